"""Model clients over HTTP: chat in two wire formats, whole or streamed, and embeddings.

Clients hold only settings, so they travel to executors. Errors of the connection are OSError (URLError and its kind), replies
without the expected fields ValueError.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from quire.functions.questions import RECIPES
from quire.plans.settings import ChatSettings, Settings

#: Kinds of work that belong to compiling; all others belong to questions.
INDEX_KINDS = frozenset(("extract", "cluster", "summary", "micro", "book"))

_GROUNDED = "Use nothing but the text you are given. If it does not answer, say so."
_OPEN = "You may add what you know of the book, but quote only the text you are given."
PROMPTS = {
    "route": f"Name the one of these that fits the question, and nothing else: {', '.join(RECIPES)}.",
    "condense": "Rewrite the last question so that it can be understood without the conversation. Reply with the question only.",
    "read": f'{_GROUNDED} Reply in JSON: {{"answer": "...", "verbatim_quotes": ["..."]}}, with one to three exact quotes.',
    "read_open": f'{_OPEN} Reply in JSON: {{"answer": "...", "verbatim_quotes": ["..."]}}, with one to three exact quotes.',
    "synthesize": f"Answer the question from the numbered sources. {_GROUNDED}",
    "synthesize_open": f"Answer the question from the numbered sources. {_OPEN}",
    "extract": (
        'List what the text names, in JSON: {"entities": [{"name", "type": "character" or "location", "offset_start", "offset_end"}], '
        '"dates": [{"raw_text", "normalized": "yyyy-MM-dd", "offset_start", "offset_end"}], "events": [{"description", "anchor_offset"}]}, three events at most.'
    ),
    "cluster": 'Group the names that mean the same person or place, in JSON: {"entities": [{"canonical", "type", "aliases": []}]}.',
    "micro": "Sum the text up in one short sentence.",
    "summary": "Sum the text up in a paragraph.",
    "book": "Sum the book up from the summaries of its chapters.",
}


def _post(url: str, body: dict, headers: dict[str, str], timeout: float):
    data = json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json"} | headers)
    return urllib.request.urlopen(request, timeout=timeout)


class ChatClient:
    def __init__(self, settings: ChatSettings, timeout: float = 120.0):
        self.settings, self.timeout = settings, timeout

    def _request(self, system: str, user: str, max_tokens: int, stream: bool):
        s = self.settings
        body = {"model": s.model, "max_tokens": max_tokens, "messages": [{"role": "user", "content": user}]} | ({"stream": True} if stream else {})
        if s.wire == "messages":  # the system's words stand apart from the messages
            headers = {"x-api-key": s.key, "anthropic-version": "2023-06-01"} if s.key else {}
            return _post(f"{s.url.rstrip('/')}/v1/messages", body | ({"system": system} if system else {}), headers, self.timeout)
        if system:
            body["messages"].insert(0, {"role": "system", "content": system})
        return _post(f"{s.url.rstrip('/')}/chat/completions", body, {"Authorization": f"Bearer {s.key}"} if s.key else {}, self.timeout)

    def complete(self, system: str, user: str, max_tokens: int = 512) -> str:
        with self._request(system, user, max_tokens, False) as reply:
            got = json.load(reply)
        try:
            if self.settings.wire == "messages":
                return "".join(p["text"] for p in got["content"] if p.get("type", "text") == "text")
            return got["choices"][0]["message"]["content"] or ""
        except (KeyError, IndexError, TypeError) as e:
            raise ValueError(f"the model's reply has no text: {str(got)[:200]}") from e

    def stream(self, system: str, user: str, max_tokens: int = 512) -> Iterator[str]:
        """Pieces of the reply as they come; lines that can't be read are passed over."""
        with self._request(system, user, max_tokens, True) as reply:
            for raw in reply:
                line = raw.decode("utf-8", "replace").strip()
                if not line.startswith("data:"):
                    continue
                if (data := line[5:].strip()) == "[DONE]":
                    return
                try:
                    got = json.loads(data)
                    text = got["delta"].get("text") if self.settings.wire == "messages" else got["choices"][0]["delta"].get("content")
                except (ValueError, KeyError, IndexError, TypeError, AttributeError):
                    continue
                if text:
                    yield text


class EmbeddingClient:
    def __init__(self, url: str, model: str, key: str = "", timeout: float = 120.0):
        self.url, self.model, self.key, self.timeout = url, model, key, timeout

    def embed(self, texts: list[str]) -> list[list[float]]:
        """A vector for each text, in the order of the texts, whatever that of the reply."""
        if not texts:
            return []
        with _post(f"{self.url.rstrip('/')}/embeddings", {"model": self.model, "input": texts}, {"Authorization": f"Bearer {self.key}"} if self.key else {}, self.timeout) as reply:
            got = sorted(json.load(reply)["data"], key=lambda d: d["index"])
        if [d["index"] for d in got] != list(range(len(texts))):
            raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
        return [d["embedding"] for d in got]


class HttpModel:
    """The engine's model: one chat model for compiling, one for questions, and an embedding model."""

    def __init__(self, settings: Settings):
        self.index, self.query = (ChatClient(s, settings.timeout) for s in (settings.index, settings.query))
        self.embeddings = EmbeddingClient(settings.embed_url, settings.embed_model, settings.embed_key, settings.timeout)
        self.embed_name = settings.embed_model

    def _chat(self, kind: str) -> ChatClient:
        return self.index if kind in INDEX_KINDS else self.query

    @staticmethod
    def _user(text: str, question: str) -> str:
        return f"{text}\n\nQuestion: {question}" if question and question != text else text

    def complete(self, kind: str, text: str, question: str = "", max_tokens: int = 512) -> str:
        return self._chat(kind).complete(PROMPTS[kind], self._user(text, question), max_tokens)

    def stream(self, kind: str, text: str, question: str = "", max_tokens: int = 512) -> Iterator[str]:
        return self._chat(kind).stream(PROMPTS[kind], self._user(text, question), max_tokens)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.embeddings.embed(texts)


def model_of(settings: Settings):
    """The HTTP model, or None (the stand-in) where no chat model is set."""
    return HttpModel(settings) if settings.index.url or settings.query.url else None
