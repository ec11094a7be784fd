"""Language and embedding models behind one small interface, and a deterministic stand-in."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Protocol

from quire.functions import english
from quire.functions.questions import RECIPES


class ModelClient(Protocol):
    """kind names the task, so that a client can choose its prompt: route, condense, read, synthesize (read_open and
    synthesize_open where the model may use what it knows of the book), extract, cluster, summary, micro or book."""

    def complete(self, kind: str, text: str, question: str = "", max_tokens: int = 512) -> str: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class StandIn:
    """Rules in place of a model; it keeps to the shapes that replies must have."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def complete(self, kind: str, text: str, question: str = "", max_tokens: int = 512) -> str:
        out = getattr(self, f"_{kind}")(text, question)
        return out if kind in ("extract", "cluster", "read", "read_open") else out[: max_tokens * 4]

    def stream(self, kind: str, text: str, question: str = "", max_tokens: int = 512) -> Iterator[str]:
        for part in re.findall(r"\S+\s*", self.complete(kind, text, question, max_tokens)):
            yield part

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w, _ in english.terms(t):
                h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out

    def _route(self, text: str, question: str) -> str:
        q = text.lower()
        rules = [("structured_view", "relationship|network|map"), ("chapter_summary", "summar|what happens"), ("verbatim_quote", "quote|passage|exact"), ("locate_entity", "^where|locate|find all"), ("contextual_why", r"\bwhy\b|\bhow\b"), ("fact_lookup", "who|what|when")]
        return next((r for r, p in rules if r in RECIPES and re.search(p, q)), "generic_fallback")

    def _condense(self, text: str, question: str) -> str:
        return question

    def _sentences(self, text: str) -> list[str]:
        return [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]

    def _read(self, text: str, question: str) -> str:
        wanted = {w for w, _ in english.terms(question)}
        best = sorted(enumerate(self._sentences(text)), key=lambda x: (-len(wanted & {w for w, _ in english.terms(x[1])}), x[0]))[:2]
        return json.dumps({"answer": best[0][1] if best else "", "verbatim_quotes": [s for _, s in sorted(best)]})

    def _synthesize(self, text: str, question: str) -> str:
        return " ".join(self._sentences(text)[:3])

    _read_open, _synthesize_open = _read, _synthesize

    def _summary(self, text: str, question: str) -> str:
        return " ".join(" ".join(self._sentences(text)[:5]).split()[:120])

    def _micro(self, text: str, question: str) -> str:
        return " ".join(" ".join(self._sentences(text)[:1]).split()[:25])

    _book = _summary

    def _extract(self, text: str, question: str) -> str:
        names = [{"name": m[0], "type": "location" if re.search(r"\b(?:in|at|to|from) $", text[max(0, m.start() - 6) : m.start()]) else "character", "offset_start": m.start(), "offset_end": m.end()} for m in re.finditer(r"(?<=[a-z,;] )[A-Z][a-z]+(?: [A-Z][a-z]+)*", text)]
        dates = [{"raw_text": m[0], "normalized": f"{m[0]}-01-01", "offset_start": m.start(), "offset_end": m.end()} for m in re.finditer(r"\b1[0-9]{3}\b|\b20[0-9]{2}\b", text)]
        events = [{"description": s, "anchor_offset": str(text.find(s))} for s in self._sentences(text)[:1]]
        return json.dumps({"entities": names, "dates": dates, "events": events})

    def _cluster(self, text: str, question: str) -> str:
        kinds = {x["name"]: x["type"] for x in json.loads(text)}
        groups: dict[str, list[str]] = {}
        for n in sorted(kinds, key=lambda n: (-len(n), n)):
            whole = next((g for g in groups if f" {n} " in f" {g} "), None)
            if whole:
                groups[whole].append(n)
            else:
                groups[n] = []
        return json.dumps({"entities": [{"canonical": g, "type": kinds[g], "aliases": a} for g, a in sorted(groups.items())]})
