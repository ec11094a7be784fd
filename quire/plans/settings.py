"""Settings of a deployment, from environment variables that start with ``QUIRE_``."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class ChatSettings:
    """One chat model. wire: ``completions`` or ``messages``, the two formats that servers speak."""

    url: str = ""
    model: str = ""
    key: str = field(default="", repr=False)
    wire: str = "completions"


@dataclass(frozen=True)
class Settings:
    root: str = ""
    index: ChatSettings = ChatSettings()  # summaries and extraction
    query: ChatSettings = ChatSettings()  # questions
    embed_url: str = ""
    embed_model: str = ""
    embed_key: str = field(default="", repr=False)
    timeout: float = 120.0
    readers: int = 4
    reader_chars: int = 8000

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None) -> Settings:
        """QUIRE_ROOT, QUIRE_TIMEOUT, ..., QUIRE_INDEX_URL, QUIRE_QUERY_MODEL, ...; the query model is the index model where none is named."""
        env = os.environ if env is None else env
        get = lambda name: env.get(f"QUIRE_{name.upper()}", "").strip()
        chat = {axis: {f.name: v for f in fields(ChatSettings) if (v := get(f"{axis}_{f.name}"))} for axis in ("index", "query")}
        for axis in chat:
            if chat[axis].get("wire", "completions") not in ("completions", "messages"):
                raise ValueError(f"QUIRE_{axis.upper()}_WIRE must be completions or messages")
        kinds = {"timeout": float, "readers": int, "reader_chars": int}
        plain = {f.name: kinds.get(f.name, str)(v) for f in fields(cls) if f.name not in chat and (v := get(f.name))}
        return cls(**plain, index=ChatSettings(**chat["index"]), query=ChatSettings(**(chat["query"] or chat["index"])))
