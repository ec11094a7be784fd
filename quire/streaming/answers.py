"""Answer events as server-sent events."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator


def frames(events: Iterable[dict]) -> Iterator[str]:
    for e in events:
        yield f"data: {json.dumps(e, ensure_ascii=False)}\n\n"
