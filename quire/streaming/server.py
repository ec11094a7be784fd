"""The engine over HTTP: JSON for lookups, server-sent events for answers.

GET /health, /books, /books/{id}/summary, /books/{id}/chapters, /chapters/{id}/summary, /sections/{id};
POST /books/{id}/ask with {"question", "up_to_chapter"?, "grounded"?, "history"?}. What is not there is 404, a book that is not
ready 409, a request that can't be read 422.
"""

from __future__ import annotations

import itertools
import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from quire.plans.engine import Engine, MissingBook, NotReady
from quire.streaming.answers import frames

TURNS = 6


def routes(engine: Engine) -> list:
    """(pattern, what to return) of the lookups."""
    rows = lambda df: [r.asDict() for r in df.collect()]

    def books():
        return [{k: v for k, v in b.items() if k != "created_at"} | {"created_at": str(b["created_at"])} for b in rows(engine.books())]

    return [
        (r"/health", engine.health),
        (r"/books", books),
        (r"/books/([^/]+)/summary", engine.book_summary),
        (r"/books/([^/]+)/chapters", lambda b: rows(engine.chapters(b))),
        (r"/chapters/([^/]+)/summary", lambda c: {"chapter_id": c, "summary": engine.chapter_summary(c)}),
        (r"/sections/([^/]+)", engine.section),
    ]


def request(body: bytes) -> dict:
    """The fields of a question; ValueError where they are not as they should be."""
    got = json.loads(body or b"{}")
    if not isinstance(got, dict) or not isinstance(got.get("question"), str) or not got["question"].strip():
        raise ValueError("question is missing")
    upto, turns = got.get("up_to_chapter"), got.get("history") or []
    if not (upto is None or (isinstance(upto, int) and not isinstance(upto, bool))):
        raise ValueError("up_to_chapter is no whole number")
    if not isinstance(turns, list) or not all(isinstance(t, dict) for t in turns):
        raise ValueError("history is no list of turns")
    # a turn that ended in an error says nothing
    turns = [t for t in turns if not t.get("error")][-TURNS:]
    return {"question": got["question"], "up_to_chapter": upto, "turns": turns, "grounded": bool(got.get("grounded", True))}


def server(engine: Engine, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server to be started with serve_forever()."""
    table = routes(engine)

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body) -> None:
            data = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _try(self, work) -> None:
            try:
                work()
            except MissingBook as e:
                self._send(404, {"error": f"{e} is not there"})
            except NotReady as e:
                self._send(409, {"error": f"{e} is not ready"})
            except ValueError as e:
                self._send(422, {"error": str(e)})

        def do_GET(self):  # noqa: N802
            for pattern, get in table:
                if m := re.fullmatch(pattern, self.path.split("?")[0]):
                    return self._try(lambda: self._send(200, get(*m.groups())))  # noqa: B023
            return self._send(404, {"error": "there is no such page"})

        def do_POST(self):  # noqa: N802
            m = re.fullmatch(r"/books/([^/]+)/ask", self.path)
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if not m:
                return self._send(404, {"error": "there is no such page"})
            return self._try(lambda: self._answer(m[1], **request(body)))

        def _answer(self, book_id: str, **asked) -> None:
            lines = frames(engine.ask_stream(book_id, **asked))
            first = next(lines)  # what is missing shows here, before the answer has begun
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream; charset=utf-8")
            self.send_header("Cache-Control", "no-cache")
            self.end_headers()
            for line in itertools.chain([first], lines):
                self.wfile.write(line.encode())
                self.wfile.flush()

        def log_message(self, *a):
            return

    return ThreadingHTTPServer((host, port), Handler)
