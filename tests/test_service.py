"""HTTP clients against a local server, settings, the API, and changes that are cut short."""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from quire.plans.clients import ChatClient, EmbeddingClient, HttpModel, model_of
from quire.plans.engine import Engine
from quire.plans.models import StandIn
from quire.plans.settings import ChatSettings, Settings
from quire.plans.stages import StageError, book_summary
from quire.sources.store import Store
from quire.streaming.server import request, server
from tests.test_engine import THREE, pack


@pytest.fixture
def fake():
    """A model server that notes what it is asked and replies in either format."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body, {k.lower(): v for k, v in self.headers.items()}))
            out = b"".join(self.reply(body))
            self.send_response(200)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def reply(self, body):
            said = body.get("messages", [{}])[-1].get("content", "")
            if self.path.endswith("/embeddings"):
                yield json.dumps({"data": [{"index": i, "embedding": [float(i), len(t)]} for i, t in reversed(list(enumerate(body["input"])))]}).encode()
            elif body.get("stream"):
                parts = [{"delta": {"text": w}} if "messages" in self.path else {"choices": [{"delta": {"content": w}}]} for w in ("one ", "two")]
                yield b": a comment\n\ndata: {broken\n\n" + b"".join(f"data: {json.dumps(p)}\n\n".encode() for p in parts) + b"data: [DONE]\n\ndata: {}\n\n"
            elif "messages" in self.path:
                yield json.dumps({"content": [{"type": "text", "text": f"m:{said}"}]}).encode()
            else:
                yield json.dumps({"choices": [{"message": {"content": f"c:{said}"}}]} if said != "nothing" else {}).encode()

        def log_message(self, *a):
            return

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_chat_in_both_formats(fake):
    url, seen = fake
    one = ChatClient(ChatSettings(url, "m1", "k1"))
    assert one.complete("be brief", "hello", 9) == "c:hello"
    path, body, headers = seen[-1]
    assert path == "/chat/completions" and headers["authorization"] == "Bearer k1"
    assert body == {"model": "m1", "max_tokens": 9, "messages": [{"role": "system", "content": "be brief"}, {"role": "user", "content": "hello"}]}
    two = ChatClient(ChatSettings(url, "m2", "k2", "messages"))
    assert two.complete("be brief", "hello") == "m:hello"
    path, body, headers = seen[-1]
    assert path == "/v1/messages" and body["system"] == "be brief" and headers["x-api-key"] == "k2"
    assert body["messages"] == [{"role": "user", "content": "hello"}]
    assert list(one.stream("", "x")) == list(two.stream("", "x")) == ["one ", "two"]
    with pytest.raises(ValueError, match="no text"):
        one.complete("", "nothing")
    with pytest.raises(OSError):
        ChatClient(ChatSettings("http://127.0.0.1:9", "m")).complete("", "x")


def test_embeddings_in_order_and_axes(fake):
    url, seen = fake
    assert EmbeddingClient(url, "e").embed(["a", "bb"]) == [[0.0, 1.0], [1.0, 2.0]] and EmbeddingClient(url, "e").embed([]) == []
    settings = Settings(index=ChatSettings(url, "slow"), query=ChatSettings(url, "fast", wire="messages"), embed_url=url, embed_model="e")
    model = HttpModel(settings)
    assert (model.complete("summary", "t"), model.complete("read", "t", "q")) == ("c:t", "m:t\n\nQuestion: q")
    assert [b["model"] for _, b, _ in seen[-2:]] == ["slow", "fast"]
    assert "".join(model.stream("synthesize_open", "t", "q")) == "one two" and model.embed(["x"]) == [[0.0, 1.0]]
    prompts = {k: HttpModel(settings).complete(k, "t", "q") and seen[-1][1].get("system") for k in ("read", "read_open")}
    assert prompts["read"] != prompts["read_open"]


def test_settings():
    env = {"QUIRE_ROOT": "hdfs:///x", "QUIRE_INDEX_URL": "http://a", "QUIRE_INDEX_MODEL": "m", "QUIRE_READERS": "7", "QUIRE_TIMEOUT": "3.5", "OTHER": "x"}
    s = Settings.load(env)
    assert (s.root, s.readers, s.timeout, s.reader_chars) == ("hdfs:///x", 7, 3.5, 8000)
    assert s.query == s.index == ChatSettings("http://a", "m") and model_of(s) and model_of(Settings.load({})) is None
    assert Settings.load(env | {"QUIRE_QUERY_URL": "http://b", "QUIRE_QUERY_WIRE": "messages"}).query == ChatSettings("http://b", wire="messages")
    assert "secret" not in repr(Settings.load({"QUIRE_INDEX_KEY": "secret"}))
    with pytest.raises(ValueError, match="WIRE"):
        Settings.load({"QUIRE_INDEX_WIRE": "x"})


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    """Two books that are compiled together, and one that fails the gate."""
    root = tmp_path_factory.mktemp("service")
    (root / "in").mkdir()
    toc = [(f"c{i}.xhtml", t) for i, t in enumerate(("One", "Two", "Three"))]
    (root / "in/a.epub").write_bytes(pack(THREE, toc, title="A"))
    (root / "in/b.epub").write_bytes(pack(THREE[::-1], toc[::-1], title="B"))
    (root / "in/bad.epub").write_bytes(pack(THREE, [(f"c{i}.xhtml", t) for i, t in enumerate(("Preface", "Contents", "Index"))], title="Bad"))
    engine = Engine(spark, f"file://{root}/db", StandIn(16))
    with pytest.raises(ValueError, match="too few body chapters"):
        engine.compile(f"file://{root}/in")
    return engine, root


def test_books_are_compiled_together(library):
    engine, root = library
    rows = {r["title"]: r for r in engine.books().collect()}
    assert {t: r["status"] for t, r in rows.items()} == {"A": "ready", "B": "ready", "Bad": "failed"}
    for t in "AB":
        b = rows[t]["book_id"]
        assert engine.book_summary(b)["summary"] and engine.store.of("embeddings", b).count() == engine.counts(b)["chunks"] > 0
        assert engine.store.of("occurrences", b).count() > 0 and engine.ask(b, "Who walked to the harbour?").text
        assert engine.store.of("books", b).first()["embed_version"] == 1 and engine.store.of("books", b).first()["embed_dim"] == 16
    assert engine.store._names(f"{engine.store.root}/_run") == [] == engine.store._names(f"{engine.store.root}/_stage")


def test_a_failing_unit_leaves_the_others(library):
    engine, _ = library

    class Picky(StandIn):
        def complete(self, kind, text, question="", max_tokens=512):
            if text.startswith("## Three"):
                raise ConnectionError("down")
            return super().complete(kind, text, question, max_tokens)

    ready = engine.store.pin(engine.store.table("books").where("status = 'ready'").select("book_id", "title"))
    titles = {r["book_id"]: r["title"] for r in ready.collect()}
    engine.store.set_books(ready, summary=None)
    for b in titles:
        engine.store.drop(b, ["ledger"])
    picky = Engine(engine.spark, engine.store.root, Picky(16))
    errors = picky.backfill_summaries()
    assert [titles[b] for b in errors] == ["B"] and "down" in next(iter(errors.values()))
    assert {titles[b]: bool(engine.book_summary(b)["summary"]) for b in titles} == {"A": True, "B": False}
    with pytest.raises(StageError):
        book_summary(engine.store, ready, Picky(16))
    assert engine.backfill_summaries() == {} and all(engine.book_summary(b)["summary"] for b in titles)


def test_changes_that_are_cut_short_are_finished(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/db")
    rows = lambda v, *books: spark.createDataFrame([(b, f"{b}{v}") for b in books], "book_id string, entity_id string")
    events = lambda v, *books: spark.createDataFrame([(b, f"{b}{v}") for b in books], "book_id string, description string")
    both = spark.createDataFrame([("x",), ("y",)], "book_id string")
    store.replace_all({"entities": rows(1, "x", "y", "z"), "events": events(1, "x", "y")}, None)
    moved = []
    fs, _, _ = store._fs("")

    def cut(self, stage, real=Store._swap):
        """Stops after the first table."""
        plan = json.loads(spark.read.text(f"{stage}/COMMIT", wholetext=True).first()[0])
        moved.append(plan["tables"])
        names = Store._names

        def only(s, path):
            if path.endswith("/events"):
                raise OSError("lost")
            return names(s, path)

        monkeypatch.setattr(Store, "_names", only)
        try:
            real(self, stage)
        finally:
            monkeypatch.setattr(Store, "_names", names)

    with monkeypatch.context() as m:
        m.setattr(Store, "_swap", cut)
        with pytest.raises(OSError, match="lost"):
            store.replace_all({"entities": rows(2, "x", "y"), "events": events(2, "x")}, both)
    assert moved == [["entities", "events"]]
    half = {r["entity_id"] for r in store.table("entities").collect()}, {r["description"] for r in store.table("events").collect()}
    assert half == ({"x2", "y2", "z1"}, {"x1", "y1"})
    again = Store(spark, store.root)
    assert {r["entity_id"] for r in again.table("entities").collect()} == {"x2", "y2", "z1"}
    assert {r["description"] for r in again.table("events").collect()} == {"x2"}
    assert again._names(f"{store.root}/_stage") == []


def test_api(library):
    engine, _ = library
    s = server(engine, 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_port}"

    def get(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, None if body is None else json.dumps(body).encode())) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    assert get("/health") == (200, '{"status": "ok"}')
    books = {b["title"]: b for b in json.loads(get("/books")[1])}
    b = books["A"]["book_id"]
    assert books["A"]["chapter_count"] == 3 and json.loads(get(f"/books/{b}/summary")[1])["title"] == "A"
    chapters = json.loads(get(f"/books/{b}/chapters")[1])
    assert [c["number"] for c in chapters] == [1, 2, 3] and json.loads(get(f"/chapters/{chapters[0]['chapter_id']}/summary")[1])["summary"]
    sid = engine.store.of("sections", b).first()["section_id"]
    assert json.loads(get(f"/sections/{sid}")[1])["section_id"] == sid
    assert [get(p)[0] for p in ("/books/none/summary", "/books/none/chapters", "/chapters/none/summary", "/sections/none", "/x")] == [404] * 5
    status, text = get(f"/books/{b}/ask", {"question": "Who walked to the harbour?", "history": [{"role": "user", "content": "hi"}]})
    events = [json.loads(x[6:]) for x in text.strip().split("\n\n")]
    assert status == 200 and events[0]["type"] == "step" and events[-1]["type"] == "done"
    assert [get(f"/books/{i}/ask", body)[0] for i, body in ((b, {}), (b, {"question": "x", "up_to_chapter": "y"}), ("none", {"question": "x"}), (books["Bad"]["book_id"], {"question": "x"}))] == [422, 422, 404, 409]
    assert len(request(json.dumps({"question": "q", "history": [{"error": True}] + [{"role": "user"}] * 9}).encode())["turns"]) == 6
    s.shutdown()


