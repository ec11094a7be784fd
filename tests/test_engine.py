from __future__ import annotations

import io
import json
import zipfile

import pytest

from quire.plans.engine import Engine, MissingBook, NotReady
from quire.plans.models import StandIn
from quire.sources import epub
from quire.streaming import answers, ingest

PAGE = "<html><body><h1 id='{id}'>{title}</h1>{body}</body></html>"


def prose(who, n=40):
    return "".join(f"<p>Once in the town, {who} walked to the harbour with Marta Vane number {i}. It was a cold day in {1900 + i}.</p>" for i in range(n))


def pack(files, toc, title="Tale", author="A. Writer", cover=None):
    items = "".join(f'<item id="i{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, (n, _) in enumerate(files))
    spine = "".join(f'<itemref idref="i{i}"/>' for i in range(len(files)))
    points = "".join(f'<navPoint id="n{i}"><navLabel><text>{t}</text></navLabel><content src="{h}"/></navPoint>' for i, (h, t) in enumerate(toc))
    ncx = '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>' if toc else ""
    image = '<item id="c" href="cover.png" media-type="image/png"/>' if cover else ""
    head = f"<dc:title>{title}</dc:title>" if title else ""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        z.writestr("OPS/p.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>{head}<dc:creator>{author}</dc:creator></metadata><manifest>{items}{ncx}{image}</manifest><spine>{spine}</spine></package>')
        if toc:
            z.writestr("OPS/toc.ncx", f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{points}</navMap></ncx>')
        if cover:
            z.writestr("OPS/cover.png", cover)
        for n, body in files:
            z.writestr(f"OPS/{n}", body)
    return out.getvalue()


def book(files, toc, **kw):
    return epub.read_book("/x/some book.epub", pack(files, toc, **kw))


THREE = [(f"c{i}.xhtml", PAGE.format(id=f"a{i}", title=f"Part {i}", body=prose(w))) for i, w in enumerate(("Ada Moss", "Tom Reed", "Ada Moss"))]


def test_chapters_by_contents():
    b = book(THREE, [(f"c{i}.xhtml", t) for i, t in enumerate(("Preface", "One", "Two"))], cover=b"png")
    got = epub.chapters(b)
    assert (b.title, b.author, b.cover, b.cover_mime, len(b.source_hash)) == ("Tale", "A. Writer", b"png", "image/png", 64)
    assert [(c.title, c.is_body) for c in got] == [("Preface", False), ("One", True), ("Two", True)]
    assert book(THREE, [], title="").title == "some book"


def test_chapters_at_anchors():
    body = "".join(f"<h2 id='k{i}'>{t}</h2>{prose('Ada', 5) if i else '<p>tiny</p>'}" for i, t in enumerate(("Title", "I", "II", "III")))
    got = epub.chapters(book([("all.xhtml", f"<html>{body}</html>")], [(f"all.xhtml#k{i}", t) for i, t in enumerate(("Title", "I", "II", "III"))]))
    assert [c.title for c in got] == ["I", "II", "III"]


def test_other_rungs():
    assert len(epub.chapters(book(THREE, []))) == 3
    heads = "".join(f"<p>CHAPTER {r}</p>{prose('Ada', 3)}" for r in ("I", "II", "III"))
    assert [c.title for c in epub.chapters(book([("a.xhtml", heads)], []))] == ["CHAPTER I", "CHAPTER II", "CHAPTER III"]
    blank = "".join(f"<p>{r}</p>" + "<br/>" * 30 + prose("Ada", 3) for r in ("I", "II", "III", "IV"))
    assert [c.title for c in epub.chapters(book([("a.xhtml", blank)], []))] == ["I", "II", "III", "IV"]
    plain = epub.chapters(book([("a.xhtml", prose("Ada", 20))], []))
    assert len(plain) == 1 and plain[0].is_body and not plain[0].is_synthetic
    assert epub.chapters(book([("a.xhtml", "")], []))[0].is_synthetic
    with pytest.raises(ValueError, match="no EPUB"):
        epub.read_book("x", b"junk")


class Counting(StandIn):
    """Notes each call in a file, as calls run in other processes."""

    def __init__(self, log):
        super().__init__(16)
        self.log = str(log)

    def complete(self, kind, text, question="", max_tokens=512):
        with open(self.log, "a") as f:
            f.write(kind + "\n")
        return super().complete(kind, text, question, max_tokens)

    def calls(self, kind):
        return open(self.log).read().split().count(kind)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    (root / "in").mkdir()
    (root / "in/tale.epub").write_bytes(pack(THREE, [(f"c{i}.xhtml", t) for i, t in enumerate(("One", "Two", "Three"))], cover=b"png"))
    engine = Engine(spark, f"file://{root}/db", Counting(root / "log"))
    seen = []
    ids = engine.compile(f"file://{root}/in/tale.epub", progress=lambda *x: seen.append(x))
    return engine, ids[0], root, seen


def test_compiled_tables(made):
    engine, b, _, seen = made
    assert [s for s, state in seen if state == "done"] == ["summaries", "book_summary", "entities", "embeddings", "fts"]
    n = engine.counts(b)
    assert n["chapters"] == 3 and n["sections"] >= 3 and n["chunks"] > n["sections"]
    row = engine.books().first()
    assert (row["title"], row["status"], row["chapter_count"]) == ("Tale", "ready", 3) and row["cover_url"].startswith("data:image/png;base64,")
    assert [r["number"] for r in engine.chapters(b).collect()] == [1, 2, 3]
    assert engine.book_summary(b)["summary"]
    assert engine.store.of("embeddings", b).count() == n["chunks"]
    occ = engine.store.of("occurrences", b).collect()
    text = {r["section_id"]: r for r in engine.store.of("sections", b).collect()}
    names = {r["entity_id"]: [r["name"], *r["aliases"]] for r in engine.store.of("entities", b).collect()}
    assert occ and {r["entity_id"] for r in occ} <= set(names)
    for o in occ:
        s = text[o["section_id"]]
        held = s["content"][o["char_offset_start"] - s["char_offset_start"] : o["char_offset_end"] - s["char_offset_start"]]
        assert held in names[o["entity_id"]]
    sid = next(iter(text))
    assert engine.section(sid)["section_id"] == sid
    assert engine.chapter_summary(engine.chapters(b).first()["chapter_id"])


def test_stages_resume(made):
    engine, b, root, _ = made
    reads, sums = engine.model.calls("extract"), engine.model.calls("summary")
    assert engine.compile(f"file://{root}/in/tale.epub") == [b]
    before = {r["name"] for r in engine.store.of("entities", b).collect()}
    occ = engine.store.of("occurrences", b).count()
    engine.reindex_entities(b)
    assert (engine.model.calls("extract"), engine.model.calls("summary")) == (reads, sums)
    assert {r["name"] for r in engine.store.of("entities", b).collect()} == before and engine.store.of("occurrences", b).count() == occ
    engine.store.forget(b, "embeddings")
    engine.store.drop(b, ["embeddings"])
    engine.compile(f"file://{root}/in/tale.epub", reindex=False)
    engine.store.set_book(b, status="indexing")
    engine.compile(f"file://{root}/in/tale.epub")
    assert engine.store.of("embeddings", b).count() == engine.counts(b)["chunks"]
    assert engine.model.calls("extract") == reads


def test_answers(made):
    engine, b, _, _ = made
    for q in ("Who walked to the harbour?", "Give me 4 quotes about the harbour", "Where does Marta Vane appear?", "Summarize chapter 2", "Why did Ada walk to the town?", "Draw a relationship map of the characters", "harbour day"):
        a = engine.ask(b, q)
        assert a.text, q
        for text, c in a.quotes:
            held = engine.section(c.section_id)["content"]
            assert held[c.char_offset : c.char_offset + len(text)] == text
    quotes = engine.ask(b, "Give me 4 quotes about the harbour")
    assert len({t for t, _ in quotes.quotes}) == len(quotes.quotes) <= 4
    assert {c.chapter for c in engine.recipe("fact_lookup", b, "harbour", chapter=2).citations} == {2}
    assert {c.chapter for c in engine.recipe("generic_fallback", b, "harbour", up_to_chapter=1).citations} == {1}
    assert engine.recipe("fact_lookup", b, "zebra", up_to_chapter=0).weak
    assert "Chapter 9 holds nothing" in engine._fallback(b, "x", engine.recipe("fact_lookup", b, "zebra", chapter=9), None, 9).text
    assert engine.ask(b, "x", most_rounds=0).weak
    with pytest.raises(MissingBook):
        engine.ask("nothing", "x")


def test_streams(made):
    engine, b, _, _ = made
    events = list(engine.ask_stream(b, "Give me 2 quotes about the harbour", turns=[{"role": "user", "content": "hello"}]))
    kinds = [e["type"] for e in events]
    assert kinds[0] == "step" and "token" in kinds and kinds[-1] == "done" and "weak" not in events[-1]["result"]
    assert len(events[-1]["result"]["quotes"]) <= 2
    assert list(engine.ask_stream(b, "Who walked?", grounded=False))[-1]["type"] == "done" and engine.health() == {"status": "ok"}
    lines = list(answers.frames(events))
    assert all(line.startswith("data: ") and line.endswith("\n\n") and json.loads(line[6:]) for line in lines)

    class Down(StandIn):
        def complete(self, *a, **k):
            raise ConnectionError("down")

    broken = Engine(engine.spark, engine.store.root, Down(16))
    assert [e["type"] for e in broken.ask_stream(b, "who?")][-1] == "error"
    assert broken.condense([{"role": "user", "content": "x"}], "and then?") == "and then?"


def test_stream_ingest_export_and_delete(made, spark, tmp_path):
    engine, b, root, _ = made
    other = Engine(spark, f"file://{tmp_path}/db", StandIn(16))
    query = ingest.watch(spark, f"file://{root}/in", other, f"file://{tmp_path}/cp")
    query.awaitTermination()
    assert [r["book_id"] for r in other.books().collect()] == [b]
    other.store.export(f"file://{tmp_path}/copy")
    assert other.delete(b) == "Tale"
    assert other.books().count() == 0 and other.store.of("chunks", b).count() == 0
    other.store.import_(f"file://{tmp_path}/copy")
    assert other.counts(b) == engine.counts(b)
    other.store.set_book(b, status="pending")
    with pytest.raises(NotReady):
        other.ask(b, "x")
