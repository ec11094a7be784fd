"""The EPUB source, table functions and SQL functions, against the functions that they stand for."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quire.functions import columns as C
from quire.functions import passages, sql, tables
from quire.functions import questions as Q
from quire.sources import epub, epub_source
from tests.test_engine import PAGE, THREE, pack, prose


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("epubs")
    (root / "more").mkdir()
    toc = [(f"c{i}.xhtml", t) for i, t in enumerate(("One", "Two", "Three"))]
    (root / "a.epub").write_bytes(pack(THREE, toc, title="A", cover=b"png"))
    (root / "more/b.epub").write_bytes(pack([("all.xhtml", "".join(PAGE.format(id=f"k{i}", title=f"P{i}", body=prose("Ada", 5)) for i in range(3)))], [(f"all.xhtml#k{i}", f"T{i}") for i in range(3)], title="B"))
    (root / "plain.epub").write_bytes(pack(THREE, [], title=""))
    (root / "empty.epub").write_bytes(pack([("a.xhtml", "")], []))
    (root / "bad.epub").write_bytes(b"junk")
    (root / "notes.txt").write_text("no book")
    return str(root)


def test_the_source_gives_the_rows_of_the_reader(spark, folder):
    want = epub.read_epubs(spark, f"file://{folder}").collect()
    got = epub_source.load(spark, f"file://{folder}", images="true").collect()
    strip = lambda r: r["path"].removeprefix("file:")
    assert sorted(map(strip, got)) == sorted(map(strip, want)) and len(got) == 5
    for g, w in zip(sorted(got, key=strip), sorted(want, key=strip), strict=True):
        g, w = g.asDict(), w.asDict()
        errors = g.pop("error"), w.pop("error")
        assert (errors[0] is None) == (errors[1] is None)
        assert {k: v for k, v in g.items() if k != "path"} == {k: v for k, v in w.items() if k != "path"}
    assert {r["title"]: r["cover_data"] for r in epub_source.load(spark, folder).where("error IS NULL").collect()}["A"] is None


def test_files_and_filters(spark, folder):
    files = epub_source.load(spark, folder, rows="files")
    assert sorted((os.path.basename(r["path"]), r["position"], r["name"]) for r in files.collect())[:3] == [("a.epub", i, f"OPS/c{i}.xhtml") for i in range(3)]
    one = files.where(F.col("path") == f"{folder}/more/b.epub")
    assert [r["name"] for r in one.collect()] == ["OPS/all.xhtml"]
    found = epub_source.found(folder)
    reader = epub_source.EpubReader({"path": folder, "partitionbytes": "1"})
    assert len(reader.partitions()) == len(found) == 5
    assert list(reader.pushFilters([epub_source.EqualTo(("path",), found[0].path), epub_source.EqualTo(("name",), "x")])) == [epub_source.EqualTo(("name",), "x")]
    assert [p.paths for p in reader.partitions()] == [[found[0].path]]
    assert len(epub_source.EpubReader({"path": folder}).partitions()) == 1
    with pytest.raises(ValueError, match="path"):
        epub_source.EpubReader({})


def test_an_empty_folder(spark, tmp_path):
    assert epub_source.load(spark, str(tmp_path)).collect() == []


def test_a_stream_sees_each_file_once(spark, tmp_path):
    epub_source.EpubSource.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.epub").write_bytes(pack(THREE, [], title="A"))
    stream = spark.readStream.format("epub").load(str(tmp_path / "in")).select("title")

    def run():
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["title"] for r in spark.read.schema("title string").parquet(str(tmp_path / "out")).collect())

    assert run() == ["A"] and run() == ["A"]
    (tmp_path / "in/b.epub").write_bytes(pack(THREE, [], title="B"))
    assert run() == ["A", "B"]


TEXTS = [None, "", "   ", "One. Two! Three? " * 400, "a" * 5000, "word " * 30 + "\n\n" + "more " * 900, "é 日本 " * 700]


def test_table_functions_are_the_splitters(spark):
    tables.register(spark)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    got = spark.sql("SELECT d.i, c.* FROM {d} d, LATERAL quire_chunks(d.text, 100, 20) c", d=docs).collect()
    want = [(i, n, *p) for i, t in enumerate(TEXTS) for n, p in enumerate((c, at + s, at + e) for part, at, _ in passages.sections(t) for c, s, e in passages.chunks(part, 100, 20))]
    assert sorted(map(tuple, got)) == sorted(want)
    got = spark.sql("SELECT d.i, s.* FROM {d} d, LATERAL quire_sections(d.text, 50) s", d=docs).collect()
    assert sorted(map(tuple, got)) == sorted((i, n, *p) for i, t in enumerate(TEXTS) for n, p in enumerate(passages.sections(t, 50)))
    long = "x " * 100
    heads = spark.createDataFrame([(f"CHAPTER I\n{long}\nCHAPTER II\n{long}",), ("short",), (None,)], "text string")
    got = spark.sql("SELECT h.* FROM {d} d, LATERAL quire_headed(d.text) h", d=heads).collect()
    assert sorted((r["ordinal"], r["title"] or "", r["content"]) for r in got) == [(0, "", "short"), (0, "CHAPTER I", long.strip()), (1, "CHAPTER II", long.strip())]


@pytest.mark.parametrize("call", ["quire_chunks(1)", "quire_chunks('x', 10, 10)", "quire_chunks('x', 0)", "quire_sections('x', 'y')"])
def test_table_functions_look_at_their_arguments(spark, call):
    tables.register(spark)
    with pytest.raises(Exception, match="quire_"):
        spark.sql(f"SELECT * FROM {call}").collect()


def test_sql_functions_say_what_the_columns_say(spark):
    sql.register(spark)
    rows = [("The Cat sat", "cat", s, e) for s in (None, -1, 0, 3, 4, 11) for e in (None, 0, 3, 7, 11, 12)] + [(None, "cat", 0, 1), ("x", None, 0, 1), ("", "", 0, 0), ("abc", "", 0, 1)]
    df = spark.createDataFrame(rows, "content string, name string, s int, e int").withColumn("n", F.col("s") * 3)
    c = [F.col(x) for x in ("content", "name", "s", "e")]
    pairs = {
        "quire_token_count(content)": C.token_count("content"),
        "quire_offsets_fit(content, name, s, e)": C.offsets_fit(*c),
        "quire_resolve_offsets(content, name, s, e)": C.resolve_offsets(*c),
        "quire_snippet(content, s, e)": C.snippet(c[0], c[2], c[3]),
        "quire_global_offset(s, e)": C.global_offset("s", "e"),
        "quire_quote_plan(n)": Q.quote_plan("n"),
        "quire_display_title(name, e)": C.display_title("name", "e"),
        "quire_content_hash(content)": C.content_hash("content"),
    }
    assert {k.split("(")[0] for k in pairs} == set(sql.FUNCTIONS)
    for call, column in pairs.items():
        assert df.where(~F.expr(call).eqNullSafe(column)).count() == 0, call
    # Catalyst sees through them: a filter on one reaches the scan's own columns
    plan = df.where("quire_token_count(content) > 2").select("s")._jdf.queryExecution().optimizedPlan().toString()
    assert "quire_token_count" not in plan
