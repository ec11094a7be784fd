"""Queries that use the library from SQL text alone, and over files that are written first."""

from __future__ import annotations

import html
import io
import zipfile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import sql, tables
from quire.plans.catalog import ORACLE, query, read
from quire.sources import epub_source
from quire.sources.store import scratch_folder


@query(ORACLE["chunk_split"])
def udtf_chunks(spark, d):
    """The chunks of all texts by a table function."""
    tables.register(spark)
    return spark.sql("SELECT d.doc_id, c.ordinal, c.char_start, c.char_end, md5(CAST(c.content AS BINARY)) AS digest FROM (SELECT doc_id, regexp_replace(text, '(?U)^\\\\s+|\\\\s+$', '') AS text FROM {docs}) d, LATERAL quire_chunks(d.text) c", docs=read(spark, d, "documents"))


@query("SELECT doc_id, count(*) AS parts, sum(length(part))::BIGINT AS chars FROM (SELECT doc_id, unnest(CASE WHEN length(t) >= 100 THEN [t, t] ELSE [trim('CHAPTER I' || chr(10) || t || chr(10) || 'CHAPTER II' || chr(10) || t, ' ' || chr(9) || chr(10) || chr(13))] END) AS part FROM (SELECT doc_id, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents)) GROUP BY 1")
def udtf_headed(spark, d):
    """Chapters by headings, from SQL."""
    tables.register(spark)
    whole = "SELECT doc_id, concat('CHAPTER I\\n', t, '\\nCHAPTER II\\n', t) AS text FROM (SELECT doc_id, trim(BOTH ' \\t\\n\\r' FROM coalesce(text, '')) AS t FROM {docs})"
    return spark.sql(f"SELECT d.doc_id, count(*) AS parts, sum(length(c.content)) AS chars FROM ({whole}) d, LATERAL quire_headed(d.text) c GROUP BY d.doc_id", docs=read(spark, d, "documents"))


@query(ORACLE["token_estimate"])
def sql_tokens(spark, d):
    sql.register(spark)
    return spark.sql("SELECT doc_id, quire_token_count(text) AS tokens FROM {docs}", docs=read(spark, d, "documents"))


@query(ORACLE["offset_recovery"])
def sql_offsets(spark, d):
    sql.register(spark)
    placed = "SELECT doc_id, text, quire_resolve_offsets(text, 'the', CAST(doc_id % 7 AS INT), CAST(doc_id % 7 + 3 AS INT)) AS at FROM {docs}"
    return spark.sql(f"SELECT doc_id, at.start AS char_start, at.end AS char_end, quire_snippet(text, at.start, at.end) AS context FROM ({placed}) WHERE at IS NOT NULL", docs=read(spark, d, "documents"))


@query("SELECT o_orderkey, (CASE WHEN o_custkey % 20 > 0 THEN least(o_custkey % 20, 12) ELSE 3 END)::INT AS want, (CASE WHEN o_custkey % 20 > 0 THEN least(10, least(o_custkey % 20, 12) + 3) ELSE 3 END)::INT AS sections, sha256(o_orderpriority) AS hash, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'Chapter ' || o_orderkey END AS title FROM orders")
def sql_plans(spark, d):
    sql.register(spark)
    planned = "SELECT *, quire_quote_plan(CAST(o_custkey % 20 AS INT)) AS p FROM {orders}"
    return spark.sql(f"SELECT o_orderkey, p.want, p.sections, quire_content_hash(o_orderpriority) AS hash, quire_display_title(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END, CAST(o_orderkey AS INT)) AS title FROM ({planned})", orders=read(spark, d, "orders"))


# EPUB files: a conversation is a book, a turn a chapter of it


def packed(title: str, author: str, turns: list[str], layout: int) -> bytes:
    """An EPUB file: a file a turn with contents (0), one file with contents that name places in it (1), or a file a turn without contents (2)."""
    body = lambda t: f"<p>{html.escape(t)}</p>"
    files = [("all.xhtml", "".join(f'<div id="k{i}">{body(t)}</div>' for i, t in enumerate(turns)))] if layout == 1 else [(f"part{i}.xhtml", body(t)) for i, t in enumerate(turns)]
    places = [] if layout == 2 else [f"all.xhtml#k{i}" if layout == 1 else f"part{i}.xhtml" for i in range(len(turns))]
    points = "".join(f'<navPoint id="n{i}"><navLabel><text>Turn {i}</text></navLabel><content src="{p}"/></navPoint>' for i, p in enumerate(places))
    items = "".join(f'<item id="i{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, (n, _) in enumerate(files))
    items += '<item id="c" href="cover.png" media-type="image/png"/>' + ('<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>' if places else "")
    spine = "".join(f'<itemref idref="i{i}"/>' for i in range(len(files)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        z.writestr("OPS/p.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{html.escape(title)}</dc:title><dc:creator>{html.escape(author)}</dc:creator></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>')
        z.writestr("OPS/cover.png", title.encode())
        if places:
            z.writestr("OPS/toc.ncx", f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{points}</navMap></ncx>')
        for n, t in files:
            z.writestr(f"OPS/{n}", f"<html><body>{t}</body></html>")
    return out.getvalue()


def write_epubs(books: DataFrame, folder: str) -> None:
    """A file <book>.epub for each row (book, title, author, turns, layout), from the tasks."""

    def run(batches):
        system, at = epub_source._opened(folder)
        for b in batches:
            for book, title, author, turns, layout in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with system.open_output_stream(f"{at}/{book}.epub") as f:
                    f.write(packed(title, author, turns, layout))
            yield b.select(["book"])

    system, at = epub_source._opened(folder)
    system.create_dir(at, recursive=True)
    books.select(F.col("book").cast("string").alias("book"), "title", "author", "turns", "layout").mapInArrow(run, "book string").write.format("noop").mode("overwrite").save()


def library(spark, d) -> str:
    """The folder of the conversations' EPUB files."""
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda t: t["text"]).alias("turns"))
    folder = scratch_folder(spark)
    write_epubs(rows.select(F.col("conv_id").alias("book"), F.concat(F.lit("Talk & "), F.col("conv_id").cast("string")).alias("title"), F.lit("A. Writer").alias("author"), "turns", F.pmod("conv_id", F.lit(3)).cast("int").alias("layout")), folder)
    return folder


def _number():
    return F.regexp_extract("path", r"(\d+)\.epub$", 1).cast("long").alias("conv_id")


_BARE = lambda c: f"length(regexp_replace({c}, '\\s+', '', 'g'))"


@query(
    f"""
WITH f AS (SELECT conv_id, turn, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t, conv_id % 3 AS layout, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS i FROM conversations),
k AS (SELECT *, CASE layout WHEN 0 THEN t <> '' WHEN 1 THEN length(t) >= 100 ELSE length(t) >= 100 END AS first FROM f),
n AS (SELECT conv_id, count(*) FILTER (WHERE first) >= 2 AS held, count(*) FILTER (WHERE length(t) >= 100) >= 2 AS by_file, max(layout) AS layout FROM k GROUP BY 1),
c AS (
  SELECT conv_id, i, CASE WHEN n.layout < 2 THEN 'Turn ' || i END AS title, t, false AS synthetic FROM k JOIN n USING (conv_id) WHERE held AND first
  UNION ALL SELECT conv_id, 0, NULL, string_agg(text, '' ORDER BY i), false FROM k JOIN n USING (conv_id) WHERE NOT held AND n.layout = 1 GROUP BY conv_id HAVING string_agg(t, '') <> ''
  UNION ALL SELECT conv_id, i, NULL, t, false FROM k JOIN n USING (conv_id) WHERE NOT held AND n.layout <> 1 AND t <> ''
  UNION ALL SELECT conv_id, 0, 'Section 1', '', true FROM k JOIN n USING (conv_id) WHERE NOT held GROUP BY conv_id HAVING string_agg(t, '') = ''
)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1)::INT AS ordinal, title, {_BARE("t")}::INT AS letters, true AS is_body, synthetic AS is_synthetic FROM c
"""
)
def epub_chapters(spark, d):
    """Chapters of real files: by their contents, at anchors within one file, and by the lower rungs where there are no contents."""
    books = epub_source.load(spark, library(spark, d)).where("error IS NULL")
    rows = books.select(_number(), F.explode("chapters").alias("c"))
    return rows.select("conv_id", "c.ordinal", "c.title", F.length(F.regexp_replace("c.text", r"(?U)\s+", "")).alias("letters"), "c.is_body", "c.is_synthetic")


@query("SELECT DISTINCT conv_id, 'Talk & ' || conv_id AS title, 'A. Writer' AS author, 'image/png' AS cover_mime, md5('Talk & ' || conv_id) AS cover FROM conversations")
def epub_books(spark, d):
    """Titles, authors and covers, images asked for."""
    rows = epub_source.load(spark, library(spark, d), images="true")
    return rows.select(_number(), "title", "author", "cover_mime", F.md5("cover_data").alias("cover"))


@query(
    f"""
WITH f AS (SELECT conv_id, coalesce(text, '') AS text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS i FROM conversations)
SELECT conv_id, i AS position, 'OPS/part' || i || '.xhtml' AS name, {_BARE("text")}::INT AS letters FROM f WHERE conv_id % 3 <> 1
UNION ALL SELECT conv_id, 0, 'OPS/all.xhtml', {_BARE("string_agg(text, '' ORDER BY i)")}::INT FROM f WHERE conv_id % 3 = 1 GROUP BY 1
"""
)
def epub_files(spark, d):
    """The spine's files, in reading order."""
    rows = epub_source.load(spark, library(spark, d), rows="files")
    return rows.select(_number(), "position", "name", F.length(F.regexp_replace("text", r"(?U)\s+", "")).alias("letters"))
