"""Queries over what is indexed first: vectors in cells, postings in blocks, books in buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import half
from quire.operators.ranked import Ranked
from quire.operators.vector_index import VectorIndex, sections
from quire.plans.catalog import CH, ORACLE, _text_sections, chapters, first_vector, query, read
from quire.sources.store import scratch_folder

# vectors, as halves: the spacing of halves at x is 2 ** (floor(log2(x)) - 10), and 2 ** -24 for the smallest

_HALF = "list_transform({v}, lambda x: CASE WHEN x = 0 THEN 0 ELSE round_even(x::DOUBLE / pow(2, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10) END)"
_COSINE = "1 - list_inner_product(a.h, b.h) / sqrt(list_inner_product(a.h, a.h) * list_inner_product(b.h, b.h))"


@query(f"SELECT vec_id, len(embedding)::INT AS n, list_sum(list_transform({_HALF.format(v='embedding')}, lambda x: (x * 16777216)::BIGINT))::BIGINT AS total FROM embeddings WHERE embedding IS NOT NULL")
def half_vectors(spark, d):
    """Packed to halves and unpacked again: every half is a whole number of 2 ** -24, so the sums are exact."""
    rows = half.unpack(half.pack(read(spark, d, "embeddings").select("vec_id", "embedding"), "embedding"), "packed", "h")
    total = F.aggregate("h", F.lit(0).cast("long"), lambda s, x: s + (x.cast("double") * 16777216).cast("long"))
    return rows.where("h IS NOT NULL").select("vec_id", F.size("h").alias("n"), total.alias("total"))


def _index(spark, d) -> VectorIndex:
    """The index of all vectors, each with its chapter's number and whether it is of the body."""
    ch = chapters(spark, d).select(F.col("chapter_id").alias("vec_id"), "book_id", "is_body", "number")
    rows = read(spark, d, "embeddings").select("vec_id", "embedding").join(ch, "vec_id", "left").withColumn("section_id", F.col("vec_id"))
    return VectorIndex.build(rows, scratch_folder(spark), "vec_id")


def _queries(spark, d) -> DataFrame:
    return read(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(
    f"""
WITH v AS (SELECT vec_id, {_HALF.format(v="embedding")} AS h FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COSINE}, 12) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM s)
SELECT query_id, rank, id, round(distance, 6) + 0.0 AS distance FROM r WHERE rank <= 10"""
)
def index_exact(spark, d):
    """All cells of the index: the exact answer of each query, which recall is measured against."""
    return _index(spark, d).search_many(_queries(spark, d), probes=0, not_self=True).withColumn("distance", F.round("distance", 6) + 0.0)


@query(
    f"""
WITH {CH}, v AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL), asking AS (SELECT count(*) AS queries FROM v WHERE vec_id % 100 = 0),
n AS (SELECT count(*) AS n FROM v), inside AS (SELECT count(*) AS n FROM v JOIN num ON chapter_id = vec_id WHERE is_body AND number <= 40)
SELECT 'all' AS scope, queries, queries * least(10, n - 1) AS wanted, true AS enough FROM asking, n
UNION ALL
SELECT 'number <= 40', queries, (SELECT sum(least(10, inside.n - coalesce((is_body AND number <= 40)::INT, 0)))::BIGINT FROM inside, v LEFT JOIN num ON chapter_id = vec_id WHERE vec_id % 100 = 0), true FROM asking"""
)
def index_recall(spark, d):
    """Whether the index finds nine of ten rows of the exact answers, over all rows and in a scope; recall itself is in ``recall_figures``."""
    return recall_figures(spark, d).select("scope", "queries", "wanted", (F.col("found") >= 0.9 * F.col("wanted")).alias("enough"))


def recall_figures(spark, d) -> DataFrame:
    """(scope, queries, wanted, found, probes, cells)."""
    index, asked = _index(spark, d), _queries(spark, d)
    scoped = index.recall(asked, where=F.expr("is_body AND number <= 40")).withColumn("scope", F.lit("number <= 40"))
    every = index.recall(asked).withColumn("scope", F.lit("all")).unionByName(scoped)
    return every.withColumns({"probes": F.lit(index.probes), "cells": F.lit(len(index.cells))})


_SCOPED = f"""
WITH {CH}, v AS (SELECT vec_id, is_body, number, {_HALF.format(v="embedding")} AS h FROM embeddings LEFT JOIN num ON chapter_id = vec_id),
near AS (SELECT b.vec_id AS id, round({_COSINE}, 12) AS distance FROM v a, v b WHERE a.vec_id = 0 AND b.is_body AND b.number <= 10 ORDER BY 2, 1 LIMIT 80)
SELECT id AS section_id, round(distance, 6) + 0.0 AS distance FROM near ORDER BY near.distance, 1 LIMIT 20"""


@query(_SCOPED)
def index_semantic(spark, d):
    """A search's nearest sections in a scope from the index, exact by the bounds of its cells."""
    found = _index(spark, d).search(first_vector(spark, d), 80, F.expr("is_body AND number <= 10"), exact=True)
    return sections(found, 20).select("section_id", (F.round("distance", 6) + 0.0).alias("distance"))


# full text, by blocks with maxima


@query(ORACLE["lexical_topk"])
def ranked_topk(spark, d):
    """The search of lexical_topk from blocks that are written first."""
    found = Ranked.build(_text_sections(spark, d), scratch_folder(spark)).search("things -question", 20)
    return found.select("section_id", F.round("score", 6).alias("score"))


@query(ORACLE["lexical_index"])
def ranked_phrase(spark, d):
    """A phrase, from blocks with positions."""
    return Ranked.build(_text_sections(spark, d), scratch_folder(spark)).search('"la de"', 20).select("section_id", F.round("score", 6).alias("score"))


# tables in buckets: customers as books, orders as their chapters, line items as sections


def bucketed(spark, d):
    from quire.sources.buckets import Buckets

    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    b = Buckets(spark, scratch_folder(spark), 16)
    chapter = F.col("o_orderkey").cast("string").alias("chapter_id")
    b.write("chapters", o.select(F.col("o_custkey").cast("string").alias("book_id"), chapter, F.col("o_orderstatus").alias("title")))
    owner = o.select("o_orderkey", F.col("o_custkey").cast("string").alias("book_id"))
    b.write("sections", li.join(owner, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("book_id", F.col("l_orderkey").cast("string").alias("chapter_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_quantity").alias("size")))
    return b


@query("SELECT o_custkey::VARCHAR AS book_id, o_orderkey::VARCHAR AS chapter_id, count(l_linenumber) AS sections, coalesce(sum(l_quantity), 0)::BIGINT AS size FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def bucket_join(spark, d):
    """Each chapter with its sections: one join and one aggregate, none of them with a shuffle."""
    rows = bucketed(spark, d).joined("chapters", "sections", "left")
    return rows.groupBy("book_id", "chapter_id").agg(F.count("ordinal").alias("sections"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size"))


@query("SELECT o_orderkey::VARCHAR AS chapter_id, o_orderstatus AS title FROM orders WHERE o_custkey = 7")
def bucket_scan(spark, d):
    """The chapters of a book, of the row groups that can hold it."""
    return bucketed(spark, d).of("chapters", "7").select("chapter_id", "title")
