"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Targets: sources in order of code point, null last, weigh ``weights`` in turn and share the budget
(all sizes). No target exceeds ``max_repeat`` times its source's size; the excess is shared by
weight again until none does. That fixed point is a water level: with the sources in order of cap
over weight, the level is the largest of (budget - caps before) / (weights left), so windows over
the one-row-a-source table give it without a loop.

Queue: a source's documents come in the order of a hash of the id, up to ``max_repeat`` rounds of all
of them. A document's virtual finish time is the source's words up to it, over the source's
target; half of its own words count, so that the cut falls at the nearer of its two ends. The mix
is all documents by finish time (ties by source) up to the budget. Running
sums have two levels, so that no source is one task: a source is cut by the hash into buckets of
a few rows, the buckets are summed first (map-side), and the windows run within a bucket. The cut
is found the same way: words by range of finish time, then the documents of one range in order.

Null texts have size 0; a source without words has target 0. Sizes of 0 take nothing. A null id
hashes as such. Rows that repeat an id count each, in order of size and text. A source is one row of the windows that share out the budget. Texts are only counted, so their length is that of a cell. Other columns may have any name but those
that start with ``__mix``. An empty table gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import materialize, release, shuffle_partitions, table

WORD = r"[^\x20\x09-\x0D]+"


def _sized(df: DataFrame, source_col: str, text_col: str, id_col: str, seed: int) -> DataFrame:
    return df.withColumns(
        {
            "__mix_size": F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long"),
            "__mix_key": F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t")),
            # what sets apart rows that repeat an id with other texts of the same size
            "__mix_tie": F.xxhash64(F.col(text_col).cast("string")),
            # 60 bits of a digest that any SQL engine has
            "__mix_hash": F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary")), 1, 15), 16, 10).cast("long"),
        }
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """Each source's key (that of null sorts last), rows, size and target, under names that start with ``__mix``."""
    s = sized.groupBy("__mix_key").agg(F.sum("__mix_size").alias("__mix_source_size"), F.count("*").alias("__mix_rows"))
    rank = F.row_number().over(W.orderBy("__mix_key"))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", (F.col("__mix_source_size") * max_repeat).cast("double"))
    before = W.orderBy(F.col("cap") / F.col("w"), "__mix_key").rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = (F.sum("__mix_source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / left
    s = s.withColumn("level", level)
    return s.select("__mix_key", "__mix_rows", "__mix_source_size", F.least("cap", F.max("level").over(every) * F.col("w")).alias("__mix_target"))


def _queued(sized: DataFrame, sources: DataFrame, rows_a_bucket: int) -> DataFrame:
    """Adds the source's size and target, and the words of the source up to each row's end."""
    rows = sized.join(sources, "__mix_key")  # Spark broadcasts the sources only below its own size threshold
    rows = rows.withColumn("__mix_bucket", F.floor(F.col("__mix_hash") / float(1 << 60) * F.ceil(F.col("__mix_rows") / rows_a_bucket))).drop("__mix_rows")
    sums = rows.groupBy("__mix_key", "__mix_bucket").agg(F.sum("__mix_size").alias("__mix_sum"))
    before = F.sum("__mix_sum").over(W.partitionBy("__mix_key").orderBy("__mix_bucket").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("__mix_key", "__mix_bucket", F.coalesce(before, F.lit(0)).alias("__mix_before"))
    rows = rows.join(sums, ["__mix_key", "__mix_bucket"])
    inside = W.partitionBy("__mix_key", "__mix_bucket").orderBy("__mix_hash", "__mix_size", "__mix_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("__mix_end", F.col("__mix_before") + F.sum("__mix_size").over(inside))


def _finish(round_: int | F.Column) -> F.Column:
    return ((round_ - 1) * F.col("__mix_source_size") + F.col("__mix_end") - F.col("__mix_size") / 2) / F.col("__mix_target")


def _beyond(sums: DataFrame, order: str, before: int, budget: int):
    """The first row whose running sum of n passes the budget, with that sum (upto)."""
    running = sums.withColumn("upto", F.sum("n").over(W.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)) + before)
    return running.where(F.col("upto") > budget).orderBy(order).first()


def cut(queued: DataFrame, max_repeat: int, ranges: int) -> tuple[float, str]:
    """Finish time and source of the first document beyond the budget."""
    offers = queued.where("__mix_target > 0 and __mix_size > 0").select("__mix_key", "__mix_size", F.explode(F.array(*(_finish(i + 1) for i in range(max_repeat)))).alias("f"))
    # a source with a document longer than its target may have finish times far beyond 1; they share the last range
    offers = offers.withColumn("r", F.floor(F.least("f", F.lit(2.0)) * ranges))
    budget = queued.agg(F.sum("__mix_size")).first()[0] or 0
    sums = offers.groupBy("r").agg(F.sum("__mix_size").alias("n"))
    # two levels, so that no task orders more than the square root of the ranges
    wide = max(1, math.isqrt(2 * ranges))
    sums = materialize(sums.withColumn("c", F.floor(F.col("r") / wide)))
    at = _beyond(sums.groupBy("c").agg(F.sum("n").alias("n")), "c", 0, budget)
    if at is None:
        return float("inf"), ""
    at = _beyond(sums.where(F.col("c") == at["c"]), "r", at["upto"] - at["n"], budget)
    release(sums)
    order = W.orderBy("f", "__mix_key").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = offers.where(F.col("r") == at["r"]).select("f", "__mix_key", F.sum("__mix_size").over(order).alias("upto"))
    first = inside.where(F.col("upto") > budget - (at["upto"] - at["n"])).orderBy("f", "__mix_key").first()
    return first["f"], first["__mix_key"]


def _copies(at: tuple[float, str], max_repeat: int) -> F.Column:
    taken = [((_finish(i + 1) < at[0]) | ((_finish(i + 1) == at[0]) & (F.col("__mix_key") < at[1]))).cast("int") for i in range(max_repeat)]
    return F.when((F.col("__mix_target") > 0) & (F.col("__mix_size") > 0), sum(taken[1:], taken[0])).otherwise(0)


def plan(df: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, seed: int = 9):
    """The queue of ids (materialized), the sources, and the cut."""
    slim = materialize(_sized(df.select(id_col, source_col, text_col), source_col, text_col, id_col, seed).drop(text_col))
    sources = materialize(targets(slim, weights, max_repeat).coalesce(1))
    n, parts = slim.count(), shuffle_partitions(df.sparkSession)
    rows_a_bucket = max(64, n // (64 * parts))
    queued = materialize(_queued(slim, sources, rows_a_bucket))
    release(slim)
    return queued, sources, cut(queued, max_repeat, max(256, n // 1024)), rows_a_bucket


def mix(df: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, seed: int = 9) -> DataFrame:
    """The rows of df that the mix takes, a row as often as it is taken."""
    queued, sources, at, rows_a_bucket = plan(df, source_col, text_col, id_col, weights, max_repeat, seed)
    release(queued)
    rows = _queued(_sized(df, source_col, text_col, id_col, seed), sources, rows_a_bucket)
    rows = rows.select(*(F.col(c) for c in df.columns), _copies(at, max_repeat).alias("__mix_copies")).where("__mix_copies > 0")
    return rows.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), "__mix_copies"))).select(*df.columns)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    queued, _, at, _ = plan(table(spark, sf_dir, "documents"))
    return queued.select("doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), (_copies(at, 3) * F.col("__mix_size")).cast("long").alias("taken"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, coalesce('s' || source, 't') AS k,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':9'), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT k, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM d GROUP BY k
), t AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM s
), u AS (
  SELECT k, source_size, least(cap, max(level) OVER () * w) AS target FROM t
), q AS (
  SELECT doc_id, size, k, source_size, target, sum(size) OVER (PARTITION BY k ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto, row_number() OVER () AS id FROM d JOIN u USING (k)
), f AS (
  SELECT id, k, size, ((r - 1) * source_size + upto - size / 2) / target AS f FROM q, (VALUES (1), (2), (3)) x(r) WHERE target > 0 AND size > 0
), a AS (
  SELECT id, size, sum(size) OVER (ORDER BY f, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= (SELECT sum(size) FROM d) AS taken FROM f
), n AS (
  SELECT id, sum(size)::BIGINT AS taken FROM a WHERE taken GROUP BY id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN n USING (id)
"""
