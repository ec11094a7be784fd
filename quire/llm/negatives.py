"""Hard-negative mining: every score of an anchor, sorted, with a binary search for where each positive's negatives begin.

Components become floor(scale * x) and scores are integer inner products. Anchors go in blocks of bounded bytes, each broadcast, and a
block scans all rows twice, in chunks of rows: the first scan keeps an anchor's best rows of its own label, its
positives; the second sorts the chunk's scores of each anchor by score (higher first) and id, finds each positive's upper limit by
binary search among the rows of other labels, and reads the next ``k`` down to the lower limit. A chunk's reading is put together with
what the task has so far, and the tasks' with one another, so the sort of an anchor is never in one place and no
pair of rows is shuffled: a task returns ``positives * k`` rows an anchor at most.

Limits are ratios of the positive's score in whole numbers: ``low * p <= 100 * n <= high * p``. Below zero no score meets both.

Rows with a null id, a null label, a null vector, or a null or non-finite component take no part. Rows are told apart by place, not by
id: rows that repeat an id are anchors of their own, and each is a candidate for the others. Ties go to the smaller id, then to the
earlier place, which the result does not show. Shorter vectors count as padded with zeros. Scores are exact: in doubles
where no sum of products can reach 2**53, else in whole numbers of any size; one that a long can't hold is returned as the nearest long.
An anchor without positives, or a positive without rows between its limits, gives no rows. Only the three named columns are
read, so other names can't clash. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import materialize, reading, release, shared_dir, table, written

CHUNK = 4096
#: Anchors that a chunk is compared with at once: scores and their order take 3 * 8 * CHUNK * ABREAST bytes, 48 MB.
ABREAST = 512
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def vectors(df: DataFrame, label, id_col: str, label_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, label, q) of the rows that take part; q holds floor(scale * x) as doubles."""
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # the floor of what a double holds is taken where it is read: a long would not hold all of them
    return rows.select("id", label.alias("label"), F.transform("v", lambda x: x * float(scale)).alias("q"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The lists' floors as rows of doubles, shorter ones padded; a product beyond the doubles counts as the largest of them."""
    top = np.finfo(np.float64).max
    values, off = np.clip(np.floor(column.values.to_numpy(zero_copy_only=False)), -top, top), column.offsets.to_numpy()
    size = np.diff(off)
    if len(size) and (size == dim).all():
        return values[off[0] : off[-1]].reshape(-1, dim)
    out = np.zeros((len(size), dim))
    for i in range(len(size)):
        out[i, : size[i]] = values[off[i] : off[i + 1]]
    return out


def whole_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: longs, exact, those beyond a long as the nearest one."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.sqrt((a**2).sum(1).max()) * np.sqrt((b**2).sum(1).max()) < 2.0**52 and np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    s = exact(a) @ exact(b).T
    return np.array([[min(max(x, LEAST), MOST) for x in r] for r in s], np.int64).reshape(len(a), len(b))


class Anchors:
    """A block of anchors (place, label, vector), and the limits of their positives once these are known."""

    def __init__(self, place: np.ndarray, label: np.ndarray, q: np.ndarray):
        self.place, self.label, self.q = place, label, q
        self.limits: list[list[tuple[int, int]]] = []

    def _chunks(self, batches, dim: int):
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                place, i, label, q = (c for c in b.slice(at, CHUNK).columns)
                place, i, label, q = place.to_numpy(), i.to_numpy(), label.to_numpy(), matrix(q, dim)
                order = np.lexsort((place, i))
                yield place[order], i[order], label[order], q[order]

    @staticmethod
    def _best(found: list[tuple], k: int) -> list[tuple]:
        """Of (group, score, id, place) arrays the k first of each group, by score, id and place."""
        g, s, i, p = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((p, i, np.bitwise_not(s), g))
        g, s, i, p = g[order], s[order], i[order], p[order]
        kept = np.arange(len(g)) - np.searchsorted(g, g) < k
        return [(g[kept], s[kept], i[kept], p[kept])]

    def positives(self, batches, dim: int, k: int):
        """(anchor, score, id, place): the k best rows of an anchor's label but itself, among the batches' rows."""
        best = [(np.zeros(0, np.int64),) * 4]
        for place, i, label, q in self._chunks(batches, dim):
            for at in range(0, len(self.place), ABREAST):
                mine = slice(at, at + ABREAST)
                score = whole_scores(self.q[mine], q)
                same = (self.label[mine, None] == label[None, :]) & (self.place[mine, None] != place[None, :])
                if score.shape[1] > k:
                    # what is behind k others of this chunk can't be among the best
                    same &= score >= np.partition(np.where(same, score, LEAST), -k, axis=1)[:, -k, None]
                a, c = np.nonzero(same)
                best = self._best([*best, (a + at, score[a, c], i[c], place[c])], k)
        return best[0]

    def negatives(self, batches, dim: int, k: int, most: int):
        """(anchor * most + positive, score, id, place): for each positive the k first rows of other labels between its limits."""
        best = [(np.zeros(0, np.int64),) * 4]
        for place, i, label, q in self._chunks(batches, dim):
            for at in range(0, len(self.place), ABREAST):
                score = whole_scores(self.q[at : at + ABREAST], q)
                found = []
                # rows come by id, so a stable sort by score alone is the order by score and id
                order = np.argsort(np.bitwise_not(score), axis=1, kind="stable")
                for a in range(len(score)):
                    limits = self.limits[at + a]
                    if not limits:
                        continue
                    other = order[a][label[order[a]] != self.label[at + a]]
                    falling = np.bitwise_not(score[a, other])
                    for n, (low, high) in enumerate(limits):
                        first = int(np.searchsorted(falling, ~high))
                        last = min(first + k, int(np.searchsorted(falling, ~low, side="right")))
                        if first < last:
                            c = other[first:last]
                            found.append((np.full(len(c), (at + a) * most + n), score[a, c], i[c], place[c]))
                if found:
                    best = self._best([*best, *found], k)
        return best[0]


def limits_of(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest whole n with low * score <= 100 * n <= high * score."""
    return max(LEAST, -(-low * score // 100)), min(MOST, high * score // 100)


def mine(df: DataFrame, is_anchor, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", label=None, k: int = 10, positives: int = 5, low: int = 30, high: int = 90, scale: int = 256, block_bytes: int = 16 << 20) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). is_anchor and label: of the columns ``id`` and ``label``."""
    spark = df.sparkSession
    rows = vectors(df, F.col("label") if label is None else label, id_col, label_col, vec_col, scale)
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("place"), "id", "label", "q"))
    dim, n = rows.agg(F.max(F.size("q")), F.count_if(is_anchor)).first()
    dim = max(1, dim or 0)
    size = max(1, block_bytes // (8 * dim))
    blocks = 1 if n <= size else math.ceil(2 * n / size)
    schema, path = "g long, score long, id long, place long", shared_dir(spark)
    near_schema = "anchor_id long, positive_id long, positive_score long, anchor long, g long"
    negative_path, positive_path = f"{path}/negatives", f"{path}/positives"

    def batch(got):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["g", "score", "id", "place"])

    done = 0
    for b in range(blocks):
        anchors = rows.where(is_anchor & (F.pmod(F.xxhash64("place"), F.lit(blocks)) == b)).orderBy("place").toArrow().combine_chunks()
        for s in range(0, anchors.num_rows, size):
            part = anchors.slice(s, size).combine_chunks()
            ids = part.column("id").to_numpy()
            q = matrix(part.column("q").combine_chunks(), dim)
            block = Anchors(part.column("place").to_numpy(), part.column("label").to_numpy(), q)
            shared = spark.sparkContext.broadcast(block)

            def near(batches, shared=shared):
                yield batch(shared.value.positives(batches, dim, positives))

            found = rows.mapInArrow(near, schema)
            found = found.withColumn("n", F.row_number().over(W.partitionBy("g").orderBy(F.desc("score"), "id", "place"))).where(F.col("n") <= positives)
            # at most ``positives`` rows an anchor of the block
            chosen = found.orderBy("g", "n").toArrow()
            shared.destroy()
            block.limits = [[] for _ in ids]
            g, score, near_id = (chosen.column(c).to_numpy() for c in ("g", "score", "id"))
            for a, p in zip(g.tolist(), score.tolist(), strict=True):
                block.limits[a].append(limits_of(p, low, high))
            number = np.arange(len(g)) - np.searchsorted(g, g)
            named = pa.table([pa.array(ids[g]), pa.array(near_id), pa.array(score), pa.array(g + done), pa.array((g + done) * positives + number)], names=near_schema.replace(" long", "").split(", "))
            spark.createDataFrame(named, near_schema).write.mode("append").parquet(positive_path)
            shared = spark.sparkContext.broadcast(block)

            def far(batches, shared=shared, base=done * positives):
                group, score, i, place = shared.value.negatives(batches, dim, k, positives)
                yield batch((group + base, score, i, place))

            rows.mapInArrow(far, schema).write.mode("append").parquet(negative_path)
            shared.destroy()
            done += len(ids)
    release(rows)
    if not done:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    found = spark.read.schema(schema).parquet(negative_path)
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(F.desc("score"), "id", "place"))).where(F.col("rank") <= k)
    near = spark.read.schema(near_schema).parquet(positive_path)
    found = found.select("g", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return reading(near.join(found, "g").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), written(near, path))


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) AS n FROM s WHERE same) WHERE n <= 5
), f AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.n ORDER BY s.score DESC, s.vec_id, s.b)::INT AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT * FROM f WHERE rank <= 10
"""
