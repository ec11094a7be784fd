"""Exact top-k search by inner product over integer vectors, in order of length.

Components become floor(scale * x). Vectors lie in Parquet in descending length. A task takes
them in chunks: a chunk whose longest vector can't reach a query's k-th score (Cauchy-Schwarz) is
skipped for it; of the others, the first coordinates in the basis of the singular vectors of the
whole table give partial sums, and the product of the residual lengths bounds the rest. What may
still reach the k-th score is scored in integers. Floating point only prunes, with a margin, and
never decides. The k-th score starts at that of the longest vectors (a fixed number of them).

Queries go in blocks: each is of bounded bytes, broadcast, and scans the table once, so no pair is
ever shuffled; a task returns k rows a query at most.

Vectors that are null, or hold a null or non-finite component, take no part; all others do. Components of at most 31 bits are kept as
integers, wider ones as doubles, which hold their floor exactly; scores are summed modulo 2**64, which is exact for every score
that fits a long, and a score that doesn't, or a component beyond 1e150, is an error, never a missing row. Shorter
vectors count as padded with zeros; a vector's length is bounded by the memory of a task, which holds ``CHUNK`` of them, and of the driver, which holds
the square of it once. Rows are told apart by place, not by id: rows that repeat an id are queries of their own, with a list each, and each is a candidate for the
others. Rows without an id take no part. Ties go to the smaller id. Only the two named columns are read, so other names can't clash. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import materialize, reading, shared_dir, shuffle_partitions, table, written

CHUNK = 2048
#: Queries that a chunk is compared with at once, so that their bounds take 64 MB at most.
ABREAST = 4096


def quantized(df: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> tuple[DataFrame, int]:
    """(id, q, length) of the rows that take part, and the dimension. q holds integers, or scaled doubles whose floor counts."""
    v = F.col(vec_col).cast("array<double>")
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(fits & F.col("id").isNotNull())
    dim, most = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if (most or 0.0) >= 1e150:
        raise ValueError(f"a component of {most} is too large for scores in 64 bits")
    if (most or 0.0) * scale < (1 << 31) - 1:
        rows = rows.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("q"))
    else:
        rows = rows.select("id", F.transform("v", lambda x: x * float(scale)).alias("q"))
    length = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return rows.withColumn("length", length), max(1, dim or 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The lists as rows of a matrix of int32 or of whole doubles, shorter ones padded."""
    off = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    if values.dtype == np.float64:
        values = np.floor(values)
    size = np.diff(off)
    if len(size) and (size == dim).all():
        return values[off[0] : off[-1]].reshape(-1, dim)
    out = np.zeros((len(size), dim), values.dtype)
    for i in range(len(size)):
        out[i, : size[i]] = values[off[i] : off[i + 1]]
    return out


def _wrapped(m: np.ndarray) -> np.ndarray:
    """Whole numbers modulo 2**64, as signed 64-bit integers."""
    if m.dtype != np.float64:
        return m.astype(np.int64)
    r = np.fmod(m, 2.0**64)
    return np.where(r >= 2.0**63, r - 2.0**64, np.where(r < -(2.0**63), r + 2.0**64, r)).astype(np.int64)


def _rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of the whole table, from its Gram matrix: a task's partial sums are dim rows of dim doubles, which are summed by row."""

    def partial(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column(0), dim).astype(np.float64)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "g"])

    def summed(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(g)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([g.tobytes() for g in sums.values()], pa.binary())], ["i", "g"])

    parts = rows.select("q").mapInArrow(partial, "i int, g binary").repartition(min(dim, shuffle_partitions(rows.sparkSession)), "i")
    got = parts.mapInArrow(summed, "i int, g binary").toArrow()
    gram = np.zeros((dim, dim))
    for i, g in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
        gram[i] = np.frombuffer(g)
    # scaled, so that squares of large components stay finite
    return np.linalg.eigh(gram / max(1.0, np.abs(gram).max()))[1][:, ::-1]


LEAST = np.iinfo(np.int64).min


class Block:
    """Queries of one block with what pruning needs: places, integer rows, rotated rows, lengths, first thresholds."""

    def __init__(self, places: np.ndarray, q: np.ndarray, basis: np.ndarray, seeds: tuple[np.ndarray, np.ndarray], k: int):
        self.places, self.q, self.k, wide = places, _wrapped(q), k, q.astype(np.float64)
        self.basis, self.head = basis, max(1, basis.shape[1] // 2)
        self.plain = wide
        r = wide @ basis
        self.rotated, self.length = r[:, : self.head].copy(), np.sqrt((wide**2).sum(1))
        self.rest = np.sqrt((r[:, self.head :] ** 2).sum(1))
        self.floor = np.full(len(places), LEAST)
        seed_places, seed = seeds
        if len(seed_places) > k:
            own = seed_places[None, :] == places[:, None]
            s = np.where(own, LEAST, self.q @ _wrapped(seed).T)
            self._check(np.where(own, 0, wide @ seed.astype(np.float64).T))
            self.floor = np.partition(s, -k, axis=1)[:, -k]

    @staticmethod
    def _check(about: np.ndarray) -> None:
        if about.size and np.abs(about).max() >= 2.0**63:
            raise OverflowError("a score does not fit 64 bits")

    def _scores(self, qi: np.ndarray, v: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Inner products of queries qi and vectors, pair by pair, exact."""
        if len(qi) and self.length.max() * np.sqrt((plain**2).sum(1).max()) >= 2.0**62:
            self._check(np.einsum("ij,ij->i", self.plain[qi], plain))
        return np.einsum("ij,ij->i", self.q[qi], v)

    def scan(self, batches):
        """(place of the query, id, score) arrays: the k best of each query among the batches' (places, ids, vectors)."""
        floor, none = self.floor.copy(), np.zeros(0, np.int64)
        best = (none, none, none)
        for places, ids, m in batches:
            for at in range(0, len(ids), CHUNK):
                place, i, v = places[at : at + CHUNK], ids[at : at + CHUNK], m[at : at + CHUNK]
                f = v.astype(np.float64)
                length = np.sqrt((f**2).sum(1))
                # the margin covers the rounding of sums of products up to this size
                slack = 1e-9 * self.length * length.max() + 1e-6
                live = np.flatnonzero(self.length * length.max() + slack >= floor)
                if not len(live):
                    continue
                r = f @ self.basis
                bound = self.rotated[live] @ r[:, : self.head].T
                bound += np.outer(self.rest[live], np.sqrt((r[:, self.head :] ** 2).sum(1)))
                qi, vi = np.nonzero(bound + slack[live, None] >= floor[live, None])
                qi = live[qi]
                other = self.places[qi] != place[vi]
                qi, vi = qi[other], vi[other]
                exact = _wrapped(v)
                score = np.concatenate([self._scores(qi[s : s + 65536], exact[vi[s : s + 65536]], f[vi[s : s + 65536]]) for s in range(0, len(qi), 65536)] or [none])
                keep = score >= floor[qi]
                best = tuple(np.concatenate(x) for x in zip(best, (qi[keep], i[vi[keep]], score[keep]), strict=True))
                order = np.lexsort((best[1], -best[2], best[0]))
                best = tuple(x[order] for x in best)
                first = np.searchsorted(best[0], best[0])
                rank = np.arange(len(first)) - first
                kth = rank == self.k - 1
                floor[best[0][kth]] = np.maximum(floor[best[0][kth]], best[2][kth])
                best = tuple(x[rank < self.k] for x in best)
        return self.places[best[0]], best[1], best[2]


def top_k(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, scale: int = 1024, block_bytes: int = 4 << 20, seeds: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score). is_query: a condition on the column ``id``."""
    spark = df.sparkSession
    rows, dim = quantized(df, id_col, vec_col, scale)
    ordered = rows.repartitionByRange(shuffle_partitions(spark), F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id")
    rows = materialize(ordered.select(F.monotonically_increasing_id().alias("place"), "id", "q", "length"))
    n = rows.agg(F.count_if(is_query)).first()[0]
    basis = _rotation(rows, dim)
    longest = rows.orderBy(F.desc("length"), "id", "place").limit(seeds).select("place", "q").toArrow().combine_chunks()
    seed = (longest.column(0).to_numpy(), _matrix(longest.column(1).combine_chunks() if longest.num_rows else pa.array([], pa.list_(pa.int32())), dim))
    queries = rows.where(is_query).select("place", "q")
    size = max(1, min(ABREAST, block_bytes // (8 * dim)))
    blocks = max(1, math.ceil(2 * n / size)) if n > size else 1
    of = F.pmod(F.xxhash64("place"), F.lit(blocks))
    path, schema = shared_dir(spark), "place long, vec_id long, score long"
    for b in range(blocks):
        got = queries.where(of == b).toArrow().combine_chunks()
        for s in range(0, max(1, got.num_rows), size):
            part = got.slice(s, size)
            q = _matrix(part.column(1).combine_chunks(), dim) if part.num_rows else np.zeros((0, dim), np.int32)
            shared = spark.sparkContext.broadcast(Block(part.column(0).to_numpy(), q, basis, seed, k))

            def run(batches, shared=shared):
                query, vec, score = shared.value.scan((b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), dim)) for b in batches)
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(vec), pa.array(score)], ["place", "vec_id", "score"])

            rows.select("place", "id", "q").mapInArrow(run, schema).write.mode("append").parquet(path)
            shared.destroy()
    found = written(spark.read.schema(schema).parquet(path), path)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("place").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    named = rows.where(is_query).select("place", F.col("id").alias("query_id"))
    return reading(ranked.join(named, "place").select("query_id", "rank", "vec_id", "score"), rows, found)


def op2_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


OP2_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.n, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.n <> b.n WHERE a.vec_id % 100 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
