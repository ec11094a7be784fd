"""A cell index of vectors, kept as Parquet: every row lies in the partition of its nearest centroid, as 16-bit halves.

``build`` fits the centroids on a bounded sample (``sample_bytes`` of vectors, the rows whose ids have the smallest hashes, so rows of all
parts of the table), puts *every* row into its cell, and measures against all rows, for some of them as queries, how many cells must be probed for
``target`` recall; ``probes_for`` measures the same within a scope, as ``search_many`` and ``recall`` do where no number is given. A
search reads the cells nearest to its query, by partition filter; with fewer rows in scope than asked for it goes on to
twice as many. ``exact`` then reads every cell that could still hold a nearer row: by the triangle inequality of
angles, no row of a cell is nearer to the query than the cell's least and greatest angle to its centroid allow. Where vectors have no
clusters that may be all cells, and the result is the same.

Distances are cosine distances of the halves, to twelve places; ties go to the smaller id. Rows with a null vector, one with a null or non-finite
component, or one too large for halves are not vectors and are left out, those of another dimension too; vectors without direction are
in a cell of their own, which is read when there are fewer others than asked for, and their distance is null and comes last.

Rows are spread over tasks by (cell, hash of id), so a cell with a third of all rows is written and read by many tasks. What is broadcast are centroids
(``MOST_CELLS`` at most) and blocks of queries (``block_bytes``); a task returns k rows a query. Only the k nearest rows of a single query
reach the driver.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from quire.functions import half

MOST_CELLS = 4096
AIMLESS = -1
ROWS = 4096


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m**2).sum(1, keepdims=True)), 1e-300)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of unit rows; the arc tangent keeps small angles exact where the arc cosine does not."""
    cos = a @ b.T
    return np.arctan2(np.sqrt(np.maximum(0.0, 1 - cos**2)), cos)


def centroids(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means over unit rows; a centroid that loses all its rows takes the worst placed one."""
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    rng = np.random.default_rng(seed)
    cells = min(cells, len(sample))
    c = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        sums, count, fit = np.zeros_like(c), np.zeros(cells, np.int64), np.zeros(len(sample))
        for at in range(0, len(sample), ROWS):
            part = sample[at : at + ROWS]
            s = part @ c.T
            to = s.argmax(1)
            fit[at : at + ROWS] = s[np.arange(len(part)), to]
            np.add.at(sums, to, part)
            count += np.bincount(to, minlength=cells)
        empty = np.flatnonzero(count == 0)
        sums[empty] = sample[np.argsort(fit)[: len(empty)]]
        c = _unit(sums)
    return c


@dataclass
class VectorIndex:
    spark: SparkSession
    root: str
    id_col: str
    dim: int
    probes: int
    cells: np.ndarray
    centroid: np.ndarray
    near: np.ndarray
    far: np.ndarray
    rows: np.ndarray
    kept: list[str] = field(default_factory=list)

    # building

    @staticmethod
    def build(vectors: DataFrame, root: str, id_col: str = "chunk_id", vec_col: str = "embedding", cells: int | None = None, sample_bytes: int = 64 << 20, k: int = 10, target: float = 0.95) -> VectorIndex:
        """The index of vectors below root; all their other columns are kept, so that searches can be scoped by them."""
        spark = vectors.sparkSession
        root = root.rstrip("/")
        kept = [c for c in vectors.columns if c != vec_col]
        v = F.col(vec_col)
        fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 65520.0))
        rows = vectors.where(v.isNotNull() & fits & (F.size(v) > 0))
        # the usual dimension is that of most rows
        sizes = rows.groupBy(F.size(v).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
        dim, n = (sizes["dim"], sizes["n"]) if sizes else (0, 0)
        rows = half.pack(rows.where(F.size(v) == dim), vec_col, "packed").drop(vec_col)
        cells = min(MOST_CELLS, cells or max(1, round(math.sqrt(n))))
        most = max(1, min(sample_bytes // max(1, 4 * dim), 256 * cells))
        spread = F.xxhash64(id_col)
        # so large a part of all hashes as the sample is of all rows
        share = F.pmod(spread, F.lit(1 << 31)) < int(min(1.0, most / max(1, n)) * (1 << 31))
        sample = half.unpack_arrow(rows.where(share).select("packed").toArrow().combine_chunks().column(0).combine_chunks(), dim) if n else np.zeros((0, 1))
        sample = _unit(sample[(sample**2).sum(1) > 0])
        c = centroids(sample, cells)
        shared = spark.sparkContext.broadcast(c)

        def placed(batches):
            for b in batches:
                m = half.unpack_arrow(b.column(b.schema.get_field_index("packed")), dim)
                cell, angle = np.full(len(m), AIMLESS, np.int32), np.zeros(len(m))
                aimed = np.flatnonzero((m**2).sum(1) > 0)
                for at in range(0, len(aimed), ROWS):
                    i = aimed[at : at + ROWS]
                    if len(shared.value):
                        a = _angles(_unit(m[i]), shared.value)
                        cell[i], angle[i] = a.argmin(1), a.min(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(angle), pa.array(cell)], [*b.schema.names, "angle", "cell"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        out = rows.mapInArrow(placed, f"{fields}, angle double, cell int")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        out.repartitionByRange(parts, "cell", spread).sortWithinPartitions("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{root}/rows")
        shared.destroy()
        found = spark.read.schema(f"{fields}, angle double, cell int").parquet(f"{root}/rows").groupBy("cell").agg(F.min("angle").alias("near"), F.max("angle").alias("far"), F.count("*").alias("n")) if n else None
        stats = {r["cell"]: r for r in found.collect()} if found is not None else {}
        table = [(int(i), c[i].astype(np.float64).tolist() if i >= 0 else [], float(stats[i]["near"]), float(stats[i]["far"]), stats[i]["n"]) for i in sorted(stats)]
        spark.createDataFrame(table, "cell int, centroid array<double>, near double, far double, n long").write.mode("overwrite").parquet(f"{root}/cells")
        index = VectorIndex(spark, root, id_col, dim, 1, *VectorIndex._arrays(table, dim), kept)
        schema = rows.schema.json()
        about = "id_col string, dim int, probes int, kept array<string>, schema string"
        spark.createDataFrame([(id_col, dim, 1, kept, schema)], about).coalesce(1).write.mode("overwrite").parquet(f"{root}/about")
        index.probes = index.probes_for(None, k, target)
        spark.createDataFrame([(id_col, dim, index.probes, kept, schema)], about).coalesce(1).write.mode("overwrite").parquet(f"{root}/about")
        return index

    @staticmethod
    def _arrays(table: list, dim: int):
        aimed = [r for r in table if r[0] != AIMLESS]
        return (
            np.array([r[0] for r in aimed], np.int32),
            np.array([r[1] for r in aimed], np.float64).reshape(len(aimed), dim),
            np.array([r[2] for r in aimed]),
            np.array([r[3] for r in aimed]),
            np.array([r[4] for r in aimed], np.int64),
        )

    @staticmethod
    def open(spark: SparkSession, root: str) -> VectorIndex:
        about = spark.read.parquet(f"{root}/about").first()
        table = [tuple(r) for r in spark.read.parquet(f"{root}/cells").orderBy("cell").collect()]
        return VectorIndex(spark, root.rstrip("/"), about["id_col"], about["dim"], about["probes"], *VectorIndex._arrays(table, about["dim"]), list(about["kept"]))

    def probes_for(self, where: Column | None = None, k: int = 10, target: float = 0.95, queries: int = 256) -> int:
        """The least number of probes with the target recall in a scope: for some rows, those with the smallest hashes, the exact k nearest of
        *all* rows in scope are found, and the cells that they lie in.

        Neighbours in a scope lie further away than those among all rows, so a scope needs more cells than the index as a whole.
        """
        asked = self.table().where(F.col("cell") != AIMLESS).select(F.col(self.id_col).alias("query_id"), "packed").orderBy(F.xxhash64(self.id_col), self.id_col).limit(queries)
        asked = asked.toArrow().combine_chunks()
        if not asked.num_rows or len(self.cells) < 2:
            return max(1, len(self.cells))
        found = self._many(self.spark.createDataFrame(asked), k, where, len(self.cells), True, 8 << 20).select("query_id", "cell").toArrow()
        vectors = half.unpack_arrow(asked.column(1).combine_chunks(), self.dim)
        order = np.argsort(_angles(_unit(vectors), self.centroid), axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
        row = {q: i for i, q in enumerate(asked.column(0).to_pylist())}
        place = np.searchsorted(self.cells, found.column(1).to_numpy())
        needed = np.sort(rank[[row[q] for q in found.column(0).to_pylist()], place])
        return int(needed[max(0, math.ceil(target * len(needed)) - 1)]) + 1 if len(needed) else len(self.cells)

    # searching

    def table(self) -> DataFrame:
        about = self.spark.read.parquet(f"{self.root}/about").first()
        schema = StructType.fromJson(json.loads(about["schema"]))
        return self.spark.read.schema(StructType([*schema.fields, StructField("angle", DoubleType()), StructField("cell", IntegerType())])).parquet(f"{self.root}/rows")

    def search(self, query: list[float], k: int = 10, where: Column | None = None, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(the kept columns, distance): the k nearest rows that meet the condition, nearest first."""
        scope = self.table() if where is None else self.table().where(where)
        q = np.array(query, np.float64).astype(np.float16).astype(np.float64)
        if len(q) != self.dim or not (q**2).sum() > 0 or not np.isfinite(q).all():
            return scope.select(*self.kept, F.lit(None).cast("double").alias("distance")).orderBy(self.id_col).limit(k)
        angle = _angles(_unit(q[None, :]), self.centroid)[0]
        order = np.argsort(angle, kind="stable")
        done, found = 0, None
        want = probes or self.probes
        while done < len(order):
            part, done = order[done:want], min(want, len(order))
            got = self._nearest(scope, q, self.cells[part].tolist(), k)
            found = got if found is None else self._first(pa.concat_tables([found, got]), k)
            if found.num_rows >= k:
                break
            want *= 2
        if exact and done < len(order) and found.num_rows >= k:
            # in angles, with a margin for what rounding the distance has lost
            worst = math.acos(max(-1.0, min(1.0, 1 - found.column("distance")[k - 1].as_py()))) + 1e-5
            rest = order[done:]
            least = np.maximum(0.0, np.maximum(angle[rest] - self.far[rest], self.near[rest] - angle[rest]))
            rest = rest[least <= worst]
            if len(rest):
                found = self._first(pa.concat_tables([found, self._nearest(scope, q, self.cells[rest].tolist(), k)]), k)
        if found is None or found.num_rows < k:
            aimless = scope.where(F.col("cell") == AIMLESS).orderBy(self.id_col).limit(k - (found.num_rows if found is not None else 0)).select(*self.kept, F.lit(None).cast("double").alias("distance"))
            if found is None:
                return aimless
            return self.spark.createDataFrame(found, aimless.schema).unionByName(aimless).orderBy(F.asc_nulls_last("distance"), self.id_col)
        schema = scope.select(*self.kept, F.lit(0.0).cast("double").alias("distance")).schema
        return self.spark.createDataFrame(found, schema).orderBy("distance", self.id_col)

    def _first(self, found: pa.Table, k: int) -> pa.Table:
        return _first(found, self.id_col, k)

    def _nearest(self, scope: DataFrame, q: np.ndarray, cells: list[int], k: int) -> pa.Table:
        """The k nearest rows of some cells: k a task, then k of these."""
        dim, id_col, names = self.dim, self.id_col, [*self.kept, "distance"]
        unit = _unit(q[None, :])[0]

        def run(batches):
            best = None
            for b in batches:
                d = np.round(1 - _unit(half.unpack_arrow(b.column(b.num_columns - 1), dim)) @ unit, 12) + 0.0
                t = pa.Table.from_arrays([*b.columns[:-1], pa.array(d)], names=names)
                best = _first(t if best is None else pa.concat_tables([best, t]), id_col, k)
            if best is not None:
                yield from best.to_batches()

        rows = scope.where(F.col("cell").isin(cells)).select(*self.kept, "packed")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
        return rows.mapInArrow(run, f"{fields}, distance double").orderBy("distance", self.id_col).limit(k).toArrow()

    def search_many(self, queries: DataFrame, k: int = 10, where: Column | None = None, probes: int | None = None, query_id: str = "query_id", vec_col: str = "embedding", not_self: bool = False, block_bytes: int = 8 << 20) -> DataFrame:
        """(query_id, rank, id, distance) of many queries at once, each with its own cells (all of them where probes is 0).

        Queries go in blocks, each broadcast with its cells; a cell's rows are compared with the queries that probe it. In a scope the number of
        probes is measured first (probes_for), unless it is given. not_self leaves out the row whose id is the query's. Queries that are no
        vectors of the index's dimension, or without direction, have no rows.
        """
        packed = half.pack(queries.select(F.col(query_id).alias("query_id"), F.col(vec_col).alias("v")).where(F.size("v") == self.dim), "v", "packed").where("packed IS NOT NULL")
        if probes is None:
            probes = self.probes if where is None else self.probes_for(where, k)
        n = len(self.cells) if probes == 0 else min(len(self.cells), probes)
        return self._many(packed.select("query_id", "packed"), k, where, n, not_self, block_bytes).select("query_id", "rank", "id", "distance")

    def _many(self, asked: DataFrame, k: int, where: Column | None, n: int, not_self: bool, block_bytes: int) -> DataFrame:
        """(query_id, rank, id, distance, cell) of the k nearest rows in the n cells nearest to each query (query_id, packed)."""
        spark, dim = self.spark, self.dim
        scope = self.table() if where is None else self.table().where(where)
        kind, id_kind = asked.schema["query_id"].dataType.simpleString(), self.table().schema[self.id_col].dataType.simpleString()
        size = max(1, block_bytes // max(1, 8 * dim))
        blocks = max(1, math.ceil(2 * asked.count() / size))
        schema = f"query_id {kind}, id {id_kind}, distance double, cell int"
        out = None
        for block in range(blocks):
            got = asked.where(F.pmod(F.xxhash64("query_id", "packed"), F.lit(blocks)) == block).toArrow().combine_chunks()
            m = half.unpack_arrow(got.column(1).combine_chunks() if got.num_rows else pa.array([], pa.binary()), dim)
            aimed = np.flatnonzero((m**2).sum(1) > 0)
            if not len(aimed) or not len(self.cells):
                continue
            ids, m = got.column(0).combine_chunks().take(pa.array(aimed)), _unit(m[aimed])
            probing = np.zeros((len(aimed), len(self.cells)), bool)
            np.put_along_axis(probing, np.argsort(_angles(m, self.centroid), axis=1, kind="stable")[:, :n], True, axis=1)
            of_cell = {int(c): np.flatnonzero(probing[:, i]) for i, c in enumerate(self.cells) if probing[:, i].any()}
            shared = spark.sparkContext.broadcast((ids, m, of_cell))
            rows = scope.where(F.col("cell").isin(list(of_cell))).select(F.col(self.id_col).alias("id"), "packed", "cell")
            found = rows.mapInArrow(_compared(shared, dim, k, not_self), schema)
            out = found if out is None else out.unionByName(found)
        if out is None:
            out = spark.createDataFrame([], schema)
        ranked = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id")))
        return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "distance", "cell")

    def recall(self, queries: DataFrame, k: int = 10, where: Column | None = None, probes: int | None = None, not_self: bool = True) -> DataFrame:
        """(queries, wanted, found): over all queries, the rows of the exact answer, and those of them that the index finds."""
        exact = self.search_many(queries, k, where, 0, not_self=not_self).select("query_id", "id")
        near = self.search_many(queries, k, where, probes, not_self=not_self).select("query_id", "id", F.lit(1).alias("hit"))
        both = exact.join(near, ["query_id", "id"], "left")
        return both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("found"))


def _first(found: pa.Table, id_col: str, k: int) -> pa.Table:
    return found.take(pc.sort_indices(found, [("distance", "ascending"), (id_col, "ascending")])[:k])


def _compared(shared, dim: int, k: int, not_self: bool):
    def run(batches):
        ids, m, of_cell = shared.value
        best = None
        floor = np.full(len(ids), np.inf)
        for b in batches:
            cell = b.column(2).to_numpy()
            v = _unit(half.unpack_arrow(b.column(1), dim))
            found = []
            for c in np.unique(cell):
                mine, asking = np.flatnonzero(cell == c), of_cell[int(c)]
                for at in range(0, len(mine), ROWS):
                    i = mine[at : at + ROWS]
                    d = np.round(1 - m[asking] @ v[i].T, 12) + 0.0
                    if d.shape[1] > k + 1:
                        # what is behind k others (and perhaps itself) of one cell can't be among the k nearest
                        near = d <= np.minimum(floor[asking], np.partition(d, k, axis=1)[:, k])[:, None]
                    else:
                        near = d <= floor[asking][:, None]
                    q, r = np.nonzero(near)
                    found.append((asking[q], i[r], d[q, r]))
            q, r, d = (np.concatenate(x) for x in zip(*found, strict=True))
            t = pa.table({"q": q, "id": b.column(0).take(pa.array(r)), "distance": d, "cell": b.column(2).take(pa.array(r))})
            if not_self:
                own = pc.equal(ids.take(pa.array(q)).cast(t.column("id").type, safe=False), t.column("id"))
                t = t.filter(pc.invert(own))
            best = t if best is None else pa.concat_tables([best, t])
            best = best.take(pc.sort_indices(best, [("q", "ascending"), ("distance", "ascending"), ("id", "ascending")]))
            q = best.column("q").to_numpy()
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            last = rank == k - 1
            floor[q[last]] = best.column("distance").to_numpy()[last]
            best = best.filter(pa.array(rank < k))
        if best is not None:
            yield from pa.table({"query_id": ids.take(best.column("q").combine_chunks()), "id": best.column("id"), "distance": best.column("distance"), "cell": best.column("cell")}).to_batches()

    return run


def sections(found: DataFrame, top_k: int) -> DataFrame:
    """(section_id, distance): each section of the rows of search() by its nearest, the top_k of them."""
    best = found.groupBy("section_id").agg(F.min("distance").alias("distance"))
    return best.orderBy(F.asc_nulls_last("distance"), "section_id").limit(top_k)
