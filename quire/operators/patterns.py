"""Which of many patterns a text holds, and where first: one walk of a trie over a batch of texts, whatever the number of patterns.

The trie is flat: an edge is a number, node * 256 + byte, in order, and the node that it leads to is its place in that order, so a step of *all*
positions of a batch is one binary search. Positions whose first two bytes begin no pattern never enter it, and those that leave it
are done, so the work is linear in the text (times the longest pattern at worst), not in the number of patterns.

Distinct patterns are counted in bytes before any of them leaves the executors. A trie takes ``most_bytes`` of them, which bounds what is broadcast
(13 bytes for each at most); more are dealt by hash into several tries, one walk of the texts for each. Nothing is shuffled but the patterns.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

FOUND = ArrayType(StructType([StructField("pattern", StringType()), StructField("start", IntegerType())]))
_ARROW = pa.list_(pa.struct([("pattern", pa.string()), ("start", pa.int32())]))
#: Bytes of text that are walked at once.
WALK = 1 << 20


class Trie:
    def __init__(self, patterns: list[str]):
        self.patterns = sorted({p.encode() for p in patterns if p})
        sizes = np.fromiter(map(len, self.patterns), np.int64, len(self.patterns))
        flat = np.frombuffer(b"".join(self.patterns), np.uint8)
        starts = np.cumsum(sizes) - sizes
        self.longest = int(sizes.max()) if len(sizes) else 0
        node, edges, nodes = np.zeros(len(sizes), np.int64), [], 1
        live = np.arange(len(sizes))
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for depth in range(self.longest):
            live = live[sizes[live] > depth]
            step = node[live] * 256 + flat[starts[live] + depth]
            # patterns are sorted, so those that share a node are neighbours
            fresh = np.concatenate([[True], step[1:] != step[:-1]])
            edges.append(step[fresh])
            node[live] = nodes + np.cumsum(fresh) - 1
            nodes += int(fresh.sum())
            whole = sizes[live] == depth + 1
            ends.append((node[live[whole]], live[whole]))
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.ends = np.full(nodes, -1, np.int32)
        for at, which in ends:
            self.ends[at] = which
        self.begins = np.zeros(65536, bool)
        for p in self.patterns:
            if len(p) == 1:
                self.begins[p[0] * 256 : p[0] * 256 + 256] = True
            else:
                self.begins[p[0] * 256 + p[1]] = True

    def walk(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, numbers of patterns) of all occurrences in some bytes."""
        none = np.zeros(0, np.int64)
        if not len(self.edges) or not len(text):
            return none, none
        two = text.astype(np.int32) * 256
        two[:-1] += text[1:]
        at = np.flatnonzero(self.begins[two])
        node, depth = np.zeros(len(at), np.int64), 0
        found = [(none, none)]
        while len(at):
            inside = at + depth < len(text)
            at, node = at[inside], node[inside]
            step = node * 256 + text[at + depth]
            edge = np.searchsorted(self.edges, step)
            there = edge < len(self.edges)
            there[there] = self.edges[edge[there]] == step[there]
            at, node = at[there], edge[there] + 1
            end = self.ends[node]
            found.append((at[end >= 0], end[end >= 0].astype(np.int64)))
            depth += 1
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def first(self, texts: list[bytes]) -> list[list[tuple[str, int]]]:
        """Of each text the patterns that it holds, in order of their first place (code points), then of length."""
        out: list[list[tuple[str, int]]] = []
        lo = 0
        while lo < len(texts):
            hi, size = lo + 1, len(texts[lo]) + 1
            while hi < len(texts) and size + len(texts[hi]) < WALK:
                size, hi = size + len(texts[hi]) + 1, hi + 1
            # no pattern holds the byte between two texts, which is none of UTF-8
            text = np.frombuffer(b"\xff".join(texts[lo:hi]) + b"\xff", np.uint8)
            at, which = self.walk(text)
            bounds = np.flatnonzero(text == 0xFF)
            of = np.searchsorted(bounds, at)
            order = np.lexsort((at, which, of))
            at, which, of = at[order], which[order], of[order]
            once = np.concatenate([[True], (of[1:] != of[:-1]) | (which[1:] != which[:-1])]) if len(at) else np.zeros(0, bool)
            at, which, of = at[once], which[once], of[once]
            points = np.cumsum((text & 0xC0) != 0x80)
            begin = np.concatenate([[0], bounds[:-1] + 1])
            place = points[at] - points[begin[of]]
            order = np.lexsort((which, place, of))
            lists: list[list[tuple[str, int]]] = [[] for _ in range(hi - lo)]
            for t, w, p in zip(of[order].tolist(), which[order].tolist(), place[order].tolist(), strict=True):
                lists[t].append((self.patterns[w].decode(), p))
            out += lists
            lo = hi
        return out


def marked(rows: DataFrame, text: Column, patterns: DataFrame, out: str = "found", most_bytes: int = 32 << 20) -> DataFrame:
    """rows with the column ``out``: the patterns (of the one column of ``patterns``) that the text holds, each with its first place, in order of places.

    Null and empty patterns are in no text, and a null text holds none. Whether case counts is up to the caller, who can lower both.
    """
    spark = rows.sparkSession
    wanted = patterns.select(F.col(patterns.columns[0]).cast("string").alias("p")).where("p != ''").distinct()
    size = wanted.agg(F.sum(F.octet_length("p"))).first()[0] or 0
    parts = max(1, math.ceil(size / most_bytes))
    names = rows.columns
    schema = StructType([*rows.schema.fields, StructField(out, FOUND)])
    done = rows.withColumn("__found", F.array().cast(FOUND)) if parts > 1 else rows
    for part in range(parts):
        held = wanted.where(F.pmod(F.xxhash64("p"), F.lit(parts)) == part).toArrow().column(0).to_pylist()
        shared = spark.sparkContext.broadcast(Trie(held))
        done = done.withColumn("__text", text).mapInArrow(_walked(shared, names, out), schema)
        if parts > 1:
            done = done.withColumn("__found", F.col(out)).drop(out) if part < parts - 1 else done
    return done


def _walked(shared, names: list[str], out: str):
    def run(batches):
        trie = shared.value
        for b in batches:
            texts = [x.as_py() or b"" for x in b.column(b.schema.get_field_index("__text")).cast(pa.binary())]
            found = [[{"pattern": p, "start": at} for p, at in row] for row in trie.first(texts)]
            if "__found" in b.schema.names:
                before = b.column(b.schema.get_field_index("__found")).to_pylist()
                found = [sorted(x + y, key=lambda f: (f["start"], f["pattern"])) for x, y in zip(before, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(found, _ARROW)], [*names, out])

    return run


def holding(rows: DataFrame, text: Column, patterns: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """The rows whose text holds any of the patterns."""
    return marked(rows, text, patterns, "__any", most_bytes).where(F.size("__any") > 0).drop("__any")
