"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's windows, one scan of each text.

Texts are normalised to words: A-Z become a-z, and a word is a run of the characters that are neither ASCII
control, space nor punctuation (bytes from 0x80 on are word characters, so this is done on UTF-8 as it lies). A window is
``size`` consecutive words of an item, or all words of an item that has fewer. The automaton holds every
distinct window as `` w1 w2 ... `` and a task runs each text's words through it once, so the work is linear in the text
whatever the number of windows. Hits are counted in words and mapped back to code points of the original text.

The windows are found and made distinct by Spark, and their bytes are summed before any of them leaves the executors: an automaton gets
``most_bytes`` of them at most, which bounds what is broadcast (with the ids of the items) and a worker's memory (about 40 bytes for each of
these). A larger benchmark is dealt by hash into several automata, each with a scan of its own, whose hits are put together by row.
With one automaton nothing is shuffled.

Null and empty texts have no words and no hits; texts of any length are scanned whole, in slices that overlap by a window.
Repeated documents give a row each, and a null id is kept. Items with the same id are one item with the windows of
all of them; items without an id mark words but are not named. Names of ids come in order of code points. Only the named
columns are read, so other names can't clash. Without documents there are no rows; without items, no hits.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize, reading, release, shared_dir, table, written

#: Of each byte, what it is in a normalised text: itself, a small letter, or a space.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLICE = 1 << 22
HITS = "array<struct<first:int,last:int,start:int,end:int>>"


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """(win, items): the distinct windows, words joined by spaces, and the ids of the items that have them."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), upper, upper.lower()), F.lit(f"({WORD})"), 1)
    rows = items.select(F.col(id_col).cast("string").alias("item"), words.alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    rows = rows.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, size), " "))).alias("win"))
    return rows.groupBy("win").agg(F.collect_set("item").alias("items"))


class Matcher:
    """The automaton of some windows, and the ids of their items."""

    def __init__(self, wins: list[str], items: list[list[str]]):
        import ahocorasick

        self.items, self.most = items, 1
        self.automaton = ahocorasick.Automaton()
        for i, win in enumerate(wins):
            self.most = max(self.most, win.count(" ") + 1)
            # a byte is a character, as in the texts
            self.automaton.add_word((b" " + win.encode() + b" ").decode("latin-1"), (i, len(win.encode()) + 2))
        if wins:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, the (first, last) words of hit stretches in order and disjoint, the windows that occur."""
        normal = text.translate(_NORMAL)
        at, total, kept, ends, found = 0, 0, [], [], set()
        while at < len(normal):
            cut = normal.find(b" ", at + SLICE)
            cut = len(normal) if cut < 0 else cut
            fresh = normal[at:cut].split()
            at, words, base = cut, kept + fresh, total - len(kept)
            total += len(fresh)
            kept = words[max(0, len(words) - self.most + 1) :]
            if not self.items or not words:
                continue
            line = b" " + b" ".join(words) + b" "
            hits = list(self.automaton.iter(line.decode("latin-1")))
            if hits:
                spaces = np.cumsum(np.frombuffer(line, np.uint8) == 32)
                found.update(i for _, (i, _) in hits)
                ends += [(base + int(spaces[e - n + 1]) - 1, base + int(spaces[e]) - 2) for e, (_, n) in hits]
        merged: list[tuple[int, int]] = []
        for first, last in sorted(set(ends)):
            if merged and first <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
            else:
                merged.append((first, last))
        return total, merged, found

    def named(self, found: set[int]) -> list[str]:
        return sorted({x for i in found for x in self.items[i]})


def placed(text: bytes, stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points [start, end) of stretches of words in the original text."""
    word = np.frombuffer(b" " + text.translate(_NORMAL) + b" ", np.uint8) != 32
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(points[starts[a]]), int(points[ends[b]])) for a, b in stretches]


@lru_cache(1)
def _matcher(shared) -> Matcher:
    return Matcher(*shared.value)


def _scanned(docs: DataFrame, shared, all_rows: bool) -> DataFrame:
    """docs (key, text) -> (key, n_words, hits, items); only rows with a hit unless all are wanted."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches):
        m = _matcher(shared)
        for b in batches:
            keys, rows = [], []
            for i, text in enumerate(b.column(1).cast(pa.binary())):
                text = text.as_py() or b""
                n, stretches, found = m.scan(text)
                if all_rows or stretches:
                    keys.append(i)
                    hits = [{"first": a, "last": z, "start": s, "end": e} for (a, z), (s, e) in zip(stretches, placed(text, stretches) if stretches else [], strict=True)]
                    rows.append((n, hits, m.named(found)))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            hit = pa.list_(pa.struct([(x, pa.int32()) for x in ("first", "last", "start", "end")]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keys, pa.int64())), pa.array(cols[0], pa.int64()), pa.array(cols[1], hit), pa.array(cols[2], pa.list_(pa.string()))], ["key", "n_words", "hits", "items"]
            )

    return docs.mapInArrow(run, f"key {kind}, n_words long, hits {HITS}, items array<string>")


def _together(hits: str):
    """Overlapping and touching stretches of several scans as one."""
    none = F.array().cast(HITS)
    last = lambda a: F.element_at(a, -1)
    longer = lambda a, x: F.struct(
        last(a)["first"].alias("first"), F.greatest(last(a)["last"], x["last"]).alias("last"), last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end")
    )
    join = lambda a, x: F.when((F.size(a) > 0) & (x["first"] <= F.try_element_at(a, F.lit(-1))["last"] + 1), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(longer(a, x)))).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(F.array_sort(hits), none, join)


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 10, most_bytes: int = 8 << 20) -> DataFrame:
    """(id, n_words, hits, items) of each document: stretches of hit words with their first and last word and code points [start, end),
    and the ids of the items with a window in it, as strings in order."""
    spark = docs.sparkSession
    wins = materialize(windows(items, item_col, item_text, size))
    ids = F.coalesce(F.aggregate(F.transform("items", F.octet_length), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    total = wins.agg(F.sum(F.octet_length("win") + ids)).first()[0] or 0
    parts = max(1, math.ceil(total / most_bytes))
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))

    def part(p: int):
        got = wins.where(F.pmod(F.xxhash64("win"), F.lit(parts)) == p).orderBy("win").toArrow()
        return spark.sparkContext.broadcast((got.column("win").to_pylist(), got.column("items").to_pylist()))

    if parts == 1:
        out = _scanned(rows, part(0), True)
        release(wins)
        return out.withColumnRenamed("key", id_col)
    rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()))
    path = shared_dir(spark)
    for p in range(parts):
        shared = part(p)
        _scanned(rows.select(F.col("__row").alias("key"), "text"), shared, p == 0).write.mode("append").parquet(path)
        shared.destroy()
    release(wins)
    found = written(spark.read.schema(f"key long, n_words long, hits {HITS}, items array<string>").parquet(path), path)
    whole = found.groupBy("key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
    whole = whole.select(F.col("key").alias("__row"), "n_words", _together("hits").alias("hits"), F.array_sort(F.array_distinct("items")).alias("items"))
    out = rows.select("__row", "key").join(whole, "__row").drop("__row").withColumnRenamed("key", id_col)
    return reading(out, rows, found)


def op11_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + (h["last"] - h["first"] + 1))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["start"], h["end"])), ",").alias("spans"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_AT = "[0-9a-zA-Z\\x80-\\x{10FFFF}]+"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w, regexp_split_to_array(coalesce(text, ''), '{_AT}') AS gaps, regexp_extract_all(coalesce(text, ''), '{_AT}') AS raw FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, array_to_string(w[i : i + 9], ' ') AS g, least(10, len(w)) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
),
grams AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))
),
hits AS (SELECT r, i, grams.n, item FROM grams JOIN win ON win.g = grams.g AND win.n = grams.n),
words AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM hits)),
ends AS (
  SELECT r, k, list_sum(list_transform(gaps[1 : k], lambda x: length(x))) + coalesce(list_sum(list_transform(raw[1 : k - 1], lambda x: length(x))), 0) AS s, length(raw[k]) AS n
  FROM words JOIN d USING (r)
),
runs AS (
  SELECT r, min(s)::BIGINT AS s, max(s + n)::BIGINT AS e, count(*) AS n
  FROM (SELECT *, k - row_number() OVER (PARTITION BY r ORDER BY k) AS run FROM ends) GROUP BY r, run
),
spans AS (SELECT r, sum(n)::BIGINT AS n_hit, string_agg(s || ':' || e, ',' ORDER BY s) AS spans FROM runs GROUP BY r),
named AS (SELECT r, count(DISTINCT item)::BIGINT AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN spans USING (r) LEFT JOIN named USING (r)
"""
