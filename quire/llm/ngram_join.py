"""N-gram Jaccard join: MinHash bands propose, Bayesian pruning drops, exact sets decide.

A document's set is the hashes of its runs of ``n`` words (lower case, ``\\w+``); one with fewer words has
a single run of all of them. Documents with the same words are one class, and only one document of
a class, its representative, goes on: copies cost one row each, whatever their number.

Proposal: 384 MinHash values in 48 bands of 8, which miss a pair at Jaccard 0.8 with
probability 0.0002 and less above it; the connected components of "shares a band" (by stars to the smallest
member, never by pairs) are the work units. A component of m representatives is cut into blocks by number and by bytes, and a task takes
a pair of blocks, so that a large group, or one of long texts, spreads over many tasks and no pair becomes a row.

Pruning in a task: MinHash values are compared 16 at a time; after each step a pair whose
posterior probability of Jaccard >= ``threshold`` (uniform prior) is below ``tolerance`` is dropped.
What is left is verified on the sets. Tasks return links counted by representative, and a forest that
spans them, whose components are the groups.

Bands lose a pair at exactly 0.8 that shares none, with that probability, if nothing else connects the two; pruning loses
less than the tolerance for each pair. Texts are in a task's memory as the sets of their hashes, 8 bytes a word, with
those of the block they are compared in; there is no other bound on a text's length. An empty table gives an empty one. Only the two named
columns are read, under names of the operator's own, so others can't clash.

Result: a row for each document: class_id (smallest id of its group: documents joined by chains of
links), copy_id (smallest id with the same words), n_links (documents linked to it, its copies
included) and n_text_links (different texts linked to it). Documents without a word (null and empty
texts too) have neither copies nor links and are their own class. Ids are taken as unique; rows
that repeat an id and words are copies of each other; rows with a null id take part and name no class, unless all of a class
are such: its class_id and copy_id are null then.
"""

from __future__ import annotations

import re
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import give_back, materialize, reading, release, shuffle_partitions, table

BANDS, ROWS, STEP = 48, 8, 16
HASHES = BANDS * ROWS
BLOCK_BYTES = 32 << 20
_rng = np.random.Generator(np.random.PCG64(20))
_A = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_M = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"\w+")
_CACHE: dict[str, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _word_hashes(text: str | None) -> np.ndarray:
    words, get = _WORD.findall((text or "").lower()), _CACHE.get
    if len(_CACHE) > 300_000:
        _CACHE.clear()
    out = []
    for w in words:
        h = get(w)
        if h is None:
            h = _CACHE[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct hashes of the runs of n words."""
    if not len(words):
        return words
    k = min(n, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _M + words[i : len(words) - k + 1 + i]
    return np.unique(_mixed(h))


def signatures(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """MinHash values, a row for each set; none may be empty. A few sets at a time stay in the cache."""
    out = np.empty((len(sets), hashes), np.uint32)
    i = 0
    while i < len(sets):
        j, total = i, 0
        while j < len(sets) and (j == i or total + len(sets[j]) <= 1 << 15):
            total += len(sets[j])
            j += 1
        x = (np.concatenate(sets[i:j]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[i : j - 1])])
        y = np.empty_like(x)
        for k in range(hashes):
            np.multiply(x, _A[k], out=y)
            np.add(y, _B[k], out=y)
            out[i:j, k] = np.minimum.reduceat(y, starts)
        i = j
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    values = sig.reshape(len(sig), BANDS, ROWS)
    for i in range(ROWS):
        h = _mixed(h * _M + values[:, :, i])
    return h.view(np.int64)


def least_matches(threshold: float, tolerance: float, hashes: int) -> int:
    """The fewest matches of so many values that leave the posterior of Jaccard >= threshold at tolerance or more."""
    total = 0.0
    for m in range(hashes + 1):
        total += comb(hashes + 1, m) * threshold**m * (1 - threshold) ** (hashes + 1 - m)
        if total >= tolerance:
            return m
    return hashes


def linked(sets: list[np.ndarray], block: np.ndarray | None, threshold: float, tolerance: float, values: int = 64) -> np.ndarray:
    """Which pairs (i, j), i < j, reach the threshold; with blocks, only pairs across them."""
    m = len(sets)
    sig, size = signatures(sets, values), np.array(list(map(len, sets)))
    i, j = np.triu_indices(m, 1)
    if block is not None:
        across = block[i] != block[j]
        i, j = i[across], j[across]
    fits = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
    i, j = i[fits], j[fits]
    same = np.zeros(len(i), np.int32)
    for at in range(0, values, STEP):
        same += (sig[i, at : at + STEP] == sig[j, at : at + STEP]).sum(1, dtype=np.int32)
        left = same >= least_matches(threshold, tolerance, at + STEP)
        i, j, same = i[left], j[left], same[left]
    if len(i) <= 4 * m:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    else:
        both = np.zeros(len(i), np.int64)
        member = np.repeat(np.arange(m), size)
        column = np.unique(np.concatenate(sets), return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        member, column = member[order], column[order]
        wide = 1 << 14
        for lo in range(0, int(column[-1]) + 1, wide):
            a, b = np.searchsorted(column, (lo, lo + wide))
            x = np.zeros((m, wide), np.float32)
            x[member[a:b], column[a:b] - lo] = 1
            both += (x @ x.T)[i, j].astype(np.int64)
    near = both >= threshold * (size[i] + size[j] - both) - 1e-9
    return np.stack([i[near], j[near]], 1)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of (u, v), by contraction: in each round every node joins its neighbour (or itself) of least random rank, edges between what has joined remain."""
    parts, maps, rnd = shuffle_partitions(edges.sparkSession), [], 0
    edges = materialize(edges.where("u != v").select("u", "v"))
    while not edges.isEmpty():
        rnd += 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(rnd), c).alias("r"), F.col(c).alias("n"))  # noqa: B023, E731
        to = both.groupBy("u").agg(F.min(rank("v")).alias("other")).select("u", F.least("other", rank("u"))["n"].alias("to"))
        to = materialize(to)
        maps.append(to)
        a = to.select("u", F.col("to").alias("a"))
        b = to.select(F.col("u").alias("v"), F.col("to").alias("b"))
        left = edges.join(a, "u").join(b, "v").where("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        left, done = materialize(left.distinct()), edges
        release(done)
        edges = left
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = maps[0].select(F.col("u").alias("node"), F.col("to").alias("component"))
    for m in maps[1:]:
        out = out.join(m.select(F.col("u").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = materialize(out.repartition(parts))
    release(edges, *maps)
    return out


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """(id, key, bands, words): key names the sequence of words, null where there are none; words is their number."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                words = [_word_hashes(t) for t in part.column(1).to_pylist()]
                keys = [xxhash.xxh3_128_digest(w.tobytes()) if len(w) else None for w in words]
                first: dict[bytes, int] = {}
                for i, k in enumerate(keys):
                    if k:
                        first.setdefault(k, i)
                sets = [shingles(words[i], n) for i in first.values()]
                values = bands(signatures(sets)).ravel() if sets else np.zeros(0, np.int64)
                own = set(first.values())
                count = np.array([0, *(BANDS * (i in own) for i in range(len(keys)))]).cumsum().astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(count), pa.array(values)), pa.array(list(map(len, words)), pa.int64())], ["id", "key", "bands", "words"])
        _CACHE.clear()
        give_back()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, key binary, bands array<bigint>, words long")


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, text), as _profile names them, of texts with words."""

    def run(batches):
        for b in batches:
            words = [_word_hashes(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(w.tobytes()) if len(w) else None for w in words], pa.binary()), b.column(0)], ["key", "text"])
        _CACHE.clear()

    return docs.select("text").mapInArrow(run, "key binary, text string").where("key IS NOT NULL")


def _rows_of_groups(batches, key: int):
    """The rows of each run of equal first ``key`` columns, over batches."""
    held, name = [], None
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for row in zip(*cols, strict=True):
            if row[:key] != name:
                if held:
                    yield held
                held, name = [], row[:key]
            held.append(row)
    if held:
        yield held


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-9) -> DataFrame:
    """(id, class_id, copy_id, n_links, n_text_links) of each row."""
    parts = shuffle_partitions(df.sparkSession)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    profile = materialize(_profile(docs, n))
    # a copy's bands are empty where an earlier row of its batch has them
    reps = profile.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.max("bands").alias("bands"), F.max("words").alias("words"))
    reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()))
    posts = reps.select("node", F.explode("bands").alias("band"))
    leads = posts.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1")
    stars = posts.join(leads.select("band", "lead"), "band").where("node != lead").select(F.col("node").alias("u"), F.col("lead").alias("v")).distinct()
    unit = unit_ = components(stars)
    sizes = unit.join(reps.select("node", "words"), "node").groupBy("component").agg(F.count("*").alias("m"), F.sum("words").alias("total"))
    unit = unit.join(sizes, "component")
    # blocks of up to 1024 texts, and of about BLOCK_BYTES of sets
    side = F.least(F.greatest(F.col("m") / 32, F.lit(64)), F.lit(1024))
    unit = unit.withColumn("nb", F.greatest(F.ceil(F.col("m") / side), F.ceil(F.col("total") * 8 / BLOCK_BYTES)).cast("int"))
    work = unit.join(reps.select("node", "rep", "key", "copies"), "node")
    work = materialize(work.select("component", "nb", F.pmod(F.xxhash64("node"), "nb").cast("int").alias("block"), "node", "copies", "key", "rep"))
    # a merge join at every size: how much moves then grows with the input alone
    columns = ["component", "nb", "block", "node", "copies", "key", "text"]
    texts = docs.join(work.hint("merge"), docs["id"] == work["rep"]).select(*columns)
    # a class that no id names is found by its words
    nameless = _keyed(docs.where("id IS NULL")).groupBy("key").agg(F.min("text").alias("text"))
    texts = texts.unionByName(work.where("rep IS NULL").join(nameless, "key").select(*columns))

    def to_sets(batches):
        names = ["component", "nb", "block", "node", "copies", "shingles"]
        for b in batches:
            keep, sets = [], []
            for i, (key, text) in enumerate(zip(b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True)):
                words = _word_hashes(text)
                if xxhash.xxh3_128_digest(words.tobytes()) == key:  # else another row with the same id
                    keep.append(i)
                    sets.append(shingles(words, n).tobytes())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(keep, pa.int64())) for c in b.columns[:5]), pa.array(sets, pa.binary())], names)
        _CACHE.clear()
        give_back()

    sets = texts.mapInArrow(to_sets, "component long, nb int, block int, node long, copies long, shingles binary")
    pair = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least("block", j).alias("bi"), F.greatest("block", j).alias("bj")))
    tasks = sets.withColumn("pair", F.explode(pair)).select("component", "pair.bi", "pair.bj", "block", "node", "copies", "shingles")
    tasks = tasks.repartition(4 * parts, "component", "bi", "bj").sortWithinPartitions("component", "bi", "bj", "node")

    def compare(batches):
        out: list[tuple[int, int, int, int]] = []
        for rows in _rows_of_groups(batches, 3):
            rows = [r for i, r in enumerate(rows) if not i or r[4] != rows[i - 1][4]]  # an id that repeats
            block = np.array([r[3] for r in rows]) if rows[0][1] != rows[0][2] else None
            got = linked([np.frombuffer(r[6], np.uint64) for r in rows], block, threshold, tolerance)
            if len(got):
                m, a, b = len(rows), got[:, 0], got[:, 1]
                copies = np.array([r[5] for r in rows])
                texts = np.bincount(a, minlength=m) + np.bincount(b, minlength=m)
                links = np.bincount(a, copies[b], m) + np.bincount(b, copies[a], m)
                root, old = np.arange(m), None
                while old is None or (root != old).any():
                    old = root.copy()
                    low = np.minimum(root[a], root[b])
                    np.minimum.at(root, a, low)
                    np.minimum.at(root, b, low)
                    root = root[root]
                out += [(rows[i][4], rows[root[i]][4], int(texts[i]), int(links[i])) for i in np.flatnonzero(texts)]
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist([dict(zip("uvtl", x, strict=True)) for x in out])
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip("uvtl", x, strict=True)) for x in out])

    found = materialize(tasks.mapInArrow(compare, "u long, v long, t long, l long"))
    counts = found.groupBy("u").agg(F.sum("t").alias("n_text_links"), F.sum("l").alias("links")).withColumnRenamed("u", "node")
    group = components(found.select("u", "v"))
    named = group.join(reps.select("node", "rep"), "node")
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("class_id")), "component").select("node", "class_id")
    known = reps.select("node", "key", "rep", "copies").join(counts, "node", "left").join(named, "node", "left")
    known = known.select(
        "key", F.coalesce("class_id", "rep").alias("class_id"), F.col("rep").alias("copy_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"),
    )
    known = materialize(known)
    release(reps, work, found, unit_, group)
    out = profile.select("id", "key").join(known, "key", "left")
    none = F.lit(0).cast("long")
    out = out.select(
        F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copy_id", "id").alias("copy_id"),
        F.coalesce("n_links", none).alias("n_links"), F.coalesce("n_text_links", none).alias("n_text_links"),
    )
    return reading(out, profile, known)


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents
), s AS (
  SELECT doc_id, array_to_string(w, ' ') AS words,
    list_distinct(list_transform(range(0, greatest(1, len(w) - 4)), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS grams
  FROM w WHERE len(w) > 0
), g AS (
  SELECT doc_id, words, len(grams) AS n, unnest(grams) AS gram FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.words) AS wa, any_value(b.words) AS wb
  FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY 1, 2 HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9
), reach AS (
  SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON p.a = r.b
), c AS (
  SELECT a, min(b) AS low FROM reach GROUP BY 1
), l AS (
  SELECT a, count(*) AS n_links, count(DISTINCT CASE WHEN wa <> wb THEN wb END) AS n_text_links, min(CASE WHEN wa = wb THEN b END) AS same FROM p GROUP BY 1
)
SELECT d.doc_id, least(d.doc_id, coalesce(c.low, d.doc_id)) AS class_id, least(d.doc_id, coalesce(l.same, d.doc_id)) AS copy_id,
  coalesce(l.n_links, 0) AS n_links, coalesce(l.n_text_links, 0) AS n_text_links
FROM documents d LEFT JOIN c ON c.a = d.doc_id LEFT JOIN l ON l.a = d.doc_id
"""
