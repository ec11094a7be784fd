"""Vectors in cells and postings in blocks: whatever is skipped, the answers are those of looking at everything."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import half
from quire.operators import retrieval
from quire.operators.ranked import Ranked
from quire.operators.vector_index import AIMLESS, VectorIndex, sections


def test_halves_round_as_the_standard_says(spark):
    rng = np.random.default_rng(4)
    values = [*(rng.normal(size=300) * 10.0 ** rng.integers(-9, 5, 300)).tolist(), 0.0, 1.0, -1.0, 2049.0, 2051.0, 65504.0, 65519.9, 6e-8, 2.9e-8, 2.0**-14, 2.0**-24, -(2.0**-25)]
    rows = [(0, values), (1, []), (2, None), (3, [1.0, None]), (4, [70000.0])]
    df = spark.createDataFrame(rows, "i int, v array<double>").withColumn("packed_", F.lit(1))
    got = {r["i"]: r for r in half.unpack(half.pack(df, "v"), "packed", "h").withColumn("r", half.rounded("v")).collect()}
    want = np.array(values).astype(np.float16).astype(float).tolist()
    assert got[0]["h"] == want and got[0]["r"] == want and len(got[0]["packed"]) == 2 * len(values)
    assert got[1]["h"] == [] and got[2]["h"] is None and got[3]["h"] is None and got[4]["h"] is None
    assert got[4]["r"] == [float("inf")]


def brute(rows, query, k, where=lambda r: True):
    q = np.array(query).astype(np.float16).astype(float)
    out = []
    for r in rows:
        if not where(r):
            continue
        v = np.array(r[2]).astype(np.float16).astype(float)
        n = np.sqrt((v**2).sum())
        out.append((round(1 - v @ q / n / np.sqrt((q**2).sum()), 12) + 0.0 if n else None, r[0]))
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0.0, x[1]))[:k]


def same(got, want):
    assert [i for _, i in got] == [i for _, i in want]
    assert [d for d, _ in got] == [None if d is None else pytest.approx(d, abs=1e-9) for d, _ in want]


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(12, 8))
    rows = [(f"c{i:04d}", i % 7, [float(x) for x in np.round(middles[rng.integers(12)] + rng.normal(size=8) * 0.2, 3)]) for i in range(700)]
    rows += [(f"same{i:03d}", 1, [1.0] * 8) for i in range(350)] + [("zero", 2, [0.0] * 8), ("zero2", 2, [0.0] * 8)]
    odd = [("null", 1, None), ("nan", 1, [float("nan")] * 8), ("short", 1, [1.0]), ("gap", 1, [None] * 8), ("huge", 1, [1e6] * 8), ("empty", 1, [])]
    df = spark.createDataFrame([*rows, *odd], "chunk_id string, number int, embedding array<double>").withColumn("section_id", F.substring("chunk_id", 1, 4))
    return rows, VectorIndex.build(df, str(tmp_path_factory.mktemp("index")), cells=16, k=5)


def test_every_vector_is_indexed(clustered):
    rows, index = clustered
    found = {r["chunk_id"]: r["cell"] for r in index.table().collect()}
    assert set(found) == {r[0] for r in rows}
    assert {i for i, c in found.items() if c == AIMLESS} == {"zero", "zero2"}
    assert index.rows.sum() == len(rows) - 2


def test_recall_holds_in_a_narrow_scope(spark, tmp_path):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, i % 50, v) for i, v in enumerate(rng.normal(size=(2000, 16)).tolist())], "chunk_id long, part int, embedding array<double>")
    index = VectorIndex.build(df, str(tmp_path / "index"))
    asked = df.where("chunk_id % 20 = 3").select(F.col("chunk_id").alias("query_id"), "embedding")
    for where in (None, F.col("part") == 7):
        got = index.recall(asked, where=where).first()
        assert got["wanted"] == 1000 and got["found"] >= 900
    assert index.probes < index.probes_for(F.col("part") == 7) <= len(index.cells)


def test_exact_search_is_brute_force(spark, clustered):
    rows, index = clustered
    rng = np.random.default_rng(1)
    index = VectorIndex.open(spark, index.root)
    for n in range(4):
        q = [float(x) for x in rng.normal(size=8)]
        for scope, where in ((None, lambda r: True), (F.col("number") <= 2, lambda r: r[1] <= 2)):
            same([(r["distance"], r["chunk_id"]) for r in index.search(q, 7, scope, probes=1, exact=True).collect()], brute(rows, q, 7, where))
    same([(r["distance"], r["chunk_id"]) for r in index.search(q, 5000).collect()], brute(rows, q, 5000))
    # without direction, or of another dimension, there is no distance
    for q in ([0.0] * 8, [1.0]):
        assert {r["distance"] for r in index.search(q, 3).collect()} == {None}


def test_many_queries_at_once(spark, clustered):
    rows, index = clustered
    asked = [r for r in rows if r[0] in ("c0001", "c0300", "same007", "zero")] + [("other", 0, [1.0] * 7)]
    df = spark.createDataFrame([(r[0], r[2]) for r in asked], "query_id string, embedding array<double>")
    for block in (8 << 20, 64):
        got = index.search_many(df, 6, probes=0, not_self=True, block_bytes=block).collect()
        assert {r["query_id"] for r in got} == {r[0] for r in asked[:3]}
        for a in asked[:3]:
            mine = sorted((r for r in got if r["query_id"] == a[0]), key=lambda r: r["rank"])
            same([(r["distance"], r["id"]) for r in mine], brute([x for x in rows if x[0] not in (a[0], "zero", "zero2")], a[2], 6))
    figures = index.recall(df, 6).first()
    assert figures["queries"] == 3 and figures["wanted"] == 18 and figures["found"] >= 0.9 * figures["wanted"]


def test_sections_are_ranked_by_their_nearest_chunk(clustered):
    _, index = clustered
    got = [r["section_id"] for r in sections(index.search([1.0] * 8, 40), 3).collect()]
    assert got[0] == "same" and len(got) <= 3


def test_an_empty_index(spark, tmp_path):
    index = VectorIndex.build(spark.createDataFrame([], "chunk_id string, embedding array<double>"), str(tmp_path / "i"))
    assert index.search_many(spark.createDataFrame([("q", [1.0])], "query_id string, embedding array<double>"), 3).collect() == []


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    words = ["river", "boats", "harbour", "the", "of", "light", "lamps", "walking", "walked", "stone", "bread", "rare"]
    weights = np.array([9, 6, 5, 20, 20, 5, 4, 3, 3, 4, 4, 0.2])
    rows = [(f"s{i:04d}", bool(i % 5), i % 9, " ".join(rng.choice(words, rng.integers(0, 40), p=weights / weights.sum()))) for i in range(900)]
    rows += [("null", True, 1, None), ("stop", True, 1, "the of the"), ("long", True, 2, "river light " * 4000)] + [(f"copy{i:03d}", True, 3, "river boats and lamps") for i in range(200)]
    df = spark.createDataFrame(rows, "section_id string, is_body boolean, number int, content string")
    return df, Ranked.build(df, str(tmp_path_factory.mktemp("ranked")), bits=4)


@pytest.mark.parametrize("query", ["river", "river harbour", "boats OR rare", '"river boats"', "walk -stone", '"river boats" OR rare lamps', "nowhere", "nowhere OR light", "-river", "the", ""])
def test_skipping_blocks_changes_no_answer(texts, query):
    df, index = texts
    for k in (1, 10, 5000):
        want = [(r["section_id"], round(r["score"], 9)) for r in retrieval.text_search(df, query, k).collect()]
        assert [(r["section_id"], round(r["score"], 9)) for r in index.search(query, k, first=3).collect()] == want


def test_blocks_are_skipped_and_scopes_hold(spark, texts):
    df, index = texts
    index = Ranked(spark, index.root)
    # short texts of a rare word score highest, so most stretches can't reach them
    work = index.work("rare OR river", 3, first=2)
    assert 0 < work["read"] < work["blocks"]
    inside = df.where("number <= 2")
    every = {r["section_id"]: r["score"] for r in retrieval.text_search(df, "river", 5000).collect()}
    ids = {r["section_id"] for r in inside.collect()}
    want = sorted((-s, i) for i, s in every.items() if i in ids)[:10]
    assert [(r["section_id"], round(r["score"], 9)) for r in index.search("river", 10, scope=inside, first=2).collect()] == [(i, round(-s, 9)) for s, i in want]


def test_positions_are_read_for_phrases_only(texts):
    _, index = texts
    plans = {q: index.search(q, 3)._jdf.queryExecution().toString() for q in ("river", '"river boats"')}
    scans = {q: [x for x in p.splitlines() if "FileScan" in x and "stretch" in x] for q, p in plans.items()}
    assert not any("positions" in x for x in scans["river"])


def test_an_index_of_no_texts(spark, tmp_path):
    index = Ranked.build(spark.createDataFrame([("a", True, None)], "section_id string, is_body boolean, content string"), str(tmp_path / "r"))
    assert index.search("river").collect() == [] and index.work("") == {"blocks": 0, "read": 0}
