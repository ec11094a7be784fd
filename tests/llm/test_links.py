"""Benchmark decontamination, hard negatives and tokenizer alignment, against plain readings of what they are."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import align, decontaminate, negatives

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_hits(docs, items, size=10):
    """(id, n_words, hit words as (start, end), item ids) of each document, window by window."""
    wins = defaultdict(set)
    for item, text in items:
        w = WORD.findall(lowered(text))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            wins[tuple(w[i : i + size])].add(item)
    out = []
    for doc, text in docs:
        at = [m.span() for m in WORD.finditer(lowered(text))]
        w = WORD.findall(lowered(text))
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if who := wins.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= who
        out.append((doc, len(w), tuple(at[i] for i in sorted(hit)), tuple(sorted(str(x) for x in found if x is not None))))
    return sorted(out, key=repr)


def hits_of(docs, found):
    texts = {}
    for doc, text in docs:
        texts.setdefault(doc, []).append(text)
    out = []
    for r in found.collect():
        text = texts[r["doc_id"]].pop(0)
        at = [m.span() for m in WORD.finditer(lowered(text))]
        words = [at[k] for h in r["hits"] for k in range(h["first"], h["last"] + 1)]
        assert [(h["start"], h["end"]) for h in r["hits"]] == [(at[h["first"]][0], at[h["last"]][1]) for h in r["hits"]]
        assert all(a["last"] + 1 < b["first"] for a, b in zip(r["hits"], r["hits"][1:], strict=False))
        out.append((r["doc_id"], r["n_words"], tuple(words), tuple(r["items"])))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def benchmark_rows():
    rng = random.Random(11)
    words = ["a", "b", "C", "né", "日本", "x9", "The", "d"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-", "  ", "\x00"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 14]))) for i in range(30)] + [(3, text(12)), (None, text(10)), (40, None), (41, ""), (42, "?!"), (43, "q r s"), (44, "q r s")]
    docs = [(i, text(rng.randint(0, 40)) + (rng.choice(items)[1] or "") + text(rng.randint(0, 10))) for i in range(60)]
    return [*docs, (60, None), (61, ""), (62, "Q, R! s"), (62, "Q, R! s"), (None, "q r s t"), (63, ". q r s")], items


@pytest.mark.parametrize("most", [8 << 20, 300])
def test_windows_are_found_with_their_places(spark, benchmark_rows, most):
    docs, items = benchmark_rows
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"key": F.lit(1), "items": F.lit("x"), "hits": F.lit(2), "win": F.lit(3)})
    b = spark.createDataFrame(items, "item_id long, text string").withColumns({"w": F.lit(1), "item": F.lit(2)})
    if most == 300:
        # several automata, put together by row: rows with an id of their own
        docs = [(i, t) for i, (_, t) in enumerate(docs)]
        d = spark.createDataFrame(docs, "doc_id long, text string")
    assert hits_of(docs, decontaminate.find(d, b, most_bytes=most)) == brute_hits(docs, items)


def test_long_texts_are_scanned_in_slices(monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE", 16)
    win = "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"
    m = decontaminate.Matcher([win, "solo"], [["1"], ["2"]])
    text = ("filler " * 50 + win + " SOLO " + "x" * 100 + " " + win).encode()
    n, stretches, found = m.scan(text)
    assert (n, stretches, found) == (50 + 10 + 1 + 1 + 10, [(50, 60), (62, 71)], {0, 1})
    points = decontaminate.placed("é solo".encode(), [(1, 1)])
    assert points == [(2, 6)]


def test_no_documents_and_no_items(spark):
    none, docs = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in decontaminate.find(docs, none).collect()] == [(1, 2, [], [])]
    assert decontaminate.find(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def brute_negatives(rows, k=10):
    inside = [(i, v, (l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * x) for x in e]) for i, (v, e, l) in enumerate(rows) if None not in (v, l, e) and all(x is not None and math.isfinite(x) for x in e) for i in [v]]
    out = []
    for n, (_, a, la, qa) in enumerate(inside):
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(qa, q, strict=False)), v, m, l) for m, (_, v, l, q) in enumerate(inside) if m != n)
        for p, pid, _, _ in [s for s in scored if s[3] == la][:5]:
            fit = [s for s in scored if s[3] != la and 30 * -p <= 100 * -s[0] <= 90 * -p][:k]
            out += [(a, pid, r + 1, s[1], -p, -s[0]) for r, s in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("wide", [1.0, 1e6])
def test_negatives_are_those_of_a_full_sort(spark, monkeypatch, wide):
    monkeypatch.setattr(negatives, "CHUNK", 7)
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=4), 1) * wide], int(rng.integers(0, 3))) for i in [*range(95, 260), 100, 100, 200, 150]]
    rows += [(None, [1.0] * 4, 1), (300, None, 1), (400, [1.0] * 4, None), (500, [1.0, None], 1), (600, [1.0, float("nan")], 1), (700, [float("inf")], 1), (-100, [1.0], 1), (800, [], 2), (900, [0.0] * 4, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"id": F.lit(1), "q": F.lit(1), "place": F.lit(1), "rank": F.lit(0)})
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    for block in (16 << 20, 100):
        got = negatives.mine(df, F.col("id") % 100 == 0, label=label, block_bytes=block)
        assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)


def test_scores_beyond_a_long_are_the_nearest_and_empty_tables_give_none(spark):
    assert negatives.whole_scores(np.array([[2.0**62]]), np.array([[2.0**10], [-(2.0**10)], [1.0]])).tolist() == [[(1 << 63) - 1, -(1 << 63), 1 << 62]]
    assert negatives.limits_of(10, 30, 90) == (3, 9) and negatives.limits_of(-10, 30, 90) == (-3, -9)
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert negatives.mine(empty, F.col("id") % 100 == 0).collect() == []
    huge = spark.createDataFrame([(100, [1e300], 1), (1, [1e300], 1), (2, [1e307], 2), (3, [-1e300], 2)], "vec_id long, embedding array<double>, label int")
    assert negatives.mine(huge, F.col("id") % 100 == 0).collect() == []


def test_negatives_sql_agrees_on_repeated_ids(spark, tables):
    rows = [(i % 150, [float((i * 7) % 11) / 10, float(i % 5) / 5], i % 3) for i in range(400)]
    d = tables(embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet/*.parquet'")
    want = duckdb.sql(negatives.OP12_SQL).fetchall()
    got = negatives.op12_negatives(spark, d)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) != []


@pytest.fixture(scope="module")
def tokenizers_():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_alignment(rows, paths):
    """Whole texts, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    t, m = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    t.encode_special_tokens = True
    _, byte = align._byte_level(paths[0])
    found, df = [], Counter()
    for doc, text in rows:
        groups = []
        if text:
            a = [(i, byte[i]) for i in t.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes.fromhex(m.id_to_piece(i)[3:5]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()) for i in m.encode(text)]
            if b"".join(x for _, x in a) == (" " + text).encode() == b"".join(x for _, x in b):
                ends = [np.cumsum([len(x) for _, x in s]).tolist() for s in (a, b)]
                low = 0
                for c in sorted(set(ends[0]) & set(ends[1])):
                    groups.append([[i for (i, _), e in zip(s, at, strict=True) if low < e <= c] for s, at in zip((a, b), ends, strict=True)])
                    low = c
        pairs = [(x, y) for p, q in groups for x in p for y in q]
        df.update(set(pairs))
        found.append((doc, groups, pairs))
    best: dict = defaultdict(int)
    for (x, _), n in df.items():
        best[x] = max(best[x], n)
    out = []
    for doc, groups, pairs in found:
        shown = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if shown else ""
        out.append((doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(pairs), sum(df[p] == best[p[0]] for p in pairs), sum(df[p] for p in pairs), digest))
    return sorted(out, key=repr), df


PARTS = ["a", " ", "  ", "\n", "\t", "word", "It's", "don't", "é", "日本語", "😀", "<|endoftext|>", "<s>", "<0x41>", " ", " 　", "123", "!!", "...", "The quick", "x" * 50, " \n", "́", "\x1c", "​"]


def test_alignment_is_that_of_whole_texts(spark, tokenizers_):
    assert align.separable(*tokenizers_)
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices([*PARTS, "▁"] if i % 4 == 0 else PARTS, k=rng.randint(0, 12)))) for i in range(250)]
    rows += [(None, "hello there"), (5, None), (6, ""), (7, "same text same text"), (7, "same text same text"), (8, " "), (9, "the word " * 3000)]
    want, pairs = brute_alignment(rows, tokenizers_)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "p", "uid", "unit", "units", "docs", "a", "b", "n")})
    got, counts = align.align(df, *tokenizers_, block_bytes=2000)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert {(r["a"], r["b"]): r["n"] for r in counts.collect()} == dict(pairs)


def test_alignment_of_whole_units_and_of_nothing(spark, tokenizers_, monkeypatch):
    monkeypatch.setattr(align, "separable", lambda *a: False)
    rows = [(1, "a few words, and  more"), (2, None)]
    got, _ = align.align(spark.createDataFrame(rows, "doc_id long, text string"), *tokenizers_)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_alignment(rows, tokenizers_)[0]
    got, counts = align.align(spark.createDataFrame([], "doc_id long, text string"), *tokenizers_)
    assert got.collect() == [] and counts.collect() == []


def test_query_of_alignment_takes_the_whole_table(spark, small, tokenizers_):
    from quire.llm import registry

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = registry.queries()["op13_align"](spark, small)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_alignment(docs, tokenizers_)[0]


def test_documents_are_numbers_of_their_units():
    rng = random.Random(4)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 9))) for _ in range(200)] + [None, "", "plain words, plain words"]
    for whole in (False, True):
        lists, units = align._numbered(pa.array(texts), whole)
        units = units.to_pylist()
        assert len(set(units)) == len(units)
        assert [x and [units[i] for i in x] for x in lists.to_pylist()] == [align.cut(t, whole) if t else None for t in texts]


def test_places_keep_blocks_and_numbers(spark):
    place, rows = align.Place(3, 20), [(0, 0), ((7 << 32) | 6, (1 << 20) - 1), (((1 << 30) << 32) | 7, 5), (5 << 32, 0)]
    packed = [r[0] for r in spark.createDataFrame(rows, "p long, k int").select(place.of("p", "k")).collect()]
    assert list(zip(*(x.tolist() for x in place.parts(np.array(packed))), strict=True)) == rows


def test_alignment_moves_a_row_a_block_and_sums_in_order(spark, tokenizers_, monkeypatch):
    seen, write = [], align.materialize

    def noted(df, **options):
        plan = df._jdf.queryExecution().executedPlan().toString()
        out = write(df, **options)
        seen.append((set(df.columns), out.count(), plan))
        return out

    monkeypatch.setattr(align, "materialize", noted)
    docs = spark.createDataFrame([(i, f"some words of text {i % 7}, and 日本 ") for i in range(300)], "doc_id long, text string").coalesce(1)
    assert align.align(docs, *tokenizers_, block_bytes=2000)[0].count() == 300
    blocks, tokens, shown, found, _ = seen
    # behind the blocks no text and no unit is carried along, and a block is a row, not each document with its links
    assert all("unit" not in columns for columns, _, _ in seen)
    assert 1 < blocks[1] == found[1] < 300
    # lists by key are gathered by sorting once, which joins and sums by the same keys use
    assert all("ObjectHashAggregate" not in plan for _, _, plan in (tokens, shown))
