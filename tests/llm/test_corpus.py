"""Language, fingerprints, mixing, near duplicates and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import langid, mixing, ngram_join, spotsigs
from tests.llm.conftest import DOCS

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


# language


def test_held_out_accuracy_and_contract(spark, small):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = langid.op7_langid(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) >= 0.95


def code_length(samples, text, order):
    """Bits of a text by the definition: each language's counts of bytes behind contexts, escapes by method C with exclusion."""
    counts = {}
    for lang, texts in samples.items():
        joined = b"".join(b"\n" * order + t for t in texts)
        for i in range(order, len(joined)):
            for k in range(order + 1):
                counts.setdefault(joined[i - k : i], {}).setdefault(lang, Counter())[joined[i]] += 1
    kept = {c for c, of in counts.items() if not c or sum(n.total() for n in of.values()) >= 3}

    def chance(lang, ctx, byte):
        if ctx is None:
            return 1 / 256
        seen, shorter = counts.get(ctx, {}).get(lang, {}), ctx[1:] if ctx else None
        if not seen:
            return chance(lang, shorter, byte)
        n, d = sum(seen.values()), len(seen)
        if byte in seen:
            return seen[byte] / (n + d) if d < 256 else seen[byte] / n
        return d / (n + d) * chance(lang, shorter, byte) / (1 - sum(chance(lang, shorter, b) for b in seen))

    out = []
    for lang in sorted(samples):
        padded, total = b"\n" * order + text, 0.0
        for i in range(order, len(padded)):
            ctx = next(padded[i - k : i] for k in range(order, -1, -1) if all(padded[i - j : i] in kept for j in range(k + 1)))
            total -= np.log2(chance(lang, ctx, padded[i]))
        out.append(total)
    return out


def test_code_lengths_are_those_of_the_definition():
    samples = {"a": [b"the cat sat on the mat", b"then the other"], "b": [b"der hund und die katze", b""], "c": [b"eins"]}
    model = langid.train(samples, order=3)
    texts = [b"the mat", b"", b"the mat", b"Zoo \xc3\xa9 qua", b"die katze und der hund " * 3, b"t"]
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    want = [code_length(samples, t, 3) for t in texts]
    assert np.allclose(model.lengths(data, offsets), want, rtol=1e-5)
    assert np.allclose(model.lengths(data, offsets, cells=3), want, rtol=1e-5)
    long = np.frombuffer(b"the cat and der hund " * 2000, np.uint8)
    assert np.allclose(model.lengths(long, np.array([0, 5, len(long)]), cells=1), model.lengths(long, np.array([0, 5, len(long)]), cells=1 << 30), rtol=1e-6)


def test_every_label_is_learned(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        letters = "".join(chr(0x4E00 + 40 * i + k) for k in range(30))
        rows += [(4 * i + j, "".join(rng.choices(letters, k=60)), f"l{i:03}") for j in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS spot", "2 AS n", "3 AS upto")
    model = langid.fit(df)
    assert len(model.langs) == 300
    got = langid.predict(df, model).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.99


def test_long_texts_are_learned_whole(spark):
    """What tells the languages apart stands behind 50,000 characters that they share."""
    rows = [(i, "a b " * 12_500 + ("xyz zyx " * 3000 if i % 2 else "qrs srq " * 3000), "ab"[i % 2]) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    asked = spark.createDataFrame([(1, "zyx xyz zyx"), (2, "srq qrs srq")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(asked, model).collect()} == {1: "b", 2: "a"}
    assert langid.fit(df.repartition(5)).bits.tobytes() == model.bits.tobytes()


def test_language_of_odd_rows(odd_documents):
    model = langid.fit(odd_documents)
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(odd_documents, model).collect()}
    und = {i for i, lang in got if lang == "und"}
    assert und == {2, 3, 5, 8}
    none = langid.fit(odd_documents.limit(0))
    assert {r["lang_pred"] for r in langid.predict(odd_documents, none).collect()} == {"und"}
    assert langid.predict(odd_documents.limit(0), model).count() == 0


# fingerprints


def edited(texts, i):
    n, nxt = len(texts[i]), texts[(i + 1) % len(texts)]
    return texts[i][: n - n // 3] + nxt[: n // 3]


def spots(text, chain=3):
    words = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
    content = [w for w in words if w not in spotsigs.ANCHORS]
    out, seen = set(), 0
    for w in words:
        if w in spotsigs.ANCHORS:
            out.add((w, *content[seen : seen + chain]))
        else:
            seen += 1
    if not out:
        out = {("", *content[i : i + chain]) for i in range(len(content))}
    return out or {text}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_fingerprints_against_sets(spark, small):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()), reverse=True)
    texts = [t for _, t in docs]
    got = {r["doc_id"]: r for r in spotsigs.op8_spotsigs(spark, small).collect()}
    for i, (d, t) in enumerate(docs):
        r, e = got[d], edited(texts, i)
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(jaccard(spots(t), spots(e)))
        assert r["near_next"] == pytest.approx(jaccard(spots(t), spots(texts[(i + 1) % len(texts)])))
        hashes = list(map(int, r["fingerprint"].split(",")))
        assert hashes == sorted(set(hashes)) and len(hashes) == len(spots(t))


@pytest.mark.parametrize("rows", [[], [(4, "only one text, and the end")], [(i, t) for i, t in enumerate(["", None, "the a of", "x", "", "the cat sat", "the cat sat"])]])
def test_fingerprints_of_small_tables(spark, tables, rows):
    got = {r["doc_id"]: r for r in spotsigs.op8_spotsigs(spark, tables(documents=([(i, t, "en", "s", 0) for i, t in rows], DOCS))).collect()}
    assert set(got) == {i for i, _ in rows}
    texts = [t or "" for _, t in sorted(rows, reverse=True)]
    for k, (i, _) in enumerate(sorted(rows, reverse=True)):
        assert got[i]["edited_sha256"] == hashlib.sha256(edited(texts, k).encode()).hexdigest()
        assert got[i]["near_next"] == pytest.approx(jaccard(spots(texts[k]), spots(texts[(k + 1) % len(texts)])))


def test_next_over_many_buckets_and_odd_rows(spark, odd_documents):
    ids = random.Random(3).sample(range(-(10**6), 10**12), 500)
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    for buckets in (1, 2, 64):
        got = {r["doc_id"]: r["nxt"] for r in spotsigs.with_next(df, "doc_id", {"text": "nxt"}, buckets).collect()}
        order = sorted(ids, reverse=True)
        assert got == {a: str(b) for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert spotsigs.with_next(odd_documents, "doc_id", {"text": "nxt"}, 8).count() == odd_documents.count()


def test_similar_pairs_against_all_pairs(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(30):
        base = " ".join(rng.choice(["the", "a", "of", *WORDS]) for _ in range(60)).split()
        for _ in range(3):
            copy = list(base)
            if rng.random() < 0.8:
                copy[rng.randrange(60)] = "changed"
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members, pairs = spotsigs.similar_pairs(df)
    of = {r["id"]: r["class_id"] for r in members.collect()}
    assert all((spots(texts[a]) == spots(texts[b])) == (of[a] == of[b]) for a in range(90) for b in range(90))
    reps = sorted(set(of.values()))
    want = {(a, b) for a in reps for b in reps if a < b and jaccard(spots(texts[a]), spots(texts[b])) >= 0.8}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and want


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_similar_pairs_with_a_common_signature(spark, threshold):
    """Every text holds one signature, many hold another; sets are small and of all lengths, so that bounds are met exactly."""
    rng = random.Random(4)
    texts = []
    for i in range(160):
        own = [f"the w{rng.randrange(12)} x{i % 7} y" for _ in range(rng.randrange(0, 9))]
        texts.append(". ".join(["the very common start", *(["a rather common line"] if i % 2 else []), *own]))
    df = spark.createDataFrame([*enumerate(texts), (None, texts[3]), (None, None), (500, "")], "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS fp", "3 AS n")
    members, pairs = spotsigs.similar_pairs(df, threshold=threshold)
    of = {r["id"]: r["class_id"] for r in members.collect()}
    reps = sorted({c for i, c in of.items() if c is not None and c < 500})
    want = {(a, b): jaccard(spots(texts[a]), spots(texts[b])) for a in reps for b in reps if a < b}
    want = {k: v for k, v in want.items() if v >= threshold - 1e-12}
    got = {(r["a"], r["b"]): r["likeness"] for r in pairs.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


# mixing


def water_filled(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        t = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s: float(cap * sizes[s]) for s in rest if t[s] > cap * sizes[s]}
        if not over:
            return fixed | t
        fixed |= over


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_taken(spark, tables, seed):
    rng = random.Random(seed)
    rows = []
    for s in ["a", "b", None, "z", "ß", "", "B"]:
        for _ in range(rng.choice([1, 5, 60, 400])):
            rows.append((len(rows), prose(rng, rng.randint(0, 30)), "en", s, 0))
    rows += [(len(rows), None, "en", "empty", 0), (len(rows) + 1, "", "en", "empty", 0)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    path = tables(documents=(rows, DOCS))
    got = {r["doc_id"]: r for r in mixing.op9_mixing(spark, path).collect()}
    assert {d: tuple(r) for d, r in got.items()} == {r["doc_id"]: tuple(r) for r in mixing.op9_mixing(spark, path).collect()}
    sizes = defaultdict(int)
    for d, t, _, s, _ in rows:
        n = len((t or "").split())
        assert got[d]["size"] == n and got[d]["taken"] <= 3 * n and (not n or got[d]["taken"] % n == 0)
        sizes[s] += n
    want, taken = water_filled(dict(sizes)), Counter()
    for d, _, _, s, _ in rows:
        assert got[d]["source_size"] == sizes[s]
        assert got[d]["target"] == pytest.approx(want[s])
        taken[s] += got[d]["taken"]
    assert sum(taken.values()) <= sum(sizes.values())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 31, s


def test_mix_of_odd_rows(spark, odd_documents):
    odd_documents = odd_documents.selectExpr("*", "1 AS target", "2 AS rows", "3 AS source_size", "4 AS w", "5 AS cap", "6 AS level", "7 AS f", "8 AS r")
    got = mixing.mix(odd_documents)
    assert got.columns == odd_documents.columns
    assert got.count() >= 1
    assert mixing.mix(odd_documents.limit(0)).count() == 0


# near duplicates


def brute(texts, n=5, threshold=0.8):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"\w+", (t or "").lower())
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    ids = sorted(texts)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def test_groups_and_links_against_all_pairs(spark):
    rng = random.Random(2)
    texts = {}
    for size in (1, 1, 2, 5, 150):  # the last spans several blocks
        base = prose(rng, 120).split()
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = "other"
            texts[len(texts)] = " ".join(copy)
    for t in ("", None, "one two", "one two", "one", "a b c d e", "a b c d e", "a b c d f", "ONE, two"):
        texts[len(texts)] = t
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join(df).collect()}
    assert got == brute(texts)


def test_posterior_bound():
    assert ngram_join.least_matches(0.8, 1e-9, 16) < ngram_join.least_matches(0.8, 1e-4, 16)
    for n in (16, 64):
        least = ngram_join.least_matches(0.8, 1e-4, n)
        rng = np.random.default_rng(0)
        # of pairs at the threshold itself, hardly any falls below
        assert (rng.binomial(n, 0.8, 20_000) < least).mean() < 1e-3
        assert 0 < least < 0.8 * n


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in ngram_join.components(edges).collect()}
    assert len({got[i] for i in range(201)}) == 1 and got[500] == got[501] != got[0] and len(got) == 203
    assert ngram_join.components(edges.limit(0)).count() == 0


def test_join_of_odd_rows(odd_documents):
    got = ngram_join.join(odd_documents).collect()
    assert len(got) == odd_documents.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_links"] == 1 and by[3]["n_links"] == 0 and by[2]["class_id"] == 2
    assert ngram_join.join(odd_documents.limit(0)).count() == 0


# pipeline


def test_pipeline_stages(spark, small, tables):
    import corpus_pipeline

    rng = random.Random(4)
    base = " ".join(f"{prose(rng, 3)} the and of to it is" for _ in range(20))
    rows = [(i, f"{prose(rng, 40)} the and of to in is it that was for on are with", "en", "ab"[i % 2], 0) for i in range(20)]
    rows += [(100, base, "en", "a", 0), (101, base + " end", "en", "a", 0), (102, None, None, None, None), (103, "12 34", None, "a", 5), (104, rows[0][1] + ' more text here token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"' + base[:400], "en", "b", 0)]
    path = tables(documents=(rows, DOCS))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    one = corpus_pipeline.language_id(spark, docs, path)
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == {r[0] for r in rows} - {102, 103}
    two = corpus_pipeline.near_duplicates(spark, one, path)
    assert two.columns == columns and {r["doc_id"] for r in two.collect()} == {r[0] for r in rows} - {101, 102, 103}
    three = corpus_pipeline.secret_scan(spark, two, path)
    texts = {r["doc_id"]: r for r in three.collect()}
    assert three.columns == columns and len(texts) == two.count()
    assert "f3ef4d6b" not in texts[104]["text"] and all(r["n_chars"] == len(r["text"]) for r in texts.values())
    assert all(r["text"] == texts[r["doc_id"]]["text"] for r in two.collect() if r["doc_id"] != 104)
    four = corpus_pipeline.mix_sources(spark, three, path)
    assert four.columns == columns and {r["doc_id"] for r in four.collect()} <= set(texts)
    five = corpus_pipeline.sentencepiece_ids(spark, four, path)
    assert five.count() == four.count()
    assert corpus_pipeline.run(spark, path).count() == five.count()
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secrets", "mixing", "sentencepiece"]


def grams(text):
    words = re.findall(r"\w+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_hand(rows):
    """Of each group of rows joined by Jaccard of at least 0.8, the first in order of id (null last) and place."""
    sets, root = [grams(r["text"]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        rank = (r["doc_id"] is None, r["doc_id"] or 0, i)
        best[find(i)] = min(best.get(find(i), rank), rank)
    return Counter((rows[k]["doc_id"], rows[k]["text"]) for _, _, k in best.values())


def test_near_duplicates_go_by_row(spark):
    import corpus_pipeline

    rng = random.Random(8)
    base = [prose(rng, 60) for _ in range(6)]
    rows = [(1, base[0]), (1, base[1]), (2, base[0]), (2, base[0]), (3, base[1] + " end"), (3, base[2]), (None, base[2]), (None, base[3]), (None, base[3] + " x"), (4, ""), (5, None), (4, ""), (-7, base[4]), (9, base[4]), (9, "short one"), (9, "short one"), (10, base[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS key", "1 AS class_id", "2 AS id", "'x' AS rep")
    got = corpus_pipeline.near_duplicates(spark, df.coalesce(1), "")
    assert got.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == kept_by_hand([r.asDict() for r in df.collect()])


def test_pipeline_of_empty_and_odd_tables(spark, tables, odd_documents):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, tables(documents=([], DOCS))).count() == 0
    docs = odd_documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        docs = out
    assert {c for c in corpus_pipeline.STAGES[-1][1](spark, docs, "").columns} == {"doc_id", "samples"}


def test_rows_without_an_id_have_links(spark):
    rng = random.Random(6)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(None, a), (None, a), (3, a + " more"), (None, b), (None, b + " more"), (8, c)]
    got = {(r["doc_id"], r["class_id"], r["copy_id"], r["n_links"], r["n_text_links"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, 3, None, 2, 1), (3, 3, 3, 2, 1), (None, None, None, 1, 1), (8, 8, 8, 0, 0)}


def test_fingerprints_among_clashing_names(spark):
    df = spark.createDataFrame([(1, "the quick brown fox", "a"), (2, None, "b"), (3, "", "c")], "doc_id long, text string, words string")
    df = df.selectExpr("*", "1 AS sig", "2 AS fp", "3 AS at", "4 AS content", "5 AS next_text")
    got = spotsigs.fingerprint(df, "text", "out")
    assert got.columns == [*df.columns, "out"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[2]["out"] == rows[3]["out"] != rows[1]["out"] and [rows[1][c] for c in df.columns[2:]] == ["a", 1, 2, 3, 4, 5]
    moved = spotsigs.with_next(df, "doc_id", {"text": "after"}, 4)
    assert {r["doc_id"]: r["after"] for r in moved.collect()} == {3: None, 2: "the quick brown fox", 1: ""}
