"""Token files, segmentation samples, archives and top-k search."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from quire.llm import pieces, token_files, topk, warc

P = pytest.importorskip("public_tokenizers")
BPE, SP = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")

# token files


@pytest.mark.parametrize("kind", ["random", "repeats", "one", "high"])
def test_blocks_round_trip(kind):
    rng = np.random.default_rng(7)
    make = {"random": lambda n: rng.integers(0, 50257, n), "repeats": lambda n: np.resize(rng.integers(0, 50257, 11), n), "one": lambda n: np.zeros(n, int), "high": lambda n: np.full(n, 50256)}[kind]
    blocks = [make(n).astype(np.uint32) for n in (2048, 1, 17, 2048, 900)]
    data = token_files.encode_blocks(blocks, 50257)
    for a, b in zip(blocks, token_files.decode_blocks(data, list(map(len, blocks)), 50257), strict=True):
        assert (a == b).all()
    alone = token_files.encode_blocks(blocks[2:3], 50257)
    assert alone == data[2:3]  # a block does not depend on the others
    if kind != "random":
        assert len(data[0]) < 400


def test_ids_beyond_the_vocabulary_are_refused():
    with pytest.raises(ValueError, match="beyond"):
        token_files.encode_blocks([np.array([70000], np.uint32)])


def test_segments_notice_damage():
    head, blocks = token_files.pack_segment([5, None], [np.arange(3000, dtype=np.uint32), np.zeros(0, np.uint32)], 50257)
    data = token_files.close_segment(head, blocks, token_files.encode_blocks(blocks, 50257))
    s = token_files.Segment(data)
    assert (s.doc_ids, list(s.counts), [b[1] for b in s.blocks]) == ([5, None], [3000, 0], [2048, 952])
    with pytest.raises(ValueError, match="head"):
        token_files.Segment(data[:30] + b"\xff" + data[31:])


def test_pieces_equal_the_library():
    own = token_files.Tokenizer(BPE)
    texts = ["", "a", "I'm  don't\t\n\n x ", "½ ² x³", "x \x1c y\x85\xa0z", "日本語 text", "a <|endoftext|> b", "naïve café – “quoted” … 12a_b", "  lead", "a b", "\r\n\r\n", "'Tis 'LL 's", "ǅ ʰ Ω", "١٢ a"]
    want = [e.ids + [2] for e in own.own.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode(texts, 2)] == want
    assert own.split


def test_pieces_of_odd_joints_equal_the_library():
    """Words are cut behind their letters, wherever those end."""
    own, rng = token_files.Tokenizer(BPE), random.Random(5)
    parts = ["'s", "'re", "'", "a", "the", "Then", "x1", "12", ".", ",", "!!", "\n", "\r\n", " ", " ", " ", "é", "ñandú", "日本", "\u0301", "²", "ǅ", "_", "\x00", "<|", "ſ", "😀"]
    for _ in range(20):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(30)]
        assert [x.tolist() for x in own.encode(texts, 2)] == [e.ids + [2] for e in own.own.encode_batch(texts, add_special_tokens=False)]


def test_known_words_are_not_encoded_again_for_what_follows_them(monkeypatch):
    own, seen = token_files.Tokenizer(BPE), []
    real = own._library
    monkeypatch.setattr(own, "_library", lambda texts: seen.extend(texts) or real(texts))
    own.encode(["x qualmost verandine", "x orth; orth"], 2)
    assert any("qualmost" in t for t in seen)
    seen.clear()
    texts = ["x qualmost, verandine.\nOrth verandine! orth", "x orth's (orth qualmost..."]
    assert [x.tolist() for x in own.encode(texts, 2)] == [e.ids + [2] for e in own.own.encode_batch(texts, add_special_tokens=False)]
    assert not any("qualmost" in t or "verandine" in t for t in seen)


def test_coded_bytes_stay_what_they_were():
    rng = np.random.default_rng(11)
    blocks = [(rng.zipf(1.3, n) % 50257).astype(np.uint32) for n in (2048, 2048, 1345, 97, 32, 1, 0)]
    data = token_files.encode_blocks(blocks, 50257)
    assert zlib.crc32(b"".join(data)) == 4085957383
    for a, b in zip(blocks, token_files.decode_blocks(data, list(map(len, blocks)), 50257), strict=True):
        assert (a == b).all()


@pytest.mark.parametrize("shape", [(0, 3), (1, 1), (63, 5), (64, 7), (130, 9)])
def test_turned(shape):
    a = np.arange(shape[0] * shape[1], dtype=np.uint16).reshape(shape)
    assert (token_files._turned(a[:, 1:]) == a[:, 1:].T).all()


@pytest.mark.parametrize("bits", [64, 3])
def test_known_words_against_a_dict(bits, monkeypatch):
    """Where most hashes are equal words may be missed, never taken for others."""
    if bits < 64:
        real = token_files.Known.hash
        monkeypatch.setattr(token_files.Known, "hash", lambda self, *a: real(self, *a) & np.uint64((1 << bits) - 1))
    rng, known, held, numbered = random.Random(4), token_files.Known(400, 9000), {}, []
    make = lambda: bytes(rng.choices(b"ab\x00\xff", k=rng.choice([0, 1, 2, 7, 8, 9, 16, 17, 40])))
    for _ in range(12):
        words = list({make() for _ in range(60)})
        data = np.frombuffer(b"x" + b"".join(words) + bytes(8), np.uint8)
        size = np.array(list(map(len, words)))
        start = 1 + np.cumsum(size) - size
        at, h = known.find(data, start, size)
        assert all(n < 0 or numbered[n] == w for n, w in zip(at.tolist(), words, strict=True))
        if bits == 64:
            assert at.tolist() == [held.get(w, -1) for w in words]
        new = np.flatnonzero(at < 0)
        if known.add(data, start[new], size[new], h[new]):
            held |= {words[i]: len(numbered) + k for k, i in enumerate(new)}
            numbered += [words[i] for i in new]
        else:
            assert len(numbered) + len(new) > 400
    assert len(numbered) > 200


def test_token_query(spark, small, tables, odd_documents):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(BPE), 0
    rows = sorted(token_files.op1_tokens(spark, small).collect(), key=lambda r: r["doc_id"])
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert [r["doc_id"] for r in rows] == sorted(docs)
    for r in rows:
        ids = np.array(library.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids + [2], "<u4")
        assert tuple(r)[1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_of_odd_rows(spark, odd_documents, tmp_path):
    token_files.write_tokens(odd_documents, f"file://{tmp_path}/t", BPE, shards=3)
    got = sorted(token_files.read_tokens(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, -3, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])])[:-1].tolist()
    token_files.write_tokens(odd_documents.limit(0), f"file://{tmp_path}/e", BPE)
    assert token_files.read_tokens(spark, f"file://{tmp_path}/e").count() == 0


# segmentations


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(SP)


def test_samples_are_distinct_and_decode(lattice):
    texts = ["the cat  sat", "", None, "a", "\n\n", " lead and trail ", "日本語 😀 é", "x" * 300, "then the then the"]
    for text, got in zip(texts, pieces.sample_texts(lattice, texts, list("abcdefghi"), 4, 0), strict=True):
        ids = [tuple(s["ids"].tolist()) for s in got]
        assert len(set(ids)) == len(ids) and 1 <= len(ids) <= 4
        assert all(lattice.decode(list(x)) == (text or "") for x in ids)
        assert all(s["log_prob"] <= 1e-9 and s["log_inclusion"] <= 1e-9 for s in got)
    assert len(pieces.sample_texts(lattice, ["\n"], ["k"], 5, 0)[0]) < 5


def test_samples_follow_the_distribution_without_replacement(lattice):
    words = lattice.build([" then", " a"])
    share = {x + y: np.exp(p + q) for p, x in words.all(0) for q, y in words.all(1)}
    assert sum(share.values()) == pytest.approx(1)
    n, first, second, weighed = 8000, Counter(), Counter(), Counter()
    for s in pieces.sample_texts(lattice, ["then a"] * n, [str(i) for i in range(n)], 3, 9):
        first[tuple(s[0]["ids"].tolist())] += 1
        second[tuple(s[1]["ids"].tolist())] += 1
        for x in s:
            weighed[tuple(x["ids"].tolist())] += np.exp(-x["log_inclusion"])
    for x, p in share.items():
        if p > 0.05:
            assert first[x] / n == pytest.approx(p, abs=0.025)
            # drawn second: after each other first
            assert second[x] / n == pytest.approx(sum(q * p / (1 - q) for y, q in share.items() if y != x), abs=0.025)
            assert weighed[x] / n == pytest.approx(1, abs=0.08)


def test_all_segmentations_come_in_the_end(lattice):
    words = lattice.build([" the"])
    every = {x: np.exp(p) for p, x in words.all(0)}
    got = pieces.sample_texts(lattice, ["the"], ["k"], len(every) + 3, 1)[0]
    assert {x for x, p in every.items() if p > 1e-8} <= {tuple(s["ids"].tolist()) for s in got} <= set(every)
    assert all(s["log_inclusion"] == 0 for s in got)


def test_what_is_left_of_a_word(lattice):
    """Shares and draws without some segmentations, against all of them."""
    words = lattice.build([" thing", " aaaa"])
    for w in (0, 1):
        every = sorted(words.all(w), reverse=True)
        for n in (1, 2, len(every) - 1, len(every)):
            share, rest = words.rest(w, {x for _, x in every[:n]})
            want = sum(np.exp(p) for p, _ in every[n:])
            assert np.isclose(np.exp(share), want, rtol=1e-9, atol=0)
            if n < len(every):
                drawn = Counter()
                for i in range(3000):
                    got, p = rest.draw(np.array([i + 1], np.uint64))
                    drawn[tuple(got.tolist())] += 1
                    assert np.isclose(p, dict((x, q) for q, x in every)[tuple(got.tolist())])
                assert set(drawn) <= {x for _, x in every[n:]}
                top = every[n]
                assert abs(drawn[top[1]] / 3000 - np.exp(top[0]) / want) < 0.05


def test_no_segmentation_is_lost_in_rounding():
    """At a steep alpha all but one segmentation have next to no share; they come all the same."""
    steep = pieces.Lattice(SP, 8.0)
    every = steep.build([" thing"]).all(0)
    assert sum(np.exp(p) < 1e-13 for p, _ in every) > 5
    got = pieces.sample_texts(steep, ["thing"], ["k"], len(every) + 3, 4)[0]
    assert len({tuple(s["ids"]) for s in got}) == len(every) == len(got)
    assert {tuple(s["ids"]): round(s["log_prob"], 6) for s in got} == {x: round(p, 6) for p, x in every}


def test_samples_do_not_depend_on_batches(lattice):
    texts = ["the cat sat", "on the mat", "a b c d e f g"]
    alone = [pieces.sample_texts(lattice, [t], [k], 3, 5)[0] for t, k in zip(texts, "xyz", strict=True)]
    for a, b in zip(alone, pieces.sample_texts(lattice, texts, list("xyz"), 3, 5), strict=True):
        assert [s["ids"].tolist() for s in a] == [s["ids"].tolist() for s in b]


def test_pieces_query_and_odd_rows(spark, small, odd_documents):
    rows = pieces.op4_pieces(spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(r["decodes"] and r["n_samples"] == 2 for r in rows)
    got = pieces.sample(odd_documents, SP).collect()
    assert len(got) == odd_documents.count()
    assert pieces.sample(odd_documents.limit(0), SP).count() == 0
    plain = {r["doc_id"]: r["ids"] for r in pieces.encode(odd_documents.where("doc_id > 0"), SP).collect()}
    back = pieces.decode(spark.createDataFrame([(k, [v]) for k, v in plain.items() if v], "doc_id long, ids array<array<int>>"), SP, "ids").collect()
    texts = {r["doc_id"]: r["text"] for r in odd_documents.collect()}
    assert all(r["decoded"] == [texts[r["doc_id"]]] for r in back if r["doc_id"] != 7)


# archives


def record(payload: bytes, i=1, kind="response", digest=None):
    digest = digest or base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def kinds(data):
    return [(r["record_type"], r.get("record_id"), r.get("reason")) for r in warc.salvage(data)]


def test_salvage_goes_on_after_damage():
    a, b, c = record(b"first"), record(b"second \r\n\r\nWARC/1.1\r\n inside", 2), record(b"third", 3)
    one = lambda i: ("response", f"<urn:page:{i}>", None)
    assert kinds(a + b + c) == [one(1), one(2), one(3)]
    wrong = bytearray(a + b + c)
    wrong[len(a) - 6] ^= 1  # in the payload
    assert kinds(bytes(wrong)) == [("gap", None, "digest"), one(2), one(3)]
    assert kinds(a + b"noise" + c) == [one(1), ("gap", None, "version"), one(3)] or kinds(a + b"noise\n" + c) == [one(1), ("gap", None, "version"), one(3)]
    assert kinds(a + c[:-20]) == [one(1), ("gap", None, "terminator")]
    z = gzip.compress
    assert kinds(z(a) + z(b) + z(c)) == [one(1), one(2), one(3)]
    assert kinds(z(a) + z(b)[:-9] + b"\0" + z(c)) == [one(1), ("gap", None, "member"), one(3)]
    assert kinds(b"") == [] and kinds(b"junk") == [("gap", None, "version")]
    gaps = [r for r in warc.salvage(a + b"x" * 9 + b"\n" + c) if r["record_type"] == "gap"]
    assert [(g["start"], g["end"]) for g in gaps] == [(len(a), len(a) + 10)]


def test_archive_round_trip_of_odd_rows(spark, tables):
    rows = [(3, "http://a b\r\nWARC/1.1", "x"), (1, None, "x"), (2, "u", None), (4, "u", ""), (None, "u", "x"), (None, "u", "alone"), (5, "u", "y\r\n\r\nWARC/1.1\r\n\r\n"), (6, "u", "é😀" * 50_000), (7, "u", "q"), (7, "u", "q")]
    path = tables(pages=(rows, "page_id long, url string, html string"))
    got = sorted((tuple(r) for r in warc.op6_warc(spark, path).collect()), key=str)
    want = []
    for i, _, h in rows:
        h = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == h and j is not None]
        first = min(same, default=None)
        revisit = first is not None and first != i
        want.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    empty = tables(pages=([], "page_id long, url string, html string"))
    assert warc.op6_warc(spark, empty).count() == 0


def test_archives_equal_sql(spark, small):
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
    want = {tuple(r.values()) for r in duckdb.sql(warc.OP6_SQL).to_arrow_table().to_pylist()}
    assert {tuple(r) for r in warc.op6_warc(spark, small).collect()} == want


def test_many_small_pages_are_few_archives(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.range(0, 30_000, 1, 1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.repeat(F.lit("x"), F.pmod("id", F.lit(90)).cast("int") * 80), F.col("id").cast("string")).alias("html"))
    warc.write_warc(pages, f"file://{tmp_path}/w", target=8 << 20)
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("*.txt")]
    # by classes of size: none beyond the target, and most of them near it
    assert max(sizes) <= 8 << 20 and len(sizes) <= 4 * sum(sizes) // (8 << 20) + 3
    assert warc.read_warc(spark, f"file://{tmp_path}/w", payloads=False).count() == 30_000


# top-k


@pytest.mark.parametrize("shape", ["spread", "equal", "tiny", "large", "wide"])
def test_top_k_against_all_products(spark, tables, shape):
    rng = np.random.default_rng(3)
    n = 7 if shape == "tiny" else 700
    v = rng.normal(size=(n, 12)) * rng.lognormal(size=(n, 1))
    if shape == "equal":
        v[100:400] = v[0]
    if shape in ("large", "wide"):  # components of a million and more, and such as need 64 bits
        v[::50, 3] = 1e6 if shape == "large" else 1e6 * rng.normal(size=14)
        v[100, 5], v[4, 5], v[7, 5] = (3e5, -3e5, 1e6) if shape == "large" else (3.0, -1e11, 1e10)
    rows = [(int(i), [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(1000, None), (1100, [1.0, None]), (1200, [float("nan")]), (1300, [float("inf")]), (1400, []), (1500, [0.5])]
    path = tables(embeddings=(rows, "vec_id long, embedding array<double>"))
    ok = {i: np.floor(1024 * np.array((r + [0.0] * 12)[:12])).astype(object) for i, r in rows if r is not None and all(x is not None and np.isfinite(x) for x in r)}
    want = set()
    for q in (i for i in ok if i % 100 == 0):
        best = sorted((-sum(int(a) * int(b) for a, b in zip(ok[q], ok[i], strict=True)), i) for i in ok if i != q)[:10]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in topk.op2_topk(spark, path).collect()} == want


def test_scores_beyond_64_bits_are_an_error(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, [1e12, 1.0]), (1, [1e12, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(df, F.col("id") == 0, k=1).collect()
    alone = spark.createDataFrame([(0, [1e12, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(alone, F.col("id") == 0, k=1).collect()] == [(0, 1, 2, 1024 * 1024)]


def test_top_k_of_repeated_ids_and_clashing_names(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [1.0, 1.0]), (1, [3.0, 0.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS q", "'x' AS length", "3 AS rank", "4 AS score")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("id") == 0, k=3).collect())
    unit = 1024 * 1024
    # each row is a query of its own, and a candidate for the other; ties to the smaller id
    assert got == sorted([(0, 1, 1, 3 * unit), (0, 2, 0, 2 * unit), (0, 3, 1, unit), (0, 1, 1, 6 * unit), (0, 2, 0, 2 * unit), (0, 3, 1, 2 * unit)])


def test_top_k_of_repeated_ids_is_what_its_sql_says(spark, tables):
    rows = [(i % 120, [float((i * 7) % 11) / 10, float(i % 5) / 5]) for i in range(400)] + [(None, [1.0, 1.0])]
    d = tables(embeddings=(rows, "vec_id long, embedding array<float>"))
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet/*.parquet'")
    want = sorted(duckdb.sql(topk.OP2_SQL).fetchall())
    assert sorted(tuple(r) for r in topk.op2_topk(spark, d).collect()) == want and len(want) == 10 * 7


def test_top_k_of_no_rows_and_many_blocks(spark, tables):
    assert topk.op2_topk(spark, tables(embeddings=([], "vec_id long, embedding array<float>"))).count() == 0
    rows = [(i, [float(i % 7), 1.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    every = {tuple(r) for r in topk.top_k(df, F.col("id") % 3 == 0, k=4).collect()}
    assert every == {tuple(r) for r in topk.top_k(df, F.col("id") % 3 == 0, k=4, block_bytes=16 * 30).collect()}


def _gzip_record(i, body):
    import gzip

    return gzip.compress(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n")


def test_gzip_members_in_linear_time():
    import time

    rng = np.random.default_rng(1)
    data = b"".join(_gzip_record(i, rng.bytes(1500)) for i in range(20_000))
    start = time.time()
    got = list(warc.salvage(data))
    assert [r["record_id"] for r in got] == [f"<urn:{i}>" for i in range(20_000)] and time.time() - start < 5
    assert [(r["start"], r["end"]) for r in got][1:] == [(a["end"], b["end"]) for a, b in zip(got, got[1:], strict=False)]


def test_members_are_inflated_in_blocks_and_bounded(monkeypatch):
    big, small = _gzip_record(1, b"a" * 300_000), _gzip_record(2, b"b")
    assert [(r["record_type"], r["end"]) for r in warc.salvage(big + small)] == [("response", len(big)), ("response", len(big + small))]
    cut = big[:-9] + small
    assert [(r["record_type"], r.get("record_id")) for r in warc.salvage(cut)][-1] == ("response", "<urn:2>")
    monkeypatch.setattr(warc, "INFLATED", 100_000)
    assert [(r["record_type"], r.get("reason")) for r in warc.salvage(big + small)] == [("gap", "member size"), ("response", None)]


def test_archives_are_sized_by_bytes_and_gaps_are_logged(spark, tmp_path):
    rows = [(i, "u", "x" * 50_000 if i % 2 else f"page {i}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).selectExpr("*", "0 AS payload", "'a' AS id")
    warc.write_warc(pages, f"file://{tmp_path}/w", small=1000, target=200_000)
    files = sorted(p.stat().st_size for p in (tmp_path / "w").glob("*.txt"))
    assert max(files) < 250_000 and len(files) > 5
    read = warc.read_warc(spark, f"file://{tmp_path}/w")
    got, gaps = warc.quarantine(read, f"file://{tmp_path}/g0")
    assert (got.count(), gaps) == (60, 0)
    first = next(iter((tmp_path / "w").glob("*.txt")))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.warc").write_bytes(first.read_bytes()[:-30])
    got, gaps = warc.quarantine(warc.read_warc(spark, f"file://{tmp_path}/bad"), f"file://{tmp_path}/g1")
    assert gaps == 1 and spark.read.parquet(f"file://{tmp_path}/g1").first()["end"] == first.stat().st_size - 30
