from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.operators import extraction, graph, history, ledger, lookups, numbering, patterns, quotes, retrieval, segment


@pytest.fixture(scope="module")
def library(spark):
    frame = spark.createDataFrame
    chapters = frame([("b", "c1", 0, 1, True, "One", "long one", "m1"), ("b", "c2", 1, 2, True, "", None, "m2"), ("b", "c0", 2, None, False, "Notes", None, None)], "book_id string, chapter_id string, ordinal int, number int, is_body boolean, title string, summary string, micro_summary string")
    texts = [("s0", "c1", "Alice met the white rabbit by the river."), ("s1", "c1", "The rabbit was late for tea, Alice said."), ("s2", "c2", "In 1984 Bob sailed down the river."), ("s3", "c2", "Bob and Alice ran home."), ("s4", "c0", "A note on rabbit rabbit rabbits.")]
    sections = frame([("b", c, s, i % 2, t, 0, len(t), c != "c0") for i, (s, c, t) in enumerate(texts)], "book_id string, chapter_id string, section_id string, ordinal int, content string, char_offset_start int, char_offset_end int, is_body boolean")
    unit = lambda i: [1.0 if k == i else 0.0 for k in range(4)]
    vectors = frame([(s, c, f"k{s}", c != "c0", None if s == "s4" else unit(0 if c == "c1" else 1)) for s, c, _ in texts] + [("s3", "c2", "kz", True, [0.0] * 4)], "section_id string, chapter_id string, chunk_id string, is_body boolean, embedding array<float>")
    entities = frame([("b", "e1", "Alice", "PERSON", ["Ally"]), ("b", "e2", "Bob", "PERSON", None), ("b", "e3", "River", "PLACE", [])], "book_id string, entity_id string, name string, entity_type string, aliases array<string>")
    occ = frame([("b", "e1", "c1", "s0", 0, 5, "Alice met"), ("b", "e1", "c1", "s1", 29, 34, "Alice said"), ("b", "e1", "c2", "s3", 8, 13, "Alice ran"), ("b", "e2", "c2", "s3", 0, 3, "Bob and"), ("b", "e2", "c2", "s2", 8, 11, "Bob"), ("b", "e3", "c2", "s2", 28, 33, "river"), ("b", "e3", "c2", None, 0, 0, "x")], "book_id string, entity_id string, chapter_id string, section_id string, char_offset_start int, char_offset_end int, context string")
    dates = frame([("c2", "s2", "1984", "1984-01-01", 3), ("c2", "s3", "long ago", None, 0), ("c1", None, "1984", None, 0)], "chapter_id string, section_id string, raw_text string, d string, char_offset_start int").withColumn("normalized_date", F.to_date("d"))
    events = frame([("c1", "s0", "Alice meets the rabbit", None, 0), ("c2", "s2", "A storm", ["e2"], 5)], "chapter_id string, section_id string, description string, entity_ids array<string>, char_offset_start int")
    return {"chapters": chapters, "sections": sections, "vectors": vectors, "entities": entities, "occurrences": occ, "dates": dates, "events": events}


def ids(df):
    return [r["section_id"] for r in df.collect()]


def test_fusion(spark):
    lists = [spark.createDataFrame([(s, i + 1) for i, s in enumerate(x)], "section_id string, rank int") for x in ("abc", "cd")]
    got = retrieval.fuse(lists).collect()
    assert [r["section_id"] for r in got] == ["c", "a", "b", "d"] or [r["section_id"] for r in got] == ["c", "a", "d", "b"]
    assert got[0]["score"] == pytest.approx(1 / 63 + 1 / 61)
    assert ids(retrieval.fuse(lists[:1])) == list("abc")
    # equal scores come in order of list, then rank
    same = [spark.createDataFrame([(s, 1)], "section_id string, rank int") for s in "zy"]
    assert ids(retrieval.fuse(same)) == ["z", "y"]
    assert ids(retrieval.fuse(same, [1.0, 2.0])) == ["y", "z"]
    with pytest.raises(ValueError, match="weight"):
        retrieval.fuse(lists, [1.0])


def test_lexical(library):
    s, posts = library["sections"], retrieval.postings(library["sections"])
    find = lambda q, **scope: ids(retrieval.lexical_search(retrieval.scoped(posts, library["chapters"], **scope), s, q))
    assert set(find("rabbits")) == {"s0", "s1"}  # not the notes
    assert find("rabbit tea") == ["s1"]
    assert set(find("tea or bob")) == {"s1", "s2", "s3"}
    assert find("rabbit -tea") == ["s0"]
    assert find('"white rabbit"') == ["s0"] and find('"rabbit white"') == []
    assert find('"rabbit was late"') == ["s1"]
    assert find("-tea") == [] and set(find("bob or -tea")) == {"s2", "s3"}
    assert find("the of") == [] == find("") == find("zebra")
    assert find("bob", up_to_chapter=1) == [] and set(find("bob", up_to_chapter=2)) == {"s2", "s3"}
    assert set(find("river", chapter=1)) == {"s0"}


def test_semantic(library):
    near = lambda k=20, **scope: ids(retrieval.semantic_search(retrieval.scoped(library["vectors"], library["chapters"], **scope), [1.0, 0.0, 0.0, 0.0], k))
    assert near() == ["s0", "s1", "s2", "s3"]
    assert near(1) == ["s0"]
    assert near(up_to_chapter=1) == ["s0", "s1"] and near(chapter=2) == ["s2", "s3"] and near(up_to_chapter=0) == []
    got = {r["section_id"]: r["distance"] for r in retrieval.semantic_search(library["vectors"], [1.0, 0.0, 0.0, 0.0]).collect()}
    assert got["s0"] == pytest.approx(0) and got["s3"] == pytest.approx(1)


def test_dates(library):
    assert ids(retrieval.date_sections(library["dates"], "what of 1984?")) == ["s2"]
    assert ids(retrieval.date_sections(library["dates"], "what of it?")) == []
    find = lambda q, **k: [r["raw_text"] for r in lookups.dates(library["dates"], library["chapters"], q, **k).collect()]
    assert find("1984") == ["1984", "1984"] and find("2099") == [] and find("ago") == ["long ago"] and len(find("")) == 3
    assert find("1984", chapter_=2) == ["1984"]


def test_entities_and_events(library):
    e = [library[t] for t in ("entities", "occurrences", "chapters")]
    get = lambda name, **k: {r["name"]: [o["section_id"] for o in r["occurrences"]] for r in lookups.entities(*e, name, **k).collect()}
    assert get("ally") == {"Alice": ["s0", "s3", "s1"]}
    assert get("alice", up_to_chapter=1) == {"Alice": ["s0", "s1"]}
    assert get("bob", up_to_chapter=0) == {"Bob": []}
    assert get("river") == {"River": ["s2"]} and get("nobody") == {}
    events = lookups.events(library["events"], library["chapters"], "").collect()
    assert [r["entity_ids"] for r in events] == [[], ["e2"]]
    assert ids(lookups.events(library["events"], library["chapters"], "RABBIT")) == ["s0"]


def test_outline_and_chapters(library):
    assert [r["number"] for r in lookups.outline(library["chapters"]).collect()] == [1, 2]
    assert [r["number"] for r in lookups.outline(library["chapters"], up_to_chapter=1).collect()] == [1]
    assert lookups.chapter(library["chapters"], 3).count() == 0
    text = history.outline(library["chapters"].where("is_body")).first()["outline"]
    assert text == "[Chapter 1 — One]\nlong one\n\n[Chapter 2 — Chapter 2]\nm2"
    short = history.outline(library["chapters"].where("is_body"), budget=3).first()["outline"]
    assert short.startswith("[Chapter 1 — One]\nm1")
    assert lookups.expand_section(library["sections"], 5).first()["content"] == "Alice"


def test_graph(library):
    m = library["occurrences"].join(library["entities"].select("entity_id", "name"), "entity_id")
    edges = [tuple(r) for r in graph.edges(m).collect()]
    assert edges == [("Alice", "Bob", 1), ("Bob", "River", 1)]
    top = graph.edges(m, 12)
    got = graph.read_set(top, m, library["events"]).collect()
    assert [r["section_id"] for r in got] == ["s2", "s3", "s0"] and [r["both"] for r in got] == [True, False, False]
    assert len(graph.read_set(top, m, library["events"], 2).collect()) == 2
    assert [r["description"] for r in graph.principal_events(library["events"], top, library["entities"]).collect()] == ["Alice meets the rabbit"]
    assert graph.principal_events(library["events"], top.limit(0), library["entities"]).count() == 2
    lists = {r["name"]: r["section_ids"] for r in graph.entity_sections(library["entities"], library["occurrences"]).collect()}
    assert sorted(lists["Alice"]) == ["s0", "s1", "s3"]
    many = m.sparkSession.createDataFrame([("1", "a"), ("1", "b"), ("1", "c"), ("2", "a"), ("2", "b"), ("2", "b"), (None, "a")], "section_id string, name string")
    assert [tuple(r) for r in graph.edges(many).collect()] == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]


def test_gate(spark):
    def issues(sections, body=True, raw=None, cap=100):
        ch = spark.createDataFrame([("b", body)], "book_id string, is_body boolean")
        s = spark.createDataFrame([("b", body, t) for t in sections], "book_id string, is_body boolean, content string")
        r = spark.createDataFrame([("b", sum(map(len, sections)) if raw is None else raw)], "book_id string, raw_length int")
        return segment.gate(ch, s, s, r, cap_tokens=cap).first()["issues"]

    assert issues(["x" * 300] * 5) == []
    assert any("cap" in i for i in issues(["x" * 500]))
    assert any("chunk" in i for i in issues(["x" * 300], body=False))
    assert any("over-segmented" in i for i in issues(["x" * 10] * 12 + ["x" * 400] * 8))
    assert issues(["x" * 20] * 5) == []
    assert any("characters from" in i for i in issues(["x" * 300], raw=900))
    assert any("sizes" in i for i in issues(["x", "x" * 600], cap=1000))


def test_numbers(spark):
    rows = [("b", i, i % 3 != 0) for i in range(50)] + [("c", i, True) for i in range(3)]
    df = spark.createDataFrame(rows, "book_id string, ordinal int, is_body boolean")
    got = {(r["book_id"], r["ordinal"]): r["number"] for r in numbering.display_numbers(df).collect()}
    want, n = {}, {"b": 0, "c": 0}
    for b, i, body in rows:
        n[b] += body
        want[b, i] = n[b] if body else None
    assert got == want
    again = numbering.number_rows(df.where("is_body"), ["book_id"], "ordinal", "number")
    assert {(r["book_id"], r["ordinal"]): r["number"] for r in again.collect()} == {k: v for k, v in want.items() if v}


def test_quotes(spark):
    rows = [(1, 0, 0, "A’s  x"), (1, 0, 1, "a's x"), (1, 1, 0, "b"), (1, 2, 0, "c"), (1, 2, 1, "d"), (2, 0, 0, "b")]
    df = quotes.comparable(spark.createDataFrame(rows, "answer_id int, result_no int, quote_no int, text string"), "text", "norm")
    assert sorted((r["answer_id"], r["text"]) for r in quotes.select(df, 3).collect()) == [(1, "A’s  x"), (1, "b"), (1, "c"), (2, "b")]
    got = quotes.locate(spark.createDataFrame([("one two", "two"), ("one", None), (None, "x")], "s string, q string"), "s", "q").collect()
    assert [(r["quote_start"], r["quote_end"]) for r in got] == [(4, 7), (None, None), (None, None)]
    docs = spark.createDataFrame([(1, "abcabc"), (2, None), (3, "zzz")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "bc"), (8, "bc"), (9, "q"), (10, "")], "item_id long, quote string")
    assert sorted(map(tuple, quotes.find_all(docs, items).collect())) == [(1, 7, 1, 3), (1, 8, 1, 3)]
    assert quotes.find_all(docs, items, most_bytes=2).count() == 2


def test_history(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "x" * 1000 if i == 19 else f"t{i}") for i in range(20)] + [(2, 0, "system", None)]
    got = {r["conv_id"]: r["history"] for r in history.render(history.cap(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), 6, 50)).collect()}
    assert got[1].split("\n") == ["User: t14", "Assistant: t15", "User: t16", "Assistant: t17", "User: t18", "Assistant: " + "x" * 50 + "…"]
    assert got[2] == "Assistant: "


def test_ledger(spark):
    rows = [("b", "s", "u1", "old", "2020-01-01"), ("b", "s", "u1", "new", "2020-01-02"), ("b", "s", "u2", None, "2020-01-01"), ("b", "s", "*", None, "2020-01-03"), ("c", "s", "u1", "x", "2020-01-01")]
    led = spark.createDataFrame(rows, "book_id string, stage string, unit_key string, payload string, t string").withColumn("updated_at", F.to_timestamp("t"))
    assert ledger.stage_done(led, "b", "s") and not ledger.stage_done(led, "c", "s")
    assert {tuple(r) for r in ledger.done_units(led, "s").collect()} == {("b", "u1"), ("b", "u2"), ("c", "u1")}
    assert {tuple(r) for r in ledger.payloads(led, "s").collect()} == {("b", "u1", "new"), ("c", "u1", "x")}
    units = spark.createDataFrame([("b", "u1"), ("b", "u3"), ("c", "u2")], "book_id string, unit string")
    assert {tuple(r) for r in ledger.pending(units, led, "s", "unit").collect()} == {("b", "u3"), ("c", "u2")}
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in ledger.upsert(table, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_extraction(spark):
    schema = "book_id string, chapter_id string, section_id string, content string, char_offset_start int, payload struct<entities:array<struct<name:string,type:string,offset_start:int,offset_end:int>>,dates:array<struct<raw_text:string,normalized:string,offset_start:int,offset_end:int>>,events:array<struct<description:string,anchor_offset:string>>>"
    rows = [("b", "c", "s1", "Ann met Bo in 1900.", 100, ([("Ann", "character", 99999, 88888), (" Bo ", "location", 8, 10), ("Zed", "character", 0, 3), ("", "location", 0, 0), ("Corp", "organization", 0, 1), ("Rex", "place", 0, 1)], [("1900", "1900-01-01", 0, 1), ("1900", "bad", 14, 18)], [(" Ann meets Bo", "4"), ("x", "many"), ("y", None), ("z", "19"), ("w", "-1"), ("v", "18")]))]
    p = spark.createDataFrame(rows, schema)
    clusters = spark.createDataFrame([("b", 0, "Ann Lee", "character", ["Ann"]), ("b", 1, "Bo", "location", []), ("b", 2, "Bo", "location", ["B", " "]), ("b", 3, "Acme", "organization", ["Ann"])], "book_id string, position int, canonical string, type string, aliases array<string>")
    assert {(r["name"], r["type"]) for r in extraction.candidates(p).collect()} == {("Ann", "character"), ("Bo", "location"), ("Zed", "character")}
    e = extraction.entities(clusters)
    assert {(r["name"], r["entity_type"]) for r in e.collect()} == {("Ann Lee", "PERSON"), ("Bo", "PLACE")}
    occ = extraction.occurrences(p, extraction.aliases(clusters), e).collect()
    assert sorted((r["char_offset_start"], r["char_offset_end"], r["context"]) for r in occ) == [(100, 103, "Ann met Bo in 1900."), (108, 110, "Ann met Bo in 1900.")]
    assert sorted((r["char_offset_start"], str(r["normalized_date"])) for r in extraction.dates(p).collect()) == [(114, "1900-01-01"), (114, "None")]
    ev = {r["description"]: r for r in extraction.events(p, e).collect()}
    assert ev["Ann meets Bo"]["char_offset_start"] == 104 and len(ev["Ann meets Bo"]["entity_ids"]) == 1
    assert set(ev) == {"Ann meets Bo", "v"} and ev["v"]["char_offset_start"] == 118 and ev["v"]["entity_ids"] is None


def test_a_name_of_two_types_is_two_entities(spark):
    schema = "book_id string, position int, canonical string, type string, aliases array<string>"
    rows = [("b", 0, "Paris", "character", ["Paris Hilton"]), ("b", 1, "Paris", "location", ["Paris city"]), ("b", 2, "Anna", "character", ["Ann"]), ("b", 3, "Annabel", "character", ["Anna"])]
    clusters = spark.createDataFrame(rows, schema)
    means = {r["alias"]: (r["canonical"], r["entity_type"]) for r in extraction.aliases(clusters).collect()}
    assert means == {"paris": ("Paris", "PLACE"), "paris hilton": ("Paris", "PERSON"), "paris city": ("Paris", "PLACE"), "anna": ("Annabel", "PERSON"), "ann": ("Anna", "PERSON"), "annabel": ("Annabel", "PERSON")}
    assert {(r["name"], r["entity_type"]): r["aliases"] for r in extraction.entities(clusters).collect()} == {
        ("Paris", "PERSON"): ["Paris Hilton"], ("Paris", "PLACE"): ["Paris city"], ("Annabel", "PERSON"): ["Anna"], ("Anna", "PERSON"): ["Ann"],
    }


def test_many_patterns_are_found_as_one_by_one(spark):
    import random

    rng = random.Random(8)
    names = {"".join(rng.choices("abcdé ", k=rng.randint(1, 9))) for _ in range(100_000)} | {"x" * 300, "日本"}
    texts = ["".join(rng.choices("abcdé x日本", k=rng.randint(0, 60))) for _ in range(40)] + ["x" * 700, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    pats = spark.createDataFrame([(n,) for n in names] + [(None,), ("",), ("ab",), ("ab",)], "p string")
    want = {i: sorted((t.find(n), n) for n in names if n in t) if t else [] for i, t in enumerate(texts)}
    for most in (32 << 20, 200_000):
        got = {r["i"]: sorted((f["start"], f["pattern"]) for f in r["found"]) for r in patterns.marked(df, F.col("t"), pats, most_bytes=most).collect()}
        assert got == want
    assert {r["i"] for r in patterns.holding(df, F.col("t"), pats).collect()} == {i for i, w in want.items() if w}
    assert patterns.holding(df, F.col("t"), pats.limit(0)).count() == 0


def test_outlines_by_ranges_are_those_of_one_row(spark):
    import random

    rng = random.Random(6)
    rows = []
    for b in ("a", "b", None, "c"):
        for i in range({"a": 300, "b": 40, "c": 1}.get(b, 5)):
            rows.append((b, i, i + 1, rng.choice(["", "T", None]), rng.choice(["", None, "full " * rng.randint(1, 60)]), rng.choice(["", None, "m" * rng.randint(1, 3)])))
    df = spark.createDataFrame(rows, "book_id string, ordinal int, number int, title string, summary string, micro_summary string")
    for budget in (0, 50, 400, 5000):
        want = {r["book_id"]: r["outline"] for r in history.outline(df, budget).collect()}
        assert {r["book_id"]: r["outline"] for r in history.outline_by_ranges(df, budget).collect()} == want
    assert history.outline_by_ranges(df.limit(0)).collect() == []


def apart(a, b):
    """Whether words are equal, or a letter apart and long enough."""
    if a == b:
        return True
    if len(a) == len(b):
        return len(a) >= 5 and sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) >= 5 and len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_name_groups_are_components_in_bounded_parts(spark):
    import random
    import re

    from quire.operators import naming

    rng = random.Random(12)
    first = ["Ann", "Anna", "Robert", "Roberto", "Marta", "Martha", "Mr", "The", "Lou"]
    last = ["Vane", "Vanes", "Lee", "Harbour", "Harbor", "Stone", "Stonne", "King", "O'Hara", "Ōe"]
    rows = {(rng.choice("ab"), " ".join(rng.sample(first, rng.randint(0, 1)) + rng.sample(last, rng.randint(0, 1))), rng.choice(["character", "location"])) for _ in range(250)}
    rows |= {("c", f"Lord Nr{i}x Smith", "character") for i in range(57)} | {("a", "", "character"), ("a", "!!", "character")}
    names = sorted(rows)
    got = {(r["book_id"], r["name"], r["type"]): (r["component"], r["part"]) for r in naming.groups(spark.createDataFrame([*names, *names[:9], ("a", None, "x")], "book_id string, name string, type string"), 10).collect()}
    assert set(got) == set(names)

    def told(n):
        every = [w for w in re.split(r"[^\w]+", n.lower()) if w]
        return [w for w in every if w not in naming.TITLES] or every

    label = {n: n for n in names}
    changed = True
    while changed:
        changed = False
        for x in names:
            for y in names:
                if x[0] == y[0] and x[2] == y[2] and label[y] < label[x] and any(apart(a, b) for a in told(x[1]) for b in told(y[1])):
                    label[x], changed = label[y], True
    assert {n: c for n, (c, _) in got.items()} == {n: label[n][1] for n in names}
    from collections import Counter

    sizes = Counter((n[0], n[2], *got[n]) for n in names)
    assert max(sizes.values()) == 10 and {got[n][1] for n in names if n[0] == "c"} == set(range(6))


def test_mentions_meet_entities_in_one_join(spark):
    """A mention is joined to what its alias stands for, and its row is not shuffled by entity again."""
    from quire.plans import recipe_queries

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = recipe_queries.extracted_occurrences(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") == 2


def test_batches_are_taken_in_parts():
    import pyarrow as pa

    from quire.functions.batches import few

    b = pa.RecordBatch.from_pydict({"i": list(range(1000)), "t": ["x" * (5000 if i == 7 else 10) for i in range(1000)]})
    parts = list(few(b, 100, 4000))
    assert pa.Table.from_batches(parts).column("i").to_pylist() == list(range(1000))
    assert all(p.num_rows <= 100 and (p.nbytes <= 4000 or p.num_rows == 1) for p in parts) and not list(few(b.slice(0, 0)))
