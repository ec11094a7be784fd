from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import columns as C
from quire.functions import english, passages
from quire.functions import questions as Q


def one(spark, c, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(c).first()[0]


@pytest.mark.parametrize(("q", "n"), [("7 quotes about love", 7), ("seven passages", 7), ("50 quotes", 50), ("chapter 7 quotes about warmth", None), ("7 quotes from chapter 3", 7), ("quotes please", None), ("three very short lines", 3), ("in 1984", None)])
def test_quote_count(spark, q, n):
    assert one(spark, Q.quote_count("q"), q=q) == n


@pytest.mark.parametrize(("n", "plan"), [(7, (7, 10)), (50, (12, 10)), (1, (1, 4)), (0, (3, 3)), (None, (3, 3))])
def test_quote_plan(spark, n, plan):
    assert tuple(spark.range(1).select(Q.quote_plan(F.lit(n).cast("int"))).first()[0]) == plan


@pytest.mark.parametrize(("q", "strict", "loose"), [("chapter 3", 3, 3), ("ch. 12", 12, 12), ("chap 4", 4, 4), ("the third chapter", 3, 3), ("chapter the second", 2, 2), ("3 quotes", None, 3), ("the fifth of May", None, 5), ("none", None, None)])
def test_chapters_of_questions(spark, q, strict, loose):
    assert (one(spark, Q.chapter_reference("q"), q=q), one(spark, Q.chapter_number("q"), q=q)) == (strict, loose)


@pytest.mark.parametrize(("q", "lexical", "dates"), [('who said "no way"', True, False), ("did Tom go", True, False), ("Did it rain", False, False), ("it was 1984", False, True), ("rain in may", False, True), ("on 3/4/1999", False, True)])
def test_nudges(spark, q, lexical, dates):
    assert (one(spark, Q.wants_lexical("q"), q=q), one(spark, Q.wants_dates("q"), q=q)) == (lexical, dates)


@pytest.mark.parametrize(("q", "name"), [("Where does Ada appear in the book?", "Ada"), ("find all occurrences of the lighthouse", "the lighthouse"), ("Where is the old man with Tom Sawyer and Huck seen", "Tom Sawyer Huck"), ("Ada", "Ada")])
def test_entity_names(spark, q, name):
    assert one(spark, Q.entity_name("q"), q=q) == name


def test_recipe_labels(spark):
    assert [one(spark, Q.recipe_label("q"), q=q) for q in (" Fact_Lookup.", "it is locate_entity or fact_lookup", "what?")] == ["fact_lookup", "fact_lookup", "generic_fallback"]


def test_titles_and_boilerplate(spark):
    assert one(spark, C.is_non_body("t"), t=" Table of Contents ") and not one(spark, C.is_non_body("t"), t="Contents of a box")
    text = "x *** START OF THE PROJECT GUTENBERG EBOOK A *** body *** END OF THE PROJECT GUTENBERG EBOOK A *** y"
    assert one(spark, C.strip_boilerplate("t"), t=text) == "body"
    assert one(spark, C.strip("t"), t="  a b \n") == "a b"
    assert [one(spark, C.token_count("t"), t=t) for t in ("", "abcd", "abcdefgh")] == [1, 1, 2]
    assert one(spark, C.display_title("t", F.lit(3)), t="") == "Chapter 3"
    assert one(spark, C.any_summary("t", F.lit("m"), "none"), t="") == "m"


@pytest.mark.parametrize(("s", "e", "want"), [(4, 7, (4, 7)), (99999, 88888, (4, 7)), (None, None, (4, 7)), (0, 2, (4, 7))])
def test_offset_recovery(spark, s, e, want):
    c = C.resolve_offsets(F.lit("the Cat sat"), F.lit("cat"), F.lit(s).cast("int"), F.lit(e).cast("int"))
    assert tuple(spark.range(1).select(c).first()[0]) == want


def test_offsets_of_what_is_not_there(spark):
    assert spark.range(1).select(C.resolve_offsets(F.lit("the cat"), F.lit("dog"), F.lit(0), F.lit(3))).first()[0] is None
    assert spark.range(1).select(C.resolve_offsets(F.lit("the cat"), F.lit(""), F.lit(None).cast("int"), F.lit(3))).first()[0] is None


def test_reader_replies(spark):
    get = lambda raw: tuple(one(spark, C.reader_reply("r"), r=raw))
    assert get('{"answer": " yes ", "verbatim_quotes": ["a"]}') == ("yes", ["a"])
    assert get('Sure: {"answer": "no", "verbatim_quotes": []} ok') == ("no", [])
    assert get(" plain ") == ("plain", [])
    assert get('{"answer": ""}') == ('{"answer": ""}', [])
    assert one(spark, C.fenced_json("r"), r='```json\n{"a": 1}\n```') == '{"a": 1}'


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("é", "é")])
def test_stems(word, stem):
    assert english.stem(word) == stem


def test_web_queries():
    words = lambda q: [[(tuple(w for w, _ in c.words), c.negative) for c in a] for a in english.parse(q)]
    assert words("the cats or dogs -bird") == [[(("cat",), False)], [(("dog",), False), (("bird",), True)]]
    assert words('"king of spain"') == [[(("king", "spain"), False)]]
    assert english.parse('"king of spain"')[0][0].words == (("king", 0), ("spain", 2))
    assert english.parse("the of and") == [] == english.parse("")


@pytest.mark.parametrize(
    ("source", "quote", "want"),
    [
        ("a line\nbreak here", "line break", ("line\nbreak", 2, 12)), ("he said “no”", 'said "no"', ("said “no”", 3, 12)),
        ("the oﬃce door", "office", ("oﬃce", 4, 8)), ("a b", "a b", ("a b", 0, 3)), ("The End", "the end", ("The End", 0, 7)),
        ("abc", "x", None), ("abc", " ", None), ("", "a", None), (None, "a", None), ("x ½ y", "1⁄", ("½", 2, 3)),
    ],
)
def test_quotes_are_found(source, quote, want):
    assert passages.locate(source, quote) == want


def test_markup():
    text, _ = passages.html_text("<html><script>x</script><p>a <b>b</b></p><p>c&amp;d<br>e</p></html>")
    assert text.split() == ["a", "b", "c&d", "e"]
    assert passages.html_text(None) == ("", []) == passages.html_text(b"")
    text, placed = passages.html_text("<h1 id='x'>A</h1><p id=y>b</p>", {"x": "<<1>>", "z": "<<2>>"})
    assert placed == ["x"] and text.index("<<1>>") < text.index("A")


def paragraphs(tokens):
    return "\n\n".join("x" * 200 for _ in range(tokens * 4 // 202 + 1))[: tokens * 4]


def test_sections_and_chunks():
    assert passages.sections("") == [] == passages.sections(None) == passages.sections("  \n ")
    short = paragraphs(500)
    assert passages.sections(short) == [(short.strip(), 0, len(short.strip()))]
    for tokens in (20_000, 20_100, 30_000):
        text = paragraphs(tokens)
        got = passages.sections(text)
        assert len(got) >= 2 and all(len(c) <= 40_000 and text[s:e] == c for c, s, e in got)
    text = " ".join(f"Sentence number {i} is here." for i in range(400))
    got = passages.chunks(text)
    assert all(a[2] > b[1] for a, b in zip(got, got[1:], strict=False)) and all(text[s:e].strip() == c for c, s, e in got)
    assert passages.chunks("A short one.") == [("A short one.", 0, 12)]
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice(["word ", ". ", "! ", "\n\n", "é", " "]) for _ in range(rng.randint(0, 900)))
        for size in (20, 60):
            ends = [e for _, _, e in passages.chunks(text, size, 5)]
            assert ends == sorted(ends)
        covered = "".join(c for c, _, _ in passages.sections(text, 30)).replace(" ", "").replace("\n", "")
        assert covered == text.replace(" ", "").replace("\n", "")


def test_late_breaks_are_hard_unless_asked():
    text = ("y" * 96 + ". ") * 500
    far = passages.sections(text, 100)[-5:]
    assert any(not c.endswith(".") for c, _, _ in far)
    assert all(c.endswith(".") for c, _, _ in passages.sections(text, 100, strict_window=True))


def test_long_paragraphs():
    text = " ".join(f"Sentence {i} ends." for i in range(300))
    got = passages.paragraph_sections(text, 10, 100)
    assert " ".join(c for c, _, _ in got) == text and got[0][1] == 10 and all(e - s == len(c) for c, s, e in got)


@pytest.mark.parametrize(("offset", "want"), [(4, (4, 7)), (None, (4, 7)), (9, None)])
def test_highlights(spark, offset, want):
    got = spark.range(1).select(C.highlight(F.lit("the cat sat"), F.lit("cat"), F.lit(offset).cast("int"))).first()[0]
    assert (got and tuple(got)) == want
