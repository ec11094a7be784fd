"""Search over a library: chapter scopes, full text, vectors, dates, and their fusion.

Searches return (section_id, rank) or scores. Ties are broken by reading order or id, so that
every result is one result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import english, questions
from quire.functions.batches import few

FUSION_K, LEXICAL_BOOST, DATE_WEIGHT, READ_FIRST = 60, 1.5, 0.5, 3


def in_scope(number: Column | str, up_to_chapter: int | None = None, chapter: int | None = None) -> Column:
    """Both bounds hold; a chapter without a number is outside either."""
    n = F.col(number) if isinstance(number, str) else number
    conditions = [n <= up_to_chapter] if up_to_chapter is not None else []
    conditions += [n == chapter] if chapter is not None else []
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def scoped(rows: DataFrame, chapters: DataFrame, up_to_chapter: int | None = None, chapter: int | None = None) -> DataFrame:
    """The rows whose chapter is in scope: a semi join on the filtered chapters, none without bounds."""
    if up_to_chapter is None and chapter is None:
        return rows
    return rows.join(chapters.where(in_scope("number", up_to_chapter, chapter)).select("chapter_id"), "chapter_id", "left_semi")


# full text


def postings(sections: DataFrame) -> DataFrame:
    """(book_id, chapter_id, section_id, term, positions, length) of each stem of each section, body or not."""
    schema = "book_id string, chapter_id string, section_id string, term string, positions array<int>, length int"

    def run(batches):
        vocabulary = english.Vocabulary()
        for b in batches:
            for part in few(b):
                text, term, position, length = vocabulary.postings(part.column(3).to_pylist(), by_text=True)
                first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (text[1:] != text[:-1])])) if len(term) else np.zeros(0, np.int64)
                of, names = pa.array(text[first]), pa.array([vocabulary.stems[t] for t in term[first].tolist()], pa.string())
                at = pa.ListArray.from_arrays(pa.array(np.append(first, len(term)).astype(np.int32)), pa.array(position.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(of) for i in range(3)), names, at, pa.array(length[text[first]].astype(np.int32))], ["book_id", "chapter_id", "section_id", "term", "positions", "length"])

    kept = sections.select(F.col("book_id").cast("string"), F.col("chapter_id").cast("string"), F.col("section_id").cast("string"), "content")
    return kept.mapInArrow(run, schema)


def _query(query: str) -> tuple[list[list[english.Clause]], list[str]]:
    """The alternatives that can match, and all their words; one that only excludes has nothing to rank by, and matches nothing."""
    alternatives = [a for a in english.parse(query) if not all(c.negative for c in a)]
    return alternatives, sorted({w for a in alternatives for c in a for w, _ in c.words})


def scan_terms(sections: DataFrame, words: list[str]) -> DataFrame:
    """(section_id, is_body, length, at) of each section: its number of terms, and where those of ``words`` stand (stem -> positions).

    Without an index, in one Arrow pass: only words that start like a stem of ``words`` (a stem differs from its word in its last
    two letters at most) go to the stemmer.
    """
    starts, wanted = tuple(sorted({w[: max(1, len(w) - 2)] for w in words})), frozenset(words)

    def one(text: str | None) -> tuple[int, list]:
        found = english.words(text)
        at: dict[str, list[int]] = {}
        for i, w in enumerate(found, 1):
            if w.startswith(starts) and w not in english.STOP and (t := english.stem(w)) in wanted:
                at.setdefault(t, []).append(i)
        return len(found) - sum(map(english.STOP.__contains__, found)), list(at.items())

    def run(batches):
        for b in batches:
            for part in few(b):
                got = [one(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([n for n, _ in got], pa.int32()), pa.array([at for _, at in got], pa.map_(pa.string(), pa.list_(pa.int32())))], ["section_id", "is_body", "length", "at"])

    kind = sections.schema["section_id"].dataType.simpleString()
    rows = sections.select("section_id", "is_body", F.col("content").cast("string"))
    return rows.mapInArrow(run, f"section_id {kind}, is_body boolean, length int, at map<string,array<int>>").where("length > 0")


def _best(per: DataFrame, alternatives: list[list[english.Clause]], stats, top_k: int) -> DataFrame:
    """(section_id, score) of the top_k rows of per (section_id, length, at) that satisfy the query, by BM25 over its positive words.

    stats has the number of sections (n), their mean length (l) and, by word, in how many of them it is (d0, d1, ...).
    """
    words = sorted({w for a in alternatives for c in a for w, _ in c.words})

    def holds(c: english.Clause) -> Column:
        at = lambda w: F.try_element_at("at", F.lit(w))
        (first, _), *rest = c.words
        here = at(first).isNotNull()
        if rest:
            here = F.exists(F.coalesce(at(first), F.array().cast("array<int>")), lambda p: reduce(lambda x, y: x & y, (F.coalesce(F.array_contains(at(w), p + d), F.lit(False)) for w, d in rest)))
        return ~here if c.negative else here

    match = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, map(holds, a)) for a in alternatives))
    score, wanted = F.lit(0.0), {w for a in alternatives for c in a if not c.negative for w, _ in c.words}
    for i, w in enumerate(words):
        if w in wanted:
            tf = F.coalesce(F.size(F.try_element_at("at", F.lit(w))), F.lit(0))
            tf = F.when(tf > 0, tf).otherwise(0).cast("double")
            idf = F.log(F.lit(1 + (stats["n"] - stats[f"d{i}"] + 0.5) / (stats[f"d{i}"] + 0.5)))
            score = score + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("length") / (stats["l"] or 1.0)))
    return per.where(match).select("section_id", score.alias("score")).orderBy(F.desc("score"), "section_id").limit(top_k)


def section_lengths(posts: DataFrame) -> DataFrame:
    """(book_id, chapter_id, section_id, length) of each section with terms: what scores need to know of all sections."""
    return posts.groupBy("book_id", "chapter_id", "section_id").agg(F.max("length").alias("length"))


def lexical_search(posts: DataFrame, sections: DataFrame, query: str, top_k: int = 20, lengths: DataFrame | None = None) -> DataFrame:
    """(section_id, score) of the best body sections that satisfy the query, from the postings.

    Of the postings those of the query's words alone are read (a pushed filter on term), and a section's meet in one
    small group, at most one row a word. The number of sections and their mean length come from ``lengths`` (section_lengths()), a
    row a section; without it, from all postings.
    """
    alternatives, words = _query(query)
    if not words:
        return sections.select("section_id", F.lit(0.0).alias("score")).limit(0)
    stats = (section_lengths(posts) if lengths is None else lengths).agg(F.count("*").alias("n"), F.avg("length").alias("l")).first().asDict()
    # a section has one row of a term
    held = {r["term"]: r["n"] for r in posts.where(F.col("term").isin(words)).groupBy("term").agg(F.count("*").alias("n")).collect()}
    stats |= {f"d{i}": held.get(w, 0) for i, w in enumerate(words)}
    hits = posts.where(F.col("term").isin(words)).join(sections.where("is_body").select("section_id"), "section_id")
    per = hits.groupBy("section_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"), F.max("length").alias("length"))
    return _best(per, alternatives, stats, top_k)


def text_search(sections: DataFrame, query: str, top_k: int = 20) -> DataFrame:
    """As lexical_search, from the texts themselves (section_id, is_body, content): two scans of them, and no index."""
    alternatives, words = _query(query)
    if not words:
        return sections.select("section_id", F.lit(0.0).alias("score")).limit(0)
    every = scan_terms(sections, words)
    has = (F.coalesce(F.sum(F.map_contains_key("at", F.lit(w)).cast("int")), F.lit(0)).alias(f"d{i}") for i, w in enumerate(words))
    stats = every.agg(F.count("*").alias("n"), F.avg("length").alias("l"), *has).first()
    return _best(every.where("is_body"), alternatives, stats, top_k)


# vectors


def cosine_distance(vector: Column | str, query: list[float]) -> Column:
    """Null for a vector without direction or of another dimension."""
    v = F.col(vector) if isinstance(vector, str) else vector
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return 1 - F.try_divide(dot, norm * float(sum(x * x for x in query) ** 0.5))


def semantic_search(vectors: DataFrame, query: list[float], top_k: int = 20) -> DataFrame:
    """(section_id, distance): of the 4 * top_k nearest body chunks, each section's nearest, the top_k of them.

    vectors: section_id, chunk_id, is_body, embedding. The query is a literal of the plan, both cuts are
    TakeOrderedAndProject, so only 4 * top_k rows leave the tasks.
    """
    near = vectors.where("is_body AND embedding IS NOT NULL").select("section_id", "chunk_id", cosine_distance("embedding", query).alias("distance"))
    near = near.orderBy(F.asc_nulls_last("distance"), "chunk_id").limit(4 * top_k)
    best = near.groupBy("section_id").agg(F.min("distance").alias("distance"))
    return best.orderBy(F.asc_nulls_last("distance"), "section_id").limit(top_k)


# dates


def date_sections(dates: DataFrame, query: str, spark=None, top_k: int = 10) -> DataFrame:
    """section_ids of dates whose text holds a date-like word of the query, in order of id."""
    import re

    tokens = re.findall(questions.DATE, query, re.IGNORECASE)
    if not tokens:
        return dates.select("section_id").limit(0)
    match = reduce(lambda a, b: a | b, (F.col("raw_text").ilike(f"%{t}%") for t in tokens))
    return dates.where(F.col("section_id").isNotNull() & match).select("section_id").distinct().orderBy("section_id").limit(top_k)


# fusion


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """(section_id, rank from 1) of a list that a limit has made short."""
    return df.select("section_id", F.row_number().over(W.orderBy(*order)).alias("rank"))


def fuse(lists: list[DataFrame], weights: list[float] | None = None, k: int = FUSION_K) -> DataFrame:
    """(section_id, score, list_no, rank): the sum of weight / (k + rank) over the lists; ties in order of first list, then rank."""
    weights = [1.0] * len(lists) if weights is None else weights
    if len(weights) != len(lists):
        raise ValueError("a weight for each list is needed")
    if not lists:
        raise ValueError("no lists")
    rows = [d.select("section_id", "rank", F.lit(i).alias("list_no"), F.lit(float(w)).alias("w")) for i, (d, w) in enumerate(zip(lists, weights, strict=True))]
    every = reduce(DataFrame.unionByName, rows)
    out = every.groupBy("section_id").agg(F.sum(F.col("w") / (F.col("rank") + k)).alias("score"), F.min(F.struct("list_no", "rank")).alias("first"))
    return out.select("section_id", "score", F.col("first.list_no").alias("list_no"), F.col("first.rank").alias("rank")).orderBy(F.desc("score"), "list_no", "rank", "section_id")


def hybrid_search(lexical: DataFrame, semantic: DataFrame, dates: DataFrame | None, boost_lexical: bool, top_k: int = 10) -> DataFrame:
    """The fusion of a lexical (section_id, score), a semantic (section_id, distance) and maybe a date list."""
    lists = [ranked(lexical, F.desc("score"), F.asc("section_id")), ranked(semantic, F.asc_nulls_last("distance"), F.asc("section_id"))]
    weights = [LEXICAL_BOOST if boost_lexical else 1.0, 1.0]
    if dates is not None:
        lists.append(ranked(dates, F.asc("section_id")))
        weights.append(DATE_WEIGHT)
    return fuse(lists, weights).select("section_id", "score").limit(top_k)


def first_sections(hits: DataFrame, n: int = READ_FIRST) -> DataFrame:
    """The first n of a search's hits, which are those that are read."""
    return hits.limit(n)
