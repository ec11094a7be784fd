"""Structured lookups of a library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.retrieval import in_scope, scoped


def contains(text: Column | str, term: str) -> Column:
    """Without case; % and _ in the term are wildcards, and an empty term is in every text."""
    return (F.col(text) if isinstance(text, str) else text).ilike(f"%{term}%")


def expand_section(sections: DataFrame, char_cap: int = 8000) -> DataFrame:
    return sections.select("section_id", F.substring("content", 1, char_cap).alias("content"))


def chapter(chapters: DataFrame, number: int) -> DataFrame:
    return chapters.where((F.col("number") == number) & F.col("is_body"))


def outline(chapters: DataFrame, up_to_chapter: int | None = None, chapter_: int | None = None) -> DataFrame:
    rows = chapters.where(F.col("is_body") & in_scope("number", up_to_chapter, chapter_))
    book = ["book_id"] if "book_id" in chapters.columns else []
    return rows.select(*book, "ordinal", "number", "title", "micro_summary", "summary").orderBy(*book, "ordinal")


def entities(entities_: DataFrame, occurrences: DataFrame, chapters: DataFrame, name: str, up_to_chapter: int | None = None, chapter_: int | None = None) -> DataFrame:
    """Entities by a part of their name or of an alias, with their occurrences in scope by offset.

    An entity without any keeps an empty list. One left join, for all entities at once.
    """
    found = entities_.where(contains("name", name) | F.coalesce(F.exists("aliases", lambda a: a.ilike(f"%{name}%")), F.lit(False)))
    here = scoped(occurrences.where("section_id IS NOT NULL"), chapters, up_to_chapter, chapter_)
    here = here.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("char_offset_start", "section_id", "char_offset_end", "context"))).alias("occurrences"))
    rows = found.join(here, "entity_id", "left")
    none = F.array().cast("array<struct<char_offset_start:int,section_id:string,char_offset_end:int,context:string>>")
    return rows.select("entity_id", "name", "entity_type", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("occurrences", none).alias("occurrences"))


def dates(dates_: DataFrame, chapters: DataFrame, query: str, limit: int = 20, up_to_chapter: int | None = None, chapter_: int | None = None) -> DataFrame:
    """By a part of the text, or by year where the query is four digits; the dated first, by date."""
    match = contains("raw_text", query)
    if len(query) == 4 and query.isdigit():
        match = match | F.coalesce(F.year("normalized_date").cast("string") == query, F.lit(False))
    return scoped(dates_.where(match), chapters, up_to_chapter, chapter_).orderBy(F.asc_nulls_last("normalized_date"), "char_offset_start", "section_id").limit(limit)


def events(events_: DataFrame, chapters: DataFrame, query: str, limit: int = 20, up_to_chapter: int | None = None, chapter_: int | None = None) -> DataFrame:
    rows = scoped(events_.where(contains("description", query)), chapters, up_to_chapter, chapter_)
    return rows.withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast("array<string>"))).orderBy("char_offset_start", "section_id", "description").limit(limit)


def forward_sections(hits: DataFrame, sections: DataFrame, chapters: DataFrame, after_ordinal: int, top: int = 3) -> DataFrame:
    """Hits (section_id, rank) in later chapters, in their order."""
    later = sections.join(chapters.where(F.col("ordinal") > after_ordinal).select("chapter_id"), "chapter_id", "left_semi").select("section_id")
    return hits.join(later, "section_id", "left_semi").orderBy("rank").limit(top)


def books(books_: DataFrame, chapters: DataFrame) -> DataFrame:
    """The library: each book with its number of chapters and its cover as a URL, the newest first."""
    n = chapters.groupBy("book_id").agg(F.count("chapter_id").alias("chapter_count"))
    url = F.concat(F.lit("data:"), F.col("cover_mime"), F.lit(";base64,"), F.base64("cover_data"))
    return books_.join(n, "book_id", "left").select("book_id", "title", "author", "status", "created_at", F.coalesce("chapter_count", F.lit(0)).alias("chapter_count"), url.alias("cover_url")).orderBy(F.desc("created_at"), "book_id")


def numbered(sections: DataFrame, chapters: DataFrame) -> DataFrame:
    """sections (section_id, chapter_id, ...) with the display number of each one's chapter, 0 where there is none."""
    numbers = chapters.select("chapter_id", "number")
    return sections.join(numbers, "chapter_id", "left").withColumn("number", F.coalesce("number", F.lit(0)))


def body_counts(sections: DataFrame) -> DataFrame:
    """(book_id, sections, body, body_chapters): sections, those of the body, and the chapters that have such."""
    chapter = F.countDistinct(F.when(F.col("is_body"), F.col("chapter_id")))
    return sections.groupBy("book_id").agg(F.count("*").alias("sections"), F.count_if("is_body").alias("body"), chapter.alias("body_chapters"))


def occurrence_text(found: DataFrame, most: int = 5, chars: int = 120) -> DataFrame:
    """(entity_id, text) of the rows of entities(): a head with the count, and a line for each of the first contexts that is not blank."""
    first = F.transform(F.slice("occurrences", 1, most), lambda o: F.trim(F.coalesce(o["context"], F.lit(""))))
    lines = F.transform(F.filter(first, lambda c: c != ""), lambda c: F.concat(F.lit("  • "), F.substring(c, 1, chars)))
    head = F.format_string("%s (%s): %d occurrence(s)", "name", "entity_type", F.size("occurrences"))
    return found.select("entity_id", F.array_join(F.concat(F.array(head), lines), "\n").alias("text"))


def unsummarized(books_: DataFrame) -> DataFrame:
    """Ready books without a summary."""
    return books_.where("status = 'ready' AND summary IS NULL")


def resume_plan(found: DataFrame, books_: DataFrame, chapters: DataFrame, reindex: bool = False) -> DataFrame:
    """(book_id, plan) of the books of found: ``skip`` where one is ready, ``resume`` where its chapters are stored, else ``store`` (all of them with reindex)."""
    rows = found.select("book_id").distinct().join(books_.select("book_id", "status"), "book_id", "left")
    rows = rows.join(chapters.select("book_id").distinct().withColumn("__stored", F.lit(True)), "book_id", "left")
    plan = F.when(F.lit(reindex), "store").when(F.col("status") == "ready", "skip").when(F.col("__stored"), "resume").otherwise("store")
    return rows.select("book_id", plan.alias("plan"))


def counts(chapters: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    one = lambda d, n: d.agg(F.count("*").alias(n))
    return one(chapters, "chapters").crossJoin(one(sections, "sections")).crossJoin(one(chunks, "chunks"))  # one row each
