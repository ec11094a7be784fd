"""From what models extract to entities, occurrences, dates and events.

Inputs: payloads (book_id, chapter_id, section_id, content, char_offset_start, payload as a struct) and clusters
(book_id, position, canonical, type, aliases).

Names, types and raw texts count without the white space around them. Types are ``character`` and ``location``, as models are asked for; what has
another type is no entity. An event needs a whole number as its anchor, within its section; others are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import columns as C
from quire.operators import patterns
from quire.schema import key

TYPES = ("character", "location")


def _stripped(text: Column | str) -> Column:
    return F.coalesce(C.strip(text), F.lit(""))


def candidates(payloads: DataFrame) -> DataFrame:
    """(book_id, name, type): each extracted name once, the last section's type (by section id)."""
    rows = payloads.select("book_id", "section_id", F.posexplode("payload.entities").alias("i", "e"))
    rows = rows.select("book_id", "section_id", "i", _stripped("e.name").alias("name"), _stripped("e.type").alias("type"))
    return rows.where((F.col("name") != "") & F.col("type").isin(*TYPES)).groupBy("book_id", "name").agg(F.max_by("type", F.struct("section_id", "i")).alias("type"))


def aliases(clusters: DataFrame) -> DataFrame:
    """(book_id, alias, canonical, entity_type, aliases, since): what lower-case names and aliases stand for; a later cluster's claim wins.

    since is the place (position, number) where the alias is named first.
    """
    rows = clusters.select("book_id", "position", _stripped("canonical").alias("canonical"), _stripped("type").alias("type"), F.coalesce("aliases", F.array().cast("array<string>")).alias("given"))
    rows = rows.where((F.col("canonical") != "") & F.col("type").isin(*TYPES))
    rows = rows.withColumn("given", F.filter(F.transform("given", _stripped), lambda a: a != ""))
    named = rows.select("book_id", "position", "canonical", C.entity_type("type").alias("entity_type"), "given", F.posexplode(F.concat(F.array("canonical"), "given")).alias("n", "alias"))
    at = F.struct("position", "n")
    each = named.groupBy("book_id", F.lower("alias").alias("alias")).agg(F.max_by(F.struct("canonical", "entity_type", F.col("given").alias("aliases")), at).alias("means"), F.min(at).alias("since"))
    return each.select("book_id", "alias", "means.canonical", "means.entity_type", "means.aliases", "since")


def entities(clusters: DataFrame) -> DataFrame:
    """Rows of the table entities: each (name, type) that some alias stands for, with the aliases of its first claim."""
    rows = aliases(clusters).groupBy("book_id", F.col("canonical").alias("name"), "entity_type").agg(F.min_by("aliases", "since").alias("aliases"))
    return rows.select("book_id", key("book_id", "name", "entity_type").alias("entity_id"), "name", "entity_type", "aliases")


def _placed(payloads: DataFrame, field: str, name: str) -> DataFrame:
    rows = payloads.select("book_id", "chapter_id", "section_id", "content", F.col("char_offset_start").alias("base"), F.explode(f"payload.{field}").alias("e"))
    rows = rows.withColumn("said", _stripped(f"e.{name}")).where("said != ''")
    rows = rows.withColumn("at", C.resolve_offsets(F.col("content"), F.col("said"), F.col("e.offset_start"), F.col("e.offset_end")))
    return rows.where("at IS NOT NULL").withColumns(
        {
            "context": C.snippet(F.col("content"), F.col("at.start"), F.col("at.end")),
            "char_offset_start": C.global_offset("base", "at.start"),
            "char_offset_end": C.global_offset("base", "at.end"),
        }
    )


def named_occurrences(payloads: DataFrame, alias_map: DataFrame, entities_: DataFrame) -> DataFrame:
    """Mentions whose text is in the section and whose name some cluster knows, with the entity's name and type; offsets are the chapter's.

    A name of two types is two entities. What an alias stands for is found first, in small rows, so that the mentions meet it in one join and
    no other has to follow.
    """
    rows = _placed(payloads, "entities", "name").withColumn("alias", F.lower("said"))
    named = entities_.select("book_id", "entity_id", F.col("name").alias("canonical"), "entity_type")
    known = alias_map.select("book_id", "alias", "canonical", "entity_type").join(named, ["book_id", "canonical", "entity_type"])
    return rows.join(known, ["book_id", "alias"]).select("book_id", "entity_id", "chapter_id", "section_id", "char_offset_start", "char_offset_end", "context", F.col("canonical").alias("name"), "entity_type")


def occurrences(payloads: DataFrame, alias_map: DataFrame, entities_: DataFrame) -> DataFrame:
    """Rows of the table occurrences."""
    return named_occurrences(payloads, alias_map, entities_).drop("name", "entity_type")


def dates(payloads: DataFrame) -> DataFrame:
    """Dates whose text is in the section; a normalized form that is no date is null."""
    rows = _placed(payloads, "dates", "raw_text")
    return rows.select("book_id", "chapter_id", "section_id", F.col("said").alias("raw_text"), F.try_to_date("e.normalized", "yyyy-MM-dd").alias("normalized_date"), "char_offset_start", "char_offset_end", "context")


def events(payloads: DataFrame, entities_: DataFrame) -> DataFrame:
    """Events with an anchor in their section, and the book's entities that the description names, in order of id (null for none).

    All books' names are one set of patterns, so a description is read once, and only names that it holds meet the entities of its book.
    """
    rows = payloads.select("book_id", "chapter_id", "section_id", F.length("content").alias("n"), F.col("char_offset_start").alias("base"), F.posexplode("payload.events").alias("i", "e"))
    rows = rows.withColumns({"description": _stripped("e.description"), "anchor": F.col("e.anchor_offset").try_cast("double").cast("long")})
    rows = rows.where("description != '' AND anchor >= 0 AND anchor < n").select("book_id", "chapter_id", "section_id", "i", "description", C.global_offset("base", F.col("anchor").cast("int")).alias("at"))
    held = patterns.marked(rows, F.lower("description"), entities_.select(F.lower("name")))
    names = entities_.select("book_id", "entity_id", F.lower("name").alias("pattern"))
    unit = ["book_id", "chapter_id", "section_id", "i", "description", "at"]
    each = held.select(*unit, F.explode_outer(F.transform("found", lambda f: f["pattern"])).alias("pattern")).join(names, ["book_id", "pattern"], "left")
    out = each.groupBy(*unit).agg(F.array_sort(F.collect_set("entity_id")).alias("ids"))
    return out.select("book_id", "chapter_id", "section_id", "description", F.lit(None).cast("string").alias("event_date"), F.when(F.size("ids") > 0, F.col("ids")).alias("entity_ids"), F.col("at").alias("char_offset_start"), F.col("at").alias("char_offset_end"))
