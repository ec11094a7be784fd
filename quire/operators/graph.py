"""Which entities share sections, and which sections to read for that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import patterns


def entity_sections(entities: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Each entity with its sections (a repeated one as often as it occurs), none as []."""
    at = occurrences.where("section_id IS NOT NULL").groupBy("book_id", "entity_id").agg(F.collect_list("section_id").alias("section_ids"))
    rows = entities.join(at, ["book_id", "entity_id"], "left")
    return rows.withColumn("section_ids", F.coalesce("section_ids", F.array().cast("array<string>"))).orderBy("name")


def edges(mentions: DataFrame, top: int | None = None) -> DataFrame:
    """(a, b, shared) of names a < b by the sections that both are in, from (section_id, name).

    The distinct names of a section are gathered, and pairs made within it: a section's pairs are bounded
    by its own names, and the sum is combined map-side.
    """
    rows = mentions.select("section_id", "name").where("section_id IS NOT NULL AND name IS NOT NULL")
    names = rows.groupBy("section_id").agg(F.sort_array(F.collect_set("name")).alias("names")).where(F.size("names") > 1)
    ahead = F.flatten(F.transform("names", lambda x, i: F.transform(F.slice("names", i + 2, F.size("names")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    out = names.select(F.explode(ahead).alias("e")).groupBy("e.a", "e.b").agg(F.count("*").cast("long").alias("shared"))
    out = out.orderBy(F.desc("shared"), "a", "b")
    return out if top is None else out.limit(top)


def edge_lines(top_edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(a, b, shared, block, line) of short edges: block ``people`` where both ends are persons, else ``places``."""
    person = entities.groupBy("name").agg(F.bool_or(F.col("entity_type") == "PERSON").alias("person"))
    rows = top_edges.join(person.select(F.col("name").alias("a"), F.col("person").alias("pa")), "a", "left").join(person.select(F.col("name").alias("b"), F.col("person").alias("pb")), "b", "left")
    block = F.when(F.col("pa") & F.col("pb"), "people").otherwise("places")
    return rows.select("a", "b", "shared", block.alias("block"), F.format_string("  %s + %s: %d", "a", "b", "shared").alias("line")).orderBy(F.desc("shared"), "a", "b")


def read_set(top_edges: DataFrame, mentions: DataFrame, event_sections: DataFrame, most: int = 8) -> DataFrame:
    """The sections to read: those of an edge and an event first, then by edges, names and id.

    top_edges is short (a limit made it) and joins by name.
    """
    rows = mentions.select("section_id", "name").where("section_id IS NOT NULL").distinct()
    first = top_edges.select("a", "b").join(rows.select("section_id", F.col("name").alias("a")), "a")
    both = first.join(rows.select("section_id", F.col("name").alias("b")), ["section_id", "b"])
    support = both.groupBy("section_id").agg(F.count("*").alias("support"))
    density = rows.groupBy("section_id").agg(F.count("*").alias("density"))
    events = event_sections.where("section_id IS NOT NULL").select("section_id").distinct().withColumn("event", F.lit(True))
    out = support.join(events, "section_id", "full").join(density, "section_id", "left")
    out = out.select("section_id", (F.col("support").isNotNull() & F.col("event").isNotNull()).alias("both"), F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("density", F.lit(0)).alias("density"))
    return out.orderBy(F.desc("both"), F.desc("support"), F.desc("density"), F.col("section_id").cast("string")).limit(most)


def principal_events(events: DataFrame, top_edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Events whose description names a person of the top edges, by name or alias; all events where there is no such person."""
    ends = top_edges.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    people = entities.where("entity_type = 'PERSON'").join(ends, "name", "left_semi")
    terms = people.select(F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("t")).select(F.lower("t").alias("t"))
    if terms.isEmpty():
        return events
    return patterns.holding(events, F.lower("description"), terms)
