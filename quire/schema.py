"""Tables of the engine. Ids are digests of natural keys, so that a recomputed row has the id it had."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = 1

TABLES: dict[str, str] = {
    "books": "book_id string, title string, author string, status string, embed_model string, embed_dim int, embed_version int, cover_mime string, cover_data binary, created_at timestamp, updated_at timestamp, source_hash string, summary string",
    "chapters": "book_id string, chapter_id string, ordinal int, title string, summary string, micro_summary string, is_body boolean, number int",
    "sections": "book_id string, chapter_id string, section_id string, ordinal int, content string, char_offset_start int, char_offset_end int, is_body boolean",
    "chunks": "book_id string, chapter_id string, section_id string, chunk_id string, ordinal int, content string, char_offset_start int, char_offset_end int, is_body boolean",
    "embeddings": "book_id string, chunk_id string, embedding array<float>",
    "postings": "book_id string, chapter_id string, section_id string, term string, positions array<int>, length int",
    "lengths": "book_id string, chapter_id string, section_id string, length int",
    "entities": "book_id string, entity_id string, name string, entity_type string, aliases array<string>",
    "occurrences": "book_id string, entity_id string, chapter_id string, section_id string, char_offset_start int, char_offset_end int, context string",
    "dates": "book_id string, chapter_id string, section_id string, raw_text string, normalized_date date, char_offset_start int, char_offset_end int, context string",
    "events": "book_id string, chapter_id string, section_id string, description string, event_date string, entity_ids array<string>, char_offset_start int, char_offset_end int",
    "ledger": "book_id string, stage string, unit_key string, payload string, updated_at timestamp",
}

#: Tables that a deleted chapter takes with it.
CHILDREN = ["sections", "chunks", "embeddings", "postings", "lengths", "occurrences", "dates", "events"]

#: What a model returns for a section.
EXTRACTION = (
    "struct<entities:array<struct<name:string,type:string,offset_start:int,offset_end:int>>,"
    "dates:array<struct<raw_text:string,normalized:string,offset_start:int,offset_end:int>>,"
    "events:array<struct<description:string,anchor_offset:string>>>"
)


def key(*parts: Column | str) -> Column:
    """The id of a natural key; nulls count as a part of their own."""
    parts = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.to_json(F.struct(*(p.cast("string").alias(f"k{i}") for i, p in enumerate(parts))), {"ignoreNullFields": "false"}), 256)
