"""Chapters to sections to overlapping chunks: one-to-many operators over Arrow batches.

Splitting is sequential in a text and independent across texts, so it needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from quire.functions import passages
from quire.functions.batches import few
from quire.schema import key


def explode_text(df: DataFrame, text_col: str, split: Callable[[str | None], list[tuple[str, int, int]]], keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ordinal (from 0), content, char_start and char_end of each part."""
    schema = df.select(*keep).schema.add("ordinal", IntegerType()).add("content", StringType()).add("char_start", IntegerType()).add("char_end", IntegerType())

    def run(batches):
        for b in batches:
            for part in few(b):
                rows, found = [], []
                for i, text in enumerate(part.column(len(keep)).to_pylist()):
                    for n, got in enumerate(split(text)):
                        rows.append(i)
                        found.append((n, *got))
                cols = list(zip(*found, strict=True)) or [(), (), (), ()]
                kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32()]
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in range(len(keep))), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [*keep, "ordinal", "content", "char_start", "char_end"])

    return df.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def sections(chapters: DataFrame, cap_tokens: int = passages.SECTION_TOKENS, strict_window: bool = False, text_col: str = "text") -> DataFrame:
    """Rows of the table sections, from book_id, chapter_id, is_body and text."""
    parts = explode_text(chapters, text_col, lambda t: passages.sections(t, cap_tokens, strict_window), ["book_id", "chapter_id", "is_body"])
    return parts.select("book_id", "chapter_id", key("chapter_id", "ordinal").alias("section_id"), "ordinal", "content", F.col("char_start").alias("char_offset_start"), F.col("char_end").alias("char_offset_end"), "is_body")


def chunks(sections_: DataFrame, chunk_tokens: int = passages.CHUNK_TOKENS, overlap_tokens: int = passages.OVERLAP_TOKENS) -> DataFrame:
    """Rows of the table chunks; offsets are those of the chapter."""
    keep = ["book_id", "chapter_id", "section_id", "char_offset_start", "is_body"]
    parts = explode_text(sections_, "content", lambda t: passages.chunks(t, chunk_tokens, overlap_tokens), keep)
    at = F.col("char_offset_start")
    return parts.select("book_id", "chapter_id", "section_id", key("section_id", "ordinal").alias("chunk_id"), "ordinal", "content", (at + F.col("char_start")).alias("char_offset_start"), (at + F.col("char_end")).alias("char_offset_end"), "is_body")


def gate(chapters: DataFrame, sections_: DataFrame, chunks_: DataFrame, raw: DataFrame, cap_tokens: int = passages.SECTION_TOKENS, most_chapters: int = 10_000, widest: int = 500, least_sections: int = 10, tiny_chars: int = 100, most_tiny: float = 0.40, drift: float = 0.25) -> DataFrame:
    """(book_id, issues) for each book of raw (book_id, raw_length); a book passes with no issues.

    One grouped aggregate of each table, joined by book.
    """
    body, size = F.col("is_body"), F.length("content")
    synthetic = F.bool_or("is_synthetic") if "is_synthetic" in chapters.columns else F.lit(False)
    c = chapters.groupBy("book_id").agg(F.count("*").alias("n"), F.count_if(body).alias("n_body"), F.coalesce(synthetic, F.lit(False)).alias("synthetic"))
    over = F.greatest(F.lit(1), F.ceil(size / 4)) > cap_tokens
    s = sections_.groupBy("book_id").agg(
        F.count_if(over).alias("over"), F.max(F.when(over, F.ceil(size / 4))).alias("worst"), F.sum(size).alias("total"),
        F.count_if(body).alias("s_body"), F.min(F.when(body, size)).alias("least"), F.max(F.when(body, size)).alias("most"), F.count_if(body & (size < tiny_chars)).alias("tiny"),
    )
    k = chunks_.groupBy("book_id").agg(F.count_if(body).alias("k_body"))
    books = raw.join(c, "book_id", "left").join(s, "book_id", "left").join(k, "book_id", "left").na.fill(0).na.fill(False)
    ratio = F.try_divide(F.col("total"), F.col("raw_length"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    rules = [
        F.when(~F.col("synthetic") & (F.col("n_body") < 1), F.lit("too few body chapters")),
        F.when(F.col("n") > most_chapters, text("too many chapters: ", F.col("n"))),
        F.when(F.col("over") > 0, text(F.col("over"), f" sections over the cap of {cap_tokens} tokens, the worst of ", F.col("worst").cast("long"))),
        F.when((F.col("least") > 0) & (F.try_divide(F.col("most"), F.col("least")) > widest), text("section sizes from ", F.col("least"), " to ", F.col("most"))),
        F.when((F.col("s_body") >= least_sections) & (F.try_divide(F.col("tiny"), F.col("s_body")) > most_tiny), text("over-segmented: ", F.col("tiny"), " of ", F.col("s_body"), " body sections are tiny")),
        F.when((F.col("raw_length") > 0) & ((ratio < 1 - drift) | (ratio > 1 + drift)), text("text of ", F.col("total"), " characters from ", F.col("raw_length"))),
        F.when(F.col("k_body") < 1, F.lit("no body chunks")),
    ]
    return books.select("book_id", F.filter(F.array(*rules), lambda x: x.isNotNull()).alias("issues"))
