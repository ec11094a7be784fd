"""The ledger of finished work: appended to, read by its latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL = "*"  # the unit that says a whole stage is done


def latest(ledger: DataFrame) -> DataFrame:
    """The last row of each (book_id, stage, unit_key); aggregated map-side, so a hot unit is one row a task."""
    rest = F.struct("updated_at", "payload")
    return ledger.groupBy("book_id", "stage", "unit_key").agg(F.max(rest).alias("last")).select("book_id", "stage", "unit_key", F.col("last.payload").alias("payload"), F.col("last.updated_at").alias("updated_at"))


def stage_done(ledger: DataFrame, book_id: str, stage: str) -> bool:
    return not ledger.where((F.col("book_id") == book_id) & (F.col("stage") == stage) & (F.col("unit_key") == ALL)).isEmpty()


def done_books(ledger: DataFrame, stage: str) -> DataFrame:
    """The books that a whole stage is done for."""
    return ledger.where((F.col("stage") == stage) & (F.col("unit_key") == ALL)).select("book_id").distinct()


def done_units(ledger: DataFrame, stage: str) -> DataFrame:
    return ledger.where((F.col("stage") == stage) & (F.col("unit_key") != ALL)).select("book_id", "unit_key").distinct()


def payloads(ledger: DataFrame, stage: str) -> DataFrame:
    return latest(ledger.where((F.col("stage") == stage) & (F.col("unit_key") != ALL))).where("payload IS NOT NULL").select("book_id", "unit_key", "payload")


def pending(units: DataFrame, ledger: DataFrame, stage: str, unit_col: str) -> DataFrame:
    """The units that the ledger has no row of."""
    done = done_units(ledger, stage).withColumnRenamed("unit_key", unit_col)
    return units.join(done, ["book_id", unit_col], "left_anti")


def pending_vectors(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Body chunks without a vector."""
    return chunks.where("is_body").join(embeddings.where("embedding IS NOT NULL").select("chunk_id"), "chunk_id", "left_anti")


def embedding_progress(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(book_id, chunks, embedded, pending) of the body chunks of each book."""
    has = embeddings.where("embedding IS NOT NULL").select("chunk_id", F.lit(1).alias("__has"))
    rows = chunks.where("is_body").join(has, "chunk_id", "left")
    return rows.groupBy("book_id").agg(F.count("*").alias("chunks"), F.count("__has").alias("embedded"), F.count_if(F.col("__has").isNull()).alias("pending"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows in place of those of their keys."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def without(tables: dict[str, DataFrame], doomed: DataFrame, key: str = "book_id") -> dict[str, DataFrame]:
    """Every table without the rows of the doomed keys, where it has that column."""
    return {n: t.join(doomed.select(key).distinct(), key, "left_anti") if key in t.columns else t for n, t in tables.items()}
