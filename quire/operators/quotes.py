"""Quotes: their place in the source, one of each, and citations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from quire.functions import passages
from quire.operators import patterns


def comparable(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """df and the text's comparable form."""
    return _mapped(df, [text_col], f"{out} string", lambda t: {out: None if t is None else passages.comparable(t)})


def locate(df: DataFrame, source_col: str, quote_col: str) -> DataFrame:
    """df with quote_text, quote_start and quote_end; nulls where the source doesn't hold the quote."""

    def one(source, quote):
        got = passages.locate(source, quote)
        return dict(zip(("quote_text", "quote_start", "quote_end"), got or (None, None, None), strict=True))

    return _mapped(df, [source_col, quote_col], "quote_text string, quote_start int, quote_end int", one)


def _mapped(df: DataFrame, inputs: list[str], added: str, one) -> DataFrame:
    names = df.columns
    schema = StructType(list(df.schema.fields))
    fields = [x.split() for x in added.split(", ")]
    for n, kind in fields:
        schema = schema.add(n, {"string": StringType(), "int": IntegerType()}[kind])
    kinds = {"string": pa.string(), "int": pa.int32()}
    at = [names.index(c) for c in inputs]

    def run(batches):
        for b in batches:
            got = [one(*row) for row in zip(*(b.column(i).to_pylist() for i in at), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([g[n] for g in got], kinds[k]) for n, k in fields)], [*names, *(n for n, _ in fields)])

    return df.mapInArrow(run, schema)


def select(quotes: DataFrame, want: int = 3) -> DataFrame:
    """Of (answer_id, result_no, quote_no, norm, ...) the first of each norm of an answer, ``want`` of them at most."""
    order = W.partitionBy("answer_id").orderBy("result_no", "quote_no")
    first = F.row_number().over(W.partitionBy("answer_id", "norm").orderBy("result_no", "quote_no"))
    kept = quotes.withColumn("__first", first).where("__first = 1").drop("__first")
    return kept.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= want).drop("__n")


def citations(results: DataFrame) -> DataFrame:
    """(answer_id, section_id, chapter, position): one for each section of (answer_id, result_no, section_id, chapter), in order of first use."""
    rows = results.groupBy("answer_id", "section_id").agg(F.min(F.struct("result_no", "chapter")).alias("first"))
    at = F.row_number().over(W.partitionBy("answer_id").orderBy("first.result_no"))
    return rows.select("answer_id", "section_id", F.col("first.chapter").alias("chapter"), at.alias("position"))


def find_all(docs: DataFrame, items: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, item_id, quote_start, quote_end): the first place of each quote of items (item_id, quote) in each text of docs (doc_id, text)."""
    held = patterns.marked(docs.select("doc_id", "text"), F.col("text"), items.select("quote"), most_bytes=most_bytes)
    rows = held.select("doc_id", F.explode("found").alias("f")).select("doc_id", F.col("f.pattern").alias("quote"), F.col("f.start").alias("quote_start"))
    rows = rows.join(items.select("item_id", "quote"), "quote")
    return rows.select("doc_id", "item_id", "quote_start", (F.col("quote_start") + F.length("quote")).alias("quote_end"))
