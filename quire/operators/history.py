"""Conversations: their last turns, as text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as _arrow_type

from quire.sources.store import scratch


def cap(turns: DataFrame, most_turns: int = 6, most_chars: int = 500) -> DataFrame:
    """The last turns of each conversation (conv_id, turn, role, text), long ones cut with an ellipsis."""
    back = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    cut = F.concat(F.regexp_replace(F.substring("text", 1, most_chars), r"\s+$", ""), F.lit("…"))
    return turns.withColumn("__back", back).where(F.col("__back") <= most_turns).drop("__back").withColumn("text", F.when(F.length("text") > most_chars, cut).otherwise(F.coalesce("text", F.lit(""))))


def render(turns: DataFrame, assistant: str = "Assistant") -> DataFrame:
    """(conv_id, history): a line for each turn, in order; any role but user is the assistant."""
    line = F.concat(F.when(F.col("role") == "user", "User").otherwise(assistant), F.lit(": "), F.col("text"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return rows.select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("history"))


def _parts(chapters: DataFrame, budget: int) -> DataFrame:
    """(book_id, ordinal, head, full, micro): what an outline may hold of each chapter. A summary beyond the budget can never be part of one, so it goes no further."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    title = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Chapter "), F.col("number").cast("string")))
    head = F.concat(F.lit("[Chapter "), F.col("number").cast("string"), F.lit(" — "), title, F.lit("]\n"))
    full = F.when(F.length(text("summary")) <= budget, text("summary")).otherwise("")
    return chapters.select("book_id", "ordinal", head.alias("head"), full.alias("full"), text("micro_summary").alias("micro"))


def outline(chapters: DataFrame, budget: int = 8000) -> DataFrame:
    """(book_id, outline): chapters in order, each with its summary while the total stays within the budget, else with its micro summary.

    A book's chapters meet in one row; where books are as large as sources of a corpus, outline_by_ranges splits them.
    """
    rows = _parts(chapters, budget).groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "head", "full", "micro"))).alias("chapters"))
    # only the places of full summaries are carried along, so that a step's cost does not grow with the chapters before it
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("full"))

    def step(acc, c):
        fits = (c["full"] != "") & (acc["used"] + F.length(c["full"]) <= budget)
        used = acc["used"] + F.length(F.when(fits, c["full"]).otherwise(c["micro"]))
        return F.struct(used.alias("used"), (acc["at"] + 1).alias("at"), F.when(fits, F.concat(acc["full"], F.array(acc["at"]))).otherwise(acc["full"]).alias("full"))

    def joined(acc):
        part = lambda c, i: F.concat(c["head"], F.nullif(F.when(F.array_contains(acc["full"], i), c["full"]).otherwise(c["micro"]), F.lit("")))
        return F.array_join(F.transform("chapters", part), "\n\n")

    return rows.select("book_id", F.aggregate("chapters", start, step, joined).alias("outline"))


def outline_by_ranges(chapters: DataFrame, budget: int = 8000) -> DataFrame:
    """As outline, for books of any number of chapters.

    Whether a summary fits depends on all chapters before it, but on nothing of them save how much of the budget is used. So all chapters
    are sorted into ranges of a task each, and a range says of its part of a book what every amount used before it becomes (a table of
    budget + 2 numbers, the last for all that is beyond the budget). These tables are few; followed from one range to the next, they give each range the amount that it
    starts with, and then it decides for its own chapters. No task holds a book, and no row more of one than its outline.
    """
    parts = int(chapters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = _parts(chapters, budget).repartitionByRange(parts, "book_id", "ordinal").sortWithinPartitions("book_id", "ordinal", "head", "full", "micro")
    # numbers of one range differ in their low bits alone
    rows = scratch(ordered.select(F.monotonically_increasing_id().alias("no"), "*")).withColumn("part", F.shiftright("no", 33))
    book = rows.schema["book_id"].dataType.simpleString()
    in_order = lambda df: df.repartition("part").sortWithinPartitions("part", "no")

    def effects(batches):
        here, table = None, None
        amounts = np.arange(budget + 2)
        for b in batches:
            for part, name, full, micro in zip(*(c.to_pylist() for c in b.columns[:4]), strict=True):
                if (part, name) != here:
                    if here is not None:
                        yield effect(*here, table)
                    here, table = (part, name), amounts.copy()
                fits = (table + full <= budget) if full else np.zeros(budget + 2, bool)
                table = np.minimum(table + np.where(fits, full, micro), budget + 1)
        if here is not None:
            yield effect(*here, table)

    kind = _arrow_type(rows.schema["book_id"].dataType)

    def effect(part, name, table):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name], kind), pa.array([table.astype(np.int32).tobytes()], pa.binary())], ["part", "book_id", "effect"])

    def followed(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        used, before = 0, []
        for e in t.column("effect").to_pylist():
            before.append(used)
            used = int(np.frombuffer(e, np.int32)[used])
        return pa.table({"of": t.column("part"), "book": t.column("book_id"), "used": pa.array(before, pa.int32())})

    lengths = rows.select("part", "book_id", F.length("full").alias("full"), F.length("micro").alias("micro"), "no")
    found = in_order(lengths).mapInArrow(effects, f"part long, book_id {book}, effect binary")
    start = found.groupBy("book_id").applyInArrow(followed, f"of long, book {book}, used int")

    def decided(batches):
        here, used = None, 0
        for b in batches:
            chosen = []
            names = b.schema.names
            cols = [b.column(names.index(c)).to_pylist() for c in ("part", "book_id", "used", "n_full", "n_micro")]
            for part, name, begin, full, micro in zip(*cols, strict=True):
                if (part, name) != here:
                    here, used = (part, name), begin
                fits = bool(full) and used + full <= budget
                chosen.append(fits)
                used += full if fits else micro
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(chosen, pa.bool_())], [*names[:5], "chosen"])

    both = rows.join(start, (F.col("part") == F.col("of")) & F.col("book_id").eqNullSafe(F.col("book")))
    both = both.select("book_id", "no", "head", "full", "micro", "part", "used", F.length("full").alias("n_full"), F.length("micro").alias("n_micro"))
    out = in_order(both).mapInArrow(decided, f"book_id {book}, no long, head string, full string, micro string, chosen boolean")
    piece = F.concat("head", F.nullif(F.when(F.col("chosen"), F.col("full")).otherwise(F.col("micro")), F.lit("")))
    lines = out.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("no", piece.alias("text")))).alias("lines"))
    return lines.select("book_id", F.array_join(F.transform("lines", lambda x: x["text"]), "\n\n").alias("outline"))


def evidence(results: DataFrame) -> DataFrame:
    """(conv_id, evidence): each result (result_no, chapter, answer, quotes) under its number, in order, with its quotes where it has any."""
    quoted = F.array_join(F.transform("quotes", lambda q: F.concat(F.lit('"'), q, F.lit('"'))), " | ")
    said = F.when(F.size("quotes") > 0, F.concat(F.lit("\nQuotes: "), quoted)).otherwise("")
    one = F.concat(F.lit("[Source "), F.col("result_no").cast("string"), F.lit(" — chapter "), F.col("chapter").cast("string"), F.lit("]\n"), F.col("answer"), said)
    rows = results.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("result_no", one.alias("text")))).alias("r"))
    return rows.select("conv_id", F.array_join(F.transform("r", lambda x: x["text"]), "\n\n").alias("evidence"))


def reduce_input(chapters: DataFrame, most_chars: int = 50_000) -> DataFrame:
    """(book_id, text): the titles and summaries of a book's chapters in order, blank ones left out, cut to most_chars."""
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled"))
    one = F.struct("ordinal", F.concat(F.lit("## "), title, F.lit("\n"), F.col("summary")).alias("text"))
    rows = chapters.where(F.trim(F.coalesce("summary", F.lit(""))) != "")
    # a chapter takes six characters at least, so only so many of a book's first ones can have a place; the rest never meet
    first = F.row_number().over(W.partitionBy("book_id").orderBy("ordinal"))
    rows = rows.withColumn("__n", first).where(F.col("__n") <= most_chars // 6 + 1).groupBy("book_id").agg(F.sort_array(F.collect_list(one)).alias("c"))
    return rows.select("book_id", F.substring(F.array_join(F.transform("c", lambda x: x["text"]), "\n\n"), 1, most_chars).alias("text"))
