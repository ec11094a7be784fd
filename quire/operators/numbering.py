"""Row numbers and running sums within groups that no single task has to hold."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _range_of(key: Column, bounds: list) -> Column:
    """How many of the sorted bounds lie below the key: every step-th of them first, then those after it."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    below = lambda a: F.size(F.filter(a, lambda x: x < key))
    literal = lambda xs: F.array(*map(F.lit, xs))
    coarse = below(literal(bounds[step - 1 :: step])) * step
    return coarse + below(F.slice(literal(bounds), coarse + 1, F.lit(step)))


def running_sums(df: DataFrame, group: list[str], order: str, sums: dict[str, Column], rows_a_range: int = 500_000, least_ranges: int = 16) -> DataFrame:
    """df with, for each name of ``sums``, the sum of that whole-number expression over the row's group up to the row, by a
    whole-number column ``order`` (distinct within a group).

    Quantiles of the order column cut it into ranges, more of them the more rows there are; a group's sums before a range
    are taken first (map-side), and the window runs within (group, range). So a group of a third of all rows
    is spread over all ranges. Null is a group like any other.
    """
    n = df.count()
    ranges = max(least_ranges, math.ceil(n / rows_a_range))
    bounds = df.select(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], max(1000, 10 * ranges))).first()[0] or []
    ranged = df.withColumn("__range", _range_of(F.col(order), sorted(set(bounds))))
    ranged = ranged.withColumns({f"__s_{k}": c.cast("long") for k, c in sums.items()})
    totals = ranged.groupBy(*group, "__range").agg(*(F.sum(f"__s_{k}").alias(f"__t_{k}") for k in sums))
    earlier = W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*(F.col(g).alias(f"__g_{g}") for g in group), F.col("__range").alias("__r"), *(F.coalesce(F.sum(f"__t_{k}").over(earlier), F.lit(0)).alias(f"__b_{k}") for k in sums))
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group), F.col("__range") == F.col("__r"))
    inside = W.partitionBy(*group, "__range").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = ranged.join(totals, same)
    out = joined.withColumns({k: (F.col(f"__b_{k}") + F.coalesce(F.sum(f"__s_{k}").over(inside), F.lit(0))).cast("int") for k in sums})
    return out.select(*(c for c in df.columns if c not in sums), *sums)


def number_rows(df: DataFrame, group: list[str], order: str, out: str, start: int = 1) -> DataFrame:
    """df with the row's number in its group by a whole-number column ``order`` (distinct within a group)."""
    return running_sums(df, group, order, {out: F.lit(1)}).withColumn(out, (F.col(out) + (start - 1)).cast("int"))


def display_numbers(chapters: DataFrame) -> DataFrame:
    """Adds number: 1, 2, ... over a book's body chapters by ordinal, null for the others.

    A running count of body chapters in one pass over (book, ordinal); chapters of a book are few, so the
    window is by book. Where books are as large as sources of a corpus, running_sums splits them.
    """
    upto = F.count_if("is_body").over(W.partitionBy("book_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, W.currentRow))
    return chapters.withColumn("number", F.when(F.col("is_body"), upto.cast("int")))
