"""Document fingerprints: spot signatures, in DataFrame operations only.

A signature is a common word (an anchor) and the chain of the next ``chain`` content words, common
words between them skipped; a fingerprint is the sorted set of the signatures' hashes. Signatures
lie where running text is, so that navigation and lists hardly count. A text without any anchor
takes every word as the start of a chain, one without a word the hash of itself, so that equal
texts, and only they, agree there too. Null is the empty text.

Likeness is Jaccard, 0 without further work if the set lengths alone keep it below ``floor``.
``similar_pairs`` joins on the rarest signatures of each set within partitions by set length.
Ids are taken as unique; rows that repeat one come in order of text. A null id comes before all others. A text is held whole with its
words, some hundred bytes a word; there is no other bound on its length. Columns that start with ``__fp`` or ``__nx`` are reserved, others are kept as they are;
an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import shuffle_partitions, table

#: Frequent function words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be by for from has have he in is it its of on or that the this to was were which will with "
    "au aux avec ce cette dans de des du elle en est et il ils la le les leur ne ou par pas pour que qui sa se ses son sur un une "
    "als am auch auf aus bei das dem den der des die durch ein eine einen er es für im ist mit nach nicht sich sie sind und von vor wie wird zu zum zur über "
    "al como con del el ella ese esta este fue ha las lo los más muy no para pero por si sin sobre su sus también una y ya"
).split()


def fingerprint(df: DataFrame, text_col: str, out: str, chain: int = 3) -> DataFrame:
    """df with the sorted array of signature hashes of text_col. Columns that start with ``__fp`` are reserved."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = df.withColumn("__fp_words", F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    df = df.withColumns(
        {
            "__fp_at": F.filter(F.transform("__fp_words", lambda w, i: F.when(w.isin(ANCHORS), i).otherwise(-1)), lambda i: i >= 0),
            "__fp_content": F.filter("__fp_words", lambda w: ~w.isin(ANCHORS)),
        }
    )
    links = lambda k: [F.get("__fp_content", k + i) for i in range(chain)]
    # the j-th anchor, at word p, has p - j content words before it
    spots = F.transform("__fp_at", lambda p, j: F.xxhash64(F.get("__fp_words", p), *links(p - j)))
    runs = F.transform("__fp_content", lambda w, i: F.xxhash64(F.lit(""), *links(i)))
    sigs = F.when(F.size("__fp_at") > 0, spots).when(F.size("__fp_content") > 0, runs).otherwise(F.array(F.xxhash64(text)))
    return df.withColumn(out, F.array_sort(F.array_distinct(sigs))).drop("__fp_words", "__fp_at", "__fp_content")


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    both = F.size(F.array_intersect(a, b))
    exact = both / (F.size(a) + F.size(b) - both)
    if not floor:
        return exact
    return F.when(F.least(F.size(a), F.size(b)) < floor * F.greatest(F.size(a), F.size(b)), F.lit(0.0)).otherwise(exact)


def similar_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, chain: int = 3) -> tuple[DataFrame, DataFrame]:
    """(id, class_id) of each row, and (a, b, likeness) of class representatives with likeness of at least ``threshold``.

    Rows of equal fingerprints are one class, named by its smallest id (null ids last), so copies cost no pairs. A
    class goes to its own length partition (powers of 1 / threshold), and is compared with that and the next. Signatures stand in
    order of how many classes have them, rarest first; a pair must share one of the first n - ceil(threshold * n) + 1 of either
    set, and a shared one at places i and j leaves at most 1 + min(na - i, nb - j) in common (from 1 on), which must reach what the threshold
    asks for. So a common signature makes candidates only of sets that have nothing rarer. What is left is compared exactly.
    """
    rows = fingerprint(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "fp", chain).drop("text")
    rows = rows.withColumn("key", F.sha2(F.array_join(F.col("fp").cast("array<string>"), ","), 256))
    classes = rows.groupBy("key").agg(F.min("id").alias("class_id"), F.any_value("fp").alias("fp"))
    members = rows.join(classes.select("key", "class_id"), "key").select("id", "class_id")
    sigs = classes.select("key", F.explode("fp").alias("sig"))
    often = sigs.groupBy("sig").agg(F.count("*").alias("often"))
    ranked = sigs.join(often, "sig").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("often", "sig"))).alias("s"))
    n = F.size("s")
    part = F.floor(F.log(n.cast("double")) / math.log(1 / threshold) + 1e-9).cast("int")
    prefix = F.slice("s", F.lit(1), (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))
    posts = ranked.select("key", n.alias("n"), part.alias("part"), F.posexplode(prefix).alias("i", "x")).select("key", "n", "part", "i", "x.sig")
    left = posts.select(F.col("key").alias("ka"), F.col("n").alias("na"), F.col("i").alias("ia"), "sig", "part")
    right = posts.select(F.col("key").alias("kb"), F.col("n").alias("nb"), F.col("i").alias("ib"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), F.col("part").alias("own"))
    # the shorter on the right, so that the next partition is enough; equal lengths in order of key
    ordered = (F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("kb") < F.col("ka")))
    needed = F.ceil((F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9)
    possible = 1 + F.least(F.col("na") - 1 - F.col("ia"), F.col("nb") - 1 - F.col("ib")) >= needed
    pairs = left.join(right, ["sig", "part"]).where(ordered & possible & (F.col("nb") >= threshold * F.col("na") - 1e-9)).select("ka", "kb").distinct()
    sets = classes.select("key", "class_id", "fp")
    pairs = pairs.join(sets.select(F.col("key").alias("ka"), F.col("class_id").alias("ca"), F.col("fp").alias("fa")), "ka").join(sets.select(F.col("key").alias("kb"), F.col("class_id").alias("cb"), F.col("fp").alias("fb")), "kb")
    near = pairs.withColumn("likeness", likeness(F.col("fa"), F.col("fb"), threshold)).where(F.col("likeness") >= threshold - 1e-12)
    swap = F.col("ca") <= F.col("cb")
    return members, near.select(F.when(swap, F.col("ca")).otherwise(F.col("cb")).alias("a"), F.when(swap, F.col("cb")).otherwise(F.col("ca")).alias("b"), "likeness")


def with_next(df: DataFrame, id_col: str, columns: dict[str, str], buckets: int, prepare=None) -> DataFrame:
    """df with columns[c] holding column c of the next row in descending id; after the last comes the first.

    Ids are dealt by quantiles into ``buckets`` ranges, each one window partition. The largest row
    of a range is also sent to the range above as its first row's next, the largest of all to the
    lowest range, so that a row never needs another task. ``prepare`` runs after the one shuffle.
    """
    ids = df.select(F.col(id_col).cast("long").alias("id"))
    low = -(1 << 63)
    bounds = ids.agg(F.percentile_approx("id", [i / buckets for i in range(1, buckets)] or [0.5], 100 * buckets)).first()[0]
    bounds = sorted(set(bounds or []))
    step = max(1, math.isqrt(len(bounds)))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(low))
    # the number of bounds below the id, by every step-th bound and then the bounds after it
    below = lambda a: F.size(F.filter(a, lambda x: x < key))
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs)) if xs else F.array().cast("array<long>")
    coarse = below(longs(bounds[step - 1 :: step])) * step
    bucket = coarse + below(F.slice(longs(bounds), coarse + 1, F.lit(step))) if bounds else F.lit(0)
    df = df.withColumn("__nx_bucket", bucket.cast("int"))
    last = {r[0]: r[1] for r in df.groupBy("__nx_bucket").agg(F.max(key)).collect()}
    full = sorted(last)
    heir = dict(zip(full, full[1:] + full[:1], strict=True))
    size = len(bounds) + 1
    is_last = key == F.get(longs([last.get(i, low) for i in range(size)]), F.col("__nx_bucket"))
    to = F.get(longs([heir.get(i, 0) for i in range(size)]), F.col("__nx_bucket")).cast("int")
    place = lambda b, ghost: F.struct(b.alias("b"), F.lit(ghost).alias("ghost"))
    here = place(F.col("__nx_bucket"), False)
    df = df.withColumn("__nx", F.explode(F.when(is_last, F.array(here, place(to, True))).otherwise(F.array(here))))
    df = df.withColumns({"__nx_bucket": F.col("__nx.b"), "__nx_ghost": F.col("__nx.ghost")}).drop("__nx")
    df = df.repartition(shuffle_partitions(df.sparkSession), "__nx_bucket")
    if prepare:
        df = prepare(df)
    order = W.partitionBy("__nx_bucket").orderBy(F.desc("__nx_ghost"), F.asc_nulls_first(id_col), *columns)
    df = df.withColumns({out: F.lag(c).over(order) for c, out in columns.items()})
    return df.where("not __nx_ghost").drop("__nx_bucket", "__nx_ghost")


def op8_spotsigs(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    buckets = 8 * shuffle_partitions(spark)
    rows = with_next(docs, "doc_id", {"text": "next_text", "fingerprint": "next_fingerprint"}, buckets, lambda df: fingerprint(df, "text", "fingerprint"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)))
    rows = fingerprint(rows.drop("text", "next_text"), "edited", "edited_fingerprint")
    shown = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown("fingerprint"), shown("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
