"""A training corpus from ``documents``, in five stages of the training-data operators.

1. language_id: documents without a language (no letter, or no language with most of the
   probability) go.
2. near_duplicates: of each group of documents joined by five-word Jaccard of at least 0.8, the one with the
   smallest id (and of rows that repeat it, one) stays. Rows are told apart by place, so a row with a repeated id goes only
   for its own text, and rows without an id take part, after all others. Documents without a word have no group and stay.
3. secrets: every secret in a text is replaced; n_chars follows. No document goes.
4. mixing: documents are repeated or left out so that sources meet their target weights.
5. sentencepiece: two sampled segmentations of each text, the corpus's token ids.

Each stage reads the table that the one before wrote, and all but the last return the columns of
their input. Ties go to the smaller id, then to one of its rows; rows that repeat are rows of their own until the second stage. An empty
table stays empty. Names that start with ``__`` are reserved. SQL cannot express them, so ``ORACLE_SQL`` is None.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import langid, mixing, ngram_join, pieces, secrets
from quire.llm.common import materialize, release, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    named = langid.predict(docs, model, lang_out="__lang", score_out="__score")
    return named.where("__lang != 'und' and __score >= 0.5").select(*docs.columns)


def _named(docs: DataFrame) -> DataFrame:
    """docs with ``__file`` and ``__place``, which name a row however the table is read, and ``__row``, a name of
    the same in order of id (null last). Rows that come from no file are written first."""
    place = (F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    try:
        rows = docs.select("*", *place)
    except AnalysisException:
        rows = materialize(docs).select("*", *place)
    order = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return rows.withColumn("__row", F.concat_ws("-", F.coalesce(order, F.lit("null")), F.hex("__file"), F.hex("__place")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = _named(docs)
    groups = ngram_join.join(named, id_col="__row")
    part = lambda i: F.conv(F.split("__row", "-")[i], 16, -10).cast("long")
    others = materialize(groups.where("__row != class_id").select(part(1).alias("__file"), part(2).alias("__place")))
    release(groups)
    return named.join(others, ["__file", "__place"], "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    clean = secrets.mask_column(docs, words=public_tokenizers.path("word_bpe_49k.json"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.sample(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_words=50_000, chars=1 << 17).select("doc_id", "samples")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mixing", mix_sources),
    ("sentencepiece", sentencepiece_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        done, docs = docs, materialize(stage(spark, docs, sf_dir))
        release(done)
    return STAGES[-1][1](spark, docs, sf_dir)
