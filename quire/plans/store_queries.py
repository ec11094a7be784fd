"""What the library store does, over a small library that is written first: nations as books, suppliers as their chapters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import columns as C
from quire.operators import ledger, lookups
from quire.plans.catalog import event_ledger, query, read
from quire.sources.store import Store, scratch_folder


def library(spark, d) -> Store:
    store = Store(spark, scratch_folder(spark))
    n, s = read(spark, d, "nation"), read(spark, d, "supplier")
    book = F.col("n_nationkey").cast("string")
    books = n.select(book.alias("book_id"), F.col("n_name").alias("title"), F.lit("ingesting").alias("status"), F.sha2(F.col("n_name").cast("binary"), 256).alias("source_hash"))
    rows = s.select(F.col("s_nationkey").cast("string").alias("book_id"), F.col("s_suppkey").cast("string").alias("chapter_id"), F.col("s_suppkey").cast("int").alias("ordinal"), F.col("s_name").alias("title"), F.lit(True).alias("is_body"))
    events = s.select(F.col("s_nationkey").cast("string").alias("book_id"), F.col("s_suppkey").cast("string").alias("chapter_id"), F.col("s_name").alias("description"))
    store.replace_all({"books": books, "chapters": rows, "events": events})
    return store


def some(spark, *books: int) -> DataFrame:
    return spark.createDataFrame([(str(b),) for b in books], "book_id string")


def per_book(store: Store) -> DataFrame:
    """(book_id, books, chapters, events): rows of each table."""
    parts = [store.table(t).select("book_id", *(F.lit(int(t == x)).alias(x) for x in ("books", "chapters", "events"))) for t in ("books", "chapters", "events")]
    rows = reduce(DataFrame.unionByName, parts).groupBy("book_id")
    return rows.agg(*(F.sum(x).alias(x) for x in ("books", "chapters", "events")))


LIB = "b AS (SELECT n_nationkey AS k, n_name FROM nation), c AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)"
_ALL = "SELECT b.k::VARCHAR AS book_id, {books}::BIGINT AS books, {chapters}::BIGINT AS chapters, {events}::BIGINT AS events FROM b LEFT JOIN c USING (k)"


def _counts_sql(books: str = "1", chapters: str = "coalesce(n, 0)", events: str = "coalesce(n, 0)") -> str:
    return f"WITH {LIB}, r AS ({_ALL.format(books=books, chapters=chapters, events=events)}) SELECT * FROM r WHERE books + chapters + events > 0"


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def content_hashes(spark, d):
    return read(spark, d, "documents").select("doc_id", C.content_hash(F.coalesce("text", F.lit(""))).alias("hash"))


@query("SELECT n_nationkey::VARCHAR AS book_id, n_name AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'ready' ELSE 'ingesting' END AS status, CASE WHEN n_nationkey = 4 THEN 'given' END AS summary FROM nation")
def store_status(spark, d):
    """Status of some books, and one field of one."""
    store = library(spark, d)
    store.set_books(store.table("books").where("book_id % 2 = 0").select("book_id"), status="ready")
    store.set_book("4", summary="given")
    return store.table("books").select("book_id", "title", "status", "summary")


@query("SELECT n_nationkey::VARCHAR AS book_id FROM nation WHERE n_nationkey = 7")
def store_find(spark, d):
    """The book of a content hash, which is known, and of one that is not."""
    store = library(spark, d)
    name = read(spark, d, "nation").where("n_nationkey = 7").first()["n_name"]
    import hashlib

    found = [store.find(hashlib.sha256(x.encode()).hexdigest()) for x in (name, "nobody")]
    return spark.createDataFrame([(b,) for b in found if b is not None], "book_id string")


@query("SELECT s_nationkey::VARCHAR AS book_id, s_suppkey::VARCHAR AS chapter_id, s_name AS title FROM supplier WHERE s_nationkey IN (3, 5, 20)")
def store_scan(spark, d):
    """The rows of some books, whose partitions alone are read."""
    return library(spark, d).of("chapters", some(spark, 3, 5, 20)).select("book_id", "chapter_id", "title")


@query(_counts_sql(chapters="CASE WHEN b.k IN (1, 2) THEN 0 ELSE coalesce(n, 0) END", events="CASE WHEN b.k IN (1, 2) THEN 0 ELSE coalesce(n, 0) END"))
def store_clear(spark, d):
    """What was made from two books goes, their own rows stay."""
    store = library(spark, d)
    store.clear("1")
    store.clear("2")
    return per_book(store)


@query(_counts_sql(*("CASE WHEN b.k IN (0, 24) THEN 0 ELSE " + x + " END" for x in ("1", "coalesce(n, 0)", "coalesce(n, 0)"))))
def store_delete(spark, d):
    store = library(spark, d)
    store.drop("0")
    store.drop("24")
    return per_book(store)


@query(_counts_sql(events="CASE WHEN b.k IN (6, 8) THEN CASE WHEN b.k = 6 THEN 1 ELSE 0 END ELSE coalesce(n, 0) END", chapters="CASE WHEN b.k IN (6, 8) THEN CASE WHEN b.k = 8 THEN 1 ELSE 0 END ELSE coalesce(n, 0) END"))
def store_rebuild(spark, d):
    """Two tables of two books made anew at once; a book without new rows in one of them loses its old ones."""
    store = library(spark, d)
    events = some(spark, 6).withColumn("description", F.lit("new"))
    rows = some(spark, 8).withColumn("chapter_id", F.lit("new"))
    store.replace_all({"events": events, "chapters": rows}, some(spark, 6, 8))
    return per_book(store)


@query("SELECT s_nationkey::VARCHAR AS book_id, s_suppkey::VARCHAR AS chapter_id, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_name END AS title FROM supplier UNION ALL SELECT '2', 'added', 'x'")
def store_upsert(spark, d):
    """Rows in place of those of their keys, and one that is new."""
    store = library(spark, d)
    new = store.table("chapters").where("chapter_id % 3 = 0").withColumn("title", F.lit("new"))
    store.upsert("chapters", new.unionByName(some(spark, 2).selectExpr("*", "'added' AS chapter_id", "'x' AS title"), allowMissingColumns=True), ["book_id", "chapter_id"])
    return store.table("chapters").select("book_id", "chapter_id", "title")


@query(_counts_sql())
def store_move(spark, d):
    """A library exported, and imported elsewhere."""
    one, two = library(spark, d), Store(spark, scratch_folder(spark))
    folder = scratch_folder(spark)
    one.export(folder)
    two.import_(folder)
    return per_book(two)


@query("SELECT DISTINCT user_id::VARCHAR AS book_id FROM events, (SELECT min(event_type) AS t FROM events) WHERE event_type = t AND event_id % 10 = 0")
def done_books(spark, d):
    """The books that a stage is done for: every tenth row of the ledger stands for a whole stage."""
    rows = event_ledger(spark, d).withColumn("unit_key", F.when(F.col("unit_key") == "0", ledger.ALL).otherwise(F.col("unit_key")))
    first = rows.agg(F.min("stage")).first()[0]
    return ledger.done_books(rows, first)


@query("SELECT user_id::VARCHAR AS book_id, (event_id % 10)::VARCHAR AS unit_key, max({'t': ts, 'p': props}).p AS payload FROM events, (SELECT min(event_type) AS t FROM events) WHERE event_type = t AND event_id % 10 > 0 GROUP BY 1, 2 HAVING payload IS NOT NULL")
def cached_payloads(spark, d):
    """The last reply for each unit of a stage."""
    rows = event_ledger(spark, d).withColumn("unit_key", F.when(F.col("unit_key") == "0", ledger.ALL).otherwise(F.col("unit_key")))
    first = rows.agg(F.min("stage")).first()[0]
    return ledger.payloads(rows, first)


@query("SELECT c_custkey AS book_id, CASE WHEN c_custkey % 4 = 0 THEN 'skip' WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'resume' ELSE 'store' END AS plan FROM customer")
def resume_plan(spark, d):
    """What a compile does with each book: ready ones are skipped, those with chapters resumed, the others stored."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("book_id"))
    status = F.when(F.col("book_id") % 4 == 0, "ready").otherwise("indexing")
    known = c.where("book_id % 3 > 0 OR book_id % 4 = 0").withColumn("status", status)
    return lookups.resume_plan(c, known, read(spark, d, "orders").select(F.col("o_custkey").alias("book_id")))


@query("SELECT c_custkey AS book_id FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 3 > 0")
def unsummarized(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("book_id"), F.when(F.col("c_custkey") % 4 == 0, "ready").otherwise("failed").alias("status"), F.when(F.col("c_custkey") % 3 == 0, "").alias("summary"))
    return lookups.unsummarized(c).select("book_id")


@query(
    """
WITH q AS (SELECT doc_id, text, substring(text, 20, 12) AS q, CASE doc_id % 3 WHEN 0 THEN 19 WHEN 1 THEN length(text) - 3 END AS given FROM documents),
s AS (SELECT *, coalesce(given, nullif(instr(text, q), 0) - 1) AS start FROM q)
SELECT doc_id, CASE WHEN start >= 0 AND start + length(q) <= length(text) THEN start::INT END AS start, CASE WHEN start >= 0 AND start + length(q) <= length(text) THEN (start + length(q))::INT END AS "end" FROM s
"""
)
def highlights(spark, d):
    """The places of quotes in their passages: given, beyond the end, or to be found."""
    rows = read(spark, d, "documents").withColumns({"q": F.substring("text", 20, 12), "at": F.when(F.col("doc_id") % 3 == 0, 19).when(F.col("doc_id") % 3 == 1, F.length("text") - 3)})
    return rows.select("doc_id", C.highlight("text", F.col("q"), F.col("at")).alias("h")).select("doc_id", "h.start", "h.end")
