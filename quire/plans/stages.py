"""The stages that make stored books ready: summaries, entities, embeddings and full text, each resumable.

A stage takes all its books at once, as a DataFrame of their ids, so a library costs as many jobs as a book. A unit's
reply goes to the ledger; a stage that starts again asks the model only for units that the ledger has no row of, and
rebuilds its tables from all of them. Units that a model fails on are left out of the ledger, the others kept, and then the stage fails.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import columns as C
from quire.operators import extraction, history, naming, retrieval
from quire.operators import ledger as L
from quire.plans.models import ModelClient
from quire.schema import EXTRACTION
from quire.sources.store import Store

STAGES = ["summaries", "book_summary", "entities", "embeddings", "fts"]
CHAPTER_CHARS, BOOK_CHARS, BATCH, SIDE_BY_SIDE = 12_000, 50_000, 64, 4
CLUSTERS = "struct<entities:array<struct<canonical:string,type:string,aliases:array<string>>>>"


class StageError(RuntimeError):
    """errors: what a model said of some books (book_id -> message)."""

    def __init__(self, stage: str, errors: dict[str, str]):
        super().__init__(f"{stage}: " + "; ".join(f"{b}: {e}" for b, e in errors.items()))
        self.errors = errors


def ask(rows: DataFrame, model: ModelClient, kinds: list[str], tokens: list[int]) -> DataFrame:
    """(book_id, unit_key, payload, error) of rows (book_id, unit_key, text): one reply a kind, as a JSON array. Some units are asked for side by side."""

    def one(text: str | None) -> tuple[str | None, str | None]:
        try:
            return json.dumps([model.complete(k, text or "", max_tokens=n).strip() for k, n in zip(kinds, tokens, strict=True)]), None
        except Exception as e:  # one unit must not stop the others
            return None, f"{type(e).__name__}: {e}"

    def run(batches):
        with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
            for whole in batches:
                for lo in range(0, whole.num_rows, BATCH):
                    b = whole.slice(lo, BATCH)
                    got = list(pool.map(one, b.column(2).to_pylist()))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.string()) for x in zip(*got, strict=True))], ["book_id", "unit_key", "payload", "error"])

    return rows.select("book_id", "unit_key", "text").mapInArrow(run, "book_id string, unit_key string, payload string, error string")


def _asked(store: Store, stage: str, units: DataFrame, model: ModelClient, kinds: list[str], tokens: list[int], keep: bool = True) -> DataFrame:
    """The replies (book_id, unit_key, payload), pinned; to the ledger as well, if they are to be kept. Fails if a unit did, once the others are kept."""
    got = store.pin(ask(units, model, kinds, tokens))
    if keep:
        store.mark(got.where("error IS NULL"), stage)
    errors = {r["book_id"]: r["error"] for r in got.where("error IS NOT NULL").groupBy("book_id").agg(F.first("error").alias("error")).limit(100).collect()}
    if errors:
        store.unpin(got)
        raise StageError(stage, errors)
    return got


def _replies(store: Store, books: DataFrame, stage: str, units: DataFrame, model: ModelClient, kinds: list[str], tokens: list[int]) -> DataFrame:
    """The payloads of all units (book_id, unit_key, text), those of new ones asked for and written first."""
    todo = L.pending(units, store.of("ledger", books), stage, "unit_key")
    if not todo.isEmpty():
        store.unpin(_asked(store, stage, todo, model, kinds, tokens))
    return L.payloads(store.of("ledger", books), stage)


def chapter_texts(sections: DataFrame) -> DataFrame:
    """(book_id, chapter_id, text): a chapter's body sections in order."""
    rows = sections.where("is_body").groupBy("book_id", "chapter_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "content"))).alias("s"))
    return rows.select("book_id", "chapter_id", F.array_join(F.transform("s", lambda x: x["content"]), "\n\n").alias("text"))


def summaries(store: Store, books: DataFrame, model: ModelClient) -> None:
    units = chapter_texts(store.of("sections", books)).select("book_id", F.col("chapter_id").alias("unit_key"), F.substring("text", 1, CHAPTER_CHARS).alias("text"))
    got = _replies(store, books, "summaries", units, model, ["micro", "summary"], [60, 700])
    got = got.select("book_id", F.col("unit_key").alias("chapter_id"), F.from_json("payload", "array<string>").alias("r"))
    chapters = store.of("chapters", books).drop("summary", "micro_summary").join(got, ["book_id", "chapter_id"], "left")
    store.replace("chapters", chapters.withColumns({"micro_summary": F.get("r", F.lit(0)), "summary": F.get("r", F.lit(1))}).drop("r"))


def book_summary(store: Store, books: DataFrame, model: ModelClient) -> None:
    units = history.reduce_input(store.of("chapters", books).where("is_body"), BOOK_CHARS).where("text != ''").select("book_id", F.lit("book").alias("unit_key"), "text")
    got = _replies(store, books, "book_summary", units, model, ["book"], [600])
    reply = got.select("book_id", F.get(F.from_json("payload", "array<string>"), F.lit(0)).alias("r"))
    rows = store.of("books", books).join(reply, "book_id", "left").withColumn("summary", F.coalesce("r", F.lit(""))).drop("r")
    store.replace("books", rows.withColumn("updated_at", F.current_timestamp()))


def entities(store: Store, books: DataFrame, model: ModelClient) -> None:
    """Entities, occurrences, dates and events from what a model finds in each section, and says of names that may mean the same."""
    body = store.of("sections", books).where("is_body")
    units = body.select("book_id", F.col("section_id").alias("unit_key"), F.col("content").alias("text"))
    got = _replies(store, books, "entities", units, model, ["extract"], [1500])
    reply = F.from_json(C.fenced_json(F.get(F.from_json("payload", "array<string>"), F.lit(0))), EXTRACTION)
    payloads = body.join(got.select("book_id", F.col("unit_key").alias("section_id"), reply.alias("payload")), ["book_id", "section_id"])
    # names that may mean the same go to the model together, and no more than a prompt holds
    parts = naming.groups(extraction.candidates(payloads)).groupBy("book_id", "type", "component", "part")
    names = store.pin(parts.agg(F.sort_array(F.collect_list(F.struct("name", "type"))).alias("names")).withColumn("no", F.monotonically_increasing_id()))
    asked = _asked(store, "clusters", names.select("book_id", F.col("no").cast("string").alias("unit_key"), F.to_json("names").alias("text")), model, ["cluster"], [3000], keep=False)
    found = F.from_json(C.fenced_json(F.get(F.from_json("payload", "array<string>"), F.lit(0))), CLUSTERS)["entities"]
    alone = F.transform("names", lambda n: F.struct(n["name"].alias("canonical"), n["type"].alias("type"), F.array().cast("array<string>").alias("aliases")))
    rows = names.join(asked.select("book_id", F.col("unit_key").cast("long").alias("no"), found.alias("found")), ["book_id", "no"], "left")
    at = F.struct("component", "type", "part", "n")
    rows = rows.select("book_id", "component", "type", "part", F.posexplode(F.when(F.size("found") > 0, F.col("found")).otherwise(alone)).alias("n", "c"))
    clusters = store.pin(rows.where("c.canonical != ''").select("book_id", at.alias("position"), "c.canonical", "c.type", "c.aliases"))
    own = extraction.entities(clusters)
    made = {"entities": own, "occurrences": extraction.occurrences(payloads, extraction.aliases(clusters), own), "dates": extraction.dates(payloads), "events": extraction.events(payloads, own)}
    store.replace_all(made, books)
    store.unpin(names, asked, clusters)


def embeddings(store: Store, books: DataFrame, model: ModelClient) -> None:
    """Vectors of body chunks that have none yet, asked for in batches."""
    todo = L.pending_vectors(store.of("chunks", books), store.of("embeddings", books))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                part = b.slice(lo, BATCH)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(model.embed(part.column(2).to_pylist()), pa.list_(pa.float32()))], ["book_id", "chunk_id", "embedding"])

    if not todo.isEmpty():
        store.append("embeddings", todo.select("book_id", "chunk_id", "content").mapInArrow(run, "book_id string, chunk_id string, embedding array<float>"))
    dim = store.of("embeddings", books).groupBy("book_id").agg(F.max(F.size("embedding")).alias("dim"))
    name = getattr(model, "embed_name", None)
    rows = store.of("books", books).join(dim, "book_id", "left").withColumns({"embed_version": C.embed_version("embed_version"), "embed_dim": F.col("dim"), "embed_model": F.lit(name) if name else F.col("embed_model")})
    store.replace("books", rows.drop("dim"))


def fts(store: Store, books: DataFrame, model: ModelClient) -> None:
    """Postings of all sections, clustered by term, so that a query's filter on terms skips row groups, and the sections' lengths."""
    posts = store.pin(retrieval.postings(store.of("sections", books)))
    store.replace_all({"postings": posts.repartition("book_id").sortWithinPartitions("book_id", "term"), "lengths": retrieval.section_lengths(posts)})
    store.unpin(posts)


def run(store: Store, books: DataFrame, model: ModelClient, progress=lambda stage, state: None) -> None:
    """All stages, each over those of the books that it is not done for."""
    for stage in STAGES:
        todo = store.pin(books.select("book_id").join(L.done_books(store.of("ledger", books), stage), "book_id", "left_anti"))
        if todo.isEmpty():
            progress(stage, "skipped")
        else:
            progress(stage, "started")
            globals()[stage](store, todo, model)
            store.mark_done(todo, stage)
            progress(stage, "done")
        store.unpin(todo)
