"""A library as Parquet tables, one folder a table, one partition a book.

A book's rows of a table are written anew as its partition, so a stage that
ran twice leaves what one run leaves. Deleting a book drops its partitions from every table.

``replace_all`` takes several tables at once: all rows are staged first, then a commit file is written, and only then the
partitions change places. Where a writer is lost between, the next store that opens the library finishes the change
(``recover``), so no book is left with new rows in one table and old ones in another. One writer at a time is assumed.
"""

from __future__ import annotations

import atexit
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import ledger as L
from quire.schema import TABLES, key


def scratch_folder(spark: SparkSession) -> str:
    """A folder below ``spark.checkpoint.dir`` (or the warehouse) that goes when the program ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/quire-scratch-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def scratch(rows: DataFrame) -> DataFrame:
    """rows, written once, for plans that read them more than once."""
    path = scratch_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        return  # the session has ended; the folder belongs to the cluster's own clean-up


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.recover()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p, jvm

    def exists(self, name: str) -> bool:
        fs, p, _ = self._fs(name)
        return fs.exists(p) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(p))

    def table(self, name: str) -> DataFrame:
        columns = TABLES[name]
        if not self.exists(name):
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(self.path(name))

    def of(self, name: str, books: str | DataFrame) -> DataFrame:
        """The rows of a book, whose partition alone is read, or of the books of a DataFrame with book_id."""
        if isinstance(books, str):
            return self.table(name).where(F.col("book_id") == books)
        return self.table(name).join(books.select("book_id"), "book_id", "left_semi")

    def pin(self, rows: DataFrame) -> DataFrame:
        """rows as they are now, as a table of their own until unpin()."""
        path = f"{self.root}/_run/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        out = self.spark.read.schema(rows.schema).parquet(path)
        out._pinned = path
        return out

    def unpin(self, *rows: DataFrame) -> None:
        for r in rows:
            self._delete(r._pinned)

    def _delete(self, path: str) -> None:
        fs, _, jvm = self._fs("")
        fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)

    def _names(self, path: str) -> list[str]:
        fs, _, jvm = self._fs("")
        p = jvm.org.apache.hadoop.fs.Path(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def shape(self, name: str, rows: DataFrame) -> DataFrame:
        """rows with the table's columns and types; missing ones are null."""
        want = self.spark.createDataFrame([], TABLES[name]).schema
        return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want))

    def replace(self, name: str, rows: DataFrame) -> None:
        """The partitions of the books in rows become these rows. rows may be read from the table itself."""
        self.replace_all({name: rows})

    def replace_all(self, tables: dict[str, DataFrame], books: DataFrame | None = None) -> None:
        """Of each table, the partitions of the books in its rows become these rows; books of ``books`` without rows there lose theirs. All or nothing."""
        stage = f"{self.root}/_stage/{uuid.uuid4().hex}"
        for name, rows in tables.items():
            self.shape(name, rows).repartition("book_id").write.partitionBy("book_id").parquet(f"{stage}/{name}")
        if books is not None:
            books.select("book_id").distinct().write.parquet(f"{stage}/of_books")
        fs, _, jvm = self._fs("")
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{stage}/COMMIT"))
        out.write(bytearray(json.dumps({"tables": list(tables), "books": books is not None}).encode()))
        out.close()
        self._swap(stage)

    def _swap(self, stage: str) -> None:
        """Moves staged partitions into place; what an earlier try has moved is no longer there."""
        fs, _, jvm = self._fs("")
        path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join(parts))
        plan = json.loads(self.spark.read.text(f"{stage}/COMMIT", wholetext=True).first()[0])
        for name in plan["tables"]:
            fs.mkdirs(path(self.root, name))
            staged = [x for x in self._names(f"{stage}/{name}") if x.startswith("book_id=")]
            if plan["books"]:
                held = {x for x in self._names(f"{self.root}/{name}") if x.startswith("book_id=")}
                done = set(self._names(f"{stage}/_done_{name}"))
                for r in self.spark.read.schema("book_id string").parquet(f"{stage}/of_books").toLocalIterator():
                    part = f"book_id={r['book_id']}"
                    if part in held and part not in staged and part not in done:
                        fs.delete(path(self.root, name, part), True)
            for part in staged:
                if plan["books"]:
                    fs.mkdirs(path(stage, f"_done_{name}", part))
                fs.delete(path(self.root, name, part), True)
                fs.rename(path(stage, name, part), path(self.root, name, part))
        self._delete(stage)

    def recover(self) -> None:
        """Finishes changes that were committed and not carried out, and clears away those that were not committed."""
        for stage in self._names(f"{self.root}/_stage"):
            at = f"{self.root}/_stage/{stage}"
            if "COMMIT" in self._names(at):
                self._swap(at)
            else:
                self._delete(at)

    def append(self, name: str, rows: DataFrame) -> None:
        self.shape(name, rows).write.mode("append").partitionBy("book_id").parquet(self.path(name))

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """rows in place of the table's rows of their keys, in the partitions of their books."""
        rows = self.shape(name, rows)
        old = self.table(name).join(rows.select("book_id").distinct(), "book_id", "left_semi")
        self.replace(name, L.upsert(old, rows, keys))

    def set_books(self, books: DataFrame, **values) -> None:
        """set_book for the books of a DataFrame, in one change."""
        rows = self.of("books", books)
        for c, v in values.items():
            rows = rows.withColumn(c, v if hasattr(v, "_jc") else F.lit(v))
        self.replace("books", rows.withColumn("updated_at", F.current_timestamp()))

    def drop(self, book_id: str, tables: list[str] | None = None) -> None:
        for name in tables or TABLES:
            fs, p, jvm = self._fs(name)
            fs.delete(jvm.org.apache.hadoop.fs.Path(p, f"book_id={book_id}"), True)

    def clear(self, book_id: str) -> None:
        """All that was made from a book; the book's own row stays."""
        self.drop(book_id, [t for t in TABLES if t != "books"])

    def find(self, source_hash: str) -> str | None:
        row = self.table("books").where(F.col("source_hash") == source_hash).select("book_id").first()
        return row and row["book_id"]

    def set_book(self, book_id: str, **values) -> None:
        rows = self.of("books", book_id)
        for c, v in values.items():
            rows = rows.withColumn(c, v if hasattr(v, "_jc") else F.lit(v))
        self.replace("books", rows.withColumn("updated_at", F.current_timestamp()))

    def mark(self, rows: DataFrame, stage: str) -> None:
        """Ledger rows for (book_id, unit_key, payload)."""
        payload = F.col("payload") if "payload" in rows.columns else F.lit(None).cast("string")
        self.append("ledger", rows.select("book_id", F.lit(stage).alias("stage"), "unit_key", payload.alias("payload"), F.current_timestamp().alias("updated_at")))

    def mark_done(self, books: DataFrame, stage: str) -> None:
        self.mark(books.select("book_id", F.lit(L.ALL).alias("unit_key")), stage)

    def done(self, book_id: str, stage: str) -> bool:
        return L.stage_done(self.table("ledger"), book_id, stage)

    def forget(self, book_id: str, stage: str) -> None:
        """Takes back that a stage is done; its units stay."""
        keep = self.of("ledger", book_id).where(~((F.col("stage") == stage) & (F.col("unit_key") == L.ALL)))
        if keep.isEmpty():
            self.drop(book_id, ["ledger"])
        else:
            self.replace("ledger", keep)

    def export(self, to: str) -> None:
        """Every table to another root."""
        for name in TABLES:
            if self.exists(name):
                self.table(name).write.mode("overwrite").partitionBy("book_id").parquet(f"{to.rstrip('/')}/{name}")

    def import_(self, source: str) -> None:
        """The tables of another root in place of these."""
        other = Store(self.spark, source)
        for name in TABLES:
            fs, p, _ = self._fs(name)
            fs.delete(p, True)
            if other.exists(name):
                other.table(name).write.partitionBy("book_id").parquet(self.path(name))


__all__ = ["Store", "key"]
