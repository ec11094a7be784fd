"""A library's tables in fixed hash buckets, in place of a folder a book: joined without a shuffle, pruned by row group.

Every table is bucketed by its chapter (``chapter_id``), into the same number of buckets, so chapters meet their sections, chunks and vectors
where they lie, and a book of a third of all rows is spread over all buckets. Within a bucket rows are sorted by book and chapter: the least and
greatest book of a row group, and a bloom filter, let a filter on a book skip the others, so no folder a book is needed.

The session's catalog holds what is bucketed; ``Buckets`` names the tables below a root to it again, since a file's bucket is in its name. A table is
written whole (``write``): by the tasks that own its buckets, a file a bucket. Rows without a chapter are in one bucket of their own hash.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BY = "chapter_id"


class Buckets:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, by: str = BY):
        self.spark, self.root, self.buckets, self.by = spark, root.rstrip("/"), buckets, by
        self.prefix = "quire_" + hashlib.md5(self.root.encode()).hexdigest()[:12]

    def name(self, table: str) -> str:
        return f"{self.prefix}_{table}"

    def write(self, table: str, rows: DataFrame, order: list[str] | None = None) -> DataFrame:
        """The table becomes these rows."""
        order = ["book_id", self.by] if order is None else order
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(table)}")
        out = rows.repartition(self.buckets, self.by).write.format("parquet").mode("overwrite").bucketBy(self.buckets, self.by).sortBy(*order)
        out.option("path", f"{self.root}/{table}").option("parquet.bloom.filter.enabled#book_id", "true").saveAsTable(self.name(table))
        return self.table(table)

    def table(self, table: str) -> DataFrame:
        """A table that was written, in this session or another."""
        try:
            return self.spark.table(self.name(table))
        except AnalysisException:
            rows = self.spark.read.parquet(f"{self.root}/{table}")
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
            order = "book_id, " if "book_id" in rows.columns else ""
            self.spark.sql(f"CREATE TABLE {self.name(table)} ({fields}) USING parquet OPTIONS (path '{self.root}/{table}') CLUSTERED BY ({self.by}) SORTED BY ({order}{self.by}) INTO {self.buckets} BUCKETS")
            return self.spark.table(self.name(table))

    def of(self, table: str, book_id: str) -> DataFrame:
        """The rows of a book: row groups that can't hold it are skipped."""
        return self.table(table).where(F.col("book_id") == book_id)

    def joined(self, left: str, right: str, how: str = "inner") -> DataFrame:
        """Two tables by their chapters, bucket with bucket."""
        return self.table(left).join(self.table(right).drop("book_id"), self.by, how)
