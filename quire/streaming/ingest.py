"""New books as a stream: files that land in a folder become chapters, each content once.

An extension: a file source with ``foreachBatch``. A batch that is run again replaces the same
partitions, so books are stored exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.plans.engine import Engine

FILES = "path string, modificationTime timestamp, length long, content binary"
FILES_A_BATCH = 1000


def watch(spark: SparkSession, folder: str, engine: Engine, checkpoint: str) -> StreamingQuery:
    """Compiles the EPUB files of folder as they come, until no more are there."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.epub").option("maxFilesPerTrigger", FILES_A_BATCH).load(folder)

    def take(batch: DataFrame, _: int) -> None:
        paths = [r["path"] for r in batch.select("path").collect()]  # FILES_A_BATCH of them at most
        if paths:
            engine.compile(paths)

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
