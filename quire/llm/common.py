"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import time
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
_WRITTEN: dict[str, SparkSession] = {}
_PLACE, _PARTS = "_quire_path", "_quire_parts"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset and all runs on this machine (tests), a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="quire-"))
        base = _LOCAL[0]
    path = f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_clean)
    _WRITTEN[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for path, spark in _WRITTEN.items():
        try:
            _delete(spark, path)
        except Exception:
            return  # the session has ended; the folder belongs to the cluster's own clean-up


def materialize(df: DataFrame, **options) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.options(**options).parquet(path)
    return written(spark.read.schema(df.schema).parquet(path), path)


def written(df: DataFrame, path: str) -> DataFrame:
    """df as the table of a folder of shared_dir(), for release()."""
    setattr(df, _PLACE, path)
    return df


def release(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that no DataFrame still to be run reads; for one of reading(), the tables that it was made from."""
    for t in tables:
        path = t.__dict__.pop(_PLACE, None)
        if path and path in _WRITTEN:
            _delete(_WRITTEN.pop(path), path)
        release(*t.__dict__.pop(_PARTS, ()))


def reading(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, with the tables that it reads, so that its user can release them once it has run."""
    setattr(df, _PARTS, tables)
    return df


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs whose DataFrames are gone: it does so, beside other work, once the JVM has collected them."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session for the jobs that are run within."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: a Python worker lives on for other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library; it keeps what it has


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads, as the planner knows them; 0 where it doesn't."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def span_digests(kinds: list[str]) -> dict:
    """n_<kind>, base_sha256 and spans from a column ``spans`` of (kind, start, end, ...)."""
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return {f"n_{k}": count(k) for k in kinds} | {"base_sha256": F.sha2(joined(base), 256), "spans": joined(F.col("spans"))}
