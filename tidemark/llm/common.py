"""Helpers that all operators of the subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.runtime import read_table as table  # noqa: F401
from tidemark.runtime import ship  # noqa: F401

#: A-Z alone change case: no locale, no other letters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it. Only a local session, whose one machine is its cluster, gets one
    where it names none; any other raises, since a folder of the driver's own would be lost to the executors."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        conf = spark.sparkContext.getConf()
        found = conf.get("spark.checkpoint.dir")
        if not found:
            if not spark.sparkContext.master.partition("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
            found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that a lost executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path  # for drop()
    return out


def drop(df: DataFrame) -> None:
    """Removes a table of cut() that nothing reads any more."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def settle(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of tables that are written and no longer read: it does so when the driver's garbage goes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """At a task's end: gives memory back to the system, since Python workers live on and executors' memory is shared."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The same as UTF-8."""
    col = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def lowered(col: Column | str) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(col, UPPER, LOWER)


def in_batches(batches: Iterable[pa.RecordBatch], f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield f(b)


def mix(x):
    """splitmix64's finaliser over a numpy uint64 array; overflow wraps."""
    import numpy as np

    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
