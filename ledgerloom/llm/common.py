"""Helpers shared by the corpus operators: byte-level words, Arrow batches, sizing, durable tables."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z and leaves every other byte alone.
LOWER_AZ = bytes.maketrans(_UPPER, _LOWER)
_keep = set(b"0123456789") | set(_LOWER) | set(range(0x80, 0x100))
#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a blank.
ALNUM_AZ = bytes(LOWER_AZ[b] if LOWER_AZ[b] in _keep else 0x20 for b in range(256))


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words of ASCII letters, digits and non-ASCII code points, A-Z lower-cased."""
    return text.translate(ALNUM_AZ).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words between blanks and the control characters 9 to 13, unchanged."""
    return text.split() if text else []


def give_back() -> None:
    """Return what this Python process has freed to the machine, so that workers at rest don't crowd an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def sub_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
        part = np.cumsum(sizes) // limit
        starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            # A copy: string kernels of Arrow misread slices that begin inside their buffers.
            yield batch.take(pa.array(np.arange(a, b))) if a else batch.slice(a, b - a)
        give_back()


#: Spark's setting that frees a query's shuffle files when the query ends.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of working tables made within ``scratch``, for each of its nested uses.
_scratch: list[list[str]] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder named by ``spark.checkpoint.dir``; without that setting on one machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        root = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").rstrip("/") + "/_work"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


def write_freeing(df: DataFrame, path: str) -> None:
    """Write Parquet and free the shuffle files that led to it: they serve no other query."""
    conf = df.sparkSession.conf
    before = conf.get(_FREE_SHUFFLES, None)
    conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_FREE_SHUFFLES) if before is None else conf.set(_FREE_SHUFFLES, before)


def durable(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = path or work_dir(df.sparkSession, name)
    write_freeing(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the working tables made within, at the end. What is read later must be written elsewhere before."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes in ``column`` over all rows."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
