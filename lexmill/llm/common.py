"""What the operators share: tables, the shared folder, safe column names, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unicode code points of ASCII white space, as the operators' word pattern has them.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:  # a single machine, as in tests
        found = tempfile.mkdtemp(prefix="lexmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Workspace:
    """Tables that an operator writes to the shared folder to cut its lineage.

    They are read back as plain Parquet scans, so a lost executor costs a reread
    and never a recomputation. ``drop`` removes one that is no longer read; the
    rest go when the session's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._clear)

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.root}/{name}")

    def _clear(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session may be gone
            pass


def release() -> None:
    """Gives memory that is free inside this process back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do it by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run):
    """A function of batches that releases its task's memory at the end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Within it, actions hand Python batches of at most so many rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of an id as decimal text, modulo a small number; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def least_hashes(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """At most ``n`` rows, those with the least hashes of ``keys``: a bounded sample, the same in every run.

    A count tells below which hash so many lie, so each task sends its share of
    the sample to the driver and not ``n`` rows of its own.
    """
    share = min(1.0, (1.2 * n + 100) / max(1, df.count()))
    h = F.xxhash64(*keys)
    few = df if share == 1 else df.filter(h < F.lit(int(-(2**63) + share * 2**64)))
    return few.orderBy(h, *keys).limit(n)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` has not got, whatever its own columns are called."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; bytes.lower and bytes.split know ASCII alone."""
    return utf8(text).lower().split() if text else []


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches whose texts hold about ``limit`` bytes, so that Python lists stay small.

    A single longer text is a batch of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(lengths.astype(np.int64) + 64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def crc32_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
