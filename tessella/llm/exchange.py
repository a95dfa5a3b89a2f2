"""Shared storage, sizing and packed hash exchange for the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes that one Python call holds at a time, and the least number of groups and buckets.
GROUP_BYTES, BUCKET_BYTES, LEAST = 8 << 20, 8 << 20, 64


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):  # another C library
    _LIBC = None


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where that is unset a folder of this machine serves, but only for a local
    master; on a cluster executors would each write to their own disks, so
    that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = getattr(shared_dir, "own", None)
        if own is None:
            own = shared_dir.own = tempfile.mkdtemp(prefix="tessella-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    until_exit(spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def until_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's file system delete a path, which must exist, when the application ends."""
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder that no later read needs, if it exists."""
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def forget(df: DataFrame | None) -> None:
    """Delete a table made by stored() that no later read needs."""
    path = getattr(df, "_stored_at", None)
    if path:
        discard(df.sparkSession, path)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes; one pair of values for all operators, since plans run later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def release() -> None:
    """Return freed memory of this Python worker to the system: workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def released(run):
    """A function (key, table) or (key, left, right) of a grouped call, with release() after it."""

    def one(key, table):
        try:
            return run(key, table)
        finally:
            release()

    def two(key, left, right):
        try:
            return run(key, left, right)
        finally:
            release()

    return two if run.__code__.co_argcount == 3 else one


def free_name() -> str:
    """A column name that no table has."""
    return f"_{uuid.uuid4().hex}"


def grouped(docs: DataFrame, doc_id: str, text: str, total_bytes: int, *more) -> DataFrame:
    """(g, doc_id, text, *more) with rows dealt evenly to groups of about GROUP_BYTES, whatever their ids."""
    groups = max(LEAST, -(-total_bytes // GROUP_BYTES))
    ident, body = F.col(doc_id).cast("long"), F.col(text).cast("string")
    return docs.select(F.pmod(F.xxhash64(ident, body), F.lit(groups)).alias("g"), ident.alias("doc_id"), body.alias("text"), *more)


def other_columns(docs: DataFrame, text: str = "text"):
    """All columns but the text in one struct, under whose name nothing can clash, and its type."""
    names = [c for c in docs.columns if c.lower() != text.lower()]
    kind = StructType([docs.schema[c] for c in names])
    return F.struct(*[F.col(f"`{c}`") for c in names]).alias("rest"), kind


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.select(F.sum(F.octet_length(F.col(text).cast("string"))).alias("n")).first()["n"] or 0


def buckets_for(total_bytes: int) -> int:
    return max(LEAST, -(-total_bytes // BUCKET_BYTES))


def pack_keys(keys: np.ndarray, *planes: np.ndarray) -> bytes:
    """Sorted uint32 keys as compressed byte planes of their differences, then further arrays unchanged."""
    gaps = np.diff(keys, prepend=np.uint32(0)).astype("<u4")
    raw = gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + b"".join(p.tobytes() for p in planes)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack_keys(blob: bytes, n: int) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    gaps = np.frombuffer(raw[: 4 * n], np.uint8).reshape(4, n).T.copy().view("<u4").ravel()
    return np.cumsum(gaps, dtype=np.uint64).astype(np.uint32), raw[4 * n :]


def slots(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket number in the high half, a 32-bit key in the low half."""
    return ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def by_bucket(slot: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted slots."""
    if not len(slot):
        return []
    b = (slot >> np.uint64(32)).astype(np.int64)
    cut = np.r_[0, np.flatnonzero(b[1:] != b[:-1]) + 1, len(b)]
    return [(int(b[i]), int(i), int(j)) for i, j in zip(cut[:-1], cut[1:])]


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal keys and, for each entry, the number of its run."""
    new = np.ones(len(sorted_keys), dtype=bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1
