"""Helpers shared by the training-data operators: shared-folder tables, unique
row keys, and moving packed numpy columns between tasks by partition number."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that carry packed columns: kind (what it holds), part (who gets it), blob.
BLOB_SCHEMA = "kind string, part int, blob binary"
_ARROW_BLOB = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("blob", pa.binary())])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only on a local master
    (tests, notebooks) a temporary folder of this machine is set where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="strandline-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again. This
    cuts the lineage: a lost executor costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandline/{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


PART = 64 << 20  # bytes of source files for one partition, at most


def n_parts(df: DataFrame) -> int:
    """Partitions to deal df's rows to: spark.sql.shuffle.partitions, or more where
    the files that df reads are larger than PART for each of those."""
    set_ = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(x for i in range(leaves.size()) if (x := int(str(leaves.apply(i).stats().sizeInBytes()))) < 1 << 60)  # above: not known
    return max(set_, min(-(-size // PART), 1 << 17))


def frees(f):
    """For a generator that runs in a Python worker: give freed memory back to the
    system at its end, as the worker stays for other tasks."""

    @functools.wraps(f)
    def run(*args):
        try:
            yield from f(*args)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def keyed_rows(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id", carry: bool = False) -> tuple[DataFrame, bool]:
    """(rid, key, text) of every row, and whether rid is the key itself. With
    carry also row: a struct of all the columns that came in.

    Where doc_id is unique and never null, rid = doc_id. Otherwise rows get
    consecutive numbers in the order (doc_id nulls first, text), written to the
    shared folder, so that every row stays a document of its own and "earlier"
    stays defined for ties and repeated rows.
    """
    rest = [F.struct("*").alias("row")] if carry else []
    rows = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"), *rest)
    odd = rows.groupBy("key").count().where("count > 1 or key is null").limit(1)
    rest = ["row"] if carry else []
    if not odd.head(1):
        return rows.select(F.col("key").cast("long").alias("rid"), "key", "text", *rest), True
    # a text's first characters are enough to deal rows out by, and all that the
    # sample of the ranges brings to the driver
    key, start = F.col("key").asc_nulls_first(), F.substring("text", 1, 32).asc_nulls_first()
    ranged = rows.repartitionByRange(n_parts(rows), key, start).sortWithinPartitions(key, F.col("text").asc_nulls_first())
    return materialize(ranged.select(F.monotonically_increasing_id().alias("rid"), "key", "text", *rest), "keyed"), False


def give_back_key(result: DataFrame, rows: DataFrame, same: bool, key_col: str = "doc_id") -> DataFrame:
    """Replace rid by the document's own key."""
    rest = [c for c in result.columns if c != "rid"]
    if same:
        return result.select(F.col("rid").alias(key_col), *rest)
    return result.join(rows.select("rid", "key"), "rid").select(F.col("key").alias(key_col), *rest)


# -- packed columns ---------------------------------------------------------


def pack(*cols: np.ndarray) -> bytes:
    """Columns of 8-byte numbers as one byte string, byte planes first: equal
    high bytes then stand together and the shuffle's compression removes them."""
    n = len(cols[0])
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(n, 8).T).tobytes() for c in cols)


def unpack(blob: bytes, dtypes: tuple[str, ...]) -> list[np.ndarray]:
    n = len(blob) // (8 * len(dtypes))
    planes = np.frombuffer(blob, np.uint8).reshape(len(dtypes), 8, n)
    return [np.ascontiguousarray(p.T).view(t).reshape(n) for p, t in zip(planes, dtypes, strict=True)]


def unpack_all(blobs: list[bytes], dtypes: tuple[str, ...]) -> list[np.ndarray]:
    parts = [unpack(b, dtypes) for b in blobs]
    return [np.concatenate(c) if parts else np.empty(0, t) for c, t in zip(zip(*parts, strict=True) if parts else [()] * len(dtypes), dtypes, strict=True)]


def range_part(h: np.ndarray, parts: int) -> np.ndarray:
    """Partition by the leading bits of a 64-bit hash."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def id_part(ids: np.ndarray, parts: int) -> np.ndarray:
    """Partition of a row number."""
    return range_part(mix64(ids.astype(np.int64).view(np.uint64) + _MIX), parts)


def split_by_part(part: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(partition, row numbers) of each partition that has rows."""
    order = np.argsort(part, kind="stable")
    at = part[order]
    cut = np.flatnonzero(np.diff(at)) + 1
    return [(int(part[rows[0]]), rows) for rows in np.split(order, cut) if len(rows)]


def blob_batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    kinds, parts, blobs = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch([pa.array(kinds, pa.string()), pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], schema=_ARROW_BLOB)


def _murmur_int(x: int, seed: int = 42) -> int:
    """The hash by which Spark deals out rows on an int column."""
    k = (x * 0xCC9E2D51) & 0xFFFFFFFF
    k = ((k << 15) | (k >> 17)) & 0xFFFFFFFF
    h = seed ^ ((k * 0x1B873593) & 0xFFFFFFFF)
    h = ((h << 13) | (h >> 19)) & 0xFFFFFFFF
    h = (h * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= 4
    h = ((h ^ (h >> 16)) * 0x85EBCA6B) & 0xFFFFFFFF
    h = ((h ^ (h >> 13)) * 0xC2B2AE35) & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >= 1 << 31 else h


def spread_keys(parts: int) -> list[int]:
    """For each partition number an int that hash partitioning sends there, so
    that part p and partition p are the same and none is left empty."""
    keys: list[int | None] = [None] * parts
    left, x = parts, 0
    while left:
        p = _murmur_int(x) % parts
        if keys[p] is None:
            keys[p], left = x, left - 1
        x += 1
    return keys  # type: ignore[return-value]


def deal(blobs: DataFrame, parts: int) -> DataFrame:
    """One partition for each part number."""
    keys = F.array(*[F.lit(k) for k in spread_keys(parts)]) if parts <= 2000 else None
    key = F.element_at(keys, F.col("part") + 1) if keys is not None else F.col("part")
    return blobs.withColumn("deal", key).repartition(parts, "deal").drop("deal")


def read_blobs(batches, per_kind: dict[str, list[bytes]]) -> dict[str, list[bytes]]:
    for b in batches:
        for k, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            per_kind[k].append(v)
    return per_kind


# -- texts --------------------------------------------------------------------


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of a string column; a null is an empty text."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    n = len(col)
    if n == 0 or off is None:
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], raw


def pieces(batch: pa.RecordBatch, ids: int, text: int, most: int = 1 << 20):
    """(rids, offsets, bytes) of runs of rows of about `most` bytes; a longer
    text stands alone and whole."""
    rid = batch.column(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    off, buf = text_buffer(batch.column(text))
    a = 0
    while a < len(rid):
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        yield rid[a:b], off[a : b + 1] - off[a], buf[off[a] : off[b]]
        a = b
