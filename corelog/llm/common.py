"""Helpers shared by the training-data operators: shared storage, fresh names, hashed words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LIBC: list = []


def release() -> None:
    """What the worker has freed goes back to the system: it may be idle for long, beside others that need the memory."""
    if _LIBC:
        _LIBC[0].malloc_trim(0)


def _lean() -> None:
    """Large arrays go back to the system when they are freed, so idle Python workers of an executor hold little memory."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD; a fixed one doesn't grow
        libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD
        if hasattr(libc, "malloc_trim"):
            _LIBC.append(libc)
    except (OSError, AttributeError):
        return  # another C library
    pa.set_memory_pool(pa.system_memory_pool())


_lean()

#: Texts are handled in slices of about so many bytes; one longer text is a slice of its own.
SLICE_BYTES = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs on one
    machine (tests). On a cluster the setting is needed: ValueError without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corelog-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_SCRATCH: list[list[str]] = []


def written(df: DataFrame, what: str, *, stays: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here and survives lost executors.

    stays: whether it outlives the scratch() in which it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    level = len(_SCRATCH) - 1 - stays
    if level >= 0:
        _SCRATCH[level].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """The tables that are written inside are deleted at the end, but for those that stay: these must be all that is read later."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table's folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of a row group of written tables: a task that writes holds one in memory.
ROW_GROUP = 32 << 20
#: A written table of up to so many rows of a few numbers (some 16 MB) is broadcast.
BROADCAST_ROWS = 500_000


def small(table: DataFrame, weight: Column | None = None) -> DataFrame:
    """A written table of short rows with a broadcast hint if its rows are counted to be few; joined by shuffle otherwise.

    weight: what a row counts, in rows of some 30 bytes, where rows hold arrays.
    """
    size = table.count() if weight is None else table.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_ROWS else table


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df doesn't have yet (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = "_" + stem
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """A long that is never NULL and equal for equal (doc_id, text); joins by it keep NULL ids and repeated ids apart."""
    return F.xxhash64(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("\x00null")),
        F.coalesce(F.col(text), F.lit("\x00null")),
    )


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) row ranges of about `limit` bytes each, covering all rows."""
    n = len(texts)
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    total = np.cumsum(sizes)
    start = 0
    while start < n:
        base = total[start - 1] if start else 0
        stop = int(np.searchsorted(total, base + limit, side="right"))
        stop = max(stop, start + 1)
        yield start, stop
        start = stop


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and the n + 1 offsets; NULL counts as empty."""
    if not pa.types.is_large_binary(texts.type):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2^64; the worker keeps those that usual slices need."""
    if "up" in _POWERS and len(_POWERS["up"]) >= n:
        return _POWERS["up"][:n], _POWERS["down"][:n]
    made = []
    for b in (_BASE, _INVERSE):
        p = np.full(max(n, 1 << 16), b, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= 4 * SLICE_BYTES:
        _POWERS["up"], _POWERS["down"] = made
    return made[0][:n], made[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the result."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space, whole texts at a time.

    Returns byte starts and ends in data, 64-bit hashes (equal bytes, equal hash, wherever they stand),
    and for each text the index of its first word (n + 1 values).
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    first[edge] = solid[edge]
    last = np.empty(n, bool)
    last[-1] = solid[-1]
    np.logical_and(solid[:-1], ~solid[1:] | first[1:], out=last[:-1])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up, out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; len(hashes) - n + 1 values. Runs cross text borders: the caller masks those."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = h * _BASE + hashes[i : i + m]
    return mix(h)


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash() of ints, as unsigned numbers."""
    with np.errstate(over="ignore"):
        k = np.asarray(x).astype(np.uint32) * np.uint32(0xCC9E2D51)
        k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
        h = np.uint32(42) ^ k
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return h ^ (h >> np.uint32(16))


def bucket_ids(spark: SparkSession, size: float, each: float) -> np.ndarray:
    """Numbers for size / each buckets, a shuffle's partitions at least: a multiple of the partitions, to each of which Spark
    hashes equally many."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, -(-int(np.ceil(size / each)) // parts))
    have, at = [np.zeros(0, np.int64) for _ in range(parts)], 0
    while min(map(len, have)) < share:
        more = np.arange(at, at + 4 * parts * share)
        where = spark_hash(more).view(np.int32).astype(np.int64) % parts
        order = np.argsort(where, kind="stable")
        edges = np.searchsorted(where[order], np.arange(parts + 1))
        have = [h if len(h) >= share else np.concatenate([h, more[order[a:b]]]) for h, a, b in zip(have, edges[:-1], edges[1:], strict=True)]
        at += len(more)
    return np.stack([h[:share] for h in have], 1).reshape(-1)


def squeeze(data: bytes) -> bytes:
    """zstd at Arrow's level."""
    return pa.compress(data, codec="zstd", asbytes=True)


def unsqueeze(data: bytes, size: int) -> bytes:
    """The `size` bytes that squeeze() took."""
    return pa.decompress(data, size, codec="zstd", asbytes=True)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as zstd-compressed byte planes: small or sorted-and-differenced ones take few bytes."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return squeeze(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, n: int, dtype) -> np.ndarray:
    """The n values that pack() took."""
    dtype = np.dtype(dtype)
    raw = unsqueeze(data, n * dtype.itemsize) if n else b""
    planes = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(n)
