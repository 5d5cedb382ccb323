"""Shared helpers of the corpus operators: Spark housekeeping and vectorised text hashing.

The numpy parts run inside Spark tasks on one Arrow batch or one bounded group at a time.
"""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
MAX = U64(0xFFFFFFFFFFFFFFFF)
#: Text bytes that one Python group may hold.
GROUP_BYTES = 3 << 20


# --- Spark housekeeping -------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set (local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_dir = spark.sparkContext.getCheckpointDir()
        found = set_dir if set_dir else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at durable files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracewright-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracewright_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete the files behind a frame that ``cut`` returned and that nothing reads any more."""
    path = getattr(df, "_tracewright_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts (one scan of one column)."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shares(total: int, size: int) -> int:
    """How many shares of about ``size`` bytes ``total`` bytes make: it follows the data, not the partitions."""
    return max(1, -(-total // size))


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


# --- text buffers ---------------------------------------------------------------------------


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another and their len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(rows, column: int | None = None, size: int = GROUP_BYTES):
    """A column, or a batch by one of its columns, in slices of about ``size`` bytes of text (one text at least)."""
    text = rows if column is None else rows.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(text):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size)))
        yield rows.slice(at, to - at)
        at = to


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array over the bytes of ``data``; ``ends``: where each value ends."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and count per document of the runs of ``inside``; no run crosses documents."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:][offsets[1:] > 0] - 1
    last[edges] = inside[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are maximal runs of bytes other than blank and 0x09-0x0D."""
    return spans_of(~_SPACE[data], offsets)


# --- hashing ----------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _stream(seed: int, n: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 20)) * U64(0x9E3779B97F4A7C15))


#: Spans up to this many bytes are named eight bytes at a time side by side, longer ones by blake2b.
_SHORT = 64


def names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name of each span, equal for equal bytes. Every eight bytes go through the finaliser before the next eight
    join, so unlike a polynomial hash it has no families of texts that collide."""
    size = ends - starts
    out = mix(size.astype(U64) + U64(0x9E3779B97F4A7C15))
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= _SHORT))
    at, left = starts[live], size[live]
    while len(live):
        chunk = eight[at]
        chunk &= MAX >> (8 * (8 - np.minimum(left, 8))).astype(U64)
        out[live] = mix((out[live] ^ chunk) * U64(0xD6E8FEB86659FD93) + U64(0x2545F4914F6CDD1D))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > _SHORT).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


_BASE = int(_stream(7, 1)[0]) | 1
_POWERS: dict[str, np.ndarray] = {}
_BYTES: dict[int, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            made = np.full(size, base, U64)
            made[0] = 1
            _POWERS[name] = np.cumprod(made)
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(data: np.ndarray, seed: int = 1) -> np.ndarray:
    """len + 1 prefix sums from which ``span_hash`` gives the hash of any span in O(1): a polynomial hash, for spans under
    256 bytes only (beyond, there are texts that collide whatever the base) and where bytes are compared afterwards."""
    if seed not in _BYTES:
        _BYTES[seed] = _stream(seed, 256)
    out = np.zeros(len(data) + 1, U64)
    up, _ = _powers(len(data) + 1)
    np.cumsum(_BYTES[seed][data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64))


def width_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """``span_hash`` of all spans of ``width`` bytes."""
    _, down = _powers(len(prefix))
    out = prefix[width:] - prefix[:-width]
    out *= down[: len(out)]
    out += U64(width)
    return mix(out)


def window_hash(items: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hash of each ``width`` consecutive items (len - width + 1 values, none if shorter)."""
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    by = _stream(100 + seed, 1)[0] | U64(1)
    out = np.zeros(n, U64)
    for k in range(width):
        out *= by
        out += items[k : k + n]
    return mix(out + U64(width))


def sliding(values: np.ndarray, width: int, f=np.minimum) -> np.ndarray:
    """f over each ``width`` consecutive values by doubling (len - width + 1 values)."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = f(out[: len(out) - step], out[step:])
        have += step
    return out


def per_doc(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (one per item) over each document's ``counts`` items."""
    total = np.concatenate([[0], np.cumsum(values)])
    at = np.concatenate([[0], np.cumsum(counts)])
    return (total[at[1:]] - total[at[:-1]]).astype(np.int64)


def arrow_table(schema: pa.Schema, **columns) -> pa.Table:
    return pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
