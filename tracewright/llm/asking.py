"""Two-way exchange between groups of whole texts and buckets of keys.

Texts are dealt into groups of bounded size by a hash of doc_id; that exchange is made once and read again
by every step of a query. A group asks about its distinct keys: the keys, sorted, go in one packed row to
each bucket, so a key that very many documents hold arrives once a group at most. A bucket's answer goes
back to the group as one packed row, in the order of the question, which the group can rebuild from
its texts. Whole texts never travel again, and neither keys nor answers reach the driver.

Groups and buckets are as many as the bytes of the texts ask for, whatever the number of partitions: a group holds
about GROUP_BYTES of text, a bucket what about BUCKET_BYTES of text ask. Tasks are as many as the shuffle has partitions; a task reads its
buckets one after the other. Rows between groups and buckets are groups times buckets at
most and never more than one for each distinct key of a group, which a plain groupBy would send as well.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, partitions, release

#: What a group sends to a bucket, and gets back.
ASK = "bucket int, pid int, blob binary"
ASK_ARROW = pa.schema([("bucket", pa.int32()), ("pid", pa.int32()), ("blob", pa.binary())])
#: Bytes of a 64-bit key that travel: its upper 48 bits.
KEY_BYTES = 6
#: Bytes of text whose questions make a bucket.
BUCKET_BYTES = 16 << 20


def grouped(docs: DataFrame, *columns: str, groups: int) -> DataFrame:
    """pid and ``columns``, dealt by pid into groups."""
    pid = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("pid")
    return docs.select(pid, *columns).repartition(partitions(docs.sparkSession), "pid")


class Carried:
    """The columns of ``docs`` besides doc_id and text: they travel under names of their own, so that none can clash."""

    def __init__(self, docs: DataFrame):
        self.columns, self.kinds = docs.columns, {f.name: f.dataType.simpleString() for f in docs.schema}
        self.names = {c: f"c{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}

    @property
    def sent(self) -> list:
        return [F.col(c).alias(n) for c, n in self.names.items()]

    def schema(self, *first: str) -> str:
        return ", ".join([*first, *(f"{n} {self.kinds[c]}" for c, n in self.names.items())])

    def taken(self, t: pa.Table) -> dict:
        return {n: t[n] for n in self.names.values()}

    def restored(self, out: DataFrame, text: str = "text") -> DataFrame:
        """The columns in their order, ``text`` in the text's place."""
        return out.select(*[F.col("doc_id").cast(self.kinds["doc_id"]).alias("doc_id") if c == "doc_id" else F.col(text).alias(c) if c == "text" else F.col(self.names[c]).alias(c) for c in self.columns])


def per_group(groups: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        out = f(t)
        release()
        return out

    return groups.groupBy("pid").applyInArrow(run, schema)


def with_answers(groups: DataFrame, answers: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """f(texts of a group, its answers); groups without texts do not occur."""

    def run(t: pa.Table, told: pa.Table) -> pa.Table:
        out = f(t, told)
        release()
        return out

    return groups.groupBy("pid").cogroup(answers.groupBy("pid")).applyInArrow(run, schema)


def to_buckets(asked: DataFrame, f: Callable, schema: str) -> DataFrame:
    """f (over batches) for the rows of one whole bucket at a time. Tasks are the shuffle's partitions, however many buckets
    there are: a task's rows are sorted by bucket, which may spill, and its buckets are read one after the other."""

    def run(t: pa.Table) -> pa.Table:
        out = pa.Table.from_batches(f(iter(t.to_batches())))
        release()
        return out

    return asked.groupBy("bucket").applyInArrow(run, schema)


def bucket_slices(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted 64-bit keys; a bucket is a range of the key space. Only buckets that hold a key are looked at,
    so the cost follows the keys."""
    if not len(keys):
        return []
    near = np.unique((keys >> U64(32)) * U64(buckets) >> U64(32)).tolist()  # at most one too low
    present = sorted({k for n in near for k in (n, min(n + 1, buckets - 1))})
    at = [*np.searchsorted(keys, np.array([(k << 64) // buckets for k in present], dtype=U64)).tolist(), len(keys)]
    return [(k, a, b) for k, a, b in zip(present, at[:-1], at[1:], strict=True) if b > a]


def pack_keys(keys: np.ndarray) -> bytes:
    """The upper 48 bits of each key."""
    return np.ascontiguousarray((keys >> U64(16)).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def unpack_keys(blob, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(blob, np.uint8, n * KEY_BYTES).reshape(n, KEY_BYTES)
    return out.view(U64).ravel()


def rows_of(batches, schema: pa.Schema) -> pa.Table:
    """All rows of a task's partition."""
    got = list(batches)
    return pa.Table.from_batches(got) if got else schema.empty_table()


# --- which keys do two documents or more hold? -------------------------------------------------


#: Places of one group, or groups, that hold a key from which on it counts as frequent.
MANY, FREQUENT = 64, 32


def ask_shared(pid: int, keys: np.ndarray, doc: np.ndarray, buckets: int, sorts: np.ndarray | None = None) -> pa.Table:
    """Question rows of a group: its distinct keys, each with two bits: two documents or more of the group hold it;
    more than MANY of its places (or, if given, of their sorts) do.

    doc: an integer for each key that is equal for equal documents."""
    distinct, several, many = own_keys(keys, doc, sorts)
    slices = bucket_slices(distinct, buckets)
    blobs = [pack_keys(distinct[a:b]) + np.packbits(several[a:b]).tobytes() + np.packbits(many[a:b]).tobytes() for _, a, b in slices]
    return pa.table([pa.array([s[0] for s in slices], pa.int32()), pa.array([pid] * len(slices), pa.int32()), pa.array(blobs, pa.binary())], schema=ASK_ARROW)


def own_keys(keys: np.ndarray, doc: np.ndarray, sorts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct 48-bit keys (as 64-bit values), whether two documents of the group and whether many places hold them."""
    keys = keys & ~U64(0xFFFF)
    order = np.argsort(keys, kind="stable") if sorts is None else np.lexsort((sorts, keys))
    keys, doc = keys[order], doc[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    if not len(at):
        return keys, np.zeros(0, bool), np.zeros(0, bool)
    new = np.ones(len(keys), np.int64)
    if sorts is not None:
        new[1:] = first[1:] | (sorts[order][1:] != sorts[order][:-1])
    return keys[at], np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at), np.add.reduceat(new, at) > MANY


def _n_keys(blob: bytes) -> int:
    """n such that 6 n + 2 ceil(n / 8) is the blob's length."""
    return len(blob) * 8 // (8 * KEY_BYTES + 2)


def answer_shared(batches, least: int = FREQUENT):
    """Two bits for each key asked about: held by two documents or more; frequent (see FREQUENT)."""
    asked = rows_of(batches, ASK_ARROW)
    blobs, pids, ids = asked["blob"].to_pylist(), asked["pid"], asked["bucket"]
    sizes = [_n_keys(b) for b in blobs]
    if sizes:
        keys = np.concatenate([unpack_keys(b, n) for b, n in zip(blobs, sizes, strict=True)])
        flags = [np.unpackbits(np.frombuffer(b, np.uint8, offset=KEY_BYTES * n).reshape(2, -1), axis=1, count=n) for b, n in zip(blobs, sizes, strict=True)]
        several, crowded = np.concatenate(flags, axis=1).astype(bool)
        order = np.argsort(keys, kind="stable")
        first = np.ones(len(keys), bool)
        first[1:] = keys[order][1:] != keys[order][:-1]
        at = np.flatnonzero(first)
        held = np.diff(np.append(at, len(keys)))
        shared = (held > 1) | np.maximum.reduceat(several[order], at)
        frequent = shared & ((held >= least) | np.maximum.reduceat(crowded[order], at))
        out, many = np.empty(len(keys), bool), np.empty(len(keys), bool)
        out[order] = np.repeat(shared, held)
        many[order] = np.repeat(frequent, held)
        edges = np.cumsum([0, *sizes])
        bits = [np.packbits(out[a:b]).tobytes() + np.packbits(many[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(pids.combine_chunks().to_numpy(zero_copy_only=False), pa.int32()), pa.array(ids.combine_chunks().to_numpy(zero_copy_only=False), pa.int32()), pa.array(bits, pa.binary())], ["pid", "bucket", "blob"])


def shared_mask(keys: np.ndarray, doc: np.ndarray, answers: dict[int, bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the group's keys (as given to ask_shared) whether it is shared, and whether it is frequent."""
    distinct, _, _ = own_keys(keys, doc)
    told = np.zeros((2, len(distinct)), bool)
    for k, a, b in bucket_slices(distinct, buckets):
        told[:, a:b] = np.unpackbits(np.frombuffer(answers[k], np.uint8).reshape(2, -1), axis=1, count=b - a)
    at = np.searchsorted(distinct, keys & ~U64(0xFFFF))
    return (told[0][at], told[1][at]) if len(distinct) else (np.zeros(0, bool), np.zeros(0, bool))


def blobs_of(table: pa.Table, kind: int) -> dict[int, bytes]:
    """The answers of one kind by bucket."""
    mine = [k == kind for k in table["kind"].to_pylist()]
    return {b: x for b, x, m in zip(table["bucket"].to_pylist(), table["blob"].to_pylist(), mine, strict=True) if m}
