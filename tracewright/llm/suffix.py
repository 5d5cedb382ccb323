"""Operator 5: repeated byte strings by longest-previous-factor arrays.

A suffix array of a whole corpus fits no task, so suffixes are dealt to buckets in which all that can match meet.

Long repeats, of whole documents above all, are settled first: texts are cut where their bytes say so into chunks of some hundred
bytes, and a chunk holds the windows that start in it. Chunks travel as 16-byte names; if a smaller document holds an equal one,
all its windows are repeated, and what is covered only by such windows takes no further part. Nothing is lost by that: the smallest document
that holds a window cannot have it in such a chunk.

Of every ``WINDOW`` bytes the least of its 20-byte hashes stands for them, and only places whose hash two documents hold
go on (see ``asking``). The bytes around such a place, up to 30 before and 50 after its start, travel to the bucket of its
hash, once a group and sort: for the least document that holds them and for the greatest. A bucket sorts the suffixes that start
at each of the 31 places up to the hash, to the end of their bytes; the order at a place is the order at the next one, sorted by one more
byte. The longest common prefixes of neighbours and the previous and the next suffix of a smaller document
give each suffix its longest previous factor. Factors of ``WINDOW`` bytes and more travel back as lengths, and what
they cover goes. Bytes are compared there, hashes only bring them together; equal chunks are told by blake2b.

A hash that very many groups hold, or with very many different surroundings in one, may have unlimited different bytes around it. Its
windows go one by one, each to the bucket of its own 50 bytes, where equal windows arrive once a group and sort; so no
bucket grows with one phrase.

Null texts are empty. Rows with equal doc_ids do not remove each other's bytes; rows with a null doc_id
neither remove nor lose bytes. Texts under 50 bytes have no window. Matches never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import asking
from .common import MAX, U64, mix, per_doc, prefix_hash, shares, sliding, span_hash, spans_of, text_buffer, text_bytes, width_hash

WINDOW, KEY = 50, 20
#: Starts of the windows around a place, and bytes left and right of its start.
STARTS = WINDOW - KEY + 1
LEFT, RIGHT = STARTS - 1, WINDOW
SIDE = LEFT + RIGHT


#: Bytes of text in a group, and of those whose hashes are held at once.
GROUP, SLICE = 3 << 19, 1 << 16
#: Bytes of text whose chunks or keys make a bucket, and whose bytes around places, which take more room, do.
BUCKET, FINER = 2 * asking.BUCKET_BYTES, 8 << 20
#: One in so many places starts a chunk, unless such a place is within CLOSE bytes before it; bytes of a chunk's name.
SPARSE, CLOSE, NAME = 256, 64, 16
#: Groups that hold a hash from which on it counts as frequent, rows whose suffixes are sorted at once.
FREQUENT, BLOCK = 1024, 30_000


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places that stand for some window (the least hash in it), and their hashes."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, U64)

    def put(values: np.ndarray, width: int, value: np.uint64) -> None:  # where ``width`` bytes reach into the next document
        at = (offsets[1:-1, None] - np.arange(1, width)).ravel()
        values[at[(at >= 0) & (at < len(values))]] = value

    key = np.minimum(width_hash(prefix_hash(data), KEY), MAX - U64(1))
    put(key, KEY, MAX)
    least = sliding(key, STARTS)
    put(least, WINDOW, U64(0))
    edge = np.zeros(STARTS - 1, U64)
    most = sliding(np.concatenate([edge, least, edge]), STARTS, np.maximum)[: len(key)]
    chosen = np.flatnonzero((key == most) & (most > 0))
    return chosen, mix(key[chosen])  # least ones are small: mixed again, they spread over the buckets


def chunks(data: np.ndarray, offsets: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunks of the documents that count: the range of the window starts of each, and its document's row.

    Where one starts depends on the eight bytes there and on the CLOSE bytes before, so equal passages are cut alike."""
    last = offsets[1:] - WINDOW
    rows = np.flatnonzero(use & (last >= offsets[:-1]))
    at = np.zeros(0, np.int64)
    if len(data) >= 8:
        eight = np.ndarray(len(data) - 7, "<u8", data.tobytes(), strides=(1,))
        at = np.flatnonzero(eight * U64(0x9E3779B97F4A7C15) < MAX // U64(SPARSE))
    row = np.searchsorted(offsets, at, "right") - 1
    far = np.ones(len(at), bool)
    far[1:] = (at[1:] - at[:-1] >= CLOSE) | (row[1:] != row[:-1])
    far &= use[row] & (at > offsets[row]) & (at <= last[row])
    row = np.concatenate([rows, row[far]])
    starts = np.concatenate([offsets[rows], at[far]])
    order = np.argsort(starts, kind="stable")
    starts, row = starts[order], row[order]
    ends = last[row] + 1
    ends[:-1] = np.where(row[1:] == row[:-1], starts[1:], ends[:-1])
    return starts, ends, row


class Group:
    """A group's bytes, its chunks and, once it is told which of them are repeated, the places that stand for the other windows."""

    def __init__(self, texts: pa.Table, told: dict[int, bytes] | None = None, buckets: int = 0):
        ids = texts["doc_id"].combine_chunks()
        self.ids = np.array(pc.fill_null(ids, 0), np.int64)
        self.null = np.array(pc.is_null(ids), bool)
        self.data, self.offsets = text_buffer(texts["text"])
        self.starts, self.ends, row = chunks(self.data, self.offsets, ~self.null)
        raw = memoryview(np.ascontiguousarray(self.data))
        wide = [hashlib.blake2b(raw[a : b + WINDOW - 1], digest_size=NAME).digest() for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]
        high, low = np.frombuffer(b"".join(wide), U64).reshape(-1, 2).T
        doc = self.ids[row]
        order, new = _by_name(high, low, doc)
        at = order[new]
        #: Each name once, sorted, and the least document with such a chunk.
        self.high, self.low, self.least = high[at], low[at], doc[at]
        if told is not None:
            number = np.empty(len(order), np.int64)
            number[order] = np.cumsum(new) - 1
            smaller = np.zeros(len(at), bool)
            for k, a, b in asking.bucket_slices(self.high, buckets):
                smaller[a:b] = np.unpackbits(np.frombuffer(told[k], np.uint8), count=b - a)
            self._open(smaller[number] | (doc > self.least[number]))

    def _open(self, repeated: np.ndarray) -> None:
        """The places that stand for windows of chunks that are not repeated, and how far around them those windows reach."""
        self.repeated, starts, ends = repeated, self.starts[~repeated], self.ends[~repeated]
        use = np.zeros(len(self.ids), bool)
        use[np.searchsorted(self.offsets, starts, "right") - 1] = True
        places, keys = self._anchors(use)
        row = np.searchsorted(self.offsets, places, "right") - 1  # rows of a group are taken in any order
        # the first and the last open window of those a place stands for
        first = np.maximum(places - LEFT, self.offsets[row])
        at = np.searchsorted(ends, first, "right")
        first = np.maximum(first, np.append(starts, len(self.data))[at])
        last = np.minimum(places, np.append(0, ends)[np.searchsorted(starts, places, "right")] - 1)
        own = first <= places
        self.places, self.keys, self.row = places[own], keys[own], row[own]
        self.left, self.right = self.places - first[own], last[own] + WINDOW - self.places
        self.doc = self.ids[self.row] if len(self.places) else np.zeros(0, np.int64)

    def _anchors(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and their hashes, some texts at a time: the hashes of all places take many times the texts' room."""
        size = np.diff(self.offsets)
        data, offsets = self.data[np.repeat(use, size)], np.concatenate([[0], np.cumsum(size[use])])
        moved = self.offsets[:-1][use] - offsets[:-1]
        places, keys, at = [np.zeros(0, np.int64)], [np.zeros(0, U64)], 0
        while at < len(moved):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
            start = offsets[at]
            found, key = anchors(data[start : offsets[to]], offsets[at : to + 1] - start)
            places.append(found + start + moved[np.searchsorted(offsets, found + start, "right") - 1])
            keys.append(key)
            at = to
        return np.concatenate(places), np.concatenate(keys)

    def sorts(self) -> np.ndarray | None:
        """A hash of the bytes around each place of keys with many places: how many different ones a key has is what counts."""
        keys = self.keys & ~U64(0xFFFF)
        key = np.sort(keys)
        crowded = key[asking.MANY :][key[asking.MANY :] == key[: max(0, len(key) - asking.MANY)]]
        if not len(crowded):
            return None
        which = np.flatnonzero(crowded[np.minimum(np.searchsorted(crowded, keys), len(crowded) - 1)] == keys)
        places, left, right = self.places[which], self.left[which], self.right[which]
        out, at = np.zeros(len(keys), U64), 0
        while at < len(which):  # some texts at a time, as above
            to = max(at + 1, int(np.searchsorted(places, places[at] + SLICE)))
            start = self.offsets[self.row[which[at]]]
            prefix = prefix_hash(self.data[start : places[to - 1] + RIGHT + 1])
            p = places[at:to] - start
            out[which[at:to]] = span_hash(prefix, p - left[at:to], p + right[at:to])
            at = to
        return out

    def around(self, which: np.ndarray):
        """Bytes around the given places (rows of SIDE, zero outside the windows) and how far they reach."""
        p, left, right = self.places[which], self.left[which].astype(np.uint8), self.right[which].astype(np.uint8)
        column = np.arange(-LEFT, RIGHT)
        padded = np.concatenate([np.zeros(LEFT, np.uint8), self.data, np.zeros(RIGHT, np.uint8)])
        out = np.lib.stride_tricks.sliding_window_view(padded, SIDE)[p]
        out[(column < -left[:, None].astype(int)) | (column >= right[:, None].astype(int))] = 0
        return out, left, right


def _by_name(high: np.ndarray, low: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of chunks by name, the least document first, and where in it a name begins."""
    order = np.lexsort((doc, low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    return order, new


def _starts(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which window starts lie within the reach of each row."""
    start = np.arange(STARTS)
    return (start >= LEFT - left[:, None].astype(int)) & (start + WINDOW <= LEFT + right[:, None].astype(int))


def previous_smaller(value: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix the common prefix with the nearest earlier one of a smaller value (0 if none).

    lcp[i]: of suffix i with suffix i - 1. Pointers jump over larger values, taking the least common
    prefix on the way, until each stands on a smaller one."""
    n = len(value)
    to, common = np.arange(n) - 1, lcp.copy()
    open_ = np.flatnonzero(to >= 0)
    open_ = open_[value[to[open_]] >= value[open_]]
    while len(open_):
        over = to[open_]
        common[open_] = np.minimum(common[open_], common[over])
        to[open_] = to[over]
        # a prefix too short to matter ends the search
        open_ = open_[(to[open_] >= 0) & (common[open_] >= WINDOW)]
        open_ = open_[value[to[open_]] >= value[open_]]
    found = (to >= 0) & (value[np.maximum(to, 0)] < value)
    return np.where(found, common, 0)


def longest_previous_factors(rows: np.ndarray, ends: np.ndarray, ok: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row and each of its first columns the length of its longest prefix from there that a row of a smaller
    document has at the same column, 0 where it is under WINDOW.

    ends: where each row's bytes end; ok (rows, columns): where a suffix of a row may start."""
    out = np.zeros(ok.shape, np.uint8)
    n, columns = ok.shape
    if n < 2:
        return out
    tail = rows[:, columns - 1 :]
    padded = np.zeros((n, -(-tail.shape[1] // 8) * 8), np.uint8)
    padded[:, : tail.shape[1]] = tail
    order = np.lexsort(padded.view(">u8").astype(U64).T[::-1])  # suffix order at the last column
    for c in range(columns - 1, -1, -1):
        if c < columns - 1:  # of the order at the next column, sorted by one more byte
            order = order[np.argsort(rows[order, c], kind="stable")]
        here = order[ok[order, c]]
        if len(here) < 2:
            continue
        sorted_ = rows[here, c:]
        differ = sorted_[1:] != sorted_[:-1]
        at = differ.argmax(1)
        same = np.where(differ[np.arange(len(at)), at], at, sorted_.shape[1])
        lcp = np.zeros(len(here), np.int64)
        lcp[1:] = np.minimum(same, np.minimum(ends[here[1:]], ends[here[:-1]]) - c)
        d = doc[here]
        back = np.zeros(len(here), np.int64)
        back[1:] = lcp[:0:-1]
        found = np.maximum(previous_smaller(d, lcp), previous_smaller(d[::-1], back)[::-1])
        out[here, c] = np.where(found >= WINDOW, found, 0)
    return out


class Distinct:
    """Each of the rows (key, bytes, reach) once, sorted by key, for its least document and, as ``later``, for its greatest."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray):
        n = len(keys)
        wide = np.concatenate([rows, left[:, None], right[:, None], np.zeros((n, (-SIDE - 2) % 8), np.uint8)], 1).view(U64) if n else np.zeros((0, 1), U64)
        mixed = np.zeros(n, U64)
        for k in range(wide.shape[1]):
            mixed = (mixed ^ wide[:, k]) * U64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> U64(29)
        order = np.lexsort((mixed, keys))
        new = np.ones(n, bool)  # by the bytes themselves; rows that share a hash may come more than once
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (wide[order[1:]] != wide[order[:-1]]).any(1)
        at = np.flatnonzero(new)
        number = np.empty(n, np.int64)
        number[order] = np.cumsum(new) - 1
        least, most = (f.reduceat(doc[order], at) if n else doc for f in (np.minimum, np.maximum))
        again = np.flatnonzero(most > least)
        which = np.concatenate([np.arange(len(at)), again])
        by_key = np.argsort(keys[order][at][which], kind="stable") if n else which
        place = np.empty(len(which), np.int64)
        place[by_key] = np.arange(len(which))
        later = np.full(len(at), -1, np.int64)
        later[again] = place[len(at) :]
        self.first = order[at][which[by_key]] if n else which
        self.doc = np.concatenate([least, most[again]])[by_key]
        #: The place of each row's document among the distinct ones.
        self.place = np.where(doc > least[number], later[number], place[: len(at)][number]) if n else which


def factors(keys, rows, left, right, doc) -> np.ndarray:
    """For each row (bytes around a place) the longest previous factor of each of its starts."""
    d = Distinct(keys, rows, left, right, doc)
    own = keys[d.first]
    out, k = np.zeros((len(own), STARTS), np.uint8), 0
    while k < len(own):  # whole keys at a time
        end = min(len(own), k + BLOCK)
        while end < len(own) and own[end] == own[end - 1]:
            end += 1
        at = d.first[k:end]
        out[k:end] = longest_previous_factors(rows[at], LEFT + right[at].astype(np.int64), _starts(left[at], right[at]), d.doc[k:end])
        k = end
    return out[d.place]


def _ask_chunks(pid: int, g: Group, buckets: int) -> pa.Table:
    """A group's distinct chunks, each with its least document there."""
    slices = asking.bucket_slices(g.high, buckets)
    # bytes of equal weight side by side: most of those of document ids are equal
    blobs = [g.high[a:b].tobytes() + g.low[a:b].tobytes() + g.least[a:b].view(np.uint8).reshape(-1, 8).T.tobytes() for _, a, b in slices]
    return pa.table([pa.array([k for k, _, _ in slices], pa.int32()), pa.array([pid] * len(slices), pa.int32()), pa.array(blobs, pa.binary())], schema=asking.ASK_ARROW)


def _answer_chunks(batches):
    """A bit for each chunk asked about: a smaller document than the group's least one holds it."""
    asked = asking.rows_of(batches, asking.ASK_ARROW)
    blobs = asked["blob"].to_pylist()
    if blobs:
        sizes = [len(b) // (NAME + 8) for b in blobs]
        high, low = (np.concatenate([np.frombuffer(b, U64, n, 8 * n * k) for b, n in zip(blobs, sizes, strict=True)]) for k in (0, 1))
        doc = np.concatenate([np.frombuffer(b, np.uint8, offset=NAME * n).reshape(8, n).T.copy().view(np.int64).ravel() for b, n in zip(blobs, sizes, strict=True)])
        order, new = _by_name(high, low, doc)
        smaller = np.empty(len(doc), bool)
        smaller[order] = doc[order] > doc[order[new]][np.cumsum(new) - 1]
        edges = np.cumsum([0, *sizes])
        bits = [np.packbits(smaller[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([asked["pid"].combine_chunks(), asked["bucket"].combine_chunks(), pa.array(bits, pa.binary())], ["pid", "bucket", "blob"])


def _ask_bytes(pid: int, keys, rows, left, right, least, buckets: int) -> pa.Table:
    squeeze, out = zstandard.ZstdCompressor(level=1), []
    for k, a, b in asking.bucket_slices(keys, buckets):
        ids, index = np.unique(least[a:b], return_inverse=True)
        wide = np.uint16 if len(ids) <= 1 << 16 else np.uint32
        parts = [np.array([b - a, len(ids), np.dtype(wide).itemsize], np.int64), keys[a:b] >> U64(16), ids, index.astype(wide), left[a:b], right[a:b], rows[a:b]]
        out.append((k, squeeze.compress(b"".join([np.ascontiguousarray(p).tobytes() for p in parts]))))
    return pa.table([pa.array([r[0] for r in out], pa.int32()), pa.array([pid] * len(out), pa.int32()), pa.array([r[1] for r in out], pa.binary())], schema=asking.ASK_ARROW)


def _read_bytes(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m, size = np.frombuffer(raw, np.int64, 3).tolist()
    at = 24
    keys = np.frombuffer(raw, U64, n, at)
    ids = np.frombuffer(raw, np.int64, m, at + 8 * n)
    at += 8 * (n + m)
    index = np.frombuffer(raw[at : at + size * n], np.uint16 if size == 2 else np.uint32)
    at += size * n
    left, right = np.frombuffer(raw, np.uint8, n, at), np.frombuffer(raw, np.uint8, n, at + n)
    return keys, np.frombuffer(raw, np.uint8, n * SIDE, at + 2 * n).reshape(n, SIDE), left, right, ids[index]


def _answer_bytes(batches):
    pids, ids, got = [], [], []
    for t in batches:
        pids += t.column(1).to_pylist()
        ids += t.column(0).to_pylist()
        got += [_read_bytes(b) for b in t.column(2).to_pylist()]
    if got:
        edges = np.cumsum([0, *(len(g[0]) for g in got)])
        columns = [np.concatenate(x) for x in zip(*got, strict=True)]
        got.clear()
        found = factors(*columns)
        yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int32()), pa.array(ids, pa.int32()), pa.array([zstandard.compress(found[a:b].tobytes(), 1) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], ["pid", "bucket", "blob"])


def _shared(g: Group, answers: pa.Table, buckets: int):
    """What the group asks about: anchor, key, bytes around it and their reach; the distinct rows of those."""
    shared, frequent = asking.shared_mask(g.keys, g.doc, asking.blobs_of(answers, 1), buckets)
    which = np.flatnonzero(shared)
    rows, left, right = g.around(which)
    keys = g.keys[which] & ~U64(0xFFFF)
    if frequent.any():
        lone = frequent[which]
        r, s = np.nonzero(_starts(left, right) & lone[:, None])
        column = np.arange(SIDE)
        one = np.where((column >= s[:, None]) & (column < s[:, None] + WINDOW), rows[r], np.uint8(0))
        at = g.places[which[r]] - LEFT + s
        own = span_hash(prefix_hash(g.data, 2), at, at + WINDOW) & ~U64(0xFFFF)
        which, keys = np.concatenate([which[~lone], which[r]]), np.concatenate([keys[~lone], own])
        rows = np.concatenate([rows[~lone], one])
        left = np.concatenate([left[~lone], (LEFT - s).clip(0).astype(np.uint8)])
        right = np.concatenate([right[~lone], (s + WINDOW - LEFT).astype(np.uint8)])
    return which, keys, rows, left, right, Distinct(keys, rows, left, right, g.doc[which])


def removed_bytes(t: pa.Table, answers: pa.Table, buckets: int, finer: int) -> tuple[Group, np.ndarray]:
    """A group's bytes and which of them go. finer: the buckets of bytes."""
    g = Group(t, asking.blobs_of(answers, 0), buckets)
    which, keys, _, _, _, d = _shared(g, answers, buckets)
    told, found = asking.blobs_of(answers, 2), np.zeros((len(d.first), STARTS), np.uint8)
    for k, a, b in asking.bucket_slices(keys[d.first], finer):
        found[a:b] = np.frombuffer(zstandard.decompress(told[k]), np.uint8).reshape(-1, STARTS)
    found = found[d.place]
    edge = np.zeros(len(g.data) + 1, np.int32)
    edge[g.starts[g.repeated]] += 1
    np.add.at(edge, g.ends[g.repeated] + WINDOW - 1, -1)
    place = g.places[which] - LEFT
    for s in range(STARTS):
        at = np.flatnonzero(found[:, s])
        np.add.at(edge, place[at] + s, 1)
        np.add.at(edge, place[at] + s + found[at, s], -1)
    return g, np.cumsum(edge[:-1]) > 0


def _exchange(docs: DataFrame, *more):
    total = text_bytes(docs)
    buckets, finer = shares(total, BUCKET), shares(total, FINER)
    groups = asking.grouped(docs, F.col("doc_id").cast("long").alias("doc_id"), "text", *more, groups=shares(total, GROUP))
    back = "pid int, bucket int, blob binary"

    def ask_chunks(t: pa.Table) -> pa.Table:
        return _ask_chunks(t["pid"][0].as_py(), Group(t), buckets)

    def ask_keys(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(t):
            return asking.ASK_ARROW.empty_table()
        g = Group(t, asking.blobs_of(answers, 0), buckets)
        return asking.ask_shared(t["pid"][0].as_py(), g.keys, g.doc, buckets, g.sorts())

    def answer_keys(batches):
        yield from asking.answer_shared(batches, FREQUENT)

    def ask_bytes(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(t):
            return asking.ASK_ARROW.empty_table()
        _, keys, rows, left, right, d = _shared(Group(t, asking.blobs_of(answers, 0), buckets), answers, buckets)
        return _ask_bytes(t["pid"][0].as_py(), keys[d.first], rows[d.first], left[d.first], right[d.first], d.doc, finer)

    # one plan without a written step between: Spark reuses the groups' exchange in it, whereas each action would make its own and
    # the earlier ones would stay on disk until the driver happens to collect its garbage
    chunked = asking.to_buckets(asking.per_group(groups, ask_chunks, asking.ASK), _answer_chunks, back).withColumn("kind", F.lit(0))
    keys = asking.to_buckets(asking.with_answers(groups, chunked, ask_keys, asking.ASK), answer_keys, back).withColumn("kind", F.lit(1))
    told = chunked.union(keys)
    found = asking.to_buckets(asking.with_answers(groups, told, ask_bytes, asking.ASK), _answer_bytes, back).withColumn("kind", F.lit(2))
    return groups, told.union(found), buckets, finer


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row."""
    groups, answers, buckets, finer = _exchange(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def finish(t: pa.Table, told: pa.Table) -> pa.Table:
        if not len(t):
            return schema.empty_table()
        g, gone = removed_bytes(t, told, buckets, finer)
        size = np.diff(g.offsets)
        _, _, spans = spans_of(gone, g.offsets)
        edges = g.offsets.tolist()
        kept = [hashlib.sha256(g.data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table([t["doc_id"].combine_chunks(), pa.array(size, pa.int64()), pa.array(per_doc(gone, size), pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    return asking.with_answers(groups, answers, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with the remaining bytes as text (binary, as a cut inside a character may leave invalid UTF-8); other columns as they
    are."""
    carried = asking.Carried(docs)
    groups, answers, buckets, finer = _exchange(docs, *carried.sent)

    def finish(t: pa.Table, told: pa.Table) -> pa.Table:
        if not len(t):
            return pa.table({"doc_id": t["doc_id"], "kept": pa.array([], pa.binary())} | carried.taken(t))
        g, gone = removed_bytes(t, told, buckets, finer)
        edges = g.offsets.tolist()
        kept = [g.data[a:b][~gone[a:b]].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({"doc_id": t["doc_id"], "kept": pa.array(kept, pa.binary())} | carried.taken(t))

    return carried.restored(asking.with_answers(groups, answers, finish, carried.schema("doc_id long", "kept binary")), "kept")
