"""Operator 1: fuzzy line deduplication by MinHash.

Lines are normalised (A-Z lower-cased, words joined by single blanks); lines without a word are left
alone. A line's set holds its distinct shingles of ``SHINGLE`` characters (a shorter line is one
shingle). ``BANDS`` bands of ``ROWS`` minima propose candidates; at a Jaccard similarity of 0.75 a pair
shares no band with probability 4.7e-4, one at 0.8 with 3e-5. Candidates are verified on full sets, components come from distributed
union-find (see ``linking``), and of each component the first line stays: least doc_id, then least place.

Equal normalised lines are one node and so always in one component. Null texts have no lines. Rows
with equal doc_ids are one document: their lines at the same place count as the same line; a null doc_id comes
after all others and, of several lines in such documents, the first place stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import asking
from .common import GROUP_BYTES, U64, _stream, cut, shares, text_buffer, text_bytes
from .linking import link, sketches

SHINGLE, PERCENT = 9, 75
BANDS, ROWS = 14, 3
NODE = 10

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_A = (_stream(41, BANDS * ROWS) >> U64(32)).astype(np.uint32) | np.uint32(1)
_B = (_stream(42, BANDS * ROWS) >> U64(32)).astype(np.uint32)


def normal_lines(text: str | None) -> list[bytes]:
    """The normalised form of each line ('' for a line without a word)."""
    return [b" ".join(line.split()) for line in (text or "").encode().translate(_LOWER).split(b"\n")]


def all_normal_lines(texts: pa.ChunkedArray) -> list[list[bytes]]:
    """normal_lines of each text; those whose blanks are single ones between words are only lower-cased and split."""
    data, offsets = text_buffer(texts)
    blank, newline = data == 32, data == 10
    odd = (data >= 9) & (data <= 13) & ~newline
    odd[1:] |= blank[1:] & (blank[:-1] | newline[:-1])
    odd[:-1] |= blank[:-1] & newline[1:]
    size = np.diff(offsets)
    ends = np.flatnonzero(size > 0)
    odd[offsets[ends]] |= blank[offsets[ends]]
    odd[offsets[ends + 1] - 1] |= blank[offsets[ends + 1] - 1]
    at = np.flatnonzero(odd)
    plain = np.searchsorted(at, offsets[:-1]) == np.searchsorted(at, offsets[1:])
    low, edges = data.tobytes().translate(_LOWER), offsets.tolist()
    out = []
    for a, b, ok in zip(edges[:-1], edges[1:], plain.tolist(), strict=True):
        lines = low[a:b].split(b"\n")
        out.append(lines if ok else [b" ".join(line.split()) for line in lines])
    return out


def node_of(line: bytes) -> bytes:
    return hashlib.blake2b(line, digest_size=NODE).digest()


def _mix32(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def _spread(lines: list[bytes]):
    """Code points of the lines one after another, and from where to where the shingles of each start. A line ends
    with SHINGLE - 1 zeros that only short lines' shingles reach into."""
    gap = b"\0" * (SHINGLE - 1)
    points = np.frombuffer((gap.join(lines) + gap).decode().encode("utf-32-le"), np.uint32)
    size = np.array([len(x) if x.isascii() else len(x.decode()) for x in lines])
    start = np.cumsum(size + SHINGLE - 1) - size - (SHINGLE - 1)
    return points, start, start + np.maximum(1, size - SHINGLE + 1)


def _slices(lines: list[bytes], most: int = 1 << 16):
    """Ranges of lines of about ``most`` bytes, so that what is made of their characters stays in a core's cache."""
    k = 0
    while k < len(lines):
        end, held = k, 0
        while end < len(lines) and (end == k or held < most):
            held += len(lines[end])
            end += 1
        yield k, end
        k = end


def _inside(hashed: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the lines without what lies between a line's last one and the next line, and where each line's start."""
    edges = np.zeros(len(hashed) + 1, np.int8)
    edges[start] += 1
    edges[stop] -= 1
    size = stop - start
    return hashed[np.cumsum(edges[:-1], dtype=np.int8).view(bool)], np.cumsum(size) - size


def band_keys(lines: list[bytes]) -> np.ndarray:
    """64-bit band keys, BANDS for each line; lines are not empty."""
    out = np.empty((len(lines), BANDS), U64)
    for k, end in _slices(lines):
        points, start, stop = _spread(lines[k:end])
        hashed = np.zeros(len(points) - SHINGLE + 1, np.uint32)
        for step in range(SHINGLE):
            hashed *= np.uint32(0x9E3779B1)
            hashed += points[step : step + len(hashed)]
        hashed, first = _inside(_mix32(hashed), start, stop)
        turned, key = np.empty_like(hashed), np.empty(end - k, U64)
        for band in range(BANDS):
            key[:] = band + 1
            for row in range(band * ROWS, (band + 1) * ROWS):
                np.multiply(hashed, _A[row], out=turned)
                turned += _B[row]
                key ^= np.minimum.reduceat(turned, first)
                key *= U64(0x9E3779B97F4A7C15)
                key ^= key >> U64(32)
            np.multiply(key, U64(0xD6E8FEB86659FD93), out=out[k:end, band])
    return out


def _joined(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    out = (a ^ (a >> U64(31))) * U64(0x9E3779B97F4A7C15) + (b ^ (b >> U64(29))) * U64(0xD6E8FEB86659FD93) + U64(width)
    out ^= out >> U64(32)
    return out


def _first(points: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` characters, a power of two."""
    out = points.astype(U64) + U64(1)
    for k in range(width.bit_length() - 1):
        out = _joined(out[: len(out) - (1 << k)], out[1 << k :], 1 << k)
    return out


def shingle_sets(lines: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each normalised line's shingles."""
    out: list[np.ndarray] = []
    for k, end in _slices(lines):
        points, start, stop = _spread(lines[k:end])
        hashed, width = points.astype(U64) + U64(1), 1
        while width < SHINGLE:  # of twice as many characters, then of the rest
            more = min(width, SHINGLE - width)
            hashed = _joined(hashed[: len(hashed) - more], hashed[more:] if more == width else _first(points, more)[width:], width)
            width += more
        hashed, first = _inside(hashed, start, stop)
        ends = [*first[1:].tolist(), len(hashed)]
        for a, b in zip(first.tolist(), ends, strict=True):
            hashed[a:b].sort()
        new = np.ones(len(hashed), bool)
        new[1:] = hashed[1:] != hashed[:-1]
        new[first] = True
        size = np.add.reduceat(new, first, dtype=np.int64)
        hashed, to = hashed[new], np.cumsum(size)
        out += [hashed[a:b] for a, b in zip((to - size).tolist(), to.tolist(), strict=True)]
    return out


# --- the exchange of band keys -------------------------------------------------------------------

#: Bytes of a line's node that travel with a band key, to tell copies of a line from different lines: two different lines of
#: one band are taken for copies, and that band of theirs is lost, with probability 2 ** -48.
CHECK = 6


def _own(t: pa.Table, normals: list[list[bytes]] | None = None) -> dict[bytes, tuple[bool, int, int]]:
    """A group's distinct lines and where each stands first: (no id, doc_id, place). normals: of each text, if at hand."""
    first: dict[bytes, tuple[bool, int, int]] = {}
    for doc, normal in zip(t["doc_id"].to_pylist(), normals or all_normal_lines(t["text"]), strict=True):
        for place, x in enumerate(normal):
            if x:
                at = (doc is None, doc or 0, place)
                if x not in first or at < first[x]:
                    first[x] = at
    return first


def _ask(pid: int, t: pa.Table, buckets: int) -> pa.Table:
    """A row for each bucket: its band keys (32 bits within the bucket's range), with each the line's check and number in the
    group's sorted lines. The highest bit of a number tells the first band."""
    lines = sorted(_own(t))
    if not lines:
        return asking.ASK_ARROW.empty_table()
    keys = band_keys(lines).ravel()
    # the upper bits of the product with the number of buckets: the bucket, then the place in its range
    keys = (keys >> U64(32)) * U64(buckets) + ((keys & U64(0xFFFFFFFF)) * U64(buckets) >> U64(32))
    bucket, inside = (keys >> U64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32), keys.astype(np.uint32)
    order = np.argsort(bucket, kind="stable")
    bucket, inside, wide = bucket[order], inside[order], np.uint16 if len(lines) <= 1 << 15 else np.uint32
    check = np.frombuffer(b"".join(node_of(x)[:CHECK] for x in lines), f"V{CHECK}")[order // BANDS]
    number = np.repeat(np.arange(len(lines), dtype=wide), BANDS)
    number[::BANDS] |= wide(1 << (8 * number.itemsize - 1))
    number = number[order]
    at = np.append(np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1)), len(keys)).tolist()
    head = bytes([number.itemsize])
    blobs = [head + inside[a:b].tobytes() + check[a:b].tobytes() + number[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.table([pa.array(bucket[at[:-1]].astype(np.int32)), pa.array([pid] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], schema=asking.ASK_ARROW)


def _read(blob: bytes):
    """Keys, checks, numbers of lines and whether the key is of the first band."""
    wide = blob[0]
    n = (len(blob) - 1) // (4 + CHECK + wide)
    check = np.zeros((n, 8), np.uint8)
    check[:, :CHECK] = np.frombuffer(blob, np.uint8, n * CHECK, 1 + 4 * n).reshape(n, CHECK)
    line = np.frombuffer(blob[1 + (4 + CHECK) * n :], np.uint16 if wide == 2 else np.uint32).astype(np.uint32)
    top = np.uint32(1 << (8 * wide - 1))
    return np.frombuffer(blob[1 : 1 + 4 * n], np.uint32), check.view(U64).ravel(), line & (top - np.uint32(1)), line >= top


def _answer(batches):
    """To each group the band keys that two different lines have, with the numbers of its lines, and the numbers of other lines that
    another group has too."""
    asked = asking.rows_of(batches, asking.ASK_ARROW)
    got = [_read(b) for b in asked["blob"].to_pylist()]
    if not got:
        return
    bucket, pids = asked["bucket"][0].as_py(), asked["pid"].to_pylist()
    group = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
    key, check, line, one = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(key, kind="stable")
    key, check = key[order], check[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    held = np.diff(np.append(at, len(key)))
    differ = np.minimum.reduceat(check, at) != np.maximum.reduceat(check, at)
    shared = np.repeat(differ, held)
    copy = order[np.repeat(~differ & (held > 1), held)]
    copy = np.sort(copy[one[copy]])
    key, order = key[shared].astype(np.int64) + (bucket << 32), order[shared]
    back = np.argsort(group[order], kind="stable")
    key, order = key[back], order[back]
    edges, ends = (np.searchsorted(group[x], np.arange(len(got) + 1)).tolist() for x in (order, copy))
    blobs = [np.int64(b - a).tobytes() + key[a:b].tobytes() + line[order[a:b]].tobytes() + line[copy[c:d]].tobytes() for a, b, c, d in zip(edges[:-1], edges[1:], ends[:-1], ends[1:], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int32()), pa.array([bucket] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["pid", "bucket", "blob"])


def _told(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an answer: shared keys, the number of the line of each, and the numbers of lines that are only copied."""
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    line = np.frombuffer(blob, np.uint32, -1, 8 + 8 * n)
    return np.frombuffer(blob, np.int64, n, 8), line[:n], line[n:]


_LINES = pa.schema([("pid", pa.int32()), ("node", pa.binary()), ("nameless", pa.bool_()), ("doc", pa.int64()), ("place", pa.int32()), ("number", pa.int32()), ("keys", pa.list_(pa.int64())), ("line", pa.binary())])


def _grouped(docs: DataFrame, groups: int, *more: str) -> DataFrame:
    return asking.grouped(docs, F.col("doc_id").cast("long").alias("doc_id"), "text", *more, groups=groups)


def lines_of(docs: DataFrame, groups: int, buckets: int) -> DataFrame:
    """A row for each distinct line of a group that another group has or that shares a band key with a different line (all others stay):
    pid, node, where it stands first (nameless, doc, place), its number in the group's sorted lines, the shared band keys, and, where
    there are any, the normalised line."""
    groups = _grouped(docs, groups)

    def ask(t: pa.Table) -> pa.Table:
        return _ask(t["pid"][0].as_py(), t, buckets)

    def tell(t: pa.Table, answers: pa.Table) -> pa.Table:
        got = [_told(x) for x in answers["blob"].to_pylist()] if len(t) else []
        key, line, copy = (np.concatenate(x) for x in zip(*got, strict=True)) if got else [()] * 3
        if not len(line) and not len(copy):
            return _LINES.empty_table()
        own = _own(t)
        order = np.argsort(line, kind="stable")
        key, line = key[order], line[order]
        number = np.union1d(line, copy)
        edges = np.append(np.searchsorted(line, number), len(line))
        every = sorted(own)
        lines = [every[k] for k in number.tolist()]
        at = [own[x] for x in lines]
        some = np.diff(edges) > 0
        keys = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(key), mask=pa.array(~some))
        return pa.table([pa.array([t["pid"][0].as_py()] * len(lines), pa.int32()), pa.array(list(map(node_of, lines)), pa.binary()), pa.array([x[0] for x in at], pa.bool_()), pa.array([x[1] for x in at], pa.int64()), pa.array([x[2] for x in at], pa.int32()), pa.array(number.astype(np.int32)), keys, pa.array([x if k else None for x, k in zip(lines, some.tolist(), strict=True)], pa.binary())], schema=_LINES)

    answers = asking.to_buckets(asking.per_group(groups, ask, asking.ASK), _answer, "pid int, bucket int, blob binary")
    return asking.with_answers(groups, answers, tell, "pid int, node binary, nameless boolean, doc long, place int, number int, keys array<long>, line binary")


def _with_sizes(batches):
    for t in batches:
        own = shingle_sets(t.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([t.column(0), pa.array(list(map(len, own)), pa.int64()), pa.array(sketches(own), pa.binary()), t.column(1)], ["name", "size", "sketch", "payload"])


def lost_lines(docs: DataFrame, groups: int, buckets: int, percent: int = PERCENT) -> DataFrame:
    """pid, number (among the group's sorted lines) of the lines of which a group keeps none, since their component has an earlier
    line elsewhere."""
    lines = cut(lines_of(docs, groups, buckets), "lines")
    candidates = lines.where("keys is not null")
    sets = candidates.groupBy("node").agg(F.first("line").alias("payload"))
    sets = sets.mapInArrow(_with_sizes, "name binary, size long, sketch binary, payload binary")
    # whole numbers stand for nodes from here on: Spark hashes and sorts them faster; once written, they do not change any more
    sets = cut(sets.withColumn("node", F.monotonically_increasing_id()), "line-sets")
    named = sets.select(F.col("name").alias("node"), F.col("node").alias("id"), "size")
    buckets = candidates.select("node", "keys").join(named, "node").select(F.explode("keys").alias("key"), F.col("id").alias("node"), "size").distinct()
    roots = link(buckets, sets.drop("name"), shingle_sets, percent)
    roots = roots.join(sets.select("name", "node"), "node").select(F.col("name").alias("node"), "root")
    owned = lines.select("pid", "number", "node", F.struct("nameless", "doc", "place").alias("at"))
    owned = owned.join(roots, "node", "left")
    # a component's lines, or the copies of a line without links
    owned = owned.select("pid", "number", "at", F.coalesce("root", F.lit(-1)).alias("root"), F.when(F.col("root").isNull(), F.col("node")).otherwise(F.lit(b"")).alias("one"))
    first = owned.groupBy("root", "one").agg(F.min("at").alias("first"))
    return owned.join(first, ["root", "one"]).where("at <> first").select("pid", "number")


def _finish(docs: DataFrame, columns: list[str], schema: str, make, percent: int) -> DataFrame:
    """make(rows of a group, (kept text, lines, removed lines) of each)."""

    def run(t: pa.Table, lost: pa.Table) -> pa.Table:
        texts, normals = t["text"].to_pylist(), all_normal_lines(t["text"])
        first = _own(t, normals)
        if len(lost):
            lines = sorted(first)
            for k in lost["number"].to_pylist():
                del first[lines[k]]
        out = []
        for doc, text, normal in zip(t["doc_id"].to_pylist(), texts, normals, strict=True):
            n, less, kept = 0, 0, []
            for place, (x, line) in enumerate(zip(normal, (text or "").split("\n"), strict=True)):
                n += bool(x)
                if x and first.get(x) != (doc is None, doc or 0, place):
                    less += 1
                else:
                    kept.append(line)
            out.append(("\n".join(kept) if less else text, n, less))
        return make(t, out)

    total = text_bytes(docs)
    groups = shares(total, GROUP_BYTES)
    return asking.with_answers(_grouped(docs, groups, *columns), lost_lines(docs, groups, shares(total, asking.BUCKET_BYTES), percent), run, schema)


def digests(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, kept_sha256 (of the remaining text, UTF-8) per row."""

    def make(t: pa.Table, out: list) -> pa.Table:
        return pa.table([t["doc_id"], pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([hashlib.sha256((x[0] or "").encode()).hexdigest() for x in out], pa.string())], names=["doc_id", "n_lines", "n_removed", "kept_sha256"])

    return _finish(docs, [], "doc_id long, n_lines long, n_removed long, kept_sha256 string", make, percent)


def clean(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the removed lines, columns kept (n_chars renewed); a document that loses all its
    lines leaves."""
    carried = asking.Carried(docs)

    def make(t: pa.Table, out: list) -> pa.Table:
        keep = pa.array([not (x[2] and x[1] == x[2]) for x in out], pa.bool_())
        return pa.table({"doc_id": t["doc_id"], "text": pa.array([x[0] for x in out], pa.string())} | carried.taken(t)).filter(keep)

    out = _finish(docs, carried.sent, carried.schema("doc_id long", "text string"), make, percent)
    if "n_chars" in carried.names:
        out = out.withColumn(carried.names["n_chars"], F.coalesce(F.length("text"), F.lit(0)).cast(carried.kinds["n_chars"]))
    return carried.restored(out)
