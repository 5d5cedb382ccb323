"""From candidate buckets to verified components without comparing all pairs of a bucket.

A bucket is a set of nodes that share a band. Small buckets (up to ``LARGE`` nodes) are packed into groups, where pairs whose
sketches leave room for the similarity become candidates. A large bucket's pivot (the node with most bucket fellows) is
a candidate with each of the others. All candidates are verified on full sets, and links join components.

Large buckets that then still hold several components hold nodes that share something (a passage, say) and yet most of them
are not similar. They are split by size: sets at 75 % are in one class of sizes or in neighbouring ones. What is
left is compared block against block, on full sets where the sketches leave room, so no pair that shares a band is left out and none
becomes a row. Sets whose sizes alone rule out the similarity are never compared.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, cut, drop, release
from .components import add_edges, label

#: Nodes of a small bucket at most; rows of a block beyond that, and items of its sets; rows of small buckets that a group holds.
LARGE, BLOCK, ITEMS, PACK = 32, 1024, 1 << 19, 4_000
#: Pairs whose sketches are compared at once, and words of 64 items.
MATRIX, WORDS = 1 << 13, 1 << 17
#: Bins of a sketch, and by how many standard deviations its count of equal bins may fall short: 1e-8 of pairs at 0.75 do.
BINS, SHORT = 128, 5.5


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """For sorted distinct arrays; an empty set is similar to nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    together = np.concatenate((a, b))
    together.sort()
    both = np.count_nonzero(together[1:] == together[:-1])
    return 100 * both >= percent * (len(a) + len(b) - both)


def similar(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (a, b) of non-empty sets are similar enough: items that two sets have are bits of a row for each set."""
    size = np.array(list(map(len, sets)))
    items, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(items)
    items, of = items[order], of[order]
    same = items[1:] == items[:-1]
    shared = np.append(same, False) | np.append(False, same)
    code = np.cumsum(np.append(True, ~same)[shared]) - 1
    words = code[-1] // 64 + 1 if len(code) else 1
    bits = np.zeros((len(sets), words * 64), bool)
    bits[of[shared], code] = True
    rows = np.packbits(bits, axis=1).view(U64)
    out = np.zeros(len(a), bool)
    for k, end in ((k, k + max(1, WORDS // words)) for k in range(0, len(a), max(1, WORDS // words))):
        x, y = a[k:end], b[k:end]
        both = np.bitwise_count(rows[x] & rows[y]).sum(1, dtype=np.int64)
        out[k:end] = both * (100 + percent) >= percent * (size[x] + size[y])
    return out


def sketch(items: np.ndarray) -> bytes:
    """A byte for each of BINS bins: of the least of the sorted 64-bit hashes that fall into it, 0 if none does. Two sets have the
    same byte in a bin with the probability of their similarity."""
    return sketches([items])[0]


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """The sketch of each set."""
    out = []
    for k in range(0, len(sets), 64):
        own = sets[k : k + 64]
        items = np.concatenate(own)
        at = (items >> U64(57)).astype(np.int64) + np.repeat(np.arange(len(own)) * BINS, list(map(len, own)))
        first = np.flatnonzero(np.diff(at, prepend=-1))
        marks = np.zeros(len(own) * BINS, np.uint8)
        marks[at[first]] = (items[first] >> U64(44)).astype(np.uint8) | np.uint8(1)
        raw = marks.tobytes()
        out += [raw[x : x + BINS] for x in range(0, len(raw), BINS)]
    return out


def may_be_near(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """For sketches, a column each: whether they leave room for the similarity."""
    count = lambda x: x.view(np.uint8).sum(0, dtype=np.uint8).astype(np.float64)  # noqa: E731  BINS fits a byte
    used, p = count((a | b) > 0), percent / 100
    return count((a == b) & (a > 0)) >= used * p - SHORT * np.sqrt(used * p * (1 - p))


def _chunks(sizes: list[int], most: int = 4 << 20):
    """Ranges of rows whose payloads have about ``most`` bytes together."""
    at, held = 0, 0
    for k, n in enumerate(sizes):
        held += n
        if held >= most:
            yield at, k + 1
            at, held = k + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def verify(pairs: DataFrame, sets: DataFrame, to_sets: Callable[[list[bytes]], list[np.ndarray]], percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets (node, payload) are similar enough."""
    kind = pairs.schema["a"].dataType.simpleString()
    left = sets.select(F.col("node").alias("a"), F.col("payload").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("payload").alias("of_b"))

    def run(batches):
        for t in batches:
            a, b = t.column(2).to_pylist(), t.column(3).to_pylist()
            keep: list[bool] = []
            for k, end in _chunks([len(x) + len(y) for x, y in zip(a, b, strict=True)]):
                known = list(dict.fromkeys(a[k:end] + b[k:end]))
                made = dict(zip(known, to_sets(known), strict=True))
                keep += [jaccard_at_least(made[x], made[y], percent) for x, y in zip(a[k:end], b[k:end], strict=True)]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
    return joined.mapInArrow(run, f"a {kind}, b {kind}")


class Linker:
    """Components so far, and what is needed to compare nodes."""

    def __init__(self, sets: DataFrame, to_sets: Callable[[list[bytes]], list[np.ndarray]], percent: int):
        self.sets, self.to_sets, self.percent = sets, to_sets, percent
        self.roots = None

    def fits(self, a: str, b: str):
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent

    def compare(self, pairs: DataFrame) -> None:
        """Verify the pairs (a, b) and join what is similar."""
        pairs = cut(pairs.distinct(), "pairs")
        self.join(verify(pairs, self.sets, self.to_sets, self.percent))
        drop(pairs)

    def join(self, links: DataFrame) -> None:
        found = cut(links, "links")
        if self.roots is None or not found.isEmpty():
            old, self.roots = self.roots, cut(add_edges(self.roots, found), "roots")
            drop(old)
        drop(found)

    def opened(self, buckets: DataFrame) -> DataFrame:
        """Buckets (key, node, size, ...) with two components or more, with each node's root and the bucket's n."""
        rows = label(buckets, self.roots, "node", "root")
        two = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", "n")
        return cut(rows.join(two, "key"), "buckets")

    def pivots(self, large: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs of each bucket's pivot with its other nodes, and the buckets (key, node, size) without their pivots.

        large: key, node, size, n and, where there are components already, root."""
        degree = large.groupBy("node").agg(F.sum("n").alias("degree"))
        root = "root" if "root" in large.columns else F.col("node").alias("root")
        rows = large.join(degree, "node").select("key", "node", "size", root, "degree")
        best = rows.groupBy("key").agg(F.max_by(F.struct("node", "size", "root"), F.struct("degree", "node")).alias("p"))
        met = rows.join(best, "key").where("node <> p.node")
        pairs = met.where("root <> p.root").where(self.fits("size", "p.size")).select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"))
        return pairs, met.select("key", "node", "size")

    def near(self, small: DataFrame, rows: int) -> DataFrame:
        """The pairs of small buckets whose sketches leave room for the similarity. rows: how many ``small`` (key, node, size) has."""
        kind, percent = small.schema["node"].dataType.simpleString(), self.percent
        pack = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-rows // PACK)))).alias("pack")
        packed = small.join(self.sets.select("node", "sketch"), "node").select(pack, "key", "node", "size", "sketch")

        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by([("key", "ascending"), ("node", "ascending")])
            key, size, node = np.array(t["key"]), np.array(t["size"]), t["node"].combine_chunks()
            marks = np.ascontiguousarray(np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, BINS).T)
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lag in range(1, len(key)):
                at = np.flatnonzero(key[lag:] == key[:-lag])
                if not len(at):
                    break
                x, y = size[at], size[at + lag]
                at = at[100 * np.minimum(x, y) >= percent * np.maximum(x, y)]
                at = at[may_be_near(marks[:, at], marks[:, at + lag], percent)]
                left.append(at)
                right.append(at + lag)
            a, b = np.concatenate(left), np.concatenate(right)
            release()
            return pa.table([node.take(pa.array(a)), node.take(pa.array(b))], names=["a", "b"])

        return packed.groupBy("pack").applyInArrow(run, f"a {kind}, b {kind}")

    def finish(self, active: DataFrame) -> None:
        """All pairs of different components in the buckets (key, node, size, root) still open, block against block.

        A size class is a power of the similarity, so a pair that fits is in one class or in two neighbours; class c of a bucket
        also gets the rows of class c + 1. Its rows fall into blocks of about BLOCK, fewer where sets are large; a task gets two blocks and
        returns the links alone: n rows move n * n / BLOCK rows."""
        percent, to_sets, kind = self.percent, self.to_sets, active.schema["node"].dataType.simpleString()
        cls = F.floor(F.log(F.col("size").cast("double")) / F.lit(-np.log(percent / 100)) + 1e-9).cast("int")
        both = active.select("key", "node", "size", "root", cls.alias("cls")).select("*", F.explode(F.array(F.col("cls"), F.col("cls") - 1)).alias("of"))
        counts = both.groupBy("key", "of").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("items"), F.min("cls").alias("low")).where("m > 1 and low = of")
        blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.least(F.col("m"), F.ceil(F.col("items") / ITEMS))).cast("int")
        rows = both.join(counts, ["key", "of"]).join(self.sets.select("node", "sketch", "payload"), "node")
        rows = rows.select("key", "of", "cls", "node", "size", "root", "sketch", "payload", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"))
        # a row of block b meets every block: (b, j) for j >= b and (i, b) for i < b
        met = rows.select("key", "of", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "node", "size", "root", "sketch", "payload")

        def run(t: pa.Table) -> pa.Table:
            i, j, of = t["i"][0].as_py(), t["j"][0].as_py(), t["of"][0].as_py()
            own, cls, size, node = np.array(t["own"]), np.array(t["cls"]), np.array(t["size"]), t["node"].combine_chunks()
            root = t["root"].combine_chunks().dictionary_encode().indices.to_numpy()
            marks = np.ascontiguousarray(np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, BINS).T)
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            theirs, step, found = np.ascontiguousarray(marks[:, right])[:, None], max(1, MATRIX // max(1, len(right))), [np.zeros((2, 0), np.int64)]
            for k in range(0, len(left), step):
                p = left[k : k + step, None]
                fits = (root[right] != root[p]) & (np.minimum(cls[right], cls[p]) == of) & (100 * np.minimum(size[right], size[p]) >= percent * np.maximum(size[right], size[p]))
                if i == j:
                    fits &= right > p
                if fits.any():
                    x, y = np.nonzero(fits & may_be_near(marks[:, p], theirs, percent))
                    found.append(np.stack([p[x, 0], right[y]]))
            pairs = np.concatenate(found, axis=1)
            if pairs.size:
                need, at = np.unique(pairs, return_inverse=True)
                at = at.reshape(pairs.shape)
                pairs = pairs[:, similar(to_sets(t["payload"].take(pa.array(need)).to_pylist()), *at, percent)]
            release()
            return pa.table([node.take(pa.array(x)) for x in pairs], names=["a", "b"])

        self.join(met.groupBy("key", "of", "i", "j").applyInArrow(run, f"a {kind}, b {kind}"))


def link(buckets: DataFrame, sets: DataFrame, to_sets: Callable[[list[bytes]], list[np.ndarray]], percent: int) -> DataFrame:
    """node, root for the nodes that have a verified link.

    buckets: key, node (distinct rows) and, if at hand, size; sets: node, size (of the set), sketch (see ``sketch``), payload (one row a node). Nodes without
    a set, or with an empty one, are linked with nothing; without buckets the result is empty."""
    work = Linker(sets, to_sets, percent)
    held = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    every = buckets.join(held, "key")
    every = every if "size" in buckets.columns else every.join(sets.select("node", "size"), "node")
    every = cut(every.select("key", "node", "size", "n"), "buckets")
    rows = every.agg(F.count_if(F.col("n") <= LARGE), F.count_if(F.col("n") > LARGE)).first()
    pairs = work.near(every.where(f"n <= {LARGE}").drop("n"), rows[0])
    if not rows[1]:
        work.compare(pairs)
        drop(every)
        return work.roots
    star, rest = work.pivots(every.where(f"n > {LARGE}"))
    work.compare(pairs.union(star))
    active = work.opened(rest)
    if not active.isEmpty():
        work.finish(active)
    drop(active)
    drop(every)
    return work.roots
