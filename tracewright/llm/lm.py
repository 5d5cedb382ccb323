"""Operator 6: document log-likelihood under a gated recurrent language model, trained and applied in Spark.

Counting: training texts are counted where they are read; sums of some texts' distinct tokens go to buckets of the token space (see ``asking``),
which write their tokens' counts. So counts are exact over all training documents and no table of them is held in one place. The buckets' most
frequent tokens, ``MOST`` of all buckets, are broadcast with their counts; groups of texts ask the buckets about their other tokens alone.

Model: the most frequent training tokens (``places``: more with more distinct ones; of each range of token hashes at most ``TOP``) are words
of the model, sorted by count into classes of
``CLASS``; all others are one further class that shares its mass by the smoothed counts. A token's
probability is that of its class times that within the class (class-factored softmax). A gated recurrent unit
of ``HIDDEN`` cells reads the tokens; it is trained in numpy by backpropagation truncated to ``STEPS``
tokens, its state carried from window to window. Training documents are all read exactly once: a
hash-chosen eighth in round one, the rest in round two. Texts become the places of their tokens where they are read, two bytes
a token, and only these are dealt, by a hash of doc_id, into shards of
about ``SHARD`` bytes of text; a copy is trained on each, in an order by another hash, and copies are averaged by
token count in a tree of bounded fan-in, in the order of the shards. So neither the partitions and the order of rows nor a task run
again change the model; only rounding in the sums of a text's score depends on what is scored beside it.

Scoring carries the state through the whole document, however long; a document starts from a zero state and
its score includes its end token. Texts are scored where they are read; only tokens whose counts are not broadcast are dealt into groups.

Null texts are empty: one token, the end. A null doc_id is no held-out one. Rows with equal ids are scored
one by one and all count. With no training token all counts are zero and the model is the unigram one.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import asking
from .common import GROUP_BYTES, LOWER, MAX, U64, _stream, cut, drop, names, pieces, release, shares, text_buffer, text_bytes, word_spans

TOP, CLASS, HIDDEN, STEPS = 4096, 64, 16, 16
#: Streams trained side by side, and steps scored at once.
STREAMS, SCORED, RATE, FAN_IN = 512, 64, 0.004, 16
GROUP, SHARD = 10 << 20, 24 << 20
#: Distinct tokens, of one slice of texts after the other, that a task holds before it sums them up and sends them.
HELD = 1 << 20
END = _stream(61, 1)[0]
#: The pid of rows with a bucket's counts.
COUNTS = -3
ALPHA = 0.1
#: Ids of several rows that are told apart from the others; with more, every id counts as one of them.
REPEATED = 1 << 16
#: The model has a place for TOP words, and for one of SHARE distinct training words where that is more, up to MOST (17 MB of parameters).
SHARE, MOST = 4096, 1 << 16


def places(distinct: int) -> int:
    """Words with a place in the model."""
    return min(MOST, max(TOP, distinct // SHARE))


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, an end token after each, and the tokens per text."""
    data, offsets = text_buffer(column)
    starts, ends, counts = word_spans(data, offsets)
    words = names(LOWER[data], starts, ends)
    out = np.empty(len(words) + len(counts), U64)
    last = np.cumsum(counts + 1) - 1
    is_end = np.zeros(len(out), bool)
    is_end[last] = True
    out[is_end] = END
    out[~is_end] = words
    return out, counts + 1


# --- the model ---------------------------------------------------------------------------------------


class Model:
    """Parameters by name (float32). Words 0 .. n - 1 by falling count, n is any other, n + 1 the start."""

    def __init__(self, words: np.ndarray, p: dict[str, np.ndarray]):
        self.order = np.argsort(words)
        self.words, self.p = words[self.order], p
        self.rare = len(words)
        self.classes = p["out"].shape[0]

    @staticmethod
    def start(words: np.ndarray, counts: np.ndarray, total: int) -> dict[str, np.ndarray]:
        """The unigram model: only the biases of the softmax are not small."""
        rng = np.random.default_rng(5)
        classes = max(1, -(-len(words) // CLASS))
        inside = np.full(classes * CLASS, -20.0)
        inside[: len(words)] = np.log(np.maximum(counts, ALPHA))
        inside = inside.reshape(classes, CLASS)
        mass = np.concatenate([np.exp(inside).sum(1), [max(total - counts.sum(), ALPHA)]])
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return {"x": small(len(words) + 2, 3 * HIDDEN), "u": small(HIDDEN, 2 * HIDDEN), "v": small(HIDDEN, HIDDEN), "cls": small(HIDDEN, classes + 1) * 0, "cls_b": np.log(mass / mass.sum()).astype(np.float32), "out": np.zeros((classes, HIDDEN, CLASS), np.float32), "out_b": (inside - inside.max(1, keepdims=True)).astype(np.float32)}

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.order[at], self.rare).astype(np.int32)

    def run(self, prev: np.ndarray, keep: np.ndarray, h: np.ndarray, record: bool = False):
        """States after each step for inputs (steps, streams); keep is 0 where a document starts."""
        x, u, v = self.p["x"][prev], self.p["u"], self.p["v"]
        out = np.empty((*prev.shape, HIDDEN), np.float32)
        trace = []
        for t in range(len(prev)):
            h = h * keep[t][:, None]
            gate = x[t, :, : 2 * HIDDEN] + h @ u
            np.negative(gate, out=gate)
            np.exp(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
            z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
            rh = r * h
            c = np.tanh(x[t, :, 2 * HIDDEN :] + rh @ v)
            new = h + z * (c - h)
            if record:
                trace.append((h, z, r, rh, c))
            out[t] = h = new
        return out, h, trace

    def log_prob(self, state: np.ndarray, target: np.ndarray, grads: dict | None = None):
        """log p of each target given its state; of rare targets that of the class. With grads, those of the
        mean negative log p are put there, and the gradient of the states is returned too."""
        n, p = len(target), self.p
        cls = np.where(target < self.rare, target // CLASS, self.classes).astype(np.int16)
        # a column a token, the tokens of a class side by side: all that follows runs along whole rows
        order = np.argsort(cls, kind="stable")
        cls, word, column = cls[order], target[order] % CLASS, np.arange(n)
        state = np.ascontiguousarray(state[order].T)
        edges = np.searchsorted(cls, np.arange(self.classes + 1))
        logit = p["cls"].T @ state
        logit += p["cls_b"][:, None]
        logit -= logit.max(0)
        out = logit[cls, column]
        np.exp(logit, out=logit)
        norm = logit.sum(0)
        out -= np.log(norm)
        back = None
        if grads is not None:
            logit /= norm * n
            logit[cls, column] -= 1 / n
            grads["cls"], grads["cls_b"] = state @ logit.T, logit.sum(1)
            grads["out"], grads["out_b"] = np.zeros_like(p["out"]), np.zeros_like(p["out_b"])
            back = p["cls"] @ logit
        for j in range(self.classes):
            at = slice(edges[j], edges[j + 1])
            if at.start == at.stop:
                continue
            s, w, k = state[:, at], word[at], column[: at.stop - at.start]
            inside = p["out"][j].T @ s
            inside += p["out_b"][j][:, None]
            inside -= inside.max(0)
            own = inside[w, k]
            np.exp(inside, out=inside)
            norm = inside.sum(0)
            out[at] += own - np.log(norm)
            if grads is not None:
                inside /= norm * n
                inside[w, k] -= 1 / n
                grads["out"][j], grads["out_b"][j] = s @ inside.T, inside.sum(1)
                back[:, at] += p["out"][j] @ inside
        place = np.empty(n, np.int64)
        place[order] = column
        return out[place], None if back is None else back.T[place]

    def gradients(self, prev: np.ndarray, keep: np.ndarray, target: np.ndarray, h: np.ndarray, real: np.ndarray | None = None):
        """Gradients over one window, and the state to carry on with. real: the tokens that count (all, if not given)."""
        state, last, trace = self.run(prev, keep, h, record=True)
        g: dict[str, np.ndarray] = {}
        if real is None:
            _, back = self.log_prob(state.reshape(-1, HIDDEN), target.ravel(), g)
            back = back.reshape(state.shape)
        else:
            back = np.zeros_like(state)
            _, back[real] = self.log_prob(state[real], target[real], g)
        u, v = self.p["u"], self.p["v"]
        dx = np.empty((*prev.shape, 3 * HIDDEN), np.float32)
        g["u"], g["v"] = np.zeros_like(u), np.zeros_like(v)
        dh = np.zeros_like(h)
        for t in range(len(prev) - 1, -1, -1):
            before, z, r, rh, c = trace[t]
            dh = dh + back[t]
            dc = dh * z * (1 - c * c)
            drh = dc @ v.T
            d = dx[t]
            d[:, :HIDDEN] = dh * (c - before) * z * (1 - z)
            d[:, HIDDEN : 2 * HIDDEN] = drh * before * r * (1 - r)
            d[:, 2 * HIDDEN :] = dc
            g["v"] += rh.T @ dc
            g["u"] += before.T @ d[:, : 2 * HIDDEN]
            dh = (dh * (1 - z) + drh * r + d[:, : 2 * HIDDEN] @ u.T) * keep[t][:, None]
        flat = prev.ravel()
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[order], prepend=-1))
        g["x"] = (flat[order][first], np.add.reduceat(dx.reshape(-1, 3 * HIDDEN)[order], first))
        return g, last


class Trainer:
    """Adam; rows of ``x`` move only when they are met."""

    def __init__(self, model: Model):
        self.m = model
        self.first = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.second = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.n = 0

    def step(self, grads: dict) -> None:
        self.n += 1
        rate = RATE * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, g in grads.items():
            at: object = slice(None)
            if k == "x":
                at, g = g
            g = np.clip(g, -0.1, 0.1)
            a = self.first[k][at] * 0.9 + 0.1 * g
            b = self.second[k][at] * 0.999 + 0.001 * g * g
            self.first[k][at], self.second[k][at] = a, b
            self.m.p[k][at] -= rate * a / (np.sqrt(b) + 1e-8)

    def learn(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """One pass over the tokens of some texts, cut into streams of equal length."""
        starts = np.zeros(len(ids), bool)
        starts[np.concatenate([[0], np.cumsum(counts)[:-1]])] = True
        prev = np.empty_like(ids)
        prev[1:] = ids[:-1]
        prev[starts] = self.m.rare + 1
        width = int(np.clip(len(ids) // (60 * STEPS), min(8, len(ids)), STREAMS))
        length = -(-len(ids) // width)
        # what is beyond the last token does not count
        at = np.arange(width)[None] * length + np.arange(length)[:, None]
        real, at = at < len(ids), np.minimum(at, len(ids) - 1)
        h = np.zeros((width, HIDDEN), np.float32)
        for t in range(0, length, STEPS):
            w = at[t : t + STEPS]
            some = real[t : t + STEPS]
            if not some.any():
                break
            grads, h = self.m.gradients(prev[w], (~starts[w]).astype(np.float32), ids[w], h, None if some.all() else some)
            self.step(grads)


def score(model: Model, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Natural log probability of each token (the class's for rare ones); the state runs through each text."""
    starts = np.cumsum(counts) - counts
    longest = int(counts.max())
    width = int(min(len(counts), np.clip(len(ids) // longest, 48, 256)))
    # texts, long ones first, go to the slot with least tokens
    heap, slots = [(0, k) for k in range(width)], [[] for _ in range(width)]
    for d in np.argsort(-counts, kind="stable").tolist():
        n, k = heapq.heappop(heap)
        slots[k].append(d)
        heapq.heappush(heap, (n + int(counts[d]), k))
    slots.sort(key=lambda s: -sum(int(counts[d]) for d in s))
    size = np.array([sum(int(counts[d]) for d in s) for s in slots])
    at = np.full((int(size[0]), width), -1, np.int64)
    for k, s in enumerate(slots):
        at[: size[k], k] = np.concatenate([np.arange(starts[d], starts[d] + counts[d]) for d in s])
    is_start = np.zeros(len(ids), bool)
    is_start[starts] = True
    prev = np.empty_like(ids)
    prev[1:] = ids[:-1]
    prev[is_start] = model.rare + 1
    out = np.zeros(len(ids), np.float32)
    h = np.zeros((width, HIDDEN), np.float32)
    for t in range(0, len(at), SCORED):
        active = int((size > t).sum())
        w = at[t : t + SCORED, :active]
        real = w >= 0
        state, h, _ = model.run(prev[w], (~is_start[w]).astype(np.float32), h[:active])
        out[w[real]] = model.log_prob(state[real], ids[w[real]])[0]
    return out


# --- counts ------------------------------------------------------------------------------------------------


def _packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    return np.int64(len(keys)).tobytes() + keys.tobytes() + zstandard.compress(n.tobytes(), 1)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens and their counts."""
    size = int(np.frombuffer(blob, np.int64, 1)[0])
    return np.frombuffer(blob, U64, size, 8), np.frombuffer(zstandard.decompress(blob[8 + 8 * size :]), np.int64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct tokens of (tokens, counts), and the sums of their counts."""
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _counts(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, blob: the counts of a bucket's tokens in the training documents ``docs`` (pid ``COUNTS``); pid -1: frequent tokens (token, n),
    in place of the bucket their rank in theirs; pid -2: totals (tokens, distinct) of a bucket."""

    def ask(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent():
            keys, n = _summed(held)
            rows = [(k, _packed(keys[a:b], n[a:b])) for k, a, b in asking.bucket_slices(keys, buckets)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([COUNTS] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=asking.ASK_ARROW)

        for batch in batches:
            for part in pieces(batch, 0):
                held.append(np.unique(tokens(part.column(0))[0], return_counts=True))
                if sum(len(k) for k, _ in held) >= HELD:
                    yield sent()
        if held:
            yield sent()
        release()

    def add(batches):
        asked = asking.rows_of(batches, asking.ASK_ARROW)
        keys, total = _summed([_unpacked(b) for b in asked["blob"].to_pylist()])
        top = np.lexsort((keys, -total))[:TOP]
        pid, bucket, blob = [COUNTS, *[-1] * len(top), -2], [asked["bucket"][0].as_py(), *range(len(top)), -1], [_packed(keys, total), *[None] * (len(top) + 1)]
        token, count = [None, *keys[top].view(np.int64), int(total.sum())], [None, *total[top], len(keys)]
        yield pa.RecordBatch.from_arrays([pa.array(pid, pa.int32()), pa.array(bucket, pa.int32()), pa.array(blob, pa.binary()), pa.array(token, pa.int64()), pa.array(count, pa.int64())], ["pid", "bucket", "blob", "token", "n"])

    return asking.to_buckets(docs.select("text").mapInArrow(ask, asking.ASK), add, "pid int, bucket int, blob binary, token long, n long")


def _own(t: pa.Table):
    """Of a group's rows (other: token hashes): each hash's row; the sorted distinct hashes, each one's place among them."""
    other = t["other"].combine_chunks()
    row = np.repeat(np.arange(len(t)), pc.list_value_length(other).to_numpy())
    return row, *np.unique(other.flatten().to_numpy().view(U64), return_inverse=True)


def _answers(groups: DataFrame, counted: DataFrame, buckets: int) -> DataFrame:
    """pid, bucket, blob: the training counts of what a group asks a bucket, in the order of its sorted distinct tokens."""

    def ask(t: pa.Table) -> pa.Table:
        _, distinct, _ = _own(t)
        slices = asking.bucket_slices(distinct, buckets)
        return pa.table([pa.array([k for k, _, _ in slices], pa.int32()), pa.array([t["pid"][0].as_py()] * len(slices), pa.int32()), pa.array([distinct[a:b].tobytes() for _, a, b in slices], pa.binary())], schema=asking.ASK_ARROW)

    def answer(batches):
        asked = asking.rows_of(batches, asking.ASK_ARROW)
        pids, blobs = asked["pid"].to_pylist(), asked["blob"].to_pylist()
        keys, n = _unpacked(blobs[pids.index(COUNTS)]) if COUNTS in pids else (np.zeros(0, U64), np.zeros(0, np.int64))
        keys, n = np.append(keys, MAX), np.append(n, 0)  # what stands beyond the last token is found there and not counted
        rows = []
        for pid, blob in zip(pids, blobs, strict=True):
            if pid != COUNTS:
                wanted = np.frombuffer(blob, U64)
                at = np.searchsorted(keys, wanted)
                rows.append((pid, zstandard.compress(np.where(keys[at] == wanted, n[at], 0).tobytes(), 1)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([asked["bucket"][0].as_py()] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["pid", "bucket", "blob"])

    asked = asking.per_group(groups, ask, asking.ASK).unionByName(counted.where(F.col("pid") == COUNTS).select("bucket", "pid", "blob"))
    return asking.to_buckets(asked, answer, "pid int, bucket int, blob binary")


# --- training ------------------------------------------------------------------------------------------------


def _pack(p: dict[str, np.ndarray]) -> bytes:
    f = io.BytesIO()
    np.savez(f, **p)
    return f.getvalue()


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as f:
        return {k: f[k] for k in f.files}


def _average(rows) -> tuple[bytes, int]:
    total, out = 0, None
    for blob, n in rows:
        p = _unpack(blob)
        out = {k: v * np.float64(n) for k, v in p.items()} if out is None else {k: out[k] + v * np.float64(n) for k, v in p.items()}
        total += n
    return _pack({k: (v / total).astype(np.float32) for k, v in out.items()}), total


def repeated(docs: DataFrame) -> pa.Array | None:
    """The doc_ids of more than one row; None if they are more than ``REPEATED``."""
    got = docs.groupBy("doc_id").count().where("count > 1").limit(REPEATED + 1).collect()
    return None if len(got) > REPEATED else pa.array([r.doc_id for r in got], pa.int64())


def encoded(docs: DataFrame, sent, again: pa.Array | None) -> DataFrame:
    """doc_id, size (bytes of text), ids (a token's place in the model, as in ``Model.ids``) and tie per row (doc_id, text); tie is the text of
    rows whose doc_id is in ``again``, of all for None: only there the text decides the order. sent: the model's words and parameters, broadcast."""
    small = len(sent.value[0]) < 1 << 15
    kind = pa.int16() if small else pa.int32()

    def run(batches):
        model = Model(*sent.value)
        for batch in batches:
            for part in pieces(batch, 1):
                doc_id, text = part.columns
                hashes, counts = tokens(text)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(model.ids(hashes), kind))
                tie = text if again is None else text.take(pc.if_else(pc.is_in(doc_id, value_set=again), pa.array(range(len(text)), pa.int32()), None))
                yield pa.RecordBatch.from_arrays([doc_id, pc.fill_null(pc.binary_length(text), 0), ids, tie], ["doc_id", "size", "ids", "tie"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, size int, ids array<{'smallint' if small else 'int'}>, tie string")


def _parts(t: pa.Table):
    """The ids, and the tokens per text, of rows (size, ids) cut like ``pieces`` of their texts."""
    ends, ids, at = np.cumsum(t["size"].to_numpy()), t["ids"].combine_chunks(), 0
    while at < len(t):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP_BYTES)))
        part = ids.slice(at, to - at)
        yield part.flatten().to_numpy().astype(np.int32), pc.list_value_length(part).to_numpy().astype(np.int64)
        at = to


def train_round(docs: DataFrame, shards: int, words: np.ndarray, start: dict[str, np.ndarray], again: pa.Array | None = None) -> dict[str, np.ndarray]:
    """The token-weighted mean of the copies trained on the shards of the rows (doc_id, text). again: see ``encoded``."""
    sent = docs.sparkSession.sparkContext.broadcast((words, start))  # MOST bounds its size

    def run(t: pa.Table) -> pa.Table:
        words, p = sent.value
        trainer, n = Trainer(Model(words, {k: v.copy() for k, v in p.items()})), 0
        t = t.sort_by([("place", "ascending"), ("doc_id", "ascending"), ("tie", "ascending")])
        for ids, counts in _parts(t):
            trainer.learn(ids, counts)
            n += len(ids)
        return pa.table([t["pid"][:1].combine_chunks(), pa.array([_pack(trainer.m.p)], pa.binary()), pa.array([n], pa.int64())], names=["pid", "blob", "n"])

    def mean(t: pa.Table) -> pa.Table:
        t = t.sort_by("pid")
        blob, n = _average(zip(t["blob"].to_pylist(), t["n"].to_pylist(), strict=True))
        return pa.table([pa.array([t["pid"][0].as_py() // FAN_IN], pa.int32()), pa.array([blob], pa.binary()), pa.array([n], pa.int64())], names=["pid", "blob", "n"])

    schema = "pid int, blob binary, n long"
    place = F.xxhash64("doc_id", F.lit(17)).alias("place")
    copies = cut(asking.per_group(asking.grouped(encoded(docs, sent, again), place, "doc_id", "size", "ids", "tie", groups=shards), run, schema), "lm-copies")
    while shards > FAN_IN:
        shards = -(-shards // FAN_IN)
        old, copies = copies, cut(copies.groupBy(F.floor(F.col("pid") / FAN_IN).alias("g")).applyInArrow(mean, schema), "lm-copies")
        drop(old)
    got = [(r.blob, r.n) for r in copies.orderBy("pid").collect()]
    drop(copies)
    return _unpack(_average(got)[0]) if got else start


def train(docs: DataFrame, words: np.ndarray, counts: np.ndarray, total: int) -> dict[str, np.ndarray]:
    """docs: the training documents (doc_id, text), each read once."""
    p, shards, again = Model.start(words, counts, total), shares(text_bytes(docs), SHARD), repeated(docs)
    eighth = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(8)) == 0
    for part in (docs.where(eighth), docs.where(~eighth)):
        p = train_round(part, shards, words, p, again)
    return p


def scores(docs: DataFrame) -> DataFrame:
    """The contract's columns per row of ``docs``."""
    total = text_bytes(docs)
    buckets = shares(total, asking.BUCKET_BYTES)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text")
    counted = cut(_counts(rows.where("not held_out"), buckets), "lm-counts")
    sums = counted.where("pid = -2").agg(F.sum("token"), F.sum("n")).first()
    n_tokens, n_distinct = int(sums[0] or 0), int(sums[1] or 0)
    frequent = counted.where("pid = -1").select("token", "n", "bucket")
    top = frequent.orderBy(F.desc("n"), "token").limit(places(n_distinct)).collect()
    words, counts = np.array([r[0] for r in top], np.int64).view(U64), np.array([r[1] for r in top], np.float64)
    more = frequent.where(F.col("bucket") < MOST // buckets).collect()  # an equal share of each bucket: of any size of data MOST rows
    known, at = np.unique(np.array([r[0] for r in top + more], np.int64).view(U64), return_index=True)
    n_known = np.array([r[1] for r in top + more], np.float64)[at]
    p = train(rows.where("not held_out"), words, counts, n_tokens)
    sent = docs.sparkSession.sparkContext.broadcast((words, p, known, n_known))  # MOST bounds its size
    rare_mass = n_tokens - int(counts.sum()) + ALPHA * (n_distinct - len(words) + 1)
    base_mass = n_tokens + ALPHA * (n_distinct + 1)

    def scored(batches):
        words, p, known, n = sent.value
        model, n = Model(words, p), np.append(n, 0)
        for batch in batches:
            for part in pieces(batch, 2, GROUP):
                hashes, per_text = map(np.concatenate, zip(*map(tokens, pieces(part.column(2))), strict=True))  # by less than is scored at once
                at = np.searchsorted(known, hashes)
                is_known = np.append(known, MAX)[at] == hashes
                is_known &= at < len(known)
                c, first = n[np.where(is_known, at, len(known))], np.cumsum(per_text) - per_text
                ids = model.ids(hashes)
                log_p = score(model, ids, per_text).astype(np.float64) / np.log(10)
                log_p += np.where((ids == model.rare) & is_known, np.log10((c + ALPHA) / rare_mass), 0)
                base = np.where(is_known, np.log10((c + ALPHA) / base_mass), 0)
                is_known = np.add.reduceat(is_known.astype(np.int64), first)
                other = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_text - is_known)), pa.int32()), pa.array(hashes[c == 0].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(per_text, pa.int64()), pa.array(is_known), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(log_p, first)), other], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "other"])
        release()

    columns = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    parts = rows.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, other array<long>")
    groups = asking.grouped(parts, *columns, "other", groups=shares(total, GROUP))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(t: pa.Table, told: pa.Table) -> pa.Table:
        if not len(t):
            return schema.empty_table()
        row, distinct, place = _own(t)
        answers, c = dict(zip(told["bucket"].to_pylist(), told["blob"].to_pylist(), strict=True)), np.zeros(len(distinct), np.int64)
        for k, a, b in asking.bucket_slices(distinct, buckets):
            c[a:b] = np.frombuffer(zstandard.decompress(answers[k]), np.int64)
        c, n = c[place], len(t)
        more = [np.bincount(row, x, n) for x in (c > 0, np.log10((c + ALPHA) / base_mass), np.log10((c + ALPHA) / rare_mass))]
        known, base, log_p = (t[x].to_numpy() + m for x, m in zip(("n_known", "base_score", "score"), more, strict=True))
        return pa.table([t["doc_id"].combine_chunks(), t["held_out"].combine_chunks(), t["n_tokens"].combine_chunks(), pa.array(known.astype(np.int64)), pa.array([n_tokens] * n, pa.int64()), pa.array(base), pa.array(log_p)], schema=schema)

    return asking.with_answers(groups, _answers(groups, counted, buckets), finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
