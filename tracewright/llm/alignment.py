"""Operator 13: alignment of two tokenizers by a dangling-suffix transducer.

Both token sequences spell the same bytes. The transducer's state is the side that leads and the bytes it has ahead of
the other, the dangling suffix. It reads the next token of the side that lags: either its bytes start the suffix, which gets
shorter, or the suffix starts its bytes, and the other side leads by the rest. A token read while a suffix dangles overlaps the token that
the suffix belongs to: a link. An empty suffix closes a group. Transitions hang on the suffix and the token alone, so each is
worked out once a worker and looked up afterwards, and so are groups that were met before.

Links are counted over the corpus by pair. Texts are tokenised once, in chunks of bounded size: a chunk's documents are written
with their links as places in the chunk's list of distinct pairs, and only that list meets the counts. A pair that every chunk
holds is one row a chunk; counts are summed before they travel.

Texts that are null, empty or not spelled alike by both sides have no tokens: zeros and an empty digest text. Repeated rows
are documents of their own and all count; extra columns are left out; an empty table gives an empty result. Token bytes are
limited by the vocabularies, so a very long text costs time and memory in its length alone.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import tokenizer_path
from .common import cut, pieces, release

#: Text bytes of a chunk, and of a call of the tokenizers.
CHUNK_BYTES, CALL_BYTES = 4 << 20, 1 << 18
#: Bits of a side-A id in a pair; a pair is b * 2^17 + a.
BITS = 17
#: Memoised transitions a worker holds; beyond, they are forgotten and worked out anew. Links of a group that is walked along nodes.
MEMO, DEPTH = 300_000, 24
#: Where tokens lead besides nodes: the bytes differ; the group is longer than DEPTH. Closed groups are below.
FAIL, LONG = -1, -2


class Transducer:
    """States are numbers; state 0 is the empty suffix. Each side's tokens are given by their bytes.

    Short groups are walked along nodes, a node for each sequence of tokens since the last empty suffix, so that the text and the
    links of a group that was met before are at hand where it closes; a longer group goes from state to state."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.tokens = (a, b)
        by_bytes = {t: k for k, t in enumerate(b) if t}
        #: For each token of A the one of B with its bytes, or -1: two transitions, there and back; their group as a text, their link.
        self.same = [by_bytes.get(t, -1) if t else -1 for t in a]
        self.texts = [f"{x}|{y}" for x, y in enumerate(self.same)]
        self.pairs = np.array(self.same, np.int64) << BITS | np.arange(len(a))
        self.forget()

    def forget(self) -> None:
        self.ids: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.states: list[tuple[int, bytes]] = [(0, b"")]
        #: What each state does with the next token of the side that lags: the next state, or -1 where the bytes differ.
        self.next: list[dict[int, int]] = [{}]
        self.lags: list[int] = [0]
        # nodes: where tokens lead (a node, or below 0: FAIL, LONG or a closed group), the side that lags, state and tokens so far
        self.roots: dict[int, int] = {}
        self.onward: list[dict[int, int]] = []
        self.behind: list[int] = []
        self.so_far: list[tuple[int, tuple[int, ...], tuple[int, ...], tuple[int, ...]]] = []
        #: Closed groups: (tokens of A, tokens of B, text, links).
        self.closed: list[tuple[int, int, str, tuple[int, ...]]] = []
        self.known = 0

    def state(self, leads: int, suffix: bytes) -> int:
        key = (leads if suffix else 0, suffix)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            self.lags.append(1 - leads)
        return self.ids[key]

    def step(self, s: int, token: int) -> int:
        """The transition of state ``s`` on ``token`` of the side that lags (A at the empty suffix)."""
        to = self.next[s].get(token)
        if to is not None:
            return to
        leads, suffix = self.states[s]
        if s == 0:
            to = self.state(0, self.tokens[0][token]) if self.tokens[0][token] else -1
        else:
            text = self.tokens[1 - leads][token]
            if text and suffix.startswith(text):
                to = self.state(leads, suffix[len(text) :])
            elif text and text.startswith(suffix):
                to = self.state(1 - leads, text[len(suffix) :])
            else:
                to = -1
        self.next[s][token] = to
        self.known += 1
        return to

    def node(self, s: int, a: tuple[int, ...], b: tuple[int, ...], links: tuple[int, ...]) -> int:
        if s < 0:
            return FAIL
        if s == 0:
            self.closed.append((len(a), len(b), group_text(a, b), links))
            return -2 - len(self.closed)
        self.onward.append({})
        self.behind.append(self.lags[s])
        self.so_far.append((s, a, b, links))
        return len(self.onward) - 1

    def walk(self, node: int, token: int) -> int:
        """Where ``token`` leads from a node."""
        s, a, b, links = self.so_far[node]
        if len(links) >= DEPTH:
            return LONG
        a, b = (a, (*b, token)) if self.behind[node] else ((*a, token), b)
        to = self.onward[node][token] = self.node(self.step(s, token), a, b, (*links, b[-1] << BITS | a[-1]))
        self.known += 1
        return to

    def align(self, a: list[int], b: list[int]) -> tuple[list[int], dict[int, tuple[int, int, str, list[int]]]] | None:
        """The groups: of one token a side as A's token, closed ones known by number as -3 - number, -1 for long ones, which are given
        by their place; None if the bytes differ."""
        if self.known > MEMO:
            self.forget()
        same, roots, onward, behind, so_far = self.same, self.roots, self.onward, self.behind, self.so_far
        groups: list[int] = []
        longer: dict[int, tuple[int, int, str, list[int]]] = {}
        rest_a, rest_b = iter(a), iter(b)
        put, read_a, read_b = groups.append, rest_a.__next__, rest_b.__next__
        try:
            for la, t in zip(rest_a, rest_b):
                if same[la] == t:  # both steps at once: the suffix is empty again
                    put(la)
                    continue
                node = roots.get(la)
                if node is None:
                    node = roots[la] = self.node(self.step(0, la), (la,), (), ())
                while node >= 0:
                    to = onward[node].get(t)
                    if to is None and (to := self.walk(node, t)) == LONG:
                        longer[len(groups)] = self.long_group(node, t, read_a, read_b)
                        break
                    node = to
                    if node >= 0:
                        t = read_b() if behind[node] else read_a()
                if node == FAIL:
                    return None
                put(node if node < 0 else -1)
        except (StopIteration, ValueError):  # one side ends while the other leads, or the bytes of a long group differ
            return None
        return groups, longer

    def long_group(self, node: int, t: int, read_a, read_b) -> tuple[int, int, str, list[int]]:
        """The group that ``node`` and then ``t`` begin, state by state."""
        s, *own = self.so_far[node]
        own_a, own_b, links = map(list, own)
        while True:
            (own_b if self.lags[s] else own_a).append(t)
            links.append(own_b[-1] << BITS | own_a[-1])
            s = self.step(s, t)
            if s < 0:
                raise ValueError("the bytes differ")
            if s == 0:
                return len(own_a), len(own_b), group_text(own_a, own_b), links
            t = read_b() if self.lags[s] else read_a()


def group_text(a, b) -> str:
    return ",".join(map(str, a)) + "|" + ",".join(map(str, b))


class Sides:
    """The two vocabularies: ids of texts and their alignment. A is read by ranks of the same vocabulary; its tokens spell any text."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.a = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of_a = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            of_a[r] = t
        of_b = [bytes([int(p[3:5], 16)]) if self.b.IsByte(k) else p.replace("▁", " ").encode() for k, p in enumerate(map(self.b.IdToPiece, range(self.b.GetPieceSize())))]
        self.transducer = Transducer(of_a, of_b)

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        return list(zip([self.a.encode_ordinary(" " + t) for t in texts], self.b.encode(texts, num_threads=1), strict=True))

    def aligned(self, a: list[int], b: list[int]) -> tuple[int, int, int, str, np.ndarray] | None:
        """n_a, n_b, n_groups, digest of the groups, links; None where B does not spell the text."""
        got = self.transducer.align(a, b)
        if got is None:
            return None
        groups, longer = got
        known, codes = self.transducer, np.array(groups, np.int64)
        said = [known.texts[g] for g in groups]
        more = []
        for k in np.flatnonzero(codes < 0).tolist():
            group = longer[k] if groups[k] == -1 else known.closed[-3 - groups[k]]
            said[k] = group[2]
            more.append(group)
        singles = len(groups) - len(more)
        if (singles + sum([g[0] for g in more]), singles + sum([g[1] for g in more])) != (len(a), len(b)):
            return None
        links = np.concatenate([known.pairs[codes[codes >= 0]], np.array([x for g in more for x in g[3]], np.int64)])
        return len(a), len(b), len(groups), hashlib.sha256(";".join(said).encode()).hexdigest(), links


_LOADED: dict[tuple[str, str], Sides] = {}


def load(a_path: str, b_path: str) -> Sides:
    """One pair of vocabularies per worker process."""
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Sides(a_path, b_path)
    return _LOADED[a_path, b_path]


def planes(values: np.ndarray) -> bytes:
    """Differences of sorted 32-bit values, byte by byte: most upper bytes are zero and cost nothing once compressed."""
    return np.ascontiguousarray(np.diff(values, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 of every row, with chunk, links (places in the chunk's list of
    pairs, see ``planes``) and, in a chunk's first row, the list itself (pairs, times). Map-only."""

    def run(batches):
        sides = load(a_path or tokenizer_path("byte_bpe_50k.tiktoken"), b_path or tokenizer_path("piece_bpe_32k.model"))
        for batch in batches:
            for chunk in pieces(batch, 1, CHUNK_BYTES):
                rows: list = []
                for part in pieces(chunk, 1, CALL_BYTES):
                    texts = [t or "" for t in part.column(1).to_pylist()]
                    for t, (a, b) in zip(texts, sides.encode(texts), strict=True):
                        rows.append((t and sides.aligned(a, b)) or (0, 0, 0, "", np.zeros(0, np.int64)))
                sizes = np.array([len(r[4]) for r in rows])
                place, pairs = pd.factorize(np.concatenate([r[4] for r in rows]))
                times = np.bincount(place, minlength=len(pairs))
                # frequent pairs get small places
                order = np.argsort(-times, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                place, at = rank[place], np.cumsum(sizes) - sizes
                links = [planes(np.sort(place[k : k + n])) for k, n in zip(at.tolist(), sizes.tolist(), strict=True)]
                n, none = len(rows), [None] * (len(rows) - 1)
                columns = [chunk.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array(sizes, pa.int64()), pa.array([r[3] for r in rows], pa.string()), pa.array([uuid.uuid4().int >> 65] * n, pa.int64()), pa.array(links, pa.binary())]
                columns += [pa.array([pairs[order].tolist(), *none], pa.list_(pa.int64())), pa.array([times[order].tolist(), *none], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "chunk", "links", "pairs", "times"])
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, chunk long, links binary, pairs array<bigint>, times array<bigint>")


def pair_counts(asked: DataFrame) -> DataFrame:
    """pair, count (links of the pair over all chunks), best (no pair of the same B id has more)."""
    total = asked.groupBy("pair").agg(F.sum("times").alias("count"))
    most = total.groupBy(F.shiftright("pair", BITS).alias("b")).agg(F.max("count").alias("most"))
    return total.withColumn("b", F.shiftright("pair", BITS)).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """The contract's columns: counts of each document's links over the corpus."""
    rows = cut(align(docs, a_path, b_path), "alignments")
    lists = rows.where("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "x")).select("chunk", "place", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = cut(pair_counts(lists), "pair-counts")
    told = lists.join(counts, "pair").select(F.col("chunk").alias("of"), "place", "count", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(t: pa.Table, said: pa.Table) -> pa.Table:
        count, best = np.zeros(said.num_rows, np.int64), np.zeros(said.num_rows, np.int64)
        place = said["place"].to_numpy()
        count[place], best[place] = said["count"].to_numpy(), said["best"].to_numpy()
        links = [from_planes(x) for x in t["links"].to_pylist()]
        out = t.drop_columns(["chunk", "links"])
        out = out.append_column("n_best", pa.array([int(best[x].sum()) for x in links], pa.int64())).append_column("count_sum", pa.array([int(count[x].sum()) for x in links], pa.int64()))
        release()
        return out.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    of = rows.drop("pairs", "times")
    return of.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def best_links(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """a, b, count: for each B id its most linked A ids, ties included, in the order of b and count."""
    rows = align(docs, a_path, b_path)
    lists = rows.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    return pair_counts(lists).where("best").select(F.col("pair").bitwiseAND((1 << BITS) - 1).alias("a"), F.shiftright("pair", BITS).alias("b"), "count")

