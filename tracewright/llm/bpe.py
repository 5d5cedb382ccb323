"""Operator 9: byte-pair encoding and decoding with a contiguous rank array per short word.

``encode`` keeps, for a block of distinct words of one length, the part boundaries and the rank of
every adjacent pair side by side in rows. Each step scans the rows for the minimum rank, deletes the
boundary there (shifting the row), and refreshes the two neighbouring ranks. Words over
``SHORT`` bytes take their pairs from a heap instead, since rows would cost the square of their length.

Texts are null-safe (null is empty: no tokens, empty decoded text); empty tables give empty results;
repeated rows give repeated rows; extra columns are left out of the query's result.
"""

from __future__ import annotations

import hashlib
import heapq
import importlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Bytes up to which a word is encoded in blocks, and cached pieces a worker holds.
SHORT, CACHE = 48, 200_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    return importlib.import_module("public_tokenizers").path(name)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary read from a public tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = _byte_alphabet(), spec["model"]["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in token)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.specials.items():
            self.bytes_of[i] = content.encode()
        self.base = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.base[b] = vocab[c]
        self.size, pairs = size, []
        for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]):
            pairs.append((vocab[a] * size + vocab[b], rank, vocab[a + b]))
        pairs.sort()
        self.none = len(pairs)
        self.keys = np.array([p[0] for p in pairs], np.int64)
        self.ranks = np.array([p[1] for p in pairs], np.int64)
        self.made = np.zeros(len(pairs) + 1, np.int64)
        for _, rank, token in pairs:
            self.made[rank] = token
        #: The public pattern of this vocabulary family.
        self.split = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.pairs: dict[int, int] | None = None
        self.cache: dict[str, tuple[str, bytes]] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def _block(self, parts: np.ndarray) -> list[list[int]]:
        """Encode words of one length, a row each: parts and ranks stay contiguous per row."""
        n, width = parts.shape
        length = np.full(n, width)
        rank = np.full((n, width), self.none, np.int64)
        if width > 1:
            rank[:, :-1] = self.rank_of(parts[:, :-1], parts[:, 1:])
        rows = np.arange(n)
        while width > 1 and len(rows):
            at = rank[rows].argmin(1)
            least = rank[rows, at]
            rows, at, least = (x[least < self.none] for x in (rows, at, least))
            if not len(rows):
                break
            parts[rows, at] = self.made[least]
            # delete the boundary: what stands right of it moves one place left
            column = np.arange(width - 1)
            source = column + (column > at[:, None])
            parts[rows[:, None], column] = parts[rows[:, None], source]
            source = column + (column >= at[:, None])
            rank[rows[:, None], column] = rank[rows[:, None], source]
            rank[rows, width - 1] = self.none
            length[rows] -= 1
            some = at + 1 < length[rows]
            r, a = rows[some], at[some]
            rank[r, a] = self.rank_of(parts[r, a], parts[r, a + 1])
            r, a = rows[~some], at[~some]
            rank[r, a] = self.none
            some = at > 0
            r, a = rows[some], at[some] - 1
            rank[r, a] = self.rank_of(parts[r, a], parts[r, a + 1])
        return [p[:k].tolist() for p, k in zip(parts, length, strict=True)]

    def _long(self, data: bytes) -> list[int]:
        """Encode one long word: a linked list of parts, pairs by rank and place from a heap."""
        if self.pairs is None:
            self.pairs = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        pairs, size, made = self.pairs, self.size, self.made
        part = self.base[np.frombuffer(data, np.uint8)].tolist()
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i] * size + part[i + 1]) for i in range(n - 1) if (r := pairs.get(part[i] * size + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, key = heapq.heappop(heap)
            j = after[i]
            if part[i] < 0 or j >= n or part[i] * size + part[j] != key:
                continue  # one of the two has gone into another part
            part[i], part[j] = int(made[rank]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (r := pairs.get(new := part[left] * size + part[right])) is not None:
                    heapq.heappush(heap, (r, left, new))
        return [p for p in part if p >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word."""
        raw = [w.encode() for w in words]
        size = np.array([len(b) for b in raw], np.int64)
        out: list[list[int]] = [[]] * len(words)
        order = np.argsort(size, kind="stable")
        edges = np.flatnonzero(np.diff(size[order])) + 1
        for at in np.split(order, edges):
            width = int(size[at[0]]) if len(at) else 0
            if not width:
                continue
            if width > SHORT:
                for i in at:
                    out[i] = self._long(raw[i])
                continue
            step = max(1, 400_000 // width)
            for k in range(0, len(at), step):
                block = at[k : k + step]
                data = np.frombuffer(b"".join([raw[i] for i in block]), np.uint8).reshape(len(block), width)
                for i, ids in zip(block, self._block(self.base[data]), strict=True):
                    out[i] = ids
        return out

    def learn(self, pieces: set[str]) -> None:
        """Cache the ids (as text) and decoded bytes of the pieces not met before."""
        new = [p for p in pieces if p not in self.cache]
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = list(pieces)
        for piece, ids in zip(new, self.encode_words(new), strict=True):
            self.cache[piece] = (",".join(map(str, ids)), self.decode_bytes(ids))

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of ordinary text; a special token's string is a piece of its own."""
        if self.special is None or not any(s in text for s in self.specials):
            return self.split.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else self.split.findall(part)
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Comma-joined ids and decoded bytes of each text; pieces are encoded once per ~1 MB of text."""
        for s, i in self.specials.items():
            self.cache[s] = (str(i), self.bytes_of[i])
        k = 0
        while k < len(texts):
            split, chars = [], 0
            while k < len(texts) and (not split or chars < 1 << 20):
                split.append(self.pieces(texts[k]))
                chars += len(texts[k])
                k += 1
            self.learn({p for x in split for p in x})
            for s, i in self.specials.items():
                self.cache[s] = (str(i), self.bytes_of[i])
            for x in split:
                got = [self.cache[p] for p in x]
                yield ",".join([g[0] for g in got]), b"".join([g[1] for g in got])

    def encode(self, text: str) -> list[int]:
        (ids, _), = self.encode_batch([text])
        return [int(i) for i in ids.split(",")] if ids else []


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One vocabulary per worker process and path."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str | None = None, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids of every row; map-only."""

    def run(batches):
        bpe = load(path or tokenizer_path())
        for b in batches:
            n, digest, decoded, every = [], [], [], []
            for s, d in bpe.encode_batch([t or "" for t in b.column(1).to_pylist()]):
                n.append(s.count(",") + 1 if s else 0)
                digest.append(hashlib.sha256(s.encode()).hexdigest())
                decoded.append(hashlib.sha256(d.decode("utf-8", "replace").encode()).hexdigest())
                if ids:
                    every.append(np.fromstring(s, np.int32, sep=",") if s else np.zeros(0, np.int32))
            out = [b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(every, pa.list_(pa.int32()))] * ids, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns."""
    return encode(docs, path, ids=False)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""

    def run(batches):
        bpe = load(path or tokenizer_path())
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode_bytes(x or []).decode("utf-8", "replace") for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
