"""Operator 4: benchmark decontamination by one Aho-Corasick automaton over normalised items.

Items and texts are normalised alike (A-Z lower-cased, words joined by single blanks); every window
of ten consecutive item words is a pattern framed by blanks. Each text is scanned once; hits map to
words and from there to byte offsets of the original text.

The benchmark is a bounded side: its bytes are summed first, and an automaton holds at most
``AUTOMATON_BYTES`` of item text (windows overlap, so it takes about 300 times as much memory); larger benchmarks are scanned in as
many blocks as needed. A worker builds an automaton once and holds the last one.
Null texts have no words; an item without words has no window; repeated item rows count once.
"""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, spans_of, text_buffer

WINDOW = 10
AUTOMATON_BYTES = 1 << 20

#: Bytes of words: digits, letters, and all of non-ASCII.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def build(items: list[tuple[str, str]], window: int = WINDOW):
    """The automaton; each pattern holds its word count and the items it stands in."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        words = normal_words(text)
        for k in range(max(1, len(words) - window + 1) if words else 0):
            part = words[k : k + window]
            found.setdefault(" " + b" ".join(part).decode() + " ", (len(part), set()))[1].add(item)
    a = ahocorasick.Automaton()
    for pattern, value in found.items():
        a.add_word(pattern, value)
    if found:
        a.make_automaton()
    return a if found else None


_HELD: dict[tuple[str, int], object] = {}


def held(key: str, items: list[tuple[str, str]], window: int):
    """The automaton of some items, built once a worker; only the last one is held."""
    if (key, window) not in _HELD:
        _HELD.clear()
        _HELD[key, window] = build(items, window)
    return _HELD[key, window]


def scan(automaton, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words of the text, hit word ranges (merged), and the items with an occurring window."""
    raw = (text or "").encode().translate(_NORMAL)
    words = raw.split()
    if automaton is None or not words:
        return len(words), [], set()
    normal = " " + b" ".join(words).decode() + " "
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    done, at = 0, 0  # blanks before position done
    for end, (n, own) in automaton.iter(normal):
        at += normal.count(" ", done, end)
        done = end
        start = at - n
        items |= own
        if spans and start <= spans[-1][1]:
            spans[-1] = (min(start, spans[-1][0]), at)
            while len(spans) > 1 and spans[-2][1] >= spans[-1][0]:
                last = spans.pop()
                spans[-1] = (min(spans[-1][0], last[0]), last[1])
        else:
            spans.append((start, at))
    return len(words), spans, items


def byte_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as byte ranges of the original text (UTF-8)."""
    data, offsets = text_buffer(pa.array([text]))
    starts, ends, _ = spans_of(_WORD[LOWER[data]], offsets)
    return [(int(starts[a]), int(ends[b - 1])) for a, b in spans]


def _blocks(benchmark: DataFrame, id_col: str, text: str) -> int:
    size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-int(size) // AUTOMATON_BYTES))


def _items(benchmark: DataFrame, blocks: int):
    """The benchmark in blocks of bounded size, each broadcast as (item id, text) pairs."""
    for k in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else benchmark
        yield benchmark.sparkSession.sparkContext.broadcast([("null" if r[0] is None else str(r[0]), r[1]) for r in part.select("item_id", "text").collect() if r[1]])


_SPANS = "array<struct<a:int,b:int>>"
_PAIRS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans (word ranges), bytes (the same as byte ranges), items per document row.

    Map-only. With one block (the usual case) each text is scanned once; with more, the rows pass
    through one scanning step a block, each adding what it found, so rows stay as they are."""
    out = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast(_SPANS).alias("spans"), F.array().cast(_SPANS).alias("bytes"), F.array().cast("array<string>").alias("items"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_words long, spans {_SPANS}, bytes {_SPANS}, items array<string>"
    for items in _items(benchmark, _blocks(benchmark, "item_id", "text")):
        out = out.mapInArrow(_scanner(items, window), schema)
    return out.drop("text")


def _scanner(items, window):
    key = uuid.uuid4().hex

    def run(batches):
        automaton = held(key, items.value, window)
        for b in batches:
            texts = b.column(1).to_pylist()
            got = [scan(automaton, t) for t in texts]
            spans, bytes_, own = (b.column(k).to_pylist() for k in (3, 4, 5))
            for k, (_, found, names) in enumerate(got):
                if found:
                    spans[k] = spans[k] + [{"a": x, "b": y} for x, y in found]
                    bytes_[k] = bytes_[k] + [{"a": x, "b": y} for x, y in byte_spans(texts[k], found)]
                    own[k] = sorted({*own[k], *names})
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.int64()), pa.array(spans, _PAIRS), pa.array(bytes_, _PAIRS), pa.array(own, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "spans", "bytes", "items"])

    return run


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns per document."""
    got = hits(docs, benchmark)
    spans = F.array_sort("spans")
    # words covered by the union of the (possibly overlapping) ranges
    walk = F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, x: F.struct((s.n + F.greatest(F.lit(0), x.b - F.greatest(x.a, s.end))).alias("n"), F.greatest(s.end, x.b).alias("end")))
    return got.select("doc_id", "n_words", walk.n.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated documents, columns kept; map-only."""
    out, at = docs, docs.columns.index("text")
    for items in _items(benchmark, _blocks(benchmark, "item_id", "text")):

        def run(batches, items=items, key=uuid.uuid4().hex):
            automaton = held(key, items.value, window)
            for b in batches:
                yield b.filter(pa.array([not scan(automaton, t)[1] for t in b.column(at).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out
