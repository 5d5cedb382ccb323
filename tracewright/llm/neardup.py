"""Operator 10: near-duplicate documents by min-max hashing.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; the whole sequence with fewer
words). Under each of ``PERMUTATIONS`` hash permutations both the minimum and the maximum are kept, so 64
evaluations give 128 values; a band is the minima and maxima of two permutations. Documents with equal
sets collapse to one node first; the nodes of a band are linked on full sets (see ``linking``).

At a similarity of 0.75 a pair shares none of the 32 bands with probability 5e-6.

Null and blank texts have an empty set: n_shingles 0, linked with nothing, kept. Rows with equal sets
(repeated rows too) are linked; equal doc_ids are one document. A null doc_id never becomes a
component_id unless its whole component has none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, _stream, cut, mix, names, pieces, release, text_buffer, window_hash, word_spans
from .linking import link, sketch

SHINGLE, PERCENT = 5, 75
PERMUTATIONS, BANDS = 64, 32

_A = _stream(31, PERMUTATIONS) | U64(1)
_B = _stream(32, PERMUTATIONS)


def shingle_sets(column, shingle: int = SHINGLE):
    """Sorted distinct shingle hashes of each text of an Arrow column, one after another."""
    for part in pieces(column):
        yield from _shingle_sets(part, shingle)


def _shingle_sets(column, shingle: int):
    data, offsets = text_buffer(column)
    starts, ends, counts = word_spans(data, offsets)
    hashes = names(LOWER[data], starts, ends)
    windows = window_hash(hashes, shingle)
    at = 0
    for n in counts.tolist():
        if n >= shingle:
            yield np.unique(windows[at : at + n - shingle + 1])
        else:
            yield window_hash(hashes[at : at + n], n) if n else np.zeros(0, U64)
        at += n


def signature(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum under each permutation."""
    low, high = np.full(PERMUTATIONS, ~U64(0)), np.zeros(PERMUTATIONS, U64)
    for k in range(0, len(items), 1024):
        x = items[k : k + 1024, None] * _A
        x += _B
        np.minimum(low, x.min(0), out=low)
        np.maximum(high, x.max(0), out=high)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    parts = [v[k :: PERMUTATIONS // BANDS] for v in (low, high) for k in range(PERMUTATIONS // BANDS)]
    out = np.arange(BANDS, dtype=U64)
    for p in parts:
        out = mix(out * U64(0x9E3779B97F4A7C15) + p)
    return out.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (16-byte digest of the set, null if empty), bands, text_key per row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, node, bands = [], [], []
            for items in shingle_sets(b.column(1)):
                n.append(len(items))
                node.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                bands.append(band_keys(*signature(items)) if len(items) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64())), b.column(2)], ["doc_id", "n_shingles", "node", "bands", "text_key"])
        release()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, f"doc_id {kind}, n_shingles long, node binary, bands array<bigint>, text_key long")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, size, sketch, payload (sorted shingle hashes) of the given nodes (node, doc_id and text_key of one holder)."""

    def run(batches):
        for b in batches:
            own = list(shingle_sets(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, own)), pa.int64()), pa.array(list(map(sketch, own)), pa.binary()), pa.array([s.tobytes() for s in own], pa.binary())], ["node", "size", "sketch", "payload"])
        release()

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    held = texts.join(nodes, texts.doc_id.eqNullSafe(nodes.doc_id) & (texts.text_key == nodes.text_key)).select("node", "text")
    return held.mapInArrow(run, "node binary, size long, sketch binary, payload binary").dropDuplicates(["node"])


def _to_sets(payloads: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(p, U64) for p in payloads]


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept per row of ``docs``."""
    rows = cut(signatures(docs), "signatures")
    # equal sets are one node; its bands are the same in all copies
    nodes = cut(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min_by("text_key", "doc_id").alias("text_key"), F.first("bands").alias("bands")), "nodes")
    every = nodes.select("node", F.explode("bands").alias("key"))
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    buckets = cut(every.join(shared, "key"), "candidates")
    wanted = nodes.join(buckets.select("node").distinct(), "node").select("node", "doc_id", "text_key")
    sets = cut(_sets(docs, wanted), "sets")
    roots = link(buckets, sets, _to_sets, percent)
    # the smallest document of each component, by way of the nodes (one row for all copies of a text)
    owned = nodes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = owned.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_node = owned.join(least, "root").select("node", "component_id")
    out = rows.drop("bands").join(by_node, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def digests(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).drop("text_key")


def clean(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the smallest document of each component, columns kept."""
    gone = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return docs.join(gone, docs.doc_id.eqNullSafe(gone["_id"]) & (F.xxhash64(docs.text) == gone["_key"]), "left_anti")
