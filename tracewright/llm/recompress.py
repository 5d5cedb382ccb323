"""Operator 3: long repeats of words by recompression.

Words are named by hash, so equal words have one name on every executor without a dictionary. Each of ``ROUNDS``
rounds gives every symbol a side by a bit of its name and joins each left one with a right one after it to the symbol
named by both; then phrases of symbols are named. All names are functions of what they name, so a round needs no
exchange and runs where the texts are, and the phrases' names travel as rows: equal texts have equal symbols everywhere, except near their ends, where
a symbol may have been joined with what stands outside. Symbols of two rounds depend on at most three words to the left of
their start and two to the right of their last word. Where a word repeats side by side its run may reach out of any window,
so there words stay symbols of their own.

A round-two symbol has up to four words, so any 13 words hold a symbol start at offsets 2 to 5. The phrase of a
symbol start is the symbols that end within the next five words, and single words up to seven. The least
phrase name of the four offsets stands for a window. A phrase that two documents hold reveals where repeats can be: the words
around it, up to 16, go to the bucket of its name, and a bucket compares windows word by word, so
what goes does not rest on hashes (of words over 64 bytes, 256-bit digests are compared). A frequent phrase sends its
windows one by one to buckets of their own, where equal windows arrive once a group.

Null texts have no words. Rows with equal doc_ids do not remove each other's words; rows with a null
doc_id neither remove nor lose words. Texts of fewer than 13 words have no window.
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
from .common import _SPACE, MAX, U64, binaries, cut, mix, names, per_doc, shares, sliding, text_buffer, text_bytes, word_spans

WINDOW, BEFORE, ROUNDS = 13, 2, 2
#: Words of a symbol at most, words within which the symbols of a phrase end, and words of a phrase.
SPAN, INNER, PHRASE = 1 << ROUNDS, 6, 8
#: Words around a phrase start that windows with it at offsets BEFORE to BEFORE + SPAN - 1 can hold.
LEFT, RIGHT = BEFORE + SPAN - 1, WINDOW - BEFORE
LONG_WORD, GROUP = 64, 3 << 20

_LEFT_RIGHT = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))


def joined(name: np.ndarray, at: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Round k: names and first words of the symbols after left ones have joined the right ones that follow them.

    doc: of each word."""
    right = (name >> U64(17 + 13 * k)) & U64(1) == 1
    pair = np.zeros(len(name), bool)  # this one and the next
    pair[:-1] = ~right[:-1] & right[1:] & (doc[at[:-1]] == doc[at[1:]])
    made = name.copy()
    made[:-1][pair[:-1]] = mix(name[:-1] * _LEFT_RIGHT[0] + name[1:] * _LEFT_RIGHT[1] + U64(k))[pair[:-1]]
    stays = np.ones(len(name), bool)
    stays[1:] = ~pair[:-1]
    return made[stays], at[stays]


def symbols(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words of the symbols after all rounds."""
    name, at = words, np.arange(len(words))
    for k in range(ROUNDS):
        name, at = joined(name, at, doc, k)
    return name, at


def phrases(words: np.ndarray, name: np.ndarray, at: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol starts with PHRASE words left in their document, and the names of their phrases. last: end of each word's document."""
    which = np.flatnonzero(at + PHRASE <= last[at])
    place = at[which]
    out, end = np.zeros(len(which), U64), place.copy()
    ends, n = np.append(at[1:], len(words)), len(at)
    live, j = np.arange(len(which)), which.copy()
    for _ in range(INNER):
        inside = ends[j] <= place[live] + INNER
        live, j = live[inside], j[inside]
        out[live] = mix(out[live] * _LEFT_RIGHT[0] + name[j] + U64(1))
        end[live] = ends[j]
        j = j + 1
        live, j = live[j < n], j[j < n]
    for _ in range(PHRASE - 1):
        live = np.flatnonzero(end < place + PHRASE)
        if not len(live):
            break
        out[live] = mix(out[live] * _LEFT_RIGHT[1] + words[end[live]] + U64(2))
        end[live] += 1
    return place, np.clip(out, U64(1), MAX - U64(1))


def anchors(words: np.ndarray, row: np.ndarray, last: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase starts that stand for some window, and the phrases' names. row: of each word; use: for each row."""
    n = len(words) - PHRASE + 1
    if len(words) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    place, name = phrases(words, *symbols(words, row), last)
    key = np.full(n, MAX)
    key[place] = name
    least = sliding(key[BEFORE:], SPAN)  # of the window at i: over i + 2 .. i + 5
    window = np.arange(len(least))
    least = np.where((window + WINDOW <= last[: len(least)]) & use[row[: len(least)]], least, U64(0))
    edge = np.zeros(SPAN - 1, U64)
    most = sliding(np.concatenate([edge, least, edge]), SPAN, np.maximum)  # of the place j + 2: over windows j - 3 .. j
    here = key[BEFORE : BEFORE + len(most)]
    most = most[: len(here)]
    chosen = np.flatnonzero((here == most) & (most > 0)) + BEFORE
    return chosen, mix(key[chosen])  # least ones are small: mixed again, they spread over the buckets


class Group:
    """A group's texts, in an order of their own whatever order they arrive in, with words and anchors."""

    def __init__(self, texts: pa.Table):
        t = self.texts = texts.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids = t["doc_id"].combine_chunks()
        self.ids, null = np.array(pc.fill_null(ids, 0), np.int64), np.array(pc.is_null(ids), bool)
        self.data, offsets = text_buffer(t["text"])
        self.starts, self.ends, self.counts = word_spans(self.data, offsets)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self.last = np.repeat(np.cumsum(self.counts), self.counts)  # end of the word's document
        self.places, self.keys = anchors(names(self.data, self.starts, self.ends), self.row, self.last, ~null)
        self.doc = self.ids[self.row[self.places]] if len(self.places) else np.zeros(0, np.int64)

    def plain(self) -> tuple[bytes, np.ndarray]:
        """The words with a blank after each (long ones as digests), and where each starts."""
        size = self.ends - self.starts
        if (size > LONG_WORD).any():
            raw = self.data.tobytes()
            words = [raw[a:b] if b - a <= LONG_WORD else b"\t" + hashlib.blake2b(raw[a:b], digest_size=32).hexdigest().encode() for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]
            size = np.array(list(map(len, words)))
            return b" ".join(words) + b" ", np.concatenate([[0], np.cumsum(size + 1)])
        starts = np.concatenate([[0], np.cumsum(size + 1)])
        out = np.full(starts[-1], 32, np.uint8)
        inside = np.ones(starts[-1], bool)
        inside[starts[1:] - 1] = False
        out[inside] = self.data[~_SPACE[self.data]]
        return out.tobytes(), starts

    def asked(self, shared: np.ndarray, frequent: np.ndarray) -> Asked:
        """What the group asks about: the words around its shared anchors, or the windows of frequent ones."""
        which = np.flatnonzero(shared & ~frequent)
        p = self.places[which]
        left = np.minimum(LEFT, p - (np.cumsum(self.counts) - self.counts)[self.row[p]])
        right = np.minimum(RIGHT, self.last[p] - p)
        keys = self.keys[which]
        lone = np.flatnonzero(shared & frequent)
        for offset in range(BEFORE, BEFORE + SPAN):
            q = self.places[lone]
            ok = (q - offset >= (np.cumsum(self.counts) - self.counts)[self.row[q]]) & (q - offset + WINDOW <= self.last[q])
            which, p = np.concatenate([which, lone[ok]]), np.concatenate([p, q[ok]])
            left, right = np.append(left, np.full(ok.sum(), offset)), np.append(right, np.full(ok.sum(), WINDOW - offset))
        text, at = self.plain()
        heads = [bytes([k, 32]) for k in range(LEFT + 1)]
        rows = [heads[k] + text[a:b] for k, a, b in zip(left.tolist(), at[p - left].tolist(), at[p + right].tolist(), strict=True)]
        # windows of frequent phrases go by what they are
        own = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in rows[len(keys) :]]
        keys = np.concatenate([keys, np.array(own, U64)]) & ~U64(0xFFFF)
        return Asked(keys, rows, self.doc[which], p, left, right)


class Asked:
    """Rows of words (the place of the phrase in the first byte), each once, sorted by key."""

    def __init__(self, keys, rows, doc, place, left, right):
        self.place, self.left, self.right, self.doc = place, left, right, doc
        coded = pa.array(rows, pa.binary()).dictionary_encode()
        code = np.array(coded.indices, np.int64)
        n = len(coded.dictionary)
        key, self.least = np.zeros(n, U64), np.full(n, np.iinfo(np.int64).max)
        key[code] = keys
        np.minimum.at(self.least, code, doc)
        order = np.argsort(key, kind="stable")
        number = np.empty(n, np.int64)
        number[order] = np.arange(n)
        self.code, self.keys, self.least, self.rows = number[code], key[order], self.least[order], coded.dictionary.take(pa.array(order))

    def packed(self, pid: int, buckets: int) -> pa.Table:
        squeeze, out = zstandard.ZstdCompressor(level=1), []
        size = np.array(pc.binary_length(self.rows), np.int32) if len(self.rows) else np.zeros(0, np.int32)
        for k, a, b in asking.bucket_slices(self.keys, buckets):
            ids, index = np.unique(self.least[a:b], return_inverse=True)
            head = np.array([b - a, len(ids)], np.int64).tobytes()
            out.append((k, squeeze.compress(b"".join([head, asking.pack_keys(self.keys[a:b]), ids.tobytes(), index.astype(np.uint32).tobytes(), size[a:b].tobytes(), *self.rows[a:b].to_pylist()]))))
        return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([pid] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.binary())], schema=asking.ASK_ARROW)


def _unpacked(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    at = 16 + asking.KEY_BYTES * n
    keys, ids = asking.unpack_keys(raw[16:at], n), np.frombuffer(raw[at : at + 8 * m], np.int64)
    at += 8 * m
    index, size = np.frombuffer(raw[at : at + 4 * n], np.uint32), np.frombuffer(raw[at + 4 * n : at + 8 * n], np.int32)
    return keys, binaries(np.frombuffer(raw, np.uint8, offset=at + 8 * n), np.cumsum(size)), ids[index]


def equal_rows(codes: np.ndarray) -> np.ndarray:
    """A number for each row, equal for equal rows: sorted by a hash, compared by their codes."""
    h = np.zeros(len(codes), U64)
    for c in codes.T:
        h = mix(h * _LEFT_RIGHT[0] + c.astype(U64) + U64(1))
    order = np.argsort(h, kind="stable")
    s = codes[order]
    new = np.ones(len(codes), bool)
    new[1:] = (s[1:] != s[:-1]).any(1)
    if (new[1:] & (h[order][1:] == h[order][:-1])).any():  # other words under one hash
        return np.unique(codes, axis=0, return_inverse=True)[1].ravel()
    out = np.empty(len(codes), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def later_windows(keys: np.ndarray, rows: pa.Array, doc: np.ndarray) -> np.ndarray:
    """For each row of words a bit for each of its windows (by the phrase's offset) that a smaller document holds."""
    coded = rows.dictionary_encode()
    code, n = np.array(coded.indices, np.int64), len(coded.dictionary)
    least, key = np.full(n, np.iinfo(np.int64).max), np.zeros(n, U64)
    np.minimum.at(least, code, doc)
    key[code] = keys
    order = np.argsort(key, kind="stable")
    same, alike = key[order][1:] == key[order][:-1], np.zeros(n, bool)
    alike[1:] |= same
    alike[:-1] |= same
    mixed = np.sort(order[alike])  # phrases with other words around them elsewhere
    bits = np.zeros(n, np.uint8)
    if len(mixed):
        data, offsets = text_buffer(coded.dictionary.take(pa.array(mixed)).cast(pa.large_binary()))
        left = data[offsets[:-1]].astype(np.int64)
        starts, ends, counts = word_spans(data, offsets)
        words = np.array(binaries(data[~_SPACE[data]], np.cumsum(ends - starts)).dictionary_encode().indices, np.int32)
        first = np.cumsum(counts) - counts + 1  # the word after the head
        for offset in range(BEFORE, BEFORE + SPAN):
            ok = np.flatnonzero((left >= offset) & (counts - 1 >= left - offset + WINDOW))
            window = equal_rows(words[(first[ok] + left[ok] - offset)[:, None] + np.arange(WINDOW)])
            held = np.full(len(ok), np.iinfo(np.int64).max)
            np.minimum.at(held, window, least[mixed[ok]])
            bits[mixed[ok[held[window] < least[mixed[ok]]]]] |= np.uint8(1 << offset)
    out = bits[code]
    out[doc > least[code]] = 0xFF
    return out


def _answer(batches):
    asked = asking.rows_of(batches, asking.ASK_ARROW)
    got = [_unpacked(b) for b in asked["blob"].to_pylist()]
    if got:
        edges = np.cumsum([0, *(len(g[0]) for g in got)])
        keys, rows, doc = zip(*got, strict=True)
        bits = later_windows(np.concatenate(keys), pa.concat_arrays(rows), np.concatenate(doc))
        blobs = [zstandard.compress(bits[a:b].tobytes(), 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(asked["pid"].to_pylist(), pa.int32()), pa.array(asked["bucket"].to_pylist(), pa.int32()), pa.array(blobs, pa.binary())], ["pid", "bucket", "blob"])


def removed_words(texts: pa.Table, answers: pa.Table, buckets: int) -> tuple[Group, np.ndarray]:
    """A group and which of its words go."""
    g = Group(texts)
    a = g.asked(*asking.shared_mask(g.keys, g.doc, asking.blobs_of(answers, 0), buckets))
    bits, told = np.zeros(len(a.keys), np.uint8), asking.blobs_of(answers, 1)
    for k, x, y in asking.bucket_slices(a.keys, buckets):
        bits[x:y] = np.frombuffer(zstandard.decompress(told[k]), np.uint8)
    bits = bits[a.code] if len(a.code) else np.zeros(0, np.uint8)
    bits[a.doc > a.least[a.code]] = 0xFF
    edge = np.zeros(len(g.starts) + 1, np.int64)
    for offset in range(BEFORE, BEFORE + SPAN):
        gone = (bits >> np.uint8(offset)) & np.uint8(1) == 1
        at = a.place[gone & (a.left >= offset) & (a.right >= WINDOW - offset)] - offset
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
    return g, np.cumsum(edge[:-1]) > 0


def _exchange(docs: DataFrame, *more):
    """The dealt texts and the answers to both questions (pid, kind, bucket, blob), which are written once."""
    total = text_bytes(docs)
    buckets = shares(total, asking.BUCKET_BYTES)
    groups = asking.grouped(docs, F.col("doc_id").cast("long").alias("doc_id"), "text", *more, groups=shares(total, GROUP))

    def ask_phrases(t: pa.Table) -> pa.Table:
        g = Group(t)
        return asking.ask_shared(t["pid"][0].as_py(), g.keys, g.doc, buckets)

    def ask_words(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(t):
            return asking.ASK_ARROW.empty_table()
        g = Group(t)
        return g.asked(*asking.shared_mask(g.keys, g.doc, asking.blobs_of(answers, 0), buckets)).packed(t["pid"][0].as_py(), buckets)

    back = "pid int, bucket int, blob binary"
    shared = cut(asking.to_buckets(asking.per_group(groups, ask_phrases, asking.ASK), asking.answer_shared, back).withColumn("kind", F.lit(0)), "phrases")
    later = asking.to_buckets(asking.with_answers(groups, shared, ask_words, asking.ASK), _answer, back).withColumn("kind", F.lit(1))
    return groups, shared.union(later), buckets


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row."""
    groups, answers, buckets = _exchange(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def finish(t: pa.Table, told: pa.Table) -> pa.Table:
        if not len(t):
            return schema.empty_table()
        g, gone = removed_words(t, told, buckets)
        n = per_doc(gone, g.counts)
        kept = [hashlib.sha256(x).hexdigest() for x in kept_texts(g, gone, n)]
        return pa.table([g.texts["doc_id"].combine_chunks(), pa.array(g.counts, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    return asking.with_answers(groups, answers, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def kept_texts(g: Group, gone: np.ndarray, n: np.ndarray):
    """The remaining words of each text joined by blanks, as bytes."""
    at = 0
    for text, count, less in zip(g.texts["text"].to_pylist(), g.counts.tolist(), n.tolist(), strict=True):
        words = (text or "").encode().split()
        if less:
            stays = ~gone[at : at + count]
            words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
        at += count
        yield b" ".join(words)


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated words removed (remaining words joined by blanks), columns kept (n_chars renewed)."""
    carried = asking.Carried(docs)
    groups, answers, buckets = _exchange(docs, *carried.sent)

    def finish(t: pa.Table, told: pa.Table) -> pa.Table:
        if not len(t):
            return t.drop_columns("pid")
        g, gone = removed_words(t, told, buckets)
        kept = [x.decode() for x in kept_texts(g, gone, per_doc(gone, g.counts))]
        return pa.table({"doc_id": g.texts["doc_id"], "text": pa.array(kept, pa.string())} | carried.taken(g.texts))

    out = asking.with_answers(groups, answers, finish, carried.schema("doc_id long", "text string"))
    if "n_chars" in carried.names:
        out = out.withColumn(carried.names["n_chars"], F.length("text").cast(carried.kinds["n_chars"]))
    return carried.restored(out)
