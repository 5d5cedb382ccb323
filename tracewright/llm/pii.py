"""Operator 2: personal data: fixed patterns, and bootstrapped contextual extraction on top of them.

Base spans (email, ip, card, phone) are found in every text. They are the seeds: the words around a seed
induce lexical patterns (two words before it; the words on both sides; a ``name=`` or ``name:`` prefix).
Identifier-like tokens of 4 characters or more outside base spans are candidates with patterns of their own; long words and
instances are known by a digest of the whole. Spark scores
the graph of patterns and instances in turn: a pattern's confidence for a kind is the share of its distinct instances
believed to be of that kind (damped by ``PRIOR``), an instance's belief the noisy-or of its patterns, for kinds its shape
allows. A pattern is strong with a confidence of ``CONFIDENCE`` and ``MIN_SEEDS`` distinct instances that are seeds or have a
strong pattern already, so what one turn discovers opens patterns in the next. After ``STEPS`` turns the
strong patterns mark the candidates that stand in them.

Null texts are empty. Repeated rows (same id and text) each get the same answer; a null doc_id is allowed.
Offsets are code points, the end exclusive. Scans are linear in the text, also for very long runs.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

#: In the contract's order.
KINDS = ("email", "ip", "card", "phone")
STEPS, MIN_SEEDS, CONFIDENCE, PRIOR = 3, 3, 0.6, 1.0
#: Characters up to which words and instances are their own names.
NAME = 64

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a part starts at a run's first digit: from a later one the same run would fail alike
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile(r"[0-9@]")
_PREFIX = re.compile(r"([A-Za-z_]+[=:])(.+)", re.S)
_EDGE = ".,;:!?()[]{}<>\"'"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c)
        total += n if k % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    """Leftmost non-overlapping matches: a match starts where the run of local characters before its @ does."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def name_of(s: str, most: int = NAME) -> str:
    """A text itself, or a digest of the whole where it is long: different texts have different names, whatever their length."""
    return s if len(s) <= most else "\0" + hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


class Words:
    """The words of a text around places in it. Each long word is named once, and prefixes of one are hashed as the places go on, so all
    of it is linear for places in ascending order."""

    def __init__(self, text: str):
        self.text, self.names = text, {}
        found = [m.span() for m in _TOKEN.finditer(text)]
        self.starts, self.ends = [a for a, _ in found], [b for _, b in found]
        self.prefix = (-1, 0, hashlib.blake2b(digest_size=16))

    def at(self, place: int) -> int:
        """The number of the word that holds ``place``, or of the last one before it."""
        return bisect.bisect_right(self.starts, place) - 1

    def name(self, k: int) -> str:
        """A word lower-cased, without its edges; '' where there is none."""
        if not 0 <= k < len(self.starts):
            return ""
        if k not in self.names:
            self.names[k] = name_of(self.text[self.starts[k] : self.ends[k]].strip(_EDGE).lower())
        return self.names[k]

    def before(self, k: int, place: int) -> str:
        """What stands in word k before ``place``, lower-cased."""
        start = self.starts[k]
        if place - start <= NAME:
            return self.text[start:place].lower()
        word, done, h = self.prefix
        if word != k or done > place:
            done, h = start, hashlib.blake2b(digest_size=16)
        h.update(self.text[done:place].lower().encode("utf-8", "surrogatepass"))
        self.prefix = (k, place, h)
        return "\0" + h.copy().hexdigest()


def patterns_of(words: Words, start: int, end: int) -> list[str]:
    """Lexical patterns around a span."""
    k = words.at(start)
    one, two, after = words.name(k - 1), words.name(k - 2), words.name(words.at(end - 1) + 1)
    out = []
    if one and two:
        out.append(f"L {two} {one}")
    if one and after:
        out.append(f"M {one} _ {after}")
    if words.starts[k] < start and words.text[start - 1] in "=:":
        out.append(f"P {words.before(k, start)}")
    return out


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like tokens (four characters or more, with a digit or @) that touch no base span."""
    out, k = [], 0
    spans = sorted((a, b) for a, _, b in taken)
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        if not _MARK.search(text, a, b):
            continue
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        inner = _PREFIX.fullmatch(text[a:b])
        if inner:
            a += len(inner[1])
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if b - a >= 4 and not (k < len(spans) and spans[k][0] < b):
            out.append((a, b))
    return out


def shape_ok(kind: int, s: str) -> bool:
    """Whether a candidate may be of the kind at all."""
    digits = len(_digits(s))
    plain = all(c in "0123456789 -.()+" for c in s)
    return bool((kind == 0 and "@" in s) or (kind == 1 and plain and s.count(".") >= 2) or (kind == 2 and plain and digits >= 8) or (kind == 3 and plain and digits >= 7))


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_SEEN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("may", pa.list_(pa.int32())), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base (start, kind, end), base_sha256 and seen (seeds and candidates with patterns) per row."""

    def run(batches):
        for t in batches:
            base, digest, seen = [], [], []
            for text in t.column(1).to_pylist():
                text = text or ""
                own = base_spans(text)
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in own])
                digest.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in own).encode()).hexdigest())
                words = Words(text) if own or "@" in text or _DIGIT.search(text) else None
                found = [{"start": a, "kind": k, "end": b, "may": [], "instance": name_of(text[a:b]), "patterns": patterns_of(words, a, b)} for a, k, b in own]
                if words:
                    for a, b in candidates(text, own):
                        may = [k for k in range(len(KINDS)) if shape_ok(k, text[a:b])]
                        found.append({"start": a, "kind": -1, "end": b, "may": may, "instance": name_of(text[a:b]), "patterns": patterns_of(words, a, b)})
                seen.append(found)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(2), pa.array(base, pa.list_(_SPAN)), pa.array(digest, pa.string()), pa.array(seen, pa.list_(_SEEN))], ["doc_id", "text_key", "base", "base_sha256", "seen"])

    span = "struct<start:int,kind:int,end:int>"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, base array<{span}>, base_sha256 string, seen array<struct<start:int,kind:int,end:int,may:array<int>,instance:string,patterns:array<string>>>")


def score_patterns(edges: DataFrame, steps: int = STEPS) -> DataFrame:
    """pattern, kind, confidence, strong from distinct edges (pattern, instance, kind or -1, may: the kinds its shape allows)."""
    seeds = edges.where("kind >= 0").select("instance", "kind").distinct().select("*", F.lit(1.0).alias("belief"), F.lit(True).alias("sure"))
    pairs = edges.select("pattern", "instance").distinct()
    size = pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    shapes = edges.where("kind < 0").select("pattern", "instance", F.explode("may").alias("kind")).distinct()
    open_ = shapes.join(seeds.select("instance").distinct(), "instance", "left_anti")
    belief, scored = seeds, None
    for _ in range(steps):
        of = pairs.join(belief, "instance").groupBy("pattern", "kind").agg(F.sum("belief").alias("mass"), F.count_if("sure").alias("sure"))
        confidence = F.col("mass") / (F.col("n") + F.lit(PRIOR))
        strong = (F.col("sure") >= MIN_SEEDS) & (confidence >= CONFIDENCE)
        old, scored = scored, cut(of.join(size, "pattern").select("pattern", "kind", confidence.alias("confidence"), strong.alias("strong")), "pattern-scores")
        drop(old)
        guess = open_.join(scored, ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))))).alias("belief"), F.bool_or("strong").alias("sure"))
        belief = seeds.unionByName(guess)
    return scored


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base, base_sha256 and found (spans of the contextual step) per row."""
    rows = cut(scan(docs), "pii")
    seen = rows.select("doc_id", "text_key", F.explode("seen").alias("s"))
    edges = cut(seen.select(F.explode("s.patterns").alias("pattern"), F.col("s.instance").alias("instance"), F.col("s.kind").alias("kind"), F.col("s.may").alias("may")).distinct(), "pii-edges")
    strong = score_patterns(edges).where("strong").select("pattern", F.col("kind").alias("as_kind"), "confidence")
    open_ = seen.where("s.kind = -1 and size(s.may) > 0").select("doc_id", "text_key", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.may").alias("may"), F.explode("s.patterns").alias("pattern"))
    met = open_.join(strong, "pattern").where(F.array_contains("may", F.col("as_kind")))
    # one kind for a span: the most confident, ties in the order of KINDS
    best = met.groupBy("doc_id", "text_key", "start", "end").agg(F.max(F.struct("confidence", (-F.col("as_kind")).alias("k"))).alias("best"))
    found = best.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", (-F.col("best.k")).alias("kind"), "end"))).alias("found"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "found")
    # the rows are small by now: no text travels
    out = rows.select("doc_id", "text_key", "base", "base_sha256").join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_key").eqNullSafe(F.col("_key")), "left")
    return out.select("doc_id", "base", "base_sha256", F.coalesce("found", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("found"))


def _count(kind: int):
    return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns, and n_found: spans that only the contextual step finds."""
    names = F.array(*map(F.lit, KINDS))
    every = F.array_sort(F.concat("base", "found"))
    text = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")
    counts = [_count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return spans(docs).select("doc_id", *counts, "base_sha256", text.alias("spans"), F.size("found").cast("long").alias("n_found"))
