"""Operator 7: quality rules by cross-document line frequency, in DataFrame functions only.

Lines are normalised (A-Z lower-cased, blanks collapsed, trimmed) and hashed. For each host (the
``source`` column; null is a host of its own) the distinct documents holding a line are counted: rows of one doc_id are one
document, rows without an id one for each text. Lines held by more than ``max(MIN_DOCS, SHARE * documents of the
host)`` are boilerplate and leave the text; a document of which less than ``LEFT`` of the word
characters remains is rejected as depleted.

Null texts have no words and fail the base rule; an empty table gives an empty result; repeated rows
(same id) are each judged, and count once; a null id is allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WORDS_MIN, REPEAT_PERCENT, WINDOW = 20, 30, 8
MIN_DOCS, SHARE, LEFT = 8, 0.10, 0.3
#: Frequent lines of all hosts that may be broadcast.
BROADCAST_LINES = 500_000

_BLANK = "[ \\t\\n\\u000B\\f\\r]"
_BLANKS, _SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{_BLANK}+"), lambda w: w != "")


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def has_word(line: Column) -> Column:
    """The line holds something other than blanks and 0x09-0x0D."""
    return F.ltrim(line, F.lit(_BLANKS)) != ""  # looks no further than the first character of a word


def without(text: Column, chars: str) -> Column:
    """``text`` without some characters: bytes are searched for each in turn; ``translate`` would make a string of every character."""
    return reduce(lambda s, c: F.replace(s, F.lit(c), F.lit("")), chars, text)


def normal(line: Column) -> Column:
    """The pattern runs where there is something to collapse, and ``translate`` where ``lower`` could change more than A-Z."""
    wide = reduce(Column.__or__, [F.contains(line, F.lit(c)) for c in ("  ", *_BLANKS[1:])])
    single = F.when(wide, F.regexp_replace(line, f"{_BLANK}+", " ")).otherwise(line)
    return F.trim(F.when(F.octet_length(line) == F.length(line), F.lower(single)).otherwise(F.translate(single, _UPPER, _LOWER)))


def let(value: Column, f) -> Column:
    """f(value) with ``value`` computed once a row: lambdas name it, expressions would repeat it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def repeat_words(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more; ``hashes``: of each word, in order."""
    windows = F.when(F.size(hashes) < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(hashes) - (WINDOW - 1))), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW))))

    def repeated(order: Column) -> Column:
        """Places of the windows whose neighbour in hash order has the same hash."""
        return F.filter(F.transform(order, lambda x, k: F.when((x.h == F.get(order, k - 1).h) | (x.h == F.get(order, k + 1).h), x.i)), lambda p: p.isNotNull())

    def covered(h: Column) -> Column:
        """Length of the union of the repeated windows, back in text order."""
        places = F.array_sort(let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated))
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, p: F.struct((s.n + (p + WINDOW) - F.greatest(p, s.end)).alias("n"), (p + WINDOW).alias("end")), lambda s: s.n)

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def word_rules(text: Column) -> Column:
    """struct(n_words, n_repeat_words, failed). One expression over the text's words, named once: a filter on it may move
    below other columns, and must not repeat them."""
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    counts = let(hashes, lambda h: F.struct(F.size(h).cast("long").alias("n_words"), repeat_words(h).alias("n_repeat_words")))
    return let(counts, lambda c: F.struct(c.n_words.alias("n_words"), c.n_repeat_words.alias("n_repeat_words"), ((c.n_words < WORDS_MIN) | (c.n_repeat_words * 100 > c.n_words * REPEAT_PERCENT)).alias("failed")))


def base(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    full = F.filter(lines(F.col("text")), has_word)
    out = docs.withColumns({
        "_rules": word_rules(F.col("text")),
        "word_chars": F.length(without(text, _BLANKS)).cast("long"),
        "n_symbols": (F.length(text) - F.length(without(text, _SYMBOLS))).cast("long"),
        "n_dup_lines": let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    })
    return out.withColumns({"n_words": F.col("_rules.n_words"), "n_repeat_words": F.col("_rules.n_repeat_words"), "base_failed": F.col("_rules.failed")}).drop("_rules")


def _keys(text: Column) -> Column:
    """Distinct hashes of a text's normalised lines."""
    return F.array_distinct(F.transform(F.filter(lines(text), has_word), lambda x: F.xxhash64(normal(x))))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """host, line (hash): the lines above the host's limit. Counts are exact and cover all documents; a line's documents are made
    distinct where (host, line, document) meet and then counted by partial sums, so a line that a third of all documents hold, or
    an id that a third of all rows have, meets in no task and no row."""
    nameless = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    own = docs.select(F.col("source").alias("host"), F.col("doc_id").alias("doc"), nameless.alias("nameless"), _keys(F.col("text")).alias("keys"))
    per_host = own.select("host", "doc", "nameless").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    held = own.select("host", "doc", "nameless", F.explode("keys").alias("line")).distinct()
    counts = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_docs)
    over = counts.join(per_host.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > share * F.col("docs"))
    return over.select("host", "line")


def with_boilerplate(rows: DataFrame, over: DataFrame) -> DataFrame:
    """``rows`` with ``boilerplate``: the hashes of frequent lines (host, line) that the document may hold.

    Up to ``BROADCAST_LINES`` of them (16 bytes each, counted) are broadcast by host, and no text moves. Beyond, the documents' line hashes meet
    them by host and line, and what a document holds of them meets its text by its id and hash: nothing meets by host."""
    none = F.array().cast("array<bigint>")
    if over.count() <= BROADCAST_LINES:
        lists = F.broadcast(over.groupBy(F.col("host").alias("_host")).agg(F.collect_set("line").alias("boilerplate")))
        out = rows.join(lists, F.col("source").eqNullSafe(F.col("_host")), "left").drop("_host")
    else:
        keyed = rows.select(F.col("source").alias("_host"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash"), _keys(F.col("text")).alias("keys"))
        held = keyed.select("_host", "_doc", "_hash", F.explode("keys").alias("_line")).distinct()
        met = held.join(over, F.col("_host").eqNullSafe(F.col("host")) & (F.col("_line") == F.col("line")))
        own = met.groupBy("_host", "_doc", "_hash").agg(F.collect_set("line").alias("boilerplate"))
        same = rows["source"].eqNullSafe(own["_host"]) & rows["doc_id"].eqNullSafe(own["_doc"]) & (F.xxhash64(rows["text"]) == own["_hash"])
        out = rows.join(own, same, "left").drop("_host", "_doc", "_hash")
    return out.withColumn("boilerplate", F.coalesce("boilerplate", none))


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, left: float = LEFT) -> DataFrame:
    """``docs`` with the base columns, ``boilerplate`` (array of hashes of lines over the limit), ``left_chars``
    (word characters outside them) and ``kept``."""
    over = cut(frequent_lines(docs, min_docs, share), "frequent-lines")
    clash = [c for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "boilerplate", "left_chars", "kept") if c in docs.columns]
    joined = with_boilerplate(docs.drop(*clash), over)
    left_chars = F.aggregate(lines(F.col("text")), F.lit(0).cast("long"), lambda s, x: s + F.when(F.array_contains(F.col("boilerplate"), F.xxhash64(normal(x))), 0).otherwise(F.length(without(x, _BLANKS))))
    # without boilerplate at this host nothing needs to be counted again
    out = base(joined).withColumn("left_chars", F.when(F.size("boilerplate") == 0, F.col("word_chars")).otherwise(left_chars))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("left_chars") >= left * F.col("word_chars")))


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The documents kept, without their boilerplate lines; columns of ``docs`` (n_chars renewed)."""
    text = F.when(F.size("boilerplate") == 0, F.col("text")).otherwise(F.array_join(F.filter(lines(F.col("text")), lambda x: ~F.array_contains(F.col("boilerplate"), F.xxhash64(normal(x)))), "\n"))
    # other columns travel under names of their own, so that none can clash with those of the rules
    rest = {c: f"_own{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")}
    out = judge(docs.withColumnsRenamed(rest), **limits).where("kept").withColumn("text", text)
    if "n_chars" in rest:
        out = out.withColumn(rest["n_chars"], F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(rest.get(c, c)).alias(c) for c in docs.columns])


def digests(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text", "source")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "left_chars")
