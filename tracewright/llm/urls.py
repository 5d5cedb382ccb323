"""Operator 8: URL filter: a blocked Bloom filter passes possible hits on to an exact hash join.

DataFrame functions only. Listed URLs are canonicalised (scheme, ``www.`` and ``m.``, query, fragment
and closing slash fall away; host A-Z lower-cased). A listed URL sets one bit in each of four 64-bit
words of one block; blocks are built by ``bit_or``, as many as the counted list asks for. Up to ``BROADCAST_BLOCKS`` (4 x 8
bytes each) they are broadcast; a larger filter meets the pages in a join by block. The hash join with the list decides; no
join but that of the small filter is forced, so Spark can split one that a frequent URL makes uneven.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule and are never listed.
Repeated rows stay, also listed ones; an empty list blocks nothing. Of rules equally long that fit, which cannot differ but in where
the host ends, the first stated holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BLOCKS, BITS_A_URL = 1 << 16, 12
#: Host, path and verdict of each rule; fixed by the contract.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Null where there is no host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, "^(www|m)\\.", ""), F.regexp_replace(path, "/+$", "")))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    return F.coalesce(*[F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in longest])


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    where = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(blocks)).cast("bigint")
    spread = F.xxhash64(key, F.lit(23))
    return where, [F.shiftrightunsigned(spread, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(4)]


def block_count(listed: DataFrame) -> int:
    return max(1, -(-listed.count() * BITS_A_URL // 256))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """block, w0..w3: at most ``blocks`` rows."""
    where, bits = _bits(F.col("url_key"), blocks)
    # shiftleft takes a constant amount; call_function gives the column form
    words = {f"w{k}": F.call_function("shiftleft", F.lit(1).cast("long"), b) for k, b in enumerate(bits)}
    return listed.select(where.alias("block"), *[w.alias(c) for c, w in words.items()]).groupBy("block").agg(*[F.bit_or(c).alias(c) for c in words])


def verdicts(pages: DataFrame, listed_urls: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed, maybe (the filter's answer) per row of ``pages``."""
    at = (host_of(F.col("url")), path_of(F.col("url")))
    listed = listed_urls.select(canonical(*at).alias("url_key")).where("url_key is not null").distinct()
    blocks = block_count(listed)
    rows = pages.select("page_id", at[0].alias("host"), at[1].alias("path"))
    rows = rows.withColumn("url_key", canonical(F.col("host"), F.col("path"))).withColumn("by_rule", rule_for(F.col("host"), F.col("path"), rules))
    where, bits = _bits(F.col("url_key"), blocks)
    built = bloom(listed, blocks)
    probed = rows.join(F.broadcast(built) if blocks <= BROADCAST_BLOCKS else built, where == F.col("block"), "left")
    passes = reduce(lambda a, b: a & b, [F.call_function("shiftright", F.col(f"w{k}"), b).bitwiseAND(F.lit(1).cast("long")) == 1 for k, b in enumerate(bits)])
    probed = probed.withColumn("maybe", F.coalesce(F.col("url_key").isNotNull() & passes, F.lit(False)))
    found = listed.withColumnRenamed("url_key", "listed_key")
    possible = probed.where("maybe").join(found, F.col("url_key") == F.col("listed_key"), "left").withColumn("listed", F.col("listed_key").isNotNull())
    rest = probed.where("not maybe").withColumn("listed", F.lit(False))
    columns = ["page_id", "host", "path", F.col("by_rule.rule").alias("rule"), F.coalesce("by_rule.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed", "maybe"]
    return possible.select(*columns).unionByName(rest.select(*columns))
