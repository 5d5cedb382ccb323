"""Sequence operators on ordered runs: transitions, consistency, pairing of starts and ends."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import placed_within, with_previous


def pairs_within(df: DataFrame, by: list[str], order: list[str], item: str, k: int, kind: str | None = None) -> DataFrame:
    """Source, target, off, ord (source's order struct) for offsets 1..k; with ``kind`` only equal kinds pair,
    though every element counts for the offset. One sort per run."""
    w = Window.partitionBy(*by).orderBy(*order)
    leads = F.array(*[F.struct(F.lit(j).alias("off"), F.lead(item, j).over(w).alias("target"), (F.lead(kind, j).over(w) if kind else F.lit(None).cast("string")).alias("kind")) for j in range(1, k + 1)])
    rows = df.select(*by, F.col(item).alias("source"), *([F.col(kind).alias("_kind")] if kind else []), F.struct(*order).alias("ord"), leads.alias("_leads"))
    out = rows.withColumn("p", F.explode("_leads")).where("p.target is not null")
    if kind:
        out = out.where("_kind = p.kind").drop("_kind")
    return out.select(*by, "source", F.col("p.target").alias("target"), F.col("p.off").alias("off"), "ord")


def transition_probs(pairs: DataFrame, min_count: int = 2) -> DataFrame:
    """Source, off, target, cnt, prob, rank. The denominator counts all targets, before ``min_count``.
    Ranks go by falling count, ties by first occurrence."""
    counts = pairs.groupBy("source", "off", "target").agg(F.count(F.lit(1)).alias("cnt"), F.min("ord").alias("first"))
    total = F.sum("cnt").over(Window.partitionBy("source", "off"))
    out = counts.withColumn("prob", F.col("cnt") / total).where(F.col("cnt") >= min_count)
    rank = F.row_number().over(Window.partitionBy("source", "off").orderBy(F.desc("cnt"), "first"))
    return out.withColumn("rank", rank.cast("long")).drop("first")


def learn(df: DataFrame, by: list[str], order: list[str], item: str, kind: str, k: int = 3, min_count: int = 2) -> DataFrame:
    """The learner over runs of mixed kinds (tools and models): kind, source, off, target, cnt, prob, rank. All elements count for
    the offset, equal kinds alone pair; probabilities are rounded half to even at four places."""
    both = df.withColumn("_item", F.struct(F.col(kind).alias("kind"), F.col(item).alias("name")))
    table = transition_probs(pairs_within(both, by, order, "_item", k, kind), min_count)
    return table.select(F.col("source.kind").alias("kind"), F.col("source.name").alias("source"), "off", F.col("target.name").alias("target"), "cnt", F.bround("prob", 4).alias("prob"), "rank")


def counts_of(df: DataFrame, by: list[str], order: list[str], item: str, k: int = 3, part: int = 0) -> DataFrame:
    """Source, off, target, cnt, first of one batch of traces: what a stored table of counts takes up. ``part`` is the batch's number, so
    that the first occurrence over batches is that of the earliest."""
    pairs = pairs_within(df, by, order, item, k)
    return pairs.groupBy("source", "off", "target").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct(F.lit(part).alias("part"), F.col("ord").alias("ord"))).alias("first"))


def merged_counts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The counts of all traces so far: old traces are not read again."""
    return stored.unionByName(new).groupBy("source", "off", "target").agg(F.sum("cnt").alias("cnt"), F.min("first").alias("first"))


def ranked_counts(counts: DataFrame, min_count: int = 2) -> DataFrame:
    """A29, L3 from counts: source, off, target, cnt, prob, rank."""
    w = Window.partitionBy("source", "off")
    out = counts.withColumn("prob", F.col("cnt") / F.sum("cnt").over(w)).where(F.col("cnt") >= min_count)
    return out.withColumn("rank", F.row_number().over(w.orderBy(F.desc("cnt"), "first")).cast("long")).drop("first")


def updated_table(table: DataFrame, stored: DataFrame, new: DataFrame, min_count: int = 2) -> DataFrame:
    """The transition table after more traces: sources and offsets of which ``new`` counts nothing keep their rows; the others are ranked
    anew from their merged counts."""
    touched = new.select("source", "off").distinct()
    fresh = ranked_counts(merged_counts(stored.join(touched, ["source", "off"], "left_semi"), new), min_count)
    return table.join(touched, ["source", "off"], "left_anti").unionByName(fresh)


def transition_matrix(df: DataFrame, by: list[str], order: list[str], item: str, off: int = 1, min_count: int = 1) -> DataFrame:
    """Source, target, prob; rows are normalised after tools with few transitions (as a source) leave."""
    pairs = pairs_within(df, by, order, item, off).where(F.col("off") == off)
    counts = pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("cnt"))
    kept = counts.groupBy("source").agg(F.sum("cnt").alias("n")).where(F.col("n") >= min_count).select(F.col("source").alias("item"))
    inside = counts.join(kept, counts.source == kept["item"], "left_semi").join(kept, counts.target == kept["item"], "left_semi")
    return inside.select("source", "target", (F.col("cnt") / F.sum("cnt").over(Window.partitionBy("source"))).alias("prob"))


def step_consistency(df: DataFrame, by: list[str], order: list[str], item: str, min_runs: int = 3) -> DataFrame:
    """Pos, item, share of the most frequent item at each position (ties: first seen by ``by``, ``order``)."""
    pos = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    at = df.select(*by, *order, item, pos.cast("long").alias("pos"))
    counts = at.groupBy("pos", item).agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct(*by, *order)).alias("first"))
    w = Window.partitionBy("pos")
    ranked = counts.withColumn("n", F.sum("cnt").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("cnt"), "first")))
    return ranked.where((F.col("r") == 1) & (F.col("n") >= min_runs)).select("pos", item, "cnt", "n", (F.col("cnt") / F.col("n")).alias("share"))


def collapse(df: DataFrame, by: list[str], order: list[str], item: str) -> DataFrame:
    """Rows whose item differs from the one before."""
    rows = with_previous(df, by, order, item, "_before")
    return rows.where(F.col("_before").isNull() | (F.col("_before") != F.col(item))).drop("_before")


def fingerprints(df: DataFrame, by: list[str], order: list[str], item: str) -> DataFrame:
    """By, steps, print: equal for runs of equal items in equal order (128 bits). Each row's hash hangs on its item and its
    place, and hashes combine by exclusive or, so parts of a run are summed up wherever they are and no task or row holds a run."""
    rows = placed_within(df.select(*by, *order, item), by, order, "_at")
    hashes = [F.bit_xor(F.xxhash64(F.lit(seed), "_at", item)) for seed in (1, 2)]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("steps"), F.struct(*[h.alias(f"h{k}") for k, h in enumerate(hashes)]).alias("print"))


def greedy_match(df: DataFrame, by: list[str], order: list[str], item: str, plan: Sequence[str]) -> DataFrame:
    """By, pos, ok: which steps of the plan each run meets in their order; a step that it misses does not move the cursor.

    One pass over the sorted rows with a flag for each step: an item meets the first unmet step of its name, and what later steps met before
    was met too early and is taken back. Only items of the plan are sorted, and a task holds the flags of one run."""
    names, n = [f"{c}" for c in by], len(plan)
    places = {x: [k for k, y in enumerate(plan) if y == x] for x in plan}
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, met, started = (), [False] * n, False
        for rows in batches:
            out = []
            for *key, x in zip(*(rows[c] for c in names), rows["_item"], strict=True):
                if not started or key != own:
                    if started:
                        out.append((*own, met))
                    own, met, started = key, [False] * n, True
                for k in places.get(x, ()):
                    if not met[k]:
                        met = [*met[:k], True, *[False] * (n - k - 1)]
                        break
            yield pd.DataFrame(out, columns=[*names, "met"])
        if started:
            yield pd.DataFrame([(*own, met)], columns=[*names, "met"])

    rows = df.where(F.col(item).isin(*plan)).select(*by, *order, F.col(item).alias("_item")).repartition(*by).sortWithinPartitions(*by, *order).select(*by, "_item")
    found = rows.mapInPandas(run, f"{kinds}, met array<boolean>")
    every = df.select(*by).distinct().join(found, by, "left")  # runs with none of the plan's items miss all steps
    return every.select(*by, F.posexplode(F.coalesce("met", F.array_repeat(F.lit(False), n))).alias("pos", "ok"))


def strict_match(df: DataFrame, by: list[str], order: list[str], item: str, plan: Sequence[str]) -> DataFrame:
    """By, step (from 1), ok: whether the n-th of a run's items of the plan is the plan's n-th. As many rows of a run as the plan has
    steps take part."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    first = df.where(F.col(item).isin(*plan)).select(*by, item, at.alias("step")).where(F.col("step") <= len(plan))
    wanted = F.array(*map(F.lit, plan))
    met = first.groupBy(*by).agg(F.collect_set(F.when(F.get(wanted, F.col("step") - 1) == F.col(item), F.col("step"))).alias("_met"))
    every = df.select(*by).distinct().join(met, by, "left")
    return every.select(*by, F.explode(F.sequence(F.lit(1), F.lit(len(plan)))).alias("step"), "_met").select(*by, F.col("step").cast("bigint").alias("step"), F.coalesce(F.array_contains("_met", F.col("step")), F.lit(False)).alias("ok"))


def tail(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def span_pairs(df: DataFrame, by: list[str], order: list[str], is_start, is_end, t: str = "t") -> DataFrame:
    """An end pairs with the latest start since the last end; others fall away. by, start, end."""
    rows = df.withColumn("_s", is_start).withColumn("_e", is_end).where("_s or _e")
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_open", F.lag("_s").over(w)).withColumn("start", F.lag(t).over(w)).where("_e and _open").select(*by, "start", F.col(t).alias("end"))


def fifo_pairs(df: DataFrame, by: list[str], order: list[str], is_start, is_end, t: str = "t") -> DataFrame:
    """Starts and ends of a key pair first in, first out; an end with no open start falls away.

    The queue needs no fold: an end is taken iff, running over the rows, it does not push the balance below its
    running minimum; the n-th taken end then meets the n-th start."""
    w = Window.partitionBy(*by).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_s", is_start).withColumn("_e", is_end).where("_s or _e").withColumn("_d", F.when(F.col("_s"), 1).otherwise(-1))
    rows = rows.withColumn("_balance", F.sum("_d").over(run)).withColumn("_low", F.least(F.lit(0), F.min("_balance").over(w.rowsBetween(Window.unboundedPreceding, -1))))
    rows = rows.withColumn("_low", F.coalesce("_low", F.lit(0))).where(F.col("_s") | (F.col("_balance") >= F.col("_low")))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_s").orderBy(*order)))
    pair = rows.groupBy(*by, "_n").agg(F.max(F.when(F.col("_s"), F.col(t))).alias("start"), F.max(F.when(F.col("_e"), F.col(t))).alias("end"))
    return pair.where("start is not null and end is not null").select(*by, "start", "end")


def lifo_spans(df: DataFrame, by: list[str], order: list[str], is_start, is_end, duration, t: str = "t") -> DataFrame:
    """Spans [end - duration, end] of the ends that find an open start."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("_s", is_start).withColumn("_e", is_end).where("_s or _e").withColumn("_d", F.when(F.col("_s"), 1).otherwise(-1))
    balance = F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_balance", balance)
    low = F.coalesce(F.least(F.lit(0), F.min("_balance").over(w.rowsBetween(Window.unboundedPreceding, -1))), F.lit(0))
    return rows.withColumn("_low", low).where(F.col("_e") & (F.col("_balance") >= F.col("_low"))).select(*by, (F.col(t) - duration).alias("start"), F.col(t).alias("end"))


def ordered_items(df: DataFrame, by: list[str], order: list[str], item: str) -> DataFrame:
    """By, items (array in order). Runs are bounded; use only where a run's items fit a row."""
    return df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("_item")))), lambda x: x["_item"]).alias("items"))


def next_by_reference(df: DataFrame, by: list[str], order: list[str], item: str, reference) -> DataFrame:
    """Each run's item against what the reference run did at the same step: by, step, predicted, actual."""
    step = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    rows = df.select(*by, F.col(item).alias("actual"), step.alias("step"))
    keys = reduce(lambda a, b: a & b, [F.col(c) == reference[c] for c in by])
    told = rows.where(keys).select("step", F.col("actual").alias("predicted"))
    return rows.where(~keys).join(told, "step", "left").select(*by, "step", "predicted", "actual")
