"""Predictors over traces behind one contract, so that they can be exchanged and judged alike.

A predictor is a function of ``Calls`` (what a run did) and ``Knowledge`` (what it may use) and returns the rows of ``CONTRACT``: one for each
predicted resource of a call, none where it has nothing to say. ``PREDICTORS`` names the variants; ``judge`` holds any of them against what the
runs did next. Calls (run_id, step, tool) have one row a run and step, as ``steps_of`` makes them. What hangs on the tool alone is worked out in
the small tables, what hangs on the run's plan meets calls by run_id alone. So calls that are partitioned by run_id never move again, and
neither do predictions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics
from .predict import maybe_broadcast, nearest_targets, rule_predict

#: run_id, step: the call that is predicted from; resource_id (one row each for a call and expected step); consumer_tool: who is expected to use it;
#: expected_at_step; confidence; predictor_id.
CONTRACT = ["run_id", "step", "resource_id", "consumer_tool", "expected_at_step", "confidence", "predictor_id"]


@dataclass
class Knowledge:
    """registry: consumer_tool, resource_id, off, confidence. table: source, off, target, prob, rank (a learned transition table).
    plans: run_id, place (from 0), tool. reference: step, tool (``reference_steps`` of a trace)."""

    registry: DataFrame
    table: DataFrame | None = None
    plans: DataFrame | None = None
    reference: DataFrame | None = None


def steps_of(events: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """by, step, tool of the tool calls (by, line_no, step, tool): the explicit step, else (missing or 0) the call's number among those
    of its run; the last call of a step counts. Calls without a tool take no number."""
    real = events.where(F.coalesce("tool", F.lit("")) != "")
    number = F.row_number().over(Window.partitionBy(*by).orderBy("line_no"))
    step = F.when(F.coalesce("step", F.lit(0)) != 0, F.col("step")).otherwise(number).cast("bigint")
    return real.withColumn("step", step).groupBy(*by, "step").agg(F.max_by("tool", "line_no").alias("tool"))


def reference_steps(events: DataFrame) -> DataFrame:
    """Step, tool of a single reference trace (its tool calls)."""
    return steps_of(events.withColumn("_one", F.lit(1)), ["_one"]).drop("_one")


def contract(rows: DataFrame, predictor_id: str, consumer: str, offset: Column, confidence: Column) -> DataFrame:
    """``rows`` (run_id, step, resource_id, ...; one a call, resource and offset, see ``strongest``) in the contract's columns."""
    return rows.select("run_id", "step", "resource_id", F.col(consumer).alias("consumer_tool"), (F.col("step") + offset).cast("bigint").alias("expected_at_step"), confidence.cast("double").alias("confidence"), F.lit(predictor_id).alias("predictor_id"))


def strongest(rows: DataFrame, keys: Sequence[str], consumer: str, confidence: str) -> DataFrame:
    """A small table's row of each key with the greatest confidence (ties: the greater consumer): a resource is predicted once for a call and step."""
    pick = F.struct(F.col(confidence).cast("double").alias(confidence), consumer)
    return rows.groupBy(*keys).agg(F.max_by(pick, pick).alias("_b")).select(*keys, "_b.*")


def rules(calls: DataFrame, known: Knowledge) -> DataFrame:
    """The registry's resources for what usually follows the call's tool (registry: tool is the call's, as in ``rule_predict``)."""
    told = strongest(known.registry.where("tool is not null"), ["tool", "resource_id", "off"], "consumer_tool", "confidence")
    return contract(rule_predict(calls, told), "rules", "consumer_tool", F.col("off"), F.col("confidence"))


def _targets(known: Knowledge, top: int, least: float) -> DataFrame:
    resources = known.registry.select(F.col("consumer_tool").alias("tool"), "resource_id").distinct()
    return strongest(nearest_targets(known.table, resources, top=top, least=least), ["tool", "resource_id", "off"], "next_tool", "prob")


def by_table(calls: DataFrame, known: Knowledge, top: int = 3, least: float = 0.3) -> DataFrame:
    """The resources of the likely targets at the nearest offset that has any."""
    return contract(calls.join(maybe_broadcast(_targets(known, top, least)), "tool"), "table", "next_tool", F.col("off"), F.col("prob"))


def planned(calls: DataFrame, known: Knowledge) -> DataFrame:
    """``calls`` with _ahead: array of (off, tool) of what the run's plan has one and two steps on from the first place of the call's tool (from
    its start if the tool is not in the plan) and the registry has a resource for; empty where the plan says nothing.

    A plan is worked out to a row a run: a map of its distinct tools, however long it is."""
    useful = maybe_broadcast(known.registry.select(F.col("consumer_tool").alias("tool")).distinct().withColumn("_has", F.lit(True)))
    plans = known.plans.select("run_id", "place", "tool").join(useful, "tool", "left")
    w = Window.partitionBy("run_id").orderBy("place")
    item = F.struct((F.col("place")).alias("place"), "tool", "_has")
    off = F.col("place")
    near = F.filter(F.array(F.lead(item, 1).over(w), F.lead(item, 2).over(w)), lambda x: F.coalesce(x["_has"] & (x["place"] - off <= 2), F.lit(False)))
    steps = plans.withColumn("_next", near)
    steps = steps.withColumn("_next", F.transform("_next", lambda x: F.struct((x["place"] - off).cast("int").alias("off"), x["tool"].alias("tool"))))
    start = F.when((off < 2) & F.col("_has"), F.struct((off + 1).cast("int").alias("off"), "tool"))
    by_tool = steps.groupBy("run_id", "tool").agg(F.min_by("_next", "place").alias("_next"), F.collect_list(start).alias("_start"))
    of_run = by_tool.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("tool").isNotNull(), F.struct("tool", "_next")))).alias("_of"), F.flatten(F.collect_list("_start")).alias("_start"))
    out = calls.join(of_run, "run_id", "left")
    ahead = F.coalesce(F.try_element_at("_of", F.col("tool")), F.col("_start"), F.array().cast("array<struct<off:int,tool:string>>"))
    return out.select("run_id", "step", "tool", ahead.alias("_ahead"))


def _of_plan(told: DataFrame, known: Knowledge, name: str, least: float = 0.8) -> DataFrame:
    rows = told.select("run_id", "step", "tool", F.explode("_ahead").alias("a")).select("run_id", "step", "tool", "a.off", F.col("a.tool").alias("consumer_tool"))
    rows = rows.join(maybe_broadcast(known.registry.select("consumer_tool", "resource_id").distinct()), "consumer_tool")
    likely = known.table.groupBy(F.col("source").alias("tool"), "off", F.col("target").alias("consumer_tool")).agg(F.max("prob").alias("prob"))
    rows = rows.join(maybe_broadcast(likely), ["tool", "off", "consumer_tool"], "left")
    return contract(rows, name, "consumer_tool", F.col("off"), F.greatest(F.coalesce("prob", F.lit(least)), F.lit(least)))


def by_plan(calls: DataFrame, known: Knowledge, least: float = 0.8) -> DataFrame:
    """What the run's own plan has next (see ``planned``), with the learned confidence or ``least`` if that is more."""
    return _of_plan(planned(calls, known), known, "plan", least)


def learned(calls: DataFrame, known: Knowledge) -> DataFrame:
    """The first of plan, table and rules that says anything about a call. Each is asked only about the calls on which those before it
    are silent, which the call itself shows, so that no rows of different signals have to meet."""
    told, targets = planned(calls, known), _targets(known, 3, 0.3)
    silent = told.where(F.size("_ahead") == 0).drop("_ahead")
    rest = silent.join(maybe_broadcast(targets.select("tool").distinct()), "tool", "left_anti")
    rows = _of_plan(told, known, "learned").unionByName(by_table(silent, known)).unionByName(rules(rest, known))
    return rows.withColumn("predictor_id", F.lit("learned")).select(*CONTRACT)


def oracle(calls: DataFrame, known: Knowledge) -> DataFrame:
    """What the reference trace did one step on, with confidence 1: the resources of that tool, each once, with the offset
    pinned to 1. Silent where the reference has no such step or its tool has no resource."""
    told = known.reference.select((F.col("step") - 1).alias("step"), F.col("tool").alias("consumer_tool"))
    resources = known.registry.select("consumer_tool", "resource_id").distinct()
    ahead = told.join(maybe_broadcast(resources), "consumer_tool").groupBy("step", "resource_id").agg(F.max("consumer_tool").alias("consumer_tool"))
    return contract(calls.join(maybe_broadcast(ahead), "step"), "oracle", "consumer_tool", F.lit(1), F.lit(1.0))


#: The variants by name.
PREDICTORS: dict[str, Callable[[DataFrame, Knowledge], DataFrame]] = {"rules": rules, "table": by_table, "plan": by_plan, "learned": learned, "oracle": oracle}


def predict(name: str, calls: DataFrame, known: Knowledge) -> DataFrame:
    """The rows of a predictor (see ``CONTRACT``) for calls (run_id, step, tool)."""
    out = PREDICTORS[name](calls, known)
    if out.columns != CONTRACT:
        raise ValueError(f"{name} returns {out.columns}")
    return out


def judge(predictions: DataFrame, calls: DataFrame) -> DataFrame:
    """predictor_id, made, hits, precision, calls_covered: a prediction is a hit if the expected step's tool is its consumer or starts with it
    by name; a call is covered if anything was predicted from it."""
    keys = ["predictor_id", "run_id", "step", "expected_at_step", "consumer_tool"]
    made = predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))  # resources of one consumer are judged alike
    none = lambda c: F.lit(None).cast(made.schema[c].dataType).alias(c)
    did = calls.select(none("predictor_id"), "run_id", none("step"), F.col("step").cast("bigint").alias("expected_at_step"), none("consumer_tool"), none("n"), F.col("tool").alias("actual"))
    both = made.withColumn("actual", F.lit(None).cast("string")).unionByName(did)
    met = both.withColumn("actual", F.max("actual").over(Window.partitionBy("run_id", "expected_at_step"))).where("n is not null")
    hit = F.coalesce(F.col("actual").startswith(F.col("consumer_tool")) & F.col("run_id").isNotNull() & F.col("expected_at_step").isNotNull(), F.lit(False))
    out = met.groupBy("predictor_id").agg(F.sum("n").alias("made"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).cast("bigint").alias("hits"), F.countDistinct("run_id", "step").alias("calls_covered"))
    return out.withColumn("precision", metrics.ratio(F.col("hits"), F.col("made")))
