"""The rows of a trial: every fetch that was made, skipped or missed, with its window, exposure and stall class (U1 with P10, P13-P15,
J14-J17, J20, J21)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import analyze, asof
from .sets import stacked

#: Types of resources that a gate holds up, and seconds by which a gate may end before its task starts.
GATED, EARLY = ("vllm_model", "model_cache"), 1.0
#: Configurations that fetch nothing ahead.
NO_PREFETCH = ("baseline", "observe_only")
#: Columns of a row, in order, after the trace's.
COLUMNS = ["resource", "name", "type", "consumer", "confidence", "bytes", "byte_source", "t_predicted", "t_decision", "action", "reason", "t_started", "t_completed", "t_cancelled", "t_needed", "need_source", "t_consumed", "transfer_s", "window_s", "lead_s", "lateness_s", "exposure_s", "start_delay_s", "outcome", "gate_group", "simulated", "estimate", "stall_class"]


def _real(t: Column) -> Column:
    """A time of 0 is none."""
    return F.when(F.coalesce(t, F.lit(0.0)) != 0, t)


def gates(e: DataFrame, by: Sequence[str]) -> DataFrame:
    """A row for each wait for a model: name, t_exit, wait_s, kind, gate_group, direct (fetched ahead by the adapter itself)."""
    w = e.where(F.col("kind").isin("worker_swap_wait", "aggregator_swap_wait"))
    swap, yes = F.col("kind") == "worker_swap_wait", lambda c: F.coalesce(c, F.lit(False))
    kind = F.when(swap, "swap_wait").otherwise("agg_wait")
    n = F.row_number().over(Window.partitionBy(*by, "kind").orderBy("line_no")) - 1
    name = F.coalesce("p.model", F.lit(""))
    scheduled = yes(F.when(swap, F.col("p.prefetch_scheduled")).otherwise(F.col("p.prefetch_started")))
    demand = yes(F.when(swap, F.col("p.on_demand_swap")).otherwise(F.col("p.on_demand_start")))
    return w.select(*by, name.alias("name"), F.col("t").alias("t_exit"), F.coalesce("p.wait_s", F.lit(0.0)).alias("wait_s"), kind.alias("gate"), F.concat_ws(":", kind, name, n.cast("string")).alias("gate_group"), (scheduled & ~demand).alias("direct"), F.struct((~swap).alias("agg"), n.alias("n")).alias("seq"))


def _needed(rows: DataFrame, called: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` with need: the first call of ``consumer`` at or after ``after`` (any, where that is null)."""
    asked = rows.withColumn("tool", F.coalesce("consumer", F.lit(""))).withColumn("_after", F.coalesce("after", F.lit(float("-inf"))))
    got = asof.forward(asked, called, [*by, "tool"], "_after", "t", [])
    return got.withColumn("need", F.when(F.col("tool") != "", F.col("matched_t"))).drop("matched_t", "tool", "_after")


def trial_rows(events: DataFrame, by: Sequence[str] = ("run_id",), mode: str = "real", config: str = "", consumers: DataFrame | None = None) -> DataFrame:
    """One row for each task, each resource whose first decision was to skip it and that has no task, each gate that matches no task,
    each calculator load from disk and each consumption of what was not fetched.

    Times count from the trace's first. A gate of the task's model that ends after its start (else the last one) says when the resource was
    needed, then its consumption, then the first call of its consumer after the prediction. Resources are joined by shuffles
    on trace and name, tool or resource; no pairs of a trace's events are formed."""
    by, e = list(by), analyze.typed(events, by)
    of = lambda *kinds: F.col("kind").isin(*kinds)
    own = analyze.tasks(events, by, consumers, e)
    preds = analyze.predictions(e, by).join(e.select(*by, "line_no", "t"), [*by, "line_no"])
    first = preds.groupBy(*by, "resource").agg(F.min_by(F.struct(F.col("t").alias("t"), "r"), F.struct("t", "line_no", "place")).alias("pred"))
    decided = e.where(of("prefetch_decision") & (F.coalesce("p.resource_id", F.lit("")) != "")).groupBy(*by, F.col("p.resource_id").alias("resource")).agg(F.min_by(F.struct("t", F.coalesce("p.action", F.lit("")).alias("action"), F.coalesce("p.reason", F.lit("")).alias("reason"), F.col("p.estimated_load_s").alias("est")), F.struct("t", "line_no")).alias("dec"))
    called = e.where(of("tool_call")).select(*by, F.coalesce("p.tool", F.lit("")).alias("tool"), "t")
    gate = gates(e, by)
    starts = own.groupBy(*by).agg(F.min(_real(F.col("started_t"))).alias("s"))
    zero = e.where(of("tool_call", "worker_swap_wait", "aggregator_swap_wait", "mace_load") | (of("prediction_result") & (F.size("p.resources") > 0))).groupBy(*by).agg(F.min(_real(F.col("t"))).alias("z"))
    zero = zero.join(starts, by, "full").select(*by, F.coalesce(F.least("z", "s"), F.lit(0.0)).alias("t0"))

    pred, dec, no = lambda f: F.col(f"pred.r.{f}"), lambda f: F.col(f"dec.{f}"), lambda kind: F.lit(None).cast(kind)
    known = own.join(first, [*by, "resource"], "left").join(decided, [*by, "resource"], "left")
    known = known.withColumns({"consumer": F.coalesce(pred("consumer_tool"), F.lit("")), "after": F.col("pred.t")})
    gated = known.where(F.col("type").isin(*GATED)).withColumn("_anchor", F.coalesce(F.col("started_t") - EARLY, F.lit(float("inf"))))
    met = asof.forward(gated, gate, [*by, "name"], "_anchor", "t_exit", ["wait_s", "gate", "gate_group", "seq"], tie="seq", else_last=True)
    met = met.withColumn("gate_t", F.col("matched_t") - F.col("wait_s")).drop("_anchor", "matched_t", "seq")
    rest = known.where(~F.col("type").isin(*GATED))
    for c, kind in (("wait_s", "double"), ("gate", "string"), ("gate_group", "string"), ("gate_t", "double")):
        rest = rest.withColumn(c, no(kind))
    rows = _needed(met.unionByName(rest), called, by)
    at_gate, used = F.col("gate_group").isNotNull(), F.col("consumed_t").isNotNull()
    need = F.when(at_gate, F.col("gate_t")).when(used, F.col("consumed_t")).otherwise(F.col("need"))
    late = F.when(F.col("completed_t").isNotNull(), F.greatest(F.lit(0.0), F.col("completed_t") - need))
    made = rows.select(
        *by, "resource", "name", "type", "consumer", pred("confidence").alias("confidence"), F.when(F.col("bytes") != 0, F.col("bytes")).alias("bytes"), "byte_source",
        F.coalesce(_real(F.col("pred.t")), F.col("started_t")).alias("t_predicted"), dec("t").alias("t_decision"), F.coalesce(dec("action"), F.lit("")).alias("action"), F.coalesce(dec("reason"), F.lit("")).alias("reason"),
        F.col("started_t").alias("t_started"), F.col("completed_t").alias("t_completed"), F.col("cancelled_t").alias("t_cancelled"), need.alias("t_needed"),
        F.when(at_gate, F.col("gate")).when(used, "consumed").when(F.col("need").isNotNull(), "consumer_tool_call").otherwise("none").alias("need_source"), F.col("consumed_t").alias("t_consumed"), F.col("elapsed_s").alias("transfer_s"),
        F.when(at_gate, F.col("wait_s")).when(used | F.col("need").isNotNull(), late).otherwise(F.lit(0.0)).alias("exposure_s"), "outcome", F.coalesce("gate_group", F.lit("")).alias("gate_group"),
        scalars.simulated(F.lit(mode), F.col("elapsed_s"), F.col("bytes")).alias("simulated"), "estimate",
    )
    skips = decided.where("dec.action = 'skip'").join(own.select(*by, "resource").distinct(), [*by, "resource"], "left_anti").join(first, [*by, "resource"], "left")
    skips = _needed(skips.withColumns({"consumer": F.coalesce(pred("consumer_tool"), F.lit("")), "after": F.col("pred.t")}), called, by)
    load = scalars.falsy_coalesce(pred("estimated_load_s"), dec("est"))
    size = F.when(F.coalesce(pred("estimated_size_bytes"), F.lit(0.0)) != 0, pred("estimated_size_bytes"))
    named = F.when(F.col("pred").isNull(), F.substring("resource", 1, 12)).otherwise(F.coalesce(pred("name"), F.lit("")))
    of_pred = [named.alias("name"), F.coalesce(pred("resource_type"), F.lit("")).alias("type")]
    sized = [size.alias("bytes"), F.when(size.isNotNull(), "estimated").otherwise("unknown").alias("byte_source")]
    skipped = skips.select(*by, "resource", *of_pred, "consumer", pred("confidence").alias("confidence"), *sized, F.col("pred.t").alias("t_predicted"), dec("t").alias("t_decision"), F.lit("skip").alias("action"), dec("reason").alias("reason"), F.col("need").alias("t_needed"), F.when(F.col("need").isNotNull(), "consumer_tool_call").otherwise("none").alias("need_source"), F.when(F.col("need").isNotNull(), load).otherwise(F.lit(0.0)).alias("exposure_s"), F.lit("skipped").alias("outcome"), load.alias("estimate"))
    none = F.lit("no_prefetch_config" if config in NO_PREFETCH else "no_prediction")
    lone = gate.join(made.select(*by, "gate_group").distinct(), [*by, "gate_group"], "left_anti").withColumn("need", F.col("t_exit") - F.col("wait_s"))
    stamps = e.where(of("aggregator_prefetch_start") & (F.coalesce("t", F.lit(0.0)) != 0)).select(*by, F.col("t").alias("stamp"))
    lone = asof.backward(lone, stamps, by, "need", "stamp", [])
    lone = lone.select(*by, "name", F.lit("vllm_model").alias("type"), F.when(F.col("direct") & (F.col("gate") == "agg_wait"), F.col("matched_t")).alias("t_started"), F.col("need").alias("t_needed"), F.col("gate").alias("need_source"), F.col("wait_s").alias("exposure_s"), "gate_group", F.when(F.col("direct"), "direct_prefetch").otherwise(none).alias("outcome"))
    disk = e.where(of("mace_load") & (F.col("p.source") == "disk")).select(*by, F.coalesce("p.model", F.lit("mace")).alias("name"), F.lit("mace_model").alias("type"), F.col("t").alias("t_needed"), F.lit("mace_load").alias("need_source"), F.col("p.duration_s").alias("exposure_s"), none.alias("outcome"))
    fetched = own.where("consumed_t is not null").select(*by, "resource").distinct()
    bare = e.where(of("resource_consumed") & (F.col("p.status") == "no_prefetch")).select(*by, F.coalesce("p.resource_id", F.lit("")).alias("resource"), "t").join(fetched, [*by, "resource"], "left_anti").join(first, [*by, "resource"], "left")
    bare = bare.select(*by, "resource", *of_pred, *sized, F.col("t").alias("t_needed"), F.lit("consumed").alias("need_source"), pred("estimated_load_s").alias("exposure_s"), none.alias("outcome"))

    out = stacked(made, skipped, lone, disk, bare).withColumns({"byte_source": F.coalesce("byte_source", F.lit("unknown")), "simulated": F.coalesce("simulated", F.lit(mode == "simulated")), **{c: F.coalesce(c, F.lit("")) for c in ("resource", "consumer", "action", "reason", "gate_group")}})
    real_need, done, predicted = _real(F.col("t_needed")), F.col("t_completed"), _real(F.col("t_predicted"))
    out = out.withColumns({"window_s": real_need - predicted, "lead_s": real_need - done, "lateness_s": F.greatest(F.lit(0.0), done - real_need), "start_delay_s": F.when(F.col("outcome").isin("direct_prefetch", "no_prediction", "no_prefetch_config"), None).otherwise(_real(F.col("t_started")) - predicted)})
    out = out.withColumn("lateness_s", F.when(real_need.isNotNull() & done.isNotNull(), F.col("lateness_s")))
    # a gate whose cached file was there in time held up the engine alone
    in_time = out.where("type = 'model_cache' and gate_group <> '' and t_completed <= t_needed + 0.5").select(*by, "gate_group", F.lit(True).alias("_in_time")).distinct()
    load = scalars.falsy_coalesce(F.col("transfer_s"), F.coalesce("estimate", F.lit(0.0)))
    cls = scalars.stall_class(F.col("exposure_s"), F.col("outcome"), F.col("reason"), F.coalesce(F.col("type") == "vllm_model", F.lit(False)), F.col("_in_time"), F.col("window_s"), load, F.col("start_delay_s"))
    out = out.join(in_time, [*by, "gate_group"], "left").withColumn("stall_class", cls).join(zero, by, "left")
    times = {c: _real(F.col(c)) - F.col("t0") for c in COLUMNS if c.startswith("t_")}
    return out.withColumns(times).select(*by, *COLUMNS)
