"""From the events of traces to their summaries: what was predicted, fetched, used and waited for.

Events: the rows of ``traces.load_events``. A trace is what shares ``by`` (a run, or a file); its order is ``line_no``. Every
function shuffles events by trace and task or resource, so no task holds a whole trace but for windows over
its few waits and tools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bytes_with_source, falsy_coalesce, task_outcome
from ..sources.scratch import kept
from . import intervals, metrics

_RESOURCE = "struct<resource_id:string,resource_type:string,name:string,estimated_load_s:double,estimated_size_bytes:double,confidence:double,cancellation_safe:boolean,consumer_tool:string>"
#: Payload fields that the summaries read.
FIELDS = f"task_id string, resource_id string, checkpoint_id string, hit boolean, wasted boolean, status string, elapsed_s double, estimated_load_s double, bytes_staged double, action string, tool string, model string, node string, run_id string, duration_s double, duration_steps bigint, wait_s double, source string, reason string, prefetch_scheduled boolean, prefetch_started boolean, on_demand_swap boolean, on_demand_start boolean, resources array<{_RESOURCE}>"
#: Seconds of grace before a used task counts as late, and seconds between a tool and the stamps it makes.
LATE, STAMP = 0.5, 0.25
#: Chains whose time is reasoning, when none are named.
AGENTS = ("PlannerAgent", "WorkerAgent", "AggregatorAgent")


def parsed(events: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """by, line_no, step, t, kind, p (the payload's fields; those of another type are null)."""
    return events.select(*by, "line_no", "step", "t", F.col("event_type").alias("kind"), F.from_json("payload", FIELDS).alias("p"))


def typed(events: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """``parsed`` events written once: lines are numbered and payloads parsed a single time, and what follows reads the columns it needs."""
    return kept(parsed(events, by), "events")


def _last(value: Column | str, when: Column) -> Column:
    return F.max_by(value, F.when(when, F.col("line_no")))


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def resource_clock(e: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per trace and resource: estimate (the last decision's), started_t, completed_t, actual, consumed_t, status.

    A completion counts for the resource whose last start before it names its task; a restart keeps the older
    completion. A task starts for one resource."""
    rid = F.coalesce("p.resource_id", F.lit(""))
    own = e.where(F.col("kind").isin("prefetch_started", "prefetch_decision", "resource_consumed")).withColumn("resource", rid)
    until = F.lead("line_no").over(Window.partitionBy(*by, "resource").orderBy("line_no"))
    starts = own.where(_is("prefetch_started")).select(*by, "resource", F.col("p.task_id").alias("task"), F.col("line_no").alias("_from"), until.alias("_until"))
    ends = e.where(_is("prefetch_completed")).select(*by, F.col("p.task_id").alias("task"), "line_no", "t", F.col("p.elapsed_s").alias("elapsed"))
    met = ends.join(starts, [*by, "task"]).where("line_no > _from and (_until is null or line_no < _until)")
    done = met.groupBy(*by, "resource").agg(F.max_by("t", "line_no").alias("completed_t"), F.max_by("elapsed", "line_no").alias("actual"))
    decided = _is("prefetch_decision") & (F.col("resource") != "") & F.col("p.estimated_load_s").isNotNull()
    rest = own.groupBy(*by, "resource").agg(
        _last("p.estimated_load_s", decided).alias("estimate"),
        _last("t", _is("prefetch_started")).alias("started_t"),
        _last("t", _is("resource_consumed")).alias("consumed_t"),
        _last(F.coalesce("p.status", F.lit("")), _is("resource_consumed")).alias("status"),
    )
    # decisions alone make no record
    return rest.where("started_t is not null or consumed_t is not null").join(done, [*by, "resource"], "left")


def resource_seconds() -> dict[str, Column]:
    """A3 on a row of ``resource_clock``: stall, overlap, benefit, waste."""
    c = F.col
    est = falsy_coalesce(c("estimate"), c("actual"), F.coalesce("estimate", F.lit(0.0)))
    cold = (F.coalesce("status", F.lit("")) == "no_prefetch") | c("started_t").isNull()
    met = ~cold & c("consumed_t").isNotNull() & c("completed_t").isNotNull()
    stall = F.greatest(F.lit(0.0), c("completed_t") - c("consumed_t"))
    unused = ~cold & c("consumed_t").isNull() & c("completed_t").isNotNull()
    of = lambda cond, x: F.when(cond, x).otherwise(F.lit(0.0))
    return {
        "stall_s": F.when(cold, est).when(met, stall).otherwise(F.lit(0.0)),
        "overlap_s": of(met, F.greatest(F.lit(0.0), F.least("completed_t", "consumed_t") - c("started_t"))),
        "benefit_s": of(met, F.greatest(F.lit(0.0), est - stall)),
        "waste_s": of(unused, falsy_coalesce(c("actual"), c("completed_t") - c("started_t"))),
    }


def analyze(events: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """A1-A3: one row a trace. Rates are null without a denominator; a divergence counts as a miss. A trace without
    resources has totals of 0; an empty table gives no rows."""
    by, e = list(by), typed(events, by)
    n = lambda kind, cond=None: F.count_if(_is(kind) if cond is None else _is(kind) & F.coalesce(cond, F.lit(False)))
    counts = e.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_events"), n("prediction_result").alias("prediction_count"), n("prediction_validated", F.col("p.hit")).alias("hit_count"),
        (n("prediction_validated") - n("prediction_validated", F.col("p.hit")) + n("divergence_detected")).alias("miss_count"),
        n("prefetch_started").alias("prefetch_started"), n("prefetch_completed").alias("prefetch_completed"), n("prefetch_cancelled").alias("prefetch_cancelled"),
        n("prefetch_cancelled", F.col("p.wasted")).alias("wasted_prefetch"), n("divergence_detected").alias("divergence_count"),
    )
    hits, misses, made = map(F.col, ("hit_count", "miss_count", "prediction_count"))
    counts = counts.select("*", (made - hits - misses).alias("unvalidated_count"), *metrics.prediction_quality(hits, misses, made)).withColumnRenamed("honest", "honest_accuracy")
    seconds = resource_seconds()
    totals = resource_clock(e, by).groupBy(*by).agg(*[F.sum(x).alias(f"total_{c}") for c, x in seconds.items()])
    return counts.join(totals, by, "left").fillna(0.0, [f"total_{c}" for c in seconds])


def steps(events: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """The last of each kind at each step: checkpoint of the prediction, hit, divergence, tool, model."""
    e = parsed(events, list(by)).where(F.col("kind").isin("prediction_result", "prediction_validated", "divergence_detected", "tool_call", "llm_call"))
    return e.groupBy(*by, "step").agg(
        _last("p.checkpoint_id", _is("prediction_result")).alias("predicted"), _last("p.hit", _is("prediction_validated")).alias("hit"),
        (F.count_if(_is("divergence_detected")) > 0).alias("diverged"), _last("p.tool", _is("tool_call")).alias("tool"), _last("p.model", _is("llm_call")).alias("model"),
    )


# --- per task: outcomes, questions 2 to 4 ---------------------------------------------------------------------------


def predictions(e: DataFrame, by: Sequence[str]) -> DataFrame:
    """A row for each predicted resource, with its place in the trace."""
    rows = e.where(_is("prediction_result")).select(*by, "line_no", "step", F.posexplode("p.resources").alias("place", "r"))
    return rows.withColumn("resource", F.coalesce("r.resource_id", F.lit("")))


def _false_stamps(e: DataFrame, by: Sequence[str], consumers: DataFrame) -> DataFrame:
    """by, line_no of the consumptions stamped by a tool that does not consume the resource (J13): the last tool call came less
    than ``STAMP`` seconds away, and the resource's name so far has consumers, but not that one.

    consumers: name, tool."""
    tool = F.when(_is("tool_call"), F.struct(F.coalesce("p.tool", F.lit("")).alias("tool"), "t"))
    run = Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    stamps = e.where(F.col("kind").isin("tool_call", "resource_consumed")).withColumn("_tool", F.last(tool, ignorenulls=True).over(run)).where(_is("resource_consumed"))
    stamps = stamps.select(*by, "line_no", F.coalesce("p.resource_id", F.lit("")).alias("resource"), F.col("_tool.tool").alias("tool"), F.abs(F.col("t") - F.col("_tool.t")).alias("away"), F.lit(None).cast("string").alias("name"), F.lit(1).alias("place"))
    names = predictions(e, by).select(*by, "line_no", "resource", F.lit(None).cast("string").alias("tool"), F.lit(None).cast("double").alias("away"), F.coalesce("r.name", F.lit("")).alias("name"), F.lit(0).alias("place"))
    so_far = Window.partitionBy(*by, "resource").orderBy("line_no", "place").rowsBetween(Window.unboundedPreceding, 0)
    near = stamps.unionByName(names).withColumn("name", F.last("name", ignorenulls=True).over(so_far)).where(F.col("tool").isNotNull() & (F.col("away") < STAMP))
    known = near.join(consumers.select("name").distinct(), "name", "left_semi")
    return known.join(consumers.select("name", "tool"), ["name", "tool"], "left_anti").select(*by, "line_no")


def tasks(events: DataFrame, by: Sequence[str] = ("run_id",), consumers: DataFrame | None = None, e: DataFrame | None = None) -> DataFrame:
    """One row a task: times, flags, resource, what its last prediction says of it, bytes and outcome.

    A start begins a task anew; a completion or cancellation without one makes a stub; a consumption counts once the task is
    there. A completion is at start + elapsed where both are known, else at its own time. e: the ``typed`` events, if at hand."""
    by, e = list(by), typed(events, by) if e is None else e
    kinds = ("prefetch_started", "prefetch_completed", "prefetch_cancelled", "resource_consumed")
    own = e.where(F.col("kind").isin(*kinds) & (~_is("resource_consumed") | (F.coalesce("p.task_id", F.lit("")) != ""))).withColumn("task", F.coalesce("p.task_id", F.lit("")))
    if consumers is not None:
        own = own.join(_false_stamps(e, by, consumers), [*by, "line_no"], "left_anti")
    w = Window.partitionBy(*by, "task")
    begun = F.coalesce(F.max(F.when(_is("prefetch_started"), F.col("line_no"))).over(w), F.min(F.when(~_is("resource_consumed"), F.col("line_no"))).over(w))
    live = own.withColumn("_from", begun).where("line_no >= _from")
    end, used, gone, start = _is("prefetch_completed"), _is("resource_consumed"), _is("prefetch_cancelled"), _is("prefetch_started")
    rows = live.groupBy(*by, "task").agg(
        _last("t", start).alias("started_t"), _last(F.coalesce("p.resource_id", F.lit("")), start).alias("resource"), F.min("line_no").alias("first"),
        _last(F.coalesce("p.elapsed_s", F.lit(0.0)), end).alias("elapsed_s"), _last("t", end).alias("_end"), _last("p.bytes_staged", end & F.col("p.bytes_staged").isNotNull()).alias("measured"),
        _last("t", gone).alias("cancelled_t"), _last(F.coalesce("p.wasted", F.lit(False)), gone).alias("wasted"),
        _last("t", used).alias("consumed_t"), _last("step", used).alias("consumed_step"), _last(F.coalesce("p.status", F.lit("")), used).alias("status"),
    )
    timed = (F.coalesce("started_t", F.lit(0.0)) != 0) & (F.col("elapsed_s") > 0)
    rows = rows.withColumn("completed_t", F.when(F.col("_end").isNotNull(), F.when(timed, F.col("started_t") + F.col("elapsed_s")).otherwise(F.col("_end")))).drop("_end")
    rows = rows.withColumn("resource", F.coalesce("resource", F.lit("")))
    meta = predictions(e, by).groupBy(*by, "resource").agg(F.max_by("r", F.struct("line_no", "place")).alias("m"))
    rows = rows.join(meta, [*by, "resource"], "left")
    is_used = F.coalesce(F.col("status") == "used", F.lit(False))
    served = rows.where(is_used).select(*by, "resource", F.lit(True).alias("served")).distinct()
    rows = rows.join(served, [*by, "resource"], "left")
    outcome = task_outcome(is_used, F.col("wasted"), F.col("cancelled_t").isNotNull(), F.col("completed_t"), F.col("consumed_t"), F.col("served"), LATE)
    staged = bytes_with_source(F.col("measured"), F.col("m.estimated_size_bytes"))
    return rows.select(*by, "task", "resource", "first", F.coalesce("m.name", F.when(F.col("m").isNull(), F.substring("resource", 1, 12)), F.lit("")).alias("name"), F.coalesce("m.resource_type", F.lit("")).alias("type"), F.col("m.estimated_load_s").alias("estimate"), F.coalesce("m.cancellation_safe", F.lit(True)).alias("safe"), "started_t", "completed_t", "cancelled_t", "consumed_t", "consumed_step", "elapsed_s", "status", "measured", F.coalesce("served", F.lit(False)).alias("served"), outcome.alias("outcome"), staged.getField("bytes").alias("bytes"), staged.getField("source").alias("byte_source"), F.coalesce("wasted", F.lit(False)).alias("wasted"))


def overlap_report(events: DataFrame, by: Sequence[str] = ("run_id",), threshold: float = 0.5) -> DataFrame:
    """Totals of a trace's tasks: overlap, benefit and waste as timed, and what the estimates say of tasks that took next to no time (or
    never ended), unless they were cancelled or wasted: the whole estimated load; used, wasted and cancelled tasks, each counted once."""
    by, own = list(by), tasks(events, by)
    gone = F.col("cancelled_t").isNotNull()
    parts = metrics.task_timing(F.col("started_t"), F.col("completed_t"), F.col("consumed_t"), gone, F.col("wasted"))
    simulated = F.coalesce("elapsed_s", F.lit(0.0)) < threshold
    estimated = F.when(simulated & ~gone & ~F.col("wasted"), F.col("estimate"))
    used = F.coalesce(F.col("status") == "used", F.lit(False))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return own.groupBy(*by).agg(
        F.count(F.lit(1)).alias("task_count"), zero(parts["overlap"]).alias("total_overlap_s"), zero(parts["slack"]).alias("total_benefit_s"), zero(parts["late"]).alias("total_waste_s"), zero(estimated).alias("estimated_total_s"),
        F.count_if(simulated).alias("n_simulated"), F.count_if(used).alias("n_used"), F.count_if(~used & F.col("wasted")).alias("n_wasted"), F.count_if(~used & ~F.col("wasted") & gone).alias("n_cancelled"),
    )


def phase_stalls(phases: DataFrame, by: Sequence[str]) -> DataFrame:
    """tool_s, swap_s and reasoning_s of each run from its phases (by, phase, start, end): the time of agents outside swap waits, the
    swap waits, which may lie inside agents, and the inference, in the unit of start and end. swap_s is null, not 0, where no phase of a model was
    recorded. One sweep over the swaps and one over both: neither forms pairs."""
    by = list(by)
    is_ = lambda p: F.col("phase").startswith(p)
    known = phases.groupBy(*by).agg(F.bool_or(is_("model_swap_wait:") | is_("model_load:")).alias("_models"), F.coalesce(F.sum(F.when(F.col("phase") == "llm:inference", F.col("end") - F.col("start"))), F.lit(0.0)).alias("reasoning_s"))
    sets = F.when(is_("agent:"), F.array(F.lit("either"))).when(is_("model_swap_wait:"), F.array(F.lit("either"), F.lit("swap")))  # agents without swaps are both without swaps
    spans = phases.select(*by, "start", "end", F.explode(sets).alias("_set"))
    of = lambda name: F.sum(F.when(F.col("_set") == name, F.col("length")))
    lengths = intervals.total_length(spans, [*by, "_set"]).groupBy(*by).agg(of("either").alias("_e"), of("swap").alias("_s"))
    out = known.join(lengths, by, "left").fillna(0, ["_e", "_s"])
    return out.select(*by, (F.col("_e") - F.col("_s")).alias("tool_s"), F.when(F.col("_models"), F.col("_s")).alias("swap_s"), "reasoning_s")


def with_phase_stalls(runs: DataFrame, phases: DataFrame, family: Column, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """``runs`` (see ``evaluate``) in which the runs of a family take their swap wait and exposed stall from their phases: null where these
    measured no swap; a run of the family without phases keeps what it has."""
    measured = phase_stalls(phases, by).withColumn("_measured", F.lit(True))
    own = F.coalesce(F.col("_measured"), F.lit(False)) & family
    out = runs.join(measured, list(by), "left")
    out = out.withColumns({"swap_wait_s": F.when(own, F.col("swap_s")).otherwise(F.col("swap_wait_s")), "exposed_stall_s": F.when(own, F.col("swap_s") + F.col("no_prefetch_stall_s")).otherwise(F.col("exposed_stall_s"))})
    return out.withColumn("overlap_recovered", metrics.ratio(F.col("overlap_s"), F.col("overlap_s") + F.coalesce("exposed_stall_s", F.lit(0.0)))).drop("_measured", "swap_s")


def evaluate(events: DataFrame, by: Sequence[str] = ("run_id",), consumers: DataFrame | None = None) -> DataFrame:
    """One row a trace with the exposed stall and its parts, prediction outcomes and rates, bytes.

    consumers (name, tool): which tools consume which resource; without it no opportunity counts as missed. Rates are null without a
    denominator. Of the tasks of models and model caches the greatest residual counts, for the aggregator apart, since they
    stall one interval; others add up. A wait is the greater of what was measured and that residual."""
    by, e = list(by), typed(events, by)
    own = tasks(events, by, consumers, e)
    o, c = F.col("outcome"), F.col
    met = o.isin("useful", "late")
    timed = met & c("started_t").isNotNull() & c("consumed_t").isNotNull()
    overlap = F.when(timed, F.greatest(F.lit(0.0), F.least(F.coalesce("completed_t", "consumed_t"), c("consumed_t")) - c("started_t")))
    residual = F.when(timed & c("completed_t").isNotNull(), F.greatest(F.lit(0.0), c("completed_t") - c("consumed_t")))
    model = c("type").isin("vllm_model", "model_cache")
    aggregator = c("name").contains("aggregator")
    lead = F.when(met & (F.coalesce("started_t", F.lit(0.0)) != 0) & (F.coalesce("consumed_t", F.lit(0.0)) != 0), c("consumed_t") - c("started_t"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    first_bad = e.where(_is("divergence_detected")).groupBy(*by).agg(F.min("t").alias("_bad"))
    wrong = o.isin("wasted", "cancelled") & (F.coalesce("_bad", F.lit(0.0)) != 0) & (zero(c("started_t")) >= c("_bad"))
    per = own.join(first_bad, by, "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_admitted"), *[F.count_if(o == x).alias(f"n_{x}") for x in ("useful", "late", "wasted", "cancelled", "duplicate", "pending")],
        zero(F.sum(overlap)).alias("overlap_s"), zero(F.max(F.when(model & ~aggregator, residual))).alias("residual_swap_s"), zero(F.max(F.when(model & aggregator, residual))).alias("residual_agg_s"), zero(F.sum(F.when(~model, residual))).alias("residual_other_s"),
        F.avg(lead).alias("mean_lead_s"), F.countDistinct(F.when(c("status") == "used", c("resource"))).alias("n_served"), F.countDistinct(F.when(o == "useful", c("resource"))).alias("n_on_time"),
        *[zero(F.sum(F.when(cond, c("bytes")))).alias(f"{name}_bytes") for name, cond in (("useful", met), ("wasted", o == "wasted"), ("cancelled", (o == "cancelled") & c("measured").isNotNull()))],
        metrics.joined_sources("byte_source").alias("byte_source"), F.count_if((o == "wasted") & ~c("safe")).alias("n_wasted_noncancellable"), F.count_if(wrong).alias("n_wrong_after"), zero(F.sum(F.when(zero(c("elapsed_s")) != 0, c("elapsed_s")))).alias("speculative_read_s"),
    )
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    waits = lambda kind: zero(F.sum(F.when(_is(kind), zero(c("p.wait_s")))))
    counts = e.groupBy(*by).agg(
        F.sum(F.when(_is("prediction_result"), F.greatest(F.lit(0), F.coalesce(F.size("p.resources"), F.lit(0)))).otherwise(0)).alias("n_predicted"), n(_is("prefetch_decision") & (c("p.action") == "skip")).alias("n_skipped"),
        n(_is("prediction_validated") & c("p.hit")).alias("n_hits"), n(_is("prediction_validated") & ~F.coalesce("p.hit", F.lit(False))).alias("n_misses"), n(_is("divergence_detected")).alias("n_divergences"),
        waits("worker_swap_wait").alias("swap_wait_s"), waits("aggregator_swap_wait").alias("agg_wait_s"), F.coalesce(F.sum(F.when(_is("conservative_mode"), F.coalesce("p.duration_steps", F.lit(0)))), F.lit(0)).alias("conservative_steps"),
    )
    firsts = predictions(e, by).groupBy(*by, "resource").agg(F.min_by("r.estimated_load_s", F.struct("line_no", "place")).alias("est"))
    cold = e.where(_is("resource_consumed") & (c("p.status") == "no_prefetch")).select(*by, F.coalesce("p.resource_id", F.lit("")).alias("resource")).join(firsts, [*by, "resource"], "left").groupBy(*by).agg(zero(F.sum("est")).alias("no_prefetch_stall_s"))
    out = counts.join(per, by, "left").join(cold, by, "left")
    if consumers is None:
        out = out.withColumn("n_missed", F.lit(0).cast("bigint"))
    else:
        called = e.where(_is("tool_call")).select(*by, F.coalesce("p.tool", F.lit("")).alias("tool")).distinct()
        missed = called.join(consumers.select("name", "tool"), "tool").select(*by, "name").distinct().join(own.select(*by, "name").distinct(), [*by, "name"], "left_anti")
        out = out.join(missed.groupBy(*by).agg(F.count(F.lit(1)).alias("n_missed")), by, "left")
    out = out.fillna(0, [x for x in out.columns if x != "mean_lead_s"]).fillna({"byte_source": "unknown"})
    consumed = c("n_useful") + c("n_late") + c("n_duplicate")
    exposed = F.greatest("swap_wait_s", "residual_swap_s") + F.greatest("agg_wait_s", "residual_agg_s") + c("residual_other_s") + c("no_prefetch_stall_s")
    return out.withColumns({
        "n_expired": F.greatest(F.lit(0), c("n_predicted") - (c("n_hits") + c("n_misses") + c("n_divergences")) - c("n_admitted")),
        "precision": metrics.ratio(consumed, c("n_admitted") - c("n_cancelled")),
        "recall": metrics.ratio(c("n_served"), c("n_served") + c("n_missed")),
        "on_time_rate": metrics.ratio(c("n_on_time"), c("n_served")),
        "exposed_stall_s": exposed,
        "overlap_recovered": metrics.ratio(c("overlap_s"), c("overlap_s") + exposed),
    })
