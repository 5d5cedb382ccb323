"""Queries on keyed state, shared streams, typed events, predictors behind one contract and files by their metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..operators import analyze, lifecycle, predictors, sequences, trials
from ..sources import scratch, sinks, traces
from ..streaming import lifecycles, scheduler
from .base import BY, ORD, E, long, query, table, trace
from .metric_queries import _CLASS, classed
from .sequence_queries import _PAIRS
from .trace_queries import _TASKS as _TRIALS
from .trace_queries import TR, events_of, written

#: Tasks of the traces where no consumers are known, so that no stamp is false.
_PLAIN = _TRIALS.replace("ok AS (SELECT * FROM tl WHERE NOT (", "ok AS (SELECT * FROM tl WHERE NOT (false AND ")

# --- admission, cancellation, consumption ------------------------------------------------------------------------------

#: signup and view ask for a fetch, click ends one, error diverges a checkpoint, purchase consumes; the policy's inputs are of k and cents.
_FETCHES = E.replace("WITH e", "WITH RECURSIVE e")[:-1] + """, v AS (SELECT run_id, ord, CASE WHEN kind IN ('signup', 'view') THEN 'predicted' WHEN kind = 'click' THEN 'completed' WHEN kind = 'error' THEN 'diverged' ELSE 'consumed' END AS kind, 'R' || (k % 10) AS resource, 'C' || (k % 4) AS cp,
  CASE WHEN k % 10 = 2 THEN 'skip resource_type_skipped (cache)' WHEN k / 100 < 0.4 THEN 'skip confidence_below_threshold (' || printf('%.2f', k / 100) || ' < 0.4)' WHEN cents % 5 > 3 THEN 'skip horizon_exceeded (4 > 3)' WHEN k % 2 = 0 AND k / 100 < 0.5 THEN 'skip non_cancellable_resource_requires_higher_confidence' WHEN k % 10 = 4 THEN 'start proactive_swap_compute_window'
    WHEN cents % 7 > 0 AND cents > cents % 7 * 2000 THEN 'skip insufficient_compute_time_for_overlap' ELSE 'start confidence_above_threshold' END AS verdict, row_number() OVER (PARTITION BY run_id ORDER BY ord) AS i FROM e),
g AS (SELECT DISTINCT run_id, 0::BIGINT AS i, NULL::BIGINT AS ord, []::STRUCT(resource VARCHAR, task VARCHAR, cp VARCHAR, status VARCHAR)[] AS live, []::STRUCT(event VARCHAR, resource VARCHAR, task VARCHAR, said VARCHAR)[] AS out FROM v
UNION ALL SELECT run_id, i, ord, CASE WHEN kind = 'predicted' AND said LIKE 'start%' THEN list_append(list_filter(live, lambda x: x.resource <> resource), {'resource': resource, 'task': 'T' || ord, 'cp': cp, 'status': 'in_progress'})
    WHEN kind = 'completed' THEN list_transform(live, lambda x: CASE WHEN x.resource = resource AND x.status = 'in_progress' THEN {'resource': x.resource, 'task': x.task, 'cp': x.cp, 'status': 'completed'} ELSE x END)
    WHEN kind = 'diverged' THEN list_transform(live, lambda x: CASE WHEN x.cp = cp AND x.status = 'in_progress' THEN {'resource': x.resource, 'task': x.task, 'cp': x.cp, 'status': 'cancelled'} WHEN x.cp = cp AND x.status = 'completed' THEN {'resource': x.resource, 'task': x.task, 'cp': x.cp, 'status': 'wasted'} ELSE x END)
    WHEN kind = 'consumed' THEN list_transform(live, lambda x: CASE WHEN x.resource = resource AND x.status NOT IN ('cancelled', 'wasted') THEN {'resource': x.resource, 'task': x.task, 'cp': x.cp, 'status': 'used'} ELSE x END) ELSE live END,
  CASE WHEN kind = 'predicted' THEN CASE WHEN said LIKE 'start%' THEN [{'event': 'prefetch_decision', 'resource': resource, 'task': NULL, 'said': said}, {'event': 'prefetch_started', 'resource': resource, 'task': 'T' || ord, 'said': 'in_progress'}] ELSE [{'event': 'prefetch_decision', 'resource': resource, 'task': NULL, 'said': said}] END
    WHEN kind = 'completed' AND own.status = 'in_progress' THEN [{'event': 'prefetch_completed', 'resource': resource, 'task': own.task, 'said': 'completed'}]
    WHEN kind = 'diverged' THEN list_transform(list_filter(live, lambda x: x.cp = cp AND x.status IN ('in_progress', 'completed')), lambda x: {'event': 'prefetch_cancelled', 'resource': x.resource, 'task': x.task, 'said': x.status || CASE WHEN x.status = 'completed' THEN ' wasted' ELSE '' END})
    WHEN kind = 'consumed' THEN CASE WHEN own IS NULL OR own.status IN ('cancelled', 'wasted') THEN [{'event': 'resource_consumed', 'resource': resource, 'task': NULL, 'said': 'no_prefetch'}] ELSE [{'event': 'resource_consumed', 'resource': resource, 'task': own.task, 'said': 'used'}] END ELSE [] END
FROM (SELECT *, CASE WHEN own.status IN ('in_progress', 'completed') THEN 'skip already_in_flight_or_complete' ELSE verdict END AS said FROM (SELECT v.*, g.live, list_filter(g.live, lambda x: x.resource = v.resource)[1] AS own FROM g JOIN v ON v.run_id = g.run_id AND v.i = g.i + 1)))
SELECT run_id, ord, CAST(place - 1 AS INT) AS place, o.event AS event, o.resource AS resource, o.task AS task, o.said AS said FROM (SELECT run_id, ord, unnest(out) AS o, unnest(range(1, len(out) + 1)) AS place FROM g WHERE i > 0)"""


def fetch_events(spark, d):
    k, cents, kind = F.col("k"), F.col("cents"), F.col("kind")
    policy = scalars.admission(F.lit("real"), F.lit(False), F.when(k % 10 == 2, "cache").otherwise("model"), ["cache"], F.lit(False), k / 100, 0.4, cents % 5, 3, k % 2 != 0, k % 10 == 4, cents, cents % 7 * 1000)
    what = F.when(kind.isin("signup", "view"), "predicted").when(kind == "click", "completed").when(kind == "error", "diverged").otherwise("consumed")
    return trace(spark, d).select("run_id", "ord", what.alias("kind"), F.concat(F.lit("R"), (k % 10).cast("string")).alias("resource"), F.concat(F.lit("C"), (k % 4).cast("string")).alias("checkpoint"), policy.alias("a")).select("run_id", "ord", "kind", "resource", "checkpoint", "a.action", "a.reason")


def said(rows):
    """What an emitted row says, in one text."""
    return rows.select("run_id", "ord", "place", "event", "resource", "task", F.when(F.col("event") == "prefetch_decision", F.concat("action", F.lit(" "), "reason")).otherwise(F.concat("status", F.when(F.coalesce("wasted", F.lit(False)), " wasted").otherwise(""))).alias("said"))


@query(_FETCHES)
def scheduler_replay(spark, d):
    """Decisions, starts, cancellations and consumptions that predictions, completions and divergences lead to: earlier admissions
    decide later ones."""
    return said(scheduler.replay(fetch_events(spark, d)))


# --- the shared append stream ----------------------------------------------------------------------------------------------------


_ONE = TR + """, lv AS (SELECT *, coalesce(max(CASE WHEN et = 'prefetch_started' THEN ord END) OVER w, min(CASE WHEN et <> 'resource_consumed' THEN ord END) OVER w) AS since FROM e WHERE et IN ('prefetch_started', 'prefetch_completed', 'prefetch_cancelled', 'resource_consumed') WINDOW w AS (PARTITION BY run_id, task)),
tk AS (SELECT run_id, task, max_by(t, ord) FILTER (et = 'prefetch_started') AS st, coalesce(max_by(resource, ord) FILTER (et = 'prefetch_started'), '') AS resource, max_by(elapsed, ord) FILTER (et = 'prefetch_completed') AS el, max_by(t, ord) FILTER (et = 'prefetch_completed') AS en, max_by(staged, ord) FILTER (et = 'prefetch_completed' AND staged IS NOT NULL) AS measured,
  max_by(t, ord) FILTER (et = 'prefetch_cancelled') AS ca, max_by(even, ord) FILTER (et = 'prefetch_cancelled') AS wasted, max_by(t, ord) FILTER (et = 'resource_consumed') AS us, max_by(status, ord) FILTER (et = 'resource_consumed') AS status FROM lv WHERE ord >= since GROUP BY ALL)
SELECT run_id, task, resource, round(st, 4) AS started_t, round(CASE WHEN en IS NOT NULL THEN CASE WHEN st IS NOT NULL AND el > 0 THEN st + el ELSE en END END, 4) AS completed_t, round(ca, 4) AS cancelled_t, round(us, 4) AS consumed_t, measured, wasted, status FROM tk"""


@query(_ONE)
def streamed_lifecycles(spark, d):
    """What several writers append, a batch of lines each, read as one stream; the lifecycles it ends with."""
    path, out = scratch.folder(spark, "bus"), scratch.folder(spark, "lifecycles")
    events = events_of(spark, d).withColumn("part", F.when(F.col("place") <= 20, 0).when(F.col("place") <= 60, 1).otherwise(2))
    for k in range(3):  # in the order of time, as writers append
        sinks.append_events(events.where(F.col("part") == k).drop("place", "part"), path)
        run_stream(spark, path, out)
    got = lifecycles.latest(spark.read.schema(lifecycles.SCHEMA).parquet(f"{out}/rows"))
    return got.select("run_id", "task", "resource", *[F.round(c, 4).alias(c) for c in ("started_t", "completed_t", "cancelled_t", "consumed_t")], "measured", "wasted", "status")


def run_stream(spark, path, out):
    """One run over what is new in ``path``; the next run starts from its checkpoint."""
    held = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(held)
    spark.conf.set(held, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        lifecycles.append_updates(lifecycles.updates(lifecycles.lines(spark, path)), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(held, before)


# --- typed events, files by their metadata ---------------------------------------------------------------------------------------------


@query(TR + """SELECT run_id, CAST(ord AS BIGINT) AS ord, et AS event_type, CASE WHEN et = 'prefetch_started' THEN task END AS started_task, CASE WHEN et = 'prefetch_completed' THEN elapsed END AS elapsed_s, CASE WHEN et = 'prefetch_cancelled' THEN even END AS wasted, CASE WHEN et = 'tool_call' THEN tool END AS tool, k,
  CAST(CASE WHEN et = 'prefetch_completed' AND staged IS NOT NULL THEN 2 WHEN et = 'conservative_mode' THEN 2 WHEN et IN ('worker_swap_wait', 'aggregator_swap_wait') THEN 5 ELSE 1 END AS BIGINT) AS n_extras, CASE WHEN et IN ('worker_swap_wait', 'aggregator_swap_wait') THEN name END AS model FROM e""")
def typed_extras(spark, d):
    """Events in typed columns, one each type, with the scalars that no type names."""
    got = traces.typed_events(written(spark, d).withColumn("ord", F.round((F.col("t") - 1000) * 5).cast("bigint")))
    x = F.col("extras")
    return got.select("run_id", "ord", "event_type", F.col("prefetch_started.task_id").alias("started_task"), "prefetch_completed.elapsed_s", "prefetch_cancelled.wasted", "tool_call.tool", x["k"].cast("bigint").alias("k"), F.size(x).cast("bigint").alias("n_extras"), F.when(F.col("event_type").endswith("swap_wait"), x["model"]).alias("model"))


@query("SELECT dense_rank() OVER (ORDER BY user_id % 20) - 1 AS trace, count(*) AS n, min(event_id) AS first FROM events WHERE user_id % 20 <> 7 GROUP BY user_id % 20")
def multi_traces(spark, d):
    """A folder of traces in the order of their paths; those without an event take no place."""
    path = scratch.folder(spark, "traces")
    e = trace(spark, d).select(F.lpad((F.col("run_id") % 20).cast("string"), 3, "0").alias("f"), "ord", F.when(F.col("run_id") % 20 == 7, " ").otherwise(F.to_json(F.struct(F.lit("tool_call").alias("event_type"), F.struct("ord").alias("payload")))).alias("value"))
    e.repartition("f").select("f", "value").write.partitionBy("f").text(path)
    got = traces.load_traces(spark, path, "*/*")
    return got.groupBy("trace").agg(F.count(F.lit(1)).alias("n"), F.min(traces.payload("ord", "bigint")).alias("first"))


@query("SELECT 'w=' || n_regionkey AS workload, max_by(n_nationkey, (n_nationkey * 7 % 25, n_nationkey)) AS trial FROM nation WHERE n_nationkey % 3 < 2 AND n_nationkey % 5 <> 4 GROUP BY 1")
def newest_completed(spark, d):
    """Of each workload's completed trials of two configurations the one whose trace was modified last."""
    root, k = scratch.folder(spark, "trials"), F.col("n_nationkey")
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("w"), F.element_at(F.array(*map(F.lit, ("baseline", "full_system", "other"))), (k % 3 + 1).cast("int")).alias("c"), k.alias("t"), F.to_json(F.struct(F.when(k % 5 == 4, "failed").otherwise("completed").alias("status"))).alias("value"))
    rows.write.partitionBy("w", "c", "t").text(f"{root}/runs")
    rows.write.mode("append").partitionBy("w", "c", "t").json(f"{root}/runs")
    touch(spark, f"{root}/runs/*/*/*/part-*.json", lambda name: int(name.split("/t=")[1].split("/")[0]) * 7 % 25)
    got = traces.newest_traces(spark, root, ("c=baseline", "c=full_system"), "part-*.json", "part-*.txt")
    return got.select("workload", F.regexp_extract("trial_dir", "t=([0-9]+)$", 1).cast("int").alias("trial"))


def touch(spark, pattern, hours):
    """Give files the modification times that a user's files would have."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.globStatus(at):
        fs.setTimes(f.getPath(), 1_700_000_000_000 + hours(f.getPath().toString()) * 3_600_000, -1)


# --- predictors behind one contract -----------------------------------------------------------------------------------------------------

#: Calls are the events of a run; every third carries its step, the others count. The registry: a resource for each nation, consumed by the type of its region.
_CALLS = E[:-1] + """, n AS (SELECT run_id, ord, kind AS tool, row_number() OVER (PARTITION BY run_id ORDER BY t, ord) AS n FROM e), c AS (SELECT run_id, CASE WHEN n % 3 = 0 THEN n + n % 2 ELSE n END AS step, max_by(tool, n) AS tool FROM n GROUP BY ALL),
reg AS (SELECT 'R' || n_nationkey AS rid, ['click', 'error', 'purchase', 'signup', 'view'][n_regionkey + 1] AS tool, ['click', 'error', 'purchase', 'signup', 'view'][n_nationkey % 5 + 1] AS after, 1 + n_nationkey % 2 AS off, (n_nationkey % 10) / 10 AS confidence FROM nation),
ref AS (SELECT step, tool FROM c WHERE run_id = (SELECT min(run_id) FROM c)),
ora AS (SELECT DISTINCT c.run_id, c.step, reg.rid, ref.tool AS consumer, c.step + 1 AS due, 1.0::DOUBLE AS confidence FROM c JOIN ref ON ref.step = c.step + 1 JOIN reg ON reg.tool = ref.tool),
rul AS (SELECT c.run_id, c.step, reg.rid, reg.tool AS consumer, c.step + reg.off AS due, reg.confidence FROM c JOIN reg ON reg.after = c.tool),
pl AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY step) - 1 AS place, tool FROM c WHERE step <= 6),
ps AS (SELECT run_id, tool, min(place) AS at FROM pl GROUP BY ALL), has AS (SELECT DISTINCT run_id FROM pl),
pla AS (SELECT DISTINCT c.run_id, c.step, reg.rid, nx.tool AS consumer, c.step + o.off AS due, 0.8::DOUBLE AS confidence FROM c JOIN has USING (run_id) LEFT JOIN ps ON ps.run_id = c.run_id AND ps.tool = c.tool CROSS JOIN (SELECT unnest([1, 2]) AS off) o JOIN pl nx ON nx.run_id = c.run_id AND nx.place = coalesce(ps.at, -1) + o.off JOIN reg ON reg.tool = nx.tool)
"""


def contract_calls(spark, d):
    n = F.row_number().over(Window.partitionBy(*BY).orderBy(*ORD))
    e = trace(spark, d).select("run_id", F.col("kind").alias("tool"), n.alias("line_no"))
    steps = predictors.steps_of(e.withColumn("step", F.when(F.col("line_no") % 3 == 0, F.col("line_no") + F.col("line_no") % 2)), BY).select("run_id", "step", "tool")
    return scratch.kept(steps, "calls")  # counted, looked up and predicted from several times


def knowledge(spark, d, calls):
    names, k = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("n_nationkey")
    reg = table(spark, d, "nation").select(F.concat(F.lit("R"), k.cast("string")).alias("resource_id"), F.get(names, F.col("n_regionkey")).alias("consumer_tool"), F.get(names, (k % 5).cast("int")).alias("tool"), (1 + k % 2).alias("off"), (k % 10 / 10).alias("confidence"))
    first = calls.agg(F.min("run_id").alias("run_id"))
    reference = calls.join(F.broadcast(first), "run_id", "left_semi").select("step", "tool")
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("step")) - 1
    plans = calls.where("step <= 6").select("run_id", place.alias("place"), "tool")
    nothing = spark.createDataFrame([], "source string, off int, target string, prob double, rank long")
    return predictors.Knowledge(reg, nothing, plans, reference)


@query(_CALLS + "SELECT run_id, CAST(step AS BIGINT) AS step, rid AS resource_id, consumer AS consumer_tool, CAST(due AS BIGINT) AS expected_at_step, confidence FROM ora")
def oracle_prediction(spark, d):
    """What a reference run did one step on, each resource once; steps as given, else as counted."""
    calls = contract_calls(spark, d)
    return predictors.predict("oracle", calls, knowledge(spark, d, calls)).drop("predictor_id")


@query(_CALLS + "SELECT run_id, CAST(step AS BIGINT) AS step, rid AS resource_id, consumer AS consumer_tool, CAST(due AS BIGINT) AS expected_at_step, confidence FROM pla")
def plan_by_run(spark, d):
    """What each run's own plan has one and two steps on from the call."""
    calls = contract_calls(spark, d)
    return predictors.predict("plan", calls, knowledge(spark, d, calls)).drop("predictor_id")


@query(_CALLS + """, p AS (SELECT *, 'oracle' AS predictor_id FROM ora UNION ALL SELECT *, 'rules' FROM rul UNION ALL SELECT *, 'plan' FROM pla UNION ALL SELECT * REPLACE ('learned' AS predictor_id) FROM (SELECT *, 'plan' AS predictor_id FROM pla UNION ALL SELECT *, 'rules' FROM rul WHERE NOT EXISTS (SELECT 1 FROM pla WHERE pla.run_id = rul.run_id AND pla.step = rul.step)))
SELECT predictor_id, count(*) AS made, CAST(count(*) FILTER (coalesce(starts_with(c.tool, consumer), false)) AS BIGINT) AS hits, count(DISTINCT (p.run_id, p.step)) AS calls_covered, round(CAST(count(*) FILTER (coalesce(starts_with(c.tool, consumer), false)) AS DOUBLE) / count(*), 6) AS precision
FROM p LEFT JOIN c ON c.run_id = p.run_id AND c.step = p.due GROUP BY predictor_id""")
def predictor_scores(spark, d):
    """Oracle, rules, plan and the learned predictor (here without a table) through one contract, judged by one function."""
    calls = contract_calls(spark, d)
    known = knowledge(spark, d, calls)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # stated, so that small calls with many predictions are not put together
    calls = calls.repartition(parts, "run_id")  # the only time that they move
    rows = [predictors.predict(name, calls, known) for name in ("oracle", "rules", "plan", "learned")]
    return predictors.judge(reduce(DataFrame.unionByName, rows), calls).withColumn("precision", F.round("precision", 6))


# --- learning in parts ---------------------------------------------------------------------------------------------------------------------------


@query(_PAIRS[: _PAIRS.index(",\nc AS")] + """, cn AS (SELECT source, off, target, count(*) AS cnt, min((run_id % 3, t, ord)) AS first FROM p WHERE target IS NOT NULL GROUP BY ALL), pr AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY source, off) AS prob FROM cn)
SELECT source, CAST(off AS BIGINT) AS off, target, cnt, round(prob, 9) AS prob, row_number() OVER (PARTITION BY source, off ORDER BY cnt DESC, first) AS rank FROM pr WHERE cnt >= 2""")
def incremental_transitions(spark, d):
    """A transition table learned in three parts, each without the traces before it."""
    e, stored, learned = trace(spark, d), None, None
    for k in range(3):
        new = scratch.kept(sequences.counts_of(e.where(F.col("run_id") % 3 == k), BY, ORD, "kind", 3, k), "counts")
        learned = sequences.ranked_counts(new) if stored is None else sequences.updated_table(learned, stored, new)
        learned = scratch.kept(learned, "table")
        stored = new if stored is None else scratch.kept(sequences.merged_counts(stored, new), "counts")
    return learned.select("source", long("off"), "target", "cnt", F.round("prob", 9).alias("prob"), "rank")


# --- reports, overrides and times of trials -------------------------------------------------------------------------------------------------


@query(_PLAIN + """SELECT run_id, count(*) AS task_count, round(coalesce(sum(CASE WHEN tim THEN greatest(0, least(done, us) - st) ELSE 0 END), 0), 4) AS total_overlap_s, round(coalesce(sum(CASE WHEN tim AND NOT w THEN greatest(0, us - done) ELSE 0 END), 0), 4) AS total_benefit_s, round(coalesce(sum(CASE WHEN tim AND NOT w THEN greatest(0, done - us) ELSE 0 END), 0), 4) AS total_waste_s,
  round(coalesce(sum(CASE WHEN sim AND ca IS NULL AND NOT w THEN est END), 0), 4) AS estimated_total_s, CAST(count(*) FILTER (sim) AS BIGINT) AS n_simulated, CAST(count(*) FILTER (u) AS BIGINT) AS n_used, CAST(count(*) FILTER (NOT u AND w) AS BIGINT) AS n_wasted, CAST(count(*) FILTER (NOT u AND NOT w AND ca IS NOT NULL) AS BIGINT) AS n_cancelled
FROM (SELECT run_id, st, done, us, ca, m.est AS est, st IS NOT NULL AND done IS NOT NULL AND us IS NOT NULL AND ca IS NULL AS tim, coalesce(wasted, false) AS w, coalesce(el, 0) < 0.5 AS sim, coalesce(status = 'used', false) AS u FROM tm) GROUP BY run_id""")
def overlap_reports(spark, d):
    """Totals of each run's tasks, timed and, for those that took next to no time, estimated."""
    got = analyze.overlap_report(written(spark, d))
    return got.withColumns({c: F.round(c, 4) for c in got.columns if c.endswith("_s")})


#: Phases of a run in its metrics file: ends in whole microseconds, durations in cents; every third run recorded no model.
_PHASES = E[:-1] + """, p AS (SELECT run_id, CASE kind WHEN 'signup' THEN 'agent:x' WHEN 'view' THEN CASE WHEN run_id % 3 = 0 THEN 'lammps:run' ELSE 'model_swap_wait:m' END WHEN 'click' THEN 'llm:inference' WHEN 'error' THEN CASE WHEN run_id % 3 = 0 THEN 'other' ELSE 'model_load:m' END ELSE 'SUMMARY' END AS phase, t - cents * 1000000 AS s, t AS f, cents FROM e)
"""


def _union_of(name, phase):
    return f""", {name}1 AS (SELECT run_id, s, f, max(f) OVER (PARTITION BY run_id ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p WHERE {phase}), {name}2 AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY s, f ROWS UNBOUNDED PRECEDING) AS g FROM {name}1),
{name} AS (SELECT run_id, min(s) AS s, max(f) AS f FROM {name}2 GROUP BY run_id, g)"""


@query(_PHASES + _union_of("a", "phase = 'agent:x'") + _union_of("w", "phase = 'model_swap_wait:m'") + """, o AS (SELECT a.run_id, sum(greatest(0, least(a.f, w.f) - greatest(a.s, w.s))) AS o FROM a JOIN w ON a.run_id = w.run_id GROUP BY 1), la AS (SELECT run_id, sum(f - s) AS n FROM a GROUP BY 1), lw AS (SELECT run_id, sum(f - s) AS n FROM w GROUP BY 1),
k AS (SELECT run_id, bool_or(phase LIKE 'model_%') AS models, coalesce(sum(cents) FILTER (phase = 'llm:inference'), 0) AS r FROM p WHERE phase <> 'SUMMARY' GROUP BY 1)
SELECT k.run_id, round((coalesce(la.n, 0) - coalesce(o.o, 0)) / 1e6, 2) AS tool_s, CASE WHEN models THEN round(coalesce(lw.n, 0) / 1e6, 2) END AS swap_s, CAST(r AS DOUBLE) AS reasoning_s FROM k LEFT JOIN la USING (run_id) LEFT JOIN lw USING (run_id) LEFT JOIN o USING (run_id)""")
def phase_stalls(spark, d):
    """Tool, swap and reasoning time of runs from their metrics files; swap waits inside agents count once, unmeasured swaps are null."""
    path, kind, third = scratch.folder(spark, "phases"), F.col("kind"), F.col("run_id") % 3 == 0
    phase = F.when(kind == "signup", "agent:x").when(kind == "view", F.when(third, "lammps:run").otherwise("model_swap_wait:m")).when(kind == "click", "llm:inference").when(kind == "error", F.when(third, "other").otherwise("model_load:m")).otherwise("SUMMARY")
    at = F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rows = trace(spark, d).select("run_id", "t", phase.alias("phase"), at.alias("timestamp"), F.col("cents").cast("string").alias("duration_s"))
    rows.repartition("run_id").sortWithinPartitions("run_id", "t").drop("t").write.option("header", True).csv(path)  # many runs a file
    micros = lambda c: F.round(F.col(c) * 1_000_000).cast("bigint").alias(c)
    phases = traces.load_phases(spark, path, BY).select(F.col("run_id").cast("bigint").alias("run_id"), "phase", micros("start"), micros("end"))
    cents = lambda c: (F.round(F.col(c) / 1_000_000 * 100) / 100).alias(c)
    return analyze.phase_stalls(phases, BY).select("run_id", *map(cents, ("tool_s", "swap_s", "reasoning_s")))


@query(E[:-1] + _CLASS + """, l AS (SELECT *, max(cents) OVER (PARTITION BY run_id, g ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lead FROM c WHERE g <> 0 AND cls <> ''),
d AS (SELECT *, row_number() OVER (PARTITION BY run_id, g ORDER BY ord DESC) AS r FROM l WHERE lead IS NULL OR cents > lead),
a AS (SELECT kind, cls, CASE WHEN r = 1 THEN cents ELSE 0 END AS s FROM d UNION ALL SELECT kind, cls, cents FROM c WHERE g = 0 AND cls <> ''), n AS (SELECT kind, count(DISTINCT run_id) AS n FROM c GROUP BY 1)
SELECT kind AS workload, cls AS stall_class, CAST(sum(s) AS DOUBLE) AS exposed_stall_s, n AS n_trials, round(sum(s) / n, 2) AS stall_s_per_trial FROM a JOIN n USING (kind) GROUP BY kind, cls, n""")
def taxonomy_table(spark, d):
    """The taxonomy as the table of a report, written and read again."""
    path, rows = scratch.folder(spark, "taxonomy"), classed(spark, d).withColumnRenamed("kind", "workload")
    cells = lifecycle.taxonomy(rows, BY, ["workload"], "g", "cents", "cls", "ord")
    sinks.write_table(sinks.taxonomy_rows(cells, rows, ["workload"]), path)
    return spark.read.option("header", True).schema("workload string, stall_class string, exposed_stall_s double, n_trials bigint, stall_s_per_trial double").csv(path)


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey DESC, s_acctbal, s_suppkey) AS place FROM supplier")
def report_places(spark, d):
    """K9: rows of a report numbered in its order."""
    return sinks.numbered(table(spark, d, "supplier"), [F.desc("s_nationkey"), F.col("s_acctbal"), F.col("s_suppkey")]).select("s_suppkey", "place")


@query(_PLAIN + """, z AS (SELECT run_id, least(coalesce(min(t) FILTER (et IN ('tool_call', 'worker_swap_wait', 'aggregator_swap_wait', 'prediction_result')), 1e18), coalesce((SELECT min(st) FROM tm WHERE tm.run_id = e.run_id), 1e18)) AS t0 FROM e GROUP BY run_id)
SELECT tm.run_id, rid AS resource, round(st - t0, 3) AS t_started, round(us - t0, 3) AS t_consumed, round(ca - t0, 3) AS t_cancelled, coalesce(el > 0 AND el < 0.5 AND CASE WHEN staged IS NOT NULL THEN staged ELSE coalesce(m.size, 0) END > 1e9, false) AS simulated FROM tm JOIN z USING (run_id) WHERE st IS NOT NULL""")
def trial_times(spark, d):
    """The times of each run's started fetches from the run's first, and whether a fetch was simulated."""
    got = trials.trial_rows(written(spark, d)).where("t_started is not null and outcome not in ('direct_prefetch', 'no_prediction')")
    return got.select("run_id", "resource", *[F.round(c, 3).alias(c) for c in ("t_started", "t_consumed", "t_cancelled")], "simulated")


# --- rules on texts, dates and maps ----------------------------------------------------------------------------------------------------------


@query(E[:-1] + """ SELECT run_id, ord, CASE WHEN k % 2 = 0 THEN kind ELSE '' END AS marker, CASE WHEN k % 7 = 0 THEN '' ELSE 'a' || k || ' ' || kind END AS prompts, CASE k % 3 WHEN 0 THEN kind WHEN 1 THEN 'baseline' ELSE substr('run-number-' || run_id, 1, 12) END AS label, CASE WHEN k % 2 = 0 THEN 'policy_skip' ELSE kind END AS cls,
  CASE WHEN k % 5 = 0 THEN NULL ELSE t / 1000000.0::DOUBLE END AS seconds, CASE WHEN k % 5 = 0 THEN NULL ELSE greatest(20, least(60, k)) END AS clamped, cents + 3 * k AS weighed FROM e""")
def text_rules(spark, d):
    """Markers, planner messages, bounds, dates, maps by number, labels of conditions and classes."""
    e, k, kind = trace(spark, d), F.col("k"), F.col("kind")
    marker = F.when(k % 2 == 0, F.concat(F.lit("go [Specialist:  "), F.upper(kind), F.lit("] now"))).otherwise("[specialist] none")
    message = F.when(k % 7 == 0, "{broken").otherwise(F.concat(F.lit('{"worker_tasks": [{"prompt": "a'), k.cast("string"), F.lit('"}, {"prompt": "'), kind, F.lit('"}]}')))
    condition, mode = F.when(k % 3 == 0, kind).when(k % 3 == 1, ""), F.when(k % 3 == 1, "baseline").otherwise("real")
    at = F.when(k % 5 == 0, "no date").otherwise(F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    by_number = scalars.int_keys(F.create_map(F.lit("1"), F.col("cents"), F.lit("3"), k, F.lit("x"), F.lit(7)))
    weighed = F.aggregate(F.map_entries(by_number), F.lit(0).cast("bigint"), lambda s, x: s + x.key * x.value)
    return e.select("run_id", "ord", scalars.specialist_marker(marker).alias("marker"), text.planner_prompts(message).alias("prompts"), scalars.condition_label(condition, mode, F.concat(F.lit("run-number-"), F.col("run_id").cast("string"))).alias("label"), scalars.merged_class(F.when(k % 2 == 0, F.concat(F.lit("policy_skip:"), kind)).otherwise(kind)).alias("cls"),
                    scalars.iso_seconds(at).alias("seconds"), scalars.clamp(F.when(k % 5 != 0, k), 20, 60).alias("clamped"), weighed.alias("weighed"))
