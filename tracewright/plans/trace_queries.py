"""Queries over traces and run trees: the driver's tables are written out as the files that a user has, and read back.

A user of ``events`` is a run; its events, 0.2 s apart, stand for the kinds of a trace by event_type and k (see ``events_of``)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import analyze, trials
from ..sources import scratch, sinks, traces
from .base import BY, ORD, query, table, trace
from .sequence_queries import _PAIRS

#: The same events in SQL: a row each with the payload's fields.
TR = """WITH e0 AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_type AS ty, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
e AS (SELECT CAST(run AS VARCHAR) AS run_id, ord, 1000 + ord * 0.2::DOUBLE AS t, k % 10 AS step, k, 'T' || (k % 40) AS task, 'R' || (k % 10) AS resource,
  CASE ty WHEN 'signup' THEN CASE WHEN k < 50 THEN 'prediction_result' WHEN k < 75 THEN 'prefetch_decision' ELSE 'prediction_validated' END WHEN 'view' THEN 'prefetch_started' WHEN 'click' THEN 'prefetch_completed'
  WHEN 'error' THEN CASE WHEN k < 50 THEN 'prefetch_cancelled' WHEN k < 75 THEN 'divergence_detected' ELSE 'conservative_mode' END
  ELSE CASE WHEN k < 50 THEN 'resource_consumed' WHEN k < 60 THEN 'worker_swap_wait' WHEN k < 70 THEN 'aggregator_swap_wait' ELSE 'tool_call' END END AS et,
  cents / 100.0::DOUBLE AS x, k / 10.0::DOUBLE AS elapsed, k % 2 = 0 AS even, CASE WHEN k % 3 = 0 THEN 'no_prefetch' ELSE 'used' END AS status, 'tool' || (k % 5) AS tool,
  CASE WHEN k % 10 = 3 THEN 'aggregator3' ELSE 'name' || (k % 10) END AS name, CASE WHEN k % 10 < 5 THEN 'vllm_model' ELSE 'dataset' END AS type, CASE WHEN k % 3 > 0 THEN cents * 10000.0::DOUBLE END AS size, CASE WHEN k % 4 = 0 THEN cents * 1000.0::DOUBLE END AS staged, 'r' || (k % 3) AS reason, even AND k % 3 <> 0 AS direct
  FROM e0)
"""


def events_of(spark, d):
    """The events as lines of a trace: run_id, step, epoch_time, event_type, payload."""
    e = in_order(trace(spark, d))
    k, ty = F.col("k"), F.col("kind")
    kind = (
        F.when(ty == "signup", F.when(k < 50, "prediction_result").when(k < 75, "prefetch_decision").otherwise("prediction_validated"))
        .when(ty == "view", "prefetch_started").when(ty == "click", "prefetch_completed")
        .when(ty == "error", F.when(k < 50, "prefetch_cancelled").when(k < 75, "divergence_detected").otherwise("conservative_mode"))
        .otherwise(F.when(k < 50, "resource_consumed").when(k < 60, "worker_swap_wait").when(k < 70, "aggregator_swap_wait").otherwise("tool_call"))
    )
    is_ = lambda *kinds: F.col("event_type").isin(*kinds)
    task, resource, x = F.concat(F.lit("T"), (k % 40).cast("string")), F.concat(F.lit("R"), (k % 10).cast("string")), F.col("cents") / 100
    predicted = F.array(F.struct(
        resource.alias("resource_id"), F.when(k % 10 == 3, "aggregator3").otherwise(F.concat(F.lit("name"), (k % 10).cast("string"))).alias("name"), F.when(k % 10 < 5, "vllm_model").otherwise("dataset").alias("resource_type"),
        x.alias("estimated_load_s"), F.when(k % 3 > 0, F.col("cents") * 10000.0).alias("estimated_size_bytes"), (k % 2 == 0).alias("cancellation_safe"), F.concat(F.lit("tool"), (k % 5).cast("string")).alias("consumer_tool"), (k / 100).alias("confidence")))
    waits = is_("worker_swap_wait", "aggregator_swap_wait")
    fields = {
        "task_id": F.when(is_("prefetch_started", "prefetch_completed", "prefetch_cancelled", "resource_consumed"), task),
        "resource_id": F.when(is_("prefetch_started", "prefetch_decision", "resource_consumed"), resource),
        "resources": F.when(is_("prediction_result"), predicted), "estimated_load_s": F.when(is_("prefetch_decision"), x), "action": F.when(is_("prefetch_decision"), F.when(k % 2 == 0, "start").otherwise("skip")),
        "hit": F.when(is_("prediction_validated"), k % 2 == 0), "wasted": F.when(is_("prefetch_cancelled"), k % 2 == 0), "elapsed_s": F.when(is_("prefetch_completed"), k / 10), "bytes_staged": F.when(is_("prefetch_completed") & (k % 4 == 0), F.col("cents") * 1000.0),
        "status": F.when(is_("resource_consumed"), F.when(k % 3 == 0, "no_prefetch").otherwise("used")), "wait_s": F.when(is_("worker_swap_wait", "aggregator_swap_wait"), x), "tool": F.when(is_("tool_call"), F.concat(F.lit("tool"), (k % 5).cast("string"))), "duration_steps": F.when(is_("conservative_mode"), F.lit(3)), "k": k, "reason": F.when(is_("prefetch_decision"), F.concat(F.lit("r"), (k % 3).cast("string"))),
        "model": F.when(waits, F.when(k % 10 == 3, "aggregator3").otherwise(F.concat(F.lit("name"), (k % 10).cast("string")))), "prefetch_scheduled": F.when(is_("worker_swap_wait"), k % 2 == 0), "prefetch_started": F.when(is_("aggregator_swap_wait"), k % 2 == 0), "on_demand_swap": F.when(is_("worker_swap_wait"), k % 3 == 0), "on_demand_start": F.when(is_("aggregator_swap_wait"), k % 3 == 0),
    }
    rows = e.select(F.col("run_id").cast("string").alias("run_id"), "place", (k % 10).cast("int").alias("step"), (1000 + F.col("place") * 0.2).alias("epoch_time"), kind.alias("event_type"), "k", "cents")
    return rows.select("run_id", "place", "step", "epoch_time", "event_type", F.struct(*[c.alias(n) for n, c in fields.items()]).alias("payload"))


def in_order(e):
    return e.withColumn("place", F.row_number().over(Window.partitionBy(*BY).orderBy(*ORD)))


def written(spark, d):
    """The events written as JSON lines, a run in one file and in order, and loaded again."""
    path = scratch.folder(spark, "trace")
    sinks.append_events(events_of(spark, d).repartition("run_id").sortWithinPartitions("run_id", "place").drop("place"), path)
    return traces.load_events(spark, path)


def consumers(spark, d):
    r = table(spark, d, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("r"))
    return r.select(F.when(F.col("r") == 3, "aggregator3").otherwise(F.concat(F.lit("name"), F.col("r").cast("string"))).alias("name"), F.concat(F.lit("tool"), (F.col("r") % 4).cast("string")).alias("tool"))


@query(TR + "SELECT run_id, step, t, et AS event_type, k FROM e")
def trace_lines(spark, d):
    """Events written line by line and loaded with their payloads."""
    return written(spark, d).select("run_id", F.col("step").cast("bigint").alias("step"), "t", "event_type", traces.payload("k", "bigint").alias("k"))


@query(TR + """, b AS (SELECT run_id, count(*) AS total_events, count(*) FILTER (et = 'prediction_result') AS prediction_count, count(*) FILTER (et = 'prediction_validated' AND even) AS hit_count, count(*) FILTER (et = 'prediction_validated' AND NOT even OR et = 'divergence_detected') AS miss_count,
  count(*) FILTER (et = 'prefetch_started') AS prefetch_started, count(*) FILTER (et = 'prefetch_completed') AS prefetch_completed, count(*) FILTER (et = 'prefetch_cancelled') AS prefetch_cancelled, count(*) FILTER (et = 'prefetch_cancelled' AND even) AS wasted_prefetch, count(*) FILTER (et = 'divergence_detected') AS divergence_count FROM e GROUP BY run_id),
st AS (SELECT run_id, resource, task, t, ord, lead(ord) OVER (PARTITION BY run_id, resource ORDER BY ord) AS until FROM e WHERE et = 'prefetch_started'),
cp AS (SELECT st.run_id, st.resource, max_by(c.t, c.ord) AS done, max_by(c.elapsed, c.ord) AS actual FROM st JOIN e c ON c.run_id = st.run_id AND c.et = 'prefetch_completed' AND c.task = st.task AND c.ord > st.ord AND (until IS NULL OR c.ord < until) GROUP BY ALL),
r AS (SELECT run_id, resource, max_by(x, ord) FILTER (et = 'prefetch_decision') AS est0, max_by(t, ord) FILTER (et = 'prefetch_started') AS st, max_by(t, ord) FILTER (et = 'resource_consumed') AS used, max_by(status, ord) FILTER (et = 'resource_consumed') AS status FROM e WHERE et IN ('prefetch_decision', 'prefetch_started', 'resource_consumed') GROUP BY ALL),
s AS (SELECT r.*, cp.done, cp.actual, coalesce(nullif(est0, 0), nullif(actual, 0), est0, 0) AS est, status = 'no_prefetch' OR st IS NULL AS cold FROM r LEFT JOIN cp USING (run_id, resource) WHERE st IS NOT NULL OR used IS NOT NULL),
q AS (SELECT run_id, sum(CASE WHEN coalesce(cold, false) THEN est WHEN used IS NOT NULL AND done IS NOT NULL THEN greatest(0, done - used) ELSE 0 END) AS stall, sum(CASE WHEN NOT coalesce(cold, false) AND used IS NOT NULL AND done IS NOT NULL THEN greatest(0, least(done, used) - st) ELSE 0 END) AS overlap,
  sum(CASE WHEN NOT coalesce(cold, false) AND used IS NOT NULL AND done IS NOT NULL THEN greatest(0, est - greatest(0, done - used)) ELSE 0 END) AS benefit, sum(CASE WHEN NOT coalesce(cold, false) AND used IS NULL AND done IS NOT NULL THEN coalesce(nullif(actual, 0), done - st) ELSE 0 END) AS waste FROM s GROUP BY run_id)
SELECT b.*, prediction_count - hit_count - miss_count AS unvalidated_count, round(hit_count / nullif(hit_count + miss_count, 0), 6) AS precision, round((hit_count + miss_count) / nullif(prediction_count, 0), 6) AS coverage, round(hit_count / nullif(prediction_count, 0), 6) AS honest_accuracy,
  round(coalesce(stall, 0), 4) AS total_stall_s, round(coalesce(overlap, 0), 4) AS total_overlap_s, round(coalesce(benefit, 0), 4) AS total_benefit_s, round(coalesce(waste, 0), 4) AS total_waste_s FROM b LEFT JOIN q USING (run_id)""")
def trace_summary(spark, d):
    """The summary of each run, from its trace's lines."""
    got = analyze.analyze(written(spark, d))
    return got.withColumns({c: F.round(c, 6) for c in ("precision", "coverage", "honest_accuracy")} | {c: F.round(c, 4) for c in got.columns if c.startswith("total_") and c.endswith("_s")})


@query(TR + "SELECT run_id, step, max_by(even, ord) FILTER (et = 'prediction_validated') AS hit, bool_or(et = 'divergence_detected') AS diverged, max_by(tool, ord) FILTER (et = 'tool_call') AS tool FROM e WHERE et IN ('prediction_result', 'prediction_validated', 'divergence_detected', 'tool_call') GROUP BY ALL")
def trace_steps(spark, d):
    """What each step predicted, hit and called, the last of each kind."""
    return analyze.steps(written(spark, d)).select("run_id", F.col("step").cast("bigint").alias("step"), "hit", "diverged", "tool")


_TASKS = TR + """, pr AS (SELECT run_id, resource, max_by({'name': name, 'type': type, 'est': x, 'size': size, 'safe': even}, ord) AS m FROM e WHERE et = 'prediction_result' GROUP BY ALL),
cons AS (SELECT CASE WHEN r = 3 THEN 'aggregator3' ELSE 'name' || r END AS name, 'tool' || (r % 4) AS tool FROM range(0, 10) t(r)),
tl AS (SELECT *, last_value(CASE WHEN et = 'tool_call' THEN {'tool': tool, 't': t} END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lt, last_value(CASE WHEN et = 'prediction_result' THEN name END IGNORE NULLS) OVER (PARTITION BY run_id, resource ORDER BY ord) AS known FROM e),
ok AS (SELECT * FROM tl WHERE NOT (et = 'resource_consumed' AND known IS NOT NULL AND lt IS NOT NULL AND abs(t - lt.t) < 0.25 AND NOT EXISTS (SELECT 1 FROM cons WHERE cons.name = known AND cons.tool = lt.tool))),
lv AS (SELECT *, coalesce(max(CASE WHEN et = 'prefetch_started' THEN ord END) OVER w, min(CASE WHEN et <> 'resource_consumed' THEN ord END) OVER w) AS since FROM ok WHERE et IN ('prefetch_started', 'prefetch_completed', 'prefetch_cancelled', 'resource_consumed') WINDOW w AS (PARTITION BY run_id, task)),
tk AS (SELECT run_id, task, max_by(t, ord) FILTER (et = 'prefetch_started') AS st, coalesce(max_by(resource, ord) FILTER (et = 'prefetch_started'), '') AS rid, max_by(elapsed, ord) FILTER (et = 'prefetch_completed') AS el, max_by(t, ord) FILTER (et = 'prefetch_completed') AS en, max_by(staged, ord) FILTER (et = 'prefetch_completed' AND staged IS NOT NULL) AS staged,
  max_by(t, ord) FILTER (et = 'prefetch_cancelled') AS ca, max_by(even, ord) FILTER (et = 'prefetch_cancelled') AS wasted, max_by(t, ord) FILTER (et = 'resource_consumed') AS us, max_by(status, ord) FILTER (et = 'resource_consumed') AS status FROM lv WHERE ord >= since GROUP BY ALL),
tm AS (SELECT tk.*, CASE WHEN en IS NOT NULL THEN CASE WHEN st IS NOT NULL AND el > 0 THEN st + el ELSE en END END AS done, m FROM tk LEFT JOIN pr ON pr.run_id = tk.run_id AND pr.resource = tk.rid),
ur AS (SELECT DISTINCT run_id, rid FROM tm WHERE status = 'used'),
cl AS (SELECT tm.*, CASE WHEN status = 'used' THEN CASE WHEN done > us + 0.5 THEN 'late' ELSE 'useful' END WHEN wasted THEN 'wasted' WHEN ca IS NOT NULL THEN 'cancelled' WHEN done IS NOT NULL THEN CASE WHEN ur.rid IS NOT NULL THEN 'duplicate' ELSE 'wasted' END ELSE 'pending' END AS outcome,
  CASE WHEN staged IS NOT NULL THEN staged WHEN coalesce(m.size, 0) <> 0 THEN m.size ELSE 0 END AS bytes, CASE WHEN staged IS NOT NULL THEN 'measured' WHEN coalesce(m.size, 0) <> 0 THEN 'estimated' ELSE 'unknown' END AS src FROM tm LEFT JOIN ur ON ur.run_id = tm.run_id AND ur.rid = tm.rid)
"""


@query(_TASKS + "SELECT run_id, task, rid AS resource, outcome, round(done, 4) AS completed_t, round(us, 4) AS consumed_t, bytes, src AS byte_source, coalesce(m.name, substr(rid, 1, 12)) AS name FROM cl")
def task_outcomes(spark, d):
    """Tasks of the traces with outcome and bytes."""
    got = analyze.tasks(written(spark, d), consumers=consumers(spark, d))
    return got.select("run_id", "task", "resource", "outcome", F.round("completed_t", 4).alias("completed_t"), F.round("consumed_t", 4).alias("consumed_t"), "bytes", "byte_source", "name")


_RUNS = _TASKS + """, fd AS (SELECT run_id, min(t) AS bad FROM e WHERE et = 'divergence_detected' GROUP BY run_id),
x AS (SELECT cl.*, outcome IN ('useful', 'late') AS met, CASE WHEN outcome IN ('useful', 'late') AND st IS NOT NULL THEN greatest(0, least(coalesce(done, us), us) - st) END AS ov, CASE WHEN outcome IN ('useful', 'late') AND st IS NOT NULL AND done IS NOT NULL THEN greatest(0, done - us) END AS res, coalesce(m.type, '') = 'vllm_model' AS model, coalesce(m.name, substr(rid, 1, 12)) LIKE '%aggregator%' AS agg, fd.bad FROM cl LEFT JOIN fd USING (run_id)),
pt AS (SELECT run_id, count(*) AS n_admitted, count(*) FILTER (outcome = 'useful') AS n_useful, count(*) FILTER (outcome = 'late') AS n_late, count(*) FILTER (outcome = 'wasted') AS n_wasted, count(*) FILTER (outcome = 'cancelled') AS n_cancelled, count(*) FILTER (outcome = 'duplicate') AS n_duplicate, count(*) FILTER (outcome = 'pending') AS n_pending,
  sum(ov) AS ov, max(res) FILTER (model AND NOT agg) AS rs, max(res) FILTER (model AND agg) AS ra, sum(res) FILTER (NOT model) AS ro, avg(us - st) FILTER (met) AS lead, count(DISTINCT rid) FILTER (status = 'used') AS n_served, count(DISTINCT rid) FILTER (outcome = 'useful') AS n_on_time,
  sum(bytes) FILTER (met) AS ub, sum(bytes) FILTER (outcome = 'wasted') AS wb, sum(bytes) FILTER (outcome = 'cancelled' AND staged IS NOT NULL) AS cb, string_agg(DISTINCT src, '+' ORDER BY src) FILTER (src <> 'unknown') AS byte_source, count(*) FILTER (outcome = 'wasted' AND NOT coalesce(m.safe, true)) AS n_wn, count(*) FILTER (outcome IN ('wasted', 'cancelled') AND bad IS NOT NULL AND coalesce(st, 0) >= bad) AS n_wa, sum(el) AS sp FROM x GROUP BY run_id),
ct AS (SELECT run_id, count(*) FILTER (et = 'prediction_result') AS n_predicted, count(*) FILTER (et = 'prefetch_decision' AND NOT even) AS n_skipped, count(*) FILTER (et = 'prediction_validated' AND even) AS n_hits, count(*) FILTER (et = 'prediction_validated' AND NOT even) AS n_misses, count(*) FILTER (et = 'divergence_detected') AS n_divergences,
  coalesce(sum(x) FILTER (et = 'worker_swap_wait'), 0) AS sw, coalesce(sum(x) FILTER (et = 'aggregator_swap_wait'), 0) AS aw, CAST(3 * count(*) FILTER (et = 'conservative_mode') AS BIGINT) AS conservative_steps FROM e GROUP BY run_id),
f1 AS (SELECT run_id, resource, min_by(x, ord) AS est FROM e WHERE et = 'prediction_result' GROUP BY ALL), np AS (SELECT e.run_id, sum(est) AS cold FROM e JOIN f1 USING (run_id, resource) WHERE et = 'resource_consumed' AND status = 'no_prefetch' GROUP BY ALL),
ms AS (SELECT e.run_id, count(DISTINCT cons.name) AS n_missed FROM e JOIN cons ON cons.tool = e.tool WHERE et = 'tool_call' AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.run_id = e.run_id AND coalesce(cl.m.name, substr(cl.rid, 1, 12)) = cons.name) GROUP BY e.run_id),
al AS (SELECT ct.*, coalesce(pt.n_admitted, 0) AS n_admitted, coalesce(n_useful, 0) AS n_useful, coalesce(n_late, 0) AS n_late, coalesce(n_wasted, 0) AS n_wasted, coalesce(n_cancelled, 0) AS n_cancelled, coalesce(n_duplicate, 0) AS n_duplicate, coalesce(n_pending, 0) AS n_pending, coalesce(ov, 0) AS ov, coalesce(rs, 0) AS rs, coalesce(ra, 0) AS ra, coalesce(ro, 0) AS ro, lead, coalesce(n_served, 0) AS n_served, coalesce(n_on_time, 0) AS n_on_time, coalesce(ub, 0) AS ub, coalesce(wb, 0) AS wb, coalesce(cb, 0) AS cb, coalesce(byte_source, 'unknown') AS byte_source, coalesce(n_wn, 0) AS n_wn, coalesce(n_wa, 0) AS n_wa, coalesce(sp, 0) AS sp, coalesce(cold, 0) AS cold, coalesce(n_missed, 0) AS n_missed FROM ct LEFT JOIN pt USING (run_id) LEFT JOIN np USING (run_id) LEFT JOIN ms USING (run_id)),
ex AS (SELECT *, greatest(sw, rs) + greatest(aw, ra) + ro + cold AS exposed FROM al)
"""


def evaluated(spark, d):
    return analyze.evaluate(written(spark, d), consumers=consumers(spark, d))


@query(_RUNS + "SELECT run_id, round(ov, 4) AS overlap_s, round(sw, 4) AS swap_wait_s, round(aw, 4) AS agg_wait_s, round(rs, 4) AS residual_swap_s, round(ra, 4) AS residual_agg_s, round(ro, 4) AS residual_other_s, round(cold, 4) AS no_prefetch_stall_s, round(exposed, 4) AS exposed_stall_s, round(ov / nullif(ov + exposed, 0), 5) AS overlap_recovered FROM ex")
def run_stalls(spark, d):
    """Q2, the exposed stall of each run and its parts."""
    seconds = ("overlap_s", "swap_wait_s", "agg_wait_s", "residual_swap_s", "residual_agg_s", "residual_other_s", "no_prefetch_stall_s", "exposed_stall_s")
    return evaluated(spark, d).select("run_id", *[F.round(c, 4).alias(c) for c in seconds], F.round("overlap_recovered", 5).alias("overlap_recovered"))


@query(_RUNS + """SELECT run_id, n_predicted, n_admitted, n_skipped, n_useful, n_late, n_wasted, n_cancelled, n_duplicate, n_pending, n_missed, n_hits, n_misses, n_divergences, greatest(0, n_predicted - n_hits - n_misses - n_divergences - n_admitted) AS n_expired, round(lead, 4) AS mean_lead_s,
  round((n_useful + n_late + n_duplicate) / nullif(n_admitted - n_cancelled, 0), 6) AS precision, round(n_served / nullif(n_served + n_missed, 0), 6) AS recall, round(n_on_time / nullif(n_served, 0), 6) AS on_time_rate FROM ex""")
def run_predictions(spark, d):
    """Q3, outcomes, lead times and rates of each run."""
    counts = ("n_predicted", "n_admitted", "n_skipped", "n_useful", "n_late", "n_wasted", "n_cancelled", "n_duplicate", "n_pending", "n_missed", "n_hits", "n_misses", "n_divergences", "n_expired")
    return evaluated(spark, d).select("run_id", *[F.col(c).cast("bigint").alias(c) for c in counts], F.round("mean_lead_s", 4).alias("mean_lead_s"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "on_time_rate")])


@query(_RUNS + "SELECT run_id, ub AS useful_bytes, wb AS wasted_bytes, cb AS cancelled_bytes, byte_source, n_wn AS n_wasted_noncancellable, n_wa AS n_wrong_after, round(sp, 4) AS speculative_read_s, conservative_steps FROM ex")
def run_bytes(spark, d):
    """Q4, the bytes of each run and what was spent in vain."""
    return evaluated(spark, d).select("run_id", "useful_bytes", "wasted_bytes", "cancelled_bytes", "byte_source", "n_wasted_noncancellable", "n_wrong_after", F.round("speculative_read_s", 4).alias("speculative_read_s"), "conservative_steps")


@query(_TASKS + """, fp AS (SELECT run_id, resource, min_by({'t': t, 'name': name, 'type': type, 'est': x, 'cons': tool}, (t, ord)) AS p FROM e WHERE et = 'prediction_result' GROUP BY ALL),
fd AS (SELECT run_id, resource, min_by({'t': t, 'even': even, 'reason': reason, 'est': x}, (t, ord)) AS d FROM e WHERE et = 'prefetch_decision' GROUP BY ALL),
g0 AS (SELECT run_id, name, t AS t_exit, x AS wait, CASE et WHEN 'worker_swap_wait' THEN 'swap_wait' ELSE 'agg_wait' END AS gate, et <> 'worker_swap_wait' AS agg, row_number() OVER (PARTITION BY run_id, et ORDER BY ord) - 1 AS n, direct FROM e WHERE et IN ('worker_swap_wait', 'aggregator_swap_wait')),
gt AS (SELECT *, gate || ':' || name || ':' || n AS grp FROM g0),
ta AS (SELECT cl.*, coalesce(m.name, substr(rid, 1, 12)) AS name, coalesce(m.type, '') AS type, fp.p, fd.d FROM cl LEFT JOIN fp ON fp.run_id = cl.run_id AND fp.resource = cl.rid LEFT JOIN fd ON fd.run_id = cl.run_id AND fd.resource = cl.rid),
tg AS (SELECT ta.run_id, ta.task, coalesce(min_by({'grp': grp, 'gate': gate, 'need': t_exit - wait, 'wait': wait}, (t_exit, agg, n)) FILTER (t_exit >= st - 1), max_by({'grp': grp, 'gate': gate, 'need': t_exit - wait, 'wait': wait}, (t_exit, agg, n))) AS g FROM ta JOIN gt ON gt.run_id = ta.run_id AND gt.name = ta.name WHERE ta.type = 'vllm_model' GROUP BY ALL),
nd AS (SELECT fp.run_id, fp.resource, min(e.t) AS need FROM fp JOIN e ON e.run_id = fp.run_id AND e.et = 'tool_call' AND e.tool = fp.p.cons AND e.t >= fp.p.t GROUP BY ALL),
t1 AS (SELECT ta.*, tg.g, nd.need AS called FROM ta LEFT JOIN tg USING (run_id, task) LEFT JOIN nd ON nd.run_id = ta.run_id AND nd.resource = ta.rid),
mk AS (SELECT run_id, rid AS resource, name, type, outcome, CASE WHEN g IS NOT NULL THEN g.gate WHEN us IS NOT NULL THEN 'consumed' WHEN called IS NOT NULL THEN 'consumer_tool_call' ELSE 'none' END AS need_source, CASE WHEN g IS NOT NULL THEN g.need WHEN us IS NOT NULL THEN us ELSE called END AS need, CASE WHEN g IS NOT NULL THEN g.wait WHEN us IS NOT NULL OR called IS NOT NULL THEN CASE WHEN done IS NOT NULL THEN greatest(0, done - coalesce(us, called)) END ELSE 0 END AS exposure,
  coalesce(p.t, st) AS predicted, st, el AS transfer, m.est AS est, coalesce(d.reason, '') AS reason, coalesce(g.grp, '') AS grp FROM t1),
sk AS (SELECT fd.run_id, fd.resource, CASE WHEN fp.p IS NULL THEN substr(fd.resource, 1, 12) ELSE fp.p.name END AS name, coalesce(fp.p.type, '') AS type, 'skipped' AS outcome, CASE WHEN nd.need IS NOT NULL THEN 'consumer_tool_call' ELSE 'none' END AS need_source, nd.need, CASE WHEN nd.need IS NOT NULL THEN CASE WHEN coalesce(fp.p.est, 0) <> 0 THEN fp.p.est ELSE fd.d.est END ELSE 0 END AS exposure, fp.p.t AS predicted, NULL AS st, NULL AS transfer, NULL AS est, fd.d.reason, '' AS grp
  FROM fd LEFT JOIN fp USING (run_id, resource) LEFT JOIN nd USING (run_id, resource) WHERE NOT fd.d.even AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.run_id = fd.run_id AND cl.rid = fd.resource)),
lo AS (SELECT run_id, '' AS resource, name, 'vllm_model' AS type, CASE WHEN direct THEN 'direct_prefetch' ELSE 'no_prediction' END AS outcome, gate AS need_source, t_exit - wait AS need, wait AS exposure, NULL AS predicted, NULL AS st, NULL AS transfer, NULL AS est, '' AS reason, grp FROM gt WHERE NOT EXISTS (SELECT 1 FROM mk WHERE mk.run_id = gt.run_id AND mk.grp = gt.grp)),
ba AS (SELECT e.run_id, e.resource, CASE WHEN fp.p IS NULL THEN substr(e.resource, 1, 12) ELSE fp.p.name END AS name, coalesce(fp.p.type, '') AS type, 'no_prediction' AS outcome, 'consumed' AS need_source, e.t AS need, fp.p.est AS exposure, NULL AS predicted, NULL AS st, NULL AS transfer, NULL AS est, '' AS reason, '' AS grp FROM e LEFT JOIN fp USING (run_id, resource) WHERE et = 'resource_consumed' AND status = 'no_prefetch' AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.run_id = e.run_id AND cl.rid = e.resource AND cl.us IS NOT NULL)),
al AS (SELECT *, need - predicted AS w, CASE WHEN coalesce(transfer, 0) <> 0 THEN transfer ELSE coalesce(est, 0) END + CASE WHEN type = 'vllm_model' THEN 30 ELSE 0 END AS full_load, st - predicted AS delay FROM (SELECT * FROM mk UNION ALL SELECT * FROM sk UNION ALL SELECT * FROM lo UNION ALL SELECT * FROM ba))
SELECT run_id, resource, name, type, outcome, need_source, round(exposure, 4) AS exposure_s, round(w, 4) AS window_s, CASE WHEN coalesce(exposure, 0) <= 0.1 THEN '' WHEN outcome = 'no_prediction' THEN 'no_prediction' WHEN outcome = 'skipped' THEN 'policy_skip:' || reason WHEN outcome = 'direct_prefetch' THEN 'residual_partial' WHEN w IS NULL THEN 'unattributed' WHEN w < 15 THEN 'no_window' WHEN w < full_load THEN 'window_too_small' WHEN w - delay < full_load THEN 'late_start' ELSE 'residual_partial' END AS stall_class FROM al""")
def trial_rows(spark, d):
    """What each run fetched, skipped and missed."""
    got = trials.trial_rows(written(spark, d), consumers=consumers(spark, d))
    return got.select("run_id", "resource", "name", "type", "outcome", "need_source", F.round("exposure_s", 4).alias("exposure_s"), F.round("window_s", 4).alias("window_s"), "stall_class")


# --- run trees, tables, registries ------------------------------------------------------------------------------------


@query("SELECT 'w' || n_regionkey AS workload, 'run' || n_nationkey AS run_id, CAST(n_nationkey AS INT) AS trial_index, n_name AS node, n_nationkey * 1.5::DOUBLE AS wall_time_s FROM nation WHERE n_nationkey % 7 <> 0")
def run_tree(spark, d):
    """Metas under runs/workload/config/trial; unreadable ones fall away."""
    root, k = scratch.folder(spark, "runs"), F.col("n_nationkey")
    meta = F.to_json(F.struct(F.concat(F.lit("w"), F.col("n_regionkey").cast("string")).alias("workload"), F.concat(F.lit("run"), k.cast("string")).alias("run_id"), k.alias("trial_index"), F.col("n_name").alias("node"), (k * 1.5).alias("wall_time_s"), F.lit(1).alias("unknown")))
    rows = table(spark, d, "nation").select(F.when(k % 7 == 0, "{broken").otherwise(meta).alias("value"), F.col("n_regionkey").alias("w"), (k % 2).alias("c"), k.alias("t"))
    rows.write.partitionBy("w", "c", "t").text(f"{root}/runs")
    return traces.discover_runs(spark, root, "part-*").select("workload", "run_id", "trial_index", "node", "wall_time_s")


@query("SELECT 'run' || n_nationkey AS run_id, n_nationkey * 2 AS hits, n_name AS node FROM nation WHERE n_nationkey % 7 <> 0")
def summaries(spark, d):
    """Summaries written as JSON texts and loaded; unreadable ones fall away."""
    path, k = scratch.folder(spark, "summaries"), F.col("n_nationkey")
    rows = table(spark, d, "nation").select(F.concat(F.lit("run"), k.cast("string")).alias("run_id"), (k * 2).alias("hits"), F.col("n_name").alias("node"), k)
    text = sinks.as_json(rows.drop("n_nationkey")).withColumnRenamed("json", "value")
    joined = rows.join(text.withColumn("run_id", F.get_json_object("value", "$.run_id")), "run_id").select(F.when(k % 7 == 0, "{broken").otherwise(F.col("value")).alias("value"), k.alias("t"))
    joined.write.partitionBy("t").text(path)
    return traces.load_summaries(spark, path, "run_id string, hits bigint, node string").select("run_id", "hits", "node")


def phases_csv(spark, d):
    """Three phases and two summary rows a run, a file each."""
    path, k = scratch.folder(spark, "metrics"), F.col("n_nationkey")
    x = table(spark, d, "nation").select(k.cast("bigint").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j"))
    at = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("j") * 100 + F.col("k")), "yyyy-MM-dd'T'HH:mm:ss")
    phase = F.when(F.col("j") > 2, "SUMMARY").when(F.col("j") == 0, "load:model").when(F.col("j") == 1, "llm").otherwise("agent:x")
    rows = x.select(F.concat(F.lit("run"), F.col("k").cast("string")).alias("run_id"), "j", phase.alias("phase"), at.alias("timestamp"), F.when(F.col("k") % 5 == 0, "x").otherwise((F.col("k") + F.col("j") * 10).cast("string")).alias("duration_s"), F.when(F.col("k") % 3 == 0, "7.0").otherwise((F.col("k") * 100 + F.col("j")).cast("string")).alias("total_tokens"), F.concat(F.lit("a=1 b="), F.col("k").cast("string"), F.lit(" skip a="), F.col("j").cast("string")).alias("notes"), F.col("k").alias("f"))
    rows.repartition("f").sortWithinPartitions("f", "j").drop("j").write.partitionBy("f").option("header", True).csv(path)
    return path


@query("SELECT 'run' || n_nationkey AS run_id, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey + 30.0::DOUBLE END AS duration_s, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey * 100 + 3 END AS total_tokens, '3' AS a, CAST(n_nationkey AS VARCHAR) AS b FROM nation")
def metrics_summaries(spark, d):
    """Each file's first summary row, with lenient numbers and its notes."""
    got = traces.load_metrics_csv(spark, phases_csv(spark, d))
    return got.select("run_id", "duration_s", "total_tokens", F.col("notes_map")["a"].alias("a"), F.col("notes_map")["b"].alias("b"))


@query("""WITH p AS (SELECT n_nationkey AS k, unnest([0, 1, 2]) AS j FROM nation), q AS (SELECT k, j, j * 100 + k AS e, CASE WHEN k % 5 = 0 THEN 0 ELSE k + j * 10 END AS d FROM p), z AS (SELECT k, min_by(e - d, j) AS zero FROM q GROUP BY k)
SELECT k, ['load', 'llm', 'agent'][j + 1] AS kind, CAST(e - d - zero AS DOUBLE) AS start, CAST(e - zero AS DOUBLE) AS "end" FROM q JOIN z USING (k)""")
def phase_intervals(spark, d):
    """Phases as intervals from the start of each file's first row."""
    got = traces.load_phases(spark, phases_csv(spark, d))
    return got.select(F.regexp_extract("file", "f=([0-9]+)", 1).cast("bigint").alias("k"), "kind", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query("SELECT s_suppkey AS t_rel_s, CAST(unnest([0, 1]) AS INT) AS gpu, unnest([CASE WHEN s_acctbal >= 0 THEN round(s_acctbal) END, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey * 1.0::DOUBLE END]) AS value FROM supplier")
def profile_metrics(spark, d):
    """A profile CSV in long form; negative and unparsable readings are null."""
    path = scratch.folder(spark, "profile")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("t_rel_s"), F.col("s_acctbal").alias("gpu0_util_pct"), F.when(F.col("s_suppkey") % 3 == 0, "oops").otherwise(F.col("s_nationkey").cast("string")).alias("gpu1_util_pct"))
    sinks.write_table(s, path)
    return traces.load_profile(spark, path).select(F.col("t_rel_s").cast("bigint").alias("t_rel_s"), "gpu", F.round("value").alias("value"))  # whole: what rounds to -0 is negative


@query("SELECT n_name AS resource, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey * 0.5::DOUBLE END AS load_s, n_nationkey % 2 = 0 AS hit FROM nation")
def timing_records(spark, d):
    """Timing records appended to a CSV and read with nulls and flags."""
    path, k = scratch.folder(spark, "timing"), F.col("n_nationkey")
    rows = table(spark, d, "nation").select(F.col("n_name").alias("resource"), F.when(k % 4 > 0, (k * 0.5).cast("string")).otherwise("").alias("load_s"), F.when(k % 2 == 0, "True").otherwise("false").alias("hit"), k)
    for half in (k < 12, k >= 12):
        sinks.append_csv(rows.where(half).drop("n_nationkey"), path)
    return traces.load_timings(spark, path, ["load_s"], ["hit"]).select("resource", "load_s", "hit")


@query("SELECT n_name AS name, CASE WHEN n_regionkey = 1 THEN NULL ELSE n_regionkey END AS a, CASE WHEN n_regionkey = 1 THEN n_nationkey END AS b FROM nation WHERE n_regionkey < 3")
def union_of_columns(spark, d):
    """K3: rows of several shapes in one CSV, with the union of their columns."""
    path, n = scratch.folder(spark, "union"), table(spark, d, "nation")
    of = lambda cond, c, name: n.where(cond).select(F.col("n_name").alias("name"), F.col(c).cast("bigint").alias(name))
    sinks.write_table(sinks.union_rows(of("n_regionkey = 0", "n_regionkey", "a"), of("n_regionkey = 1", "n_nationkey", "b"), of("n_regionkey = 2", "n_regionkey", "a")), path)
    return spark.read.option("header", True).csv(path).select("name", F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))


@query("SELECT n_name AS name, n_regionkey AS region, row_number() OVER (ORDER BY n_regionkey, n_name) AS place FROM nation")
def report_rows(spark, d):
    """K4, K9: a report of fixed columns in a fixed order (it has a row a run and is one file)."""
    path = scratch.folder(spark, "report")
    sinks.write_report_csv(table(spark, d, "nation"), ["n_regionkey", "n_name"], ["n_regionkey", "n_name"], path)
    got = traces.numbered(spark.read.option("header", True).csv(path))
    return got.select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("region"), (F.col("line_no") + 1).alias("place"))


@query(_PAIRS + "SELECT source, CAST(off AS INT) AS off, target, prob, cnt, rank FROM x")
def transitions_reloaded(spark, d):
    """A learned transition table saved as JSON and loaded again."""
    from .more_queries import likely

    path = scratch.folder(spark, "transitions")
    sinks.transitions_json(likely(spark, d)).withColumnRenamed("json", "value").write.text(path)
    return traces.load_transitions(spark, path).select("source", "off", "target", "prob", "cnt", "rank")


@query("SELECT n_name AS name, 'tool' || n_regionkey AS consumer_tool, 'R' || n_nationkey AS resource_id, n_nationkey / 25.0::DOUBLE AS confidence FROM nation WHERE n_nationkey % 6 <> 0 AND n_nationkey % 5 <> 0")
def registry_entries(spark, d):
    """A registry's JSON array; comments and entries without a consumer fall away."""
    return traces.load_registry(spark, registry_json(spark, d)).select("name", "consumer_tool", "resource_id", "confidence")


@query("SELECT 'tool' || n_regionkey AS tool, string_agg(n_name, '+' ORDER BY n_nationkey) AS names FROM nation WHERE n_nationkey % 5 <> 0 GROUP BY 1")
def registry_consumers(spark, d):
    """The resources of each consumer, in the file's order; commented entries stay."""
    got = traces.consumer_map(spark, registry_json(spark, d))
    return got.select("tool", F.array_join("names", "+").alias("names"))


def registry_json(spark, d):
    path, k = scratch.folder(spark, "registry"), F.col("n_nationkey")
    entry = F.to_json(F.struct(F.when(k % 6 == 0, "a comment").alias("_comment"), F.col("n_name").alias("name"), F.when(k % 5 != 0, F.concat(F.lit("tool"), F.col("n_regionkey").cast("string"))).alias("consumer_tool"), F.concat(F.lit("R"), k.cast("string")).alias("resource_id"), (k / 25).alias("confidence"), F.lit(3).alias("unknown")))
    all_ = table(spark, d, "nation").agg(F.transform(F.array_sort(F.collect_list(F.struct(k, entry.alias("e")))), lambda x: x["e"]).alias("e"))
    all_.select(F.concat(F.lit("["), F.array_join("e", ","), F.lit("]")).alias("value")).write.text(path)
    return path
