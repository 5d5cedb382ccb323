"""Queries on task lifecycles, run metrics, rollups and rankings over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import asof, lifecycle, metrics, ordering, predict, sequences
from ..sources.sinks import union_rows, validation_report
from ..streaming import guard
from .base import ET, ORD, E, long, query, rounded, table, trace

KINDS = {"started": "view", "completed": "click", "cancelled": "error", "consumed": "purchase"}
KEY = ["run_id"]

_TASKS = ET[:-1] + """, j AS (SELECT run_id, task,
    max(ord) FILTER (kind = 'view') AS so, max_by(t, ord) FILTER (kind = 'view') AS started_t, max_by(resource, ord) FILTER (kind = 'view') AS resource,
    max(ord) FILTER (kind = 'click') AS co, max_by(t, ord) FILTER (kind = 'click') AS completed_t,
    max(ord) FILTER (kind = 'error') AS xo, max_by(t, ord) FILTER (kind = 'error') AS cancelled_t,
    max(ord) FILTER (kind = 'purchase') AS uo, max_by(t, ord) FILTER (kind = 'purchase') AS consumed_t FROM r GROUP BY ALL),
tasks AS (SELECT run_id, task, resource, started_t, CASE WHEN co > so THEN completed_t END AS completed_t, CASE WHEN xo > so THEN cancelled_t END AS cancelled_t,
    CASE WHEN uo > so THEN consumed_t END AS consumed_t FROM j WHERE so IS NOT NULL)
"""


def tasks_of(spark, d, stubs=False):
    return lifecycle.tasks(trace(spark, d), KEY, **KINDS, stubs=stubs)


@query(_TASKS + "SELECT * FROM tasks")
def lifecycle_join(spark, d):
    """One row a task; what precedes its last start does not count."""
    return tasks_of(spark, d)


@query(_TASKS + "SELECT run_id, task, resource, started_t, completed_t, cancelled_t, consumed_t FROM j WHERE coalesce(so, co, xo, uo) IS NOT NULL")
def lifecycle_stubs(spark, d):
    """Tasks without a start are kept as stubs."""
    return tasks_of(spark, d, stubs=True)


_RES = ET[:-1] + """, c AS (SELECT *, last_value(CASE WHEN kind = 'view' THEN task END IGNORE NULLS) OVER (PARTITION BY run_id, resource ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM r),
x AS (SELECT run_id, resource, max_by(task, ord) FILTER (kind = 'view') AS task, max_by(t, ord) FILTER (kind = 'view') AS started_t,
    max_by(t, ord) FILTER (kind = 'click' AND task = cur) AS completed_t, max_by(t, ord) FILTER (kind = 'purchase') AS consumed_t FROM c GROUP BY ALL),
res AS (SELECT * FROM x WHERE started_t IS NOT NULL),
est AS (SELECT run_id, resource, max_by(cents, ord) AS est FROM r WHERE kind = 'signup' GROUP BY ALL)
"""


def resources_of(spark, d):
    e = trace(spark, d)
    est = asof.last_per_key(e.where("kind = 'signup'"), ["run_id", "resource"], ["ord"], ["cents"]).withColumnRenamed("cents", "est")
    return lifecycle.resource_timings(e, KEY, "view", "click", "purchase").join(est, ["run_id", "resource"], "left")


@query(_RES + "SELECT * FROM res")
def resource_timings(spark, d):
    """Timings by resource; a restart keeps the older completion."""
    return lifecycle.resource_timings(trace(spark, d), KEY, "view", "click", "purchase")


@query(_RES + "SELECT res.*, est.est FROM res LEFT JOIN est USING (run_id, resource)")
def last_meta_enrich(spark, d):
    """Resources with their last estimate."""
    return resources_of(spark, d)


@query(_RES + """, q AS (SELECT run_id, CAST(CASE WHEN consumed_t IS NOT NULL THEN greatest(0, least(coalesce(completed_t, consumed_t), consumed_t) - started_t) ELSE 0 END AS BIGINT) AS overlap,
  CASE WHEN consumed_t IS NOT NULL AND completed_t IS NOT NULL THEN greatest(0, completed_t - consumed_t) ELSE 0 END AS stall,
  CASE WHEN consumed_t IS NULL AND completed_t IS NOT NULL THEN completed_t - started_t ELSE 0 END AS unused, consumed_t, est * 10000 AS est FROM res LEFT JOIN est USING (run_id, resource))
SELECT run_id, CAST(sum(overlap) AS BIGINT) AS overlap, CAST(sum(stall) AS BIGINT) AS stall, CAST(sum(CASE WHEN consumed_t IS NOT NULL AND est IS NOT NULL THEN greatest(0, est - stall) ELSE 0 END) AS BIGINT) AS est_benefit, CAST(sum(unused) AS BIGINT) AS unused_load FROM q GROUP BY run_id""")
def resource_totals(spark, d):
    """A3: overlap, stall, benefit and unused load by the analyzer's clock."""
    parts = metrics.stall_and_benefit(F.col("started_t"), F.col("completed_t"), F.col("consumed_t"), F.col("est") * 10_000)
    return resources_of(spark, d).groupBy("run_id").agg(*[F.sum(c).cast("bigint").alias(n) for n, c in parts.items()])


@query(_TASKS + """, x AS (SELECT *, started_t IS NOT NULL AND completed_t IS NOT NULL AND consumed_t IS NOT NULL AND cancelled_t IS NULL AS known FROM tasks)
SELECT run_id, CAST(sum(CASE WHEN known THEN greatest(0, least(completed_t, consumed_t) - started_t) ELSE 0 END) AS BIGINT) AS overlap,
  CAST(sum(CASE WHEN known THEN greatest(0, consumed_t - completed_t) ELSE 0 END) AS BIGINT) AS slack, CAST(sum(CASE WHEN known THEN greatest(0, completed_t - consumed_t) ELSE 0 END) AS BIGINT) AS late,
  CAST(count(*) FILTER (consumed_t IS NOT NULL) AS BIGINT) AS used, CAST(count(*) FILTER (cancelled_t IS NOT NULL) AS BIGINT) AS cancelled FROM x GROUP BY run_id""")
def task_timing(spark, d):
    """Overlap, slack and lateness of tasks, summed per run."""
    parts = metrics.task_timing(F.col("started_t"), F.col("completed_t"), F.col("consumed_t"), F.col("cancelled_t").isNotNull(), F.lit(False))
    return tasks_of(spark, d).groupBy("run_id").agg(*[F.sum(c).cast("bigint").alias(n) for n, c in parts.items()], F.count("consumed_t").alias("used"), F.count("cancelled_t").alias("cancelled"))


@query(_TASKS + """SELECT run_id, CAST(sum(CASE WHEN started_t IS NULL OR consumed_t IS NULL THEN 0 ELSE greatest(0, coalesce(least(completed_t, consumed_t), consumed_t) - started_t) END) AS BIGINT) AS overlap,
  CAST(sum(CASE WHEN completed_t IS NULL OR consumed_t IS NULL THEN 0 ELSE greatest(0, completed_t - consumed_t) END) AS BIGINT) AS residual,
  round(sum(CASE WHEN consumed_t IS NULL THEN 0 ELSE greatest(0, coalesce(least(completed_t, consumed_t), consumed_t) - started_t) END)
    / nullif(sum(CASE WHEN consumed_t IS NULL THEN 0 ELSE greatest(0, coalesce(least(completed_t, consumed_t), consumed_t) - started_t) + greatest(0, coalesce(completed_t, consumed_t) - consumed_t) END), 0), 6) AS recovered
FROM tasks GROUP BY run_id""")
def overlap_recovered(spark, d):
    """Overlapped and residual load of used tasks; their share recovered, null on 0."""
    end = F.coalesce(F.when(F.col("completed_t").isNotNull() & F.col("consumed_t").isNotNull(), F.least("completed_t", "consumed_t")), F.col("consumed_t"))
    over = F.when(F.col("consumed_t").isNotNull(), F.greatest(F.lit(0), end - F.col("started_t"))).otherwise(0)
    late = F.when(F.col("consumed_t").isNotNull() & F.col("completed_t").isNotNull(), F.greatest(F.lit(0), F.col("completed_t") - F.col("consumed_t"))).otherwise(0)
    s = tasks_of(spark, d).groupBy("run_id").agg(F.sum(over).cast("bigint").alias("overlap"), F.sum(late).cast("bigint").alias("residual"))
    return s.withColumn("recovered", F.round(metrics.ratio(F.col("overlap"), F.col("overlap") + F.col("residual")), 6))


@query(E[:-1] + """, c AS (SELECT run_id, count(*) FILTER (kind = 'signup') AS made, count(*) FILTER (kind = 'purchase') AS hits, count(*) FILTER (kind = 'click' AND k % 5 = 0) AS failed,
  count(*) FILTER (kind = 'error') AS divergences, count(*) FILTER (kind = 'view') AS started FROM e GROUP BY run_id)
SELECT run_id, made, hits, failed + divergences AS misses, started, divergences, round(hits / nullif(hits + failed + divergences, 0), 6) AS precision,
  round((hits + failed + divergences) / nullif(made, 0), 6) AS coverage, round(hits / nullif(made, 0), 6) AS honest FROM c""")
def run_summary(spark, d):
    """A1, A2: counters of a run and its three rates; a divergence is a miss too."""
    kind = F.col("kind")
    n = trace(spark, d).groupBy("run_id").agg(F.count_if(kind == "signup").alias("made"), F.count_if(kind == "purchase").alias("hits"), F.count_if(((kind == "click") & (F.col("k") % 5 == 0)) | (kind == "error")).alias("misses"), F.count_if(kind == "view").alias("started"), F.count_if(kind == "error").alias("divergences"))
    rates = metrics.prediction_quality(F.col("hits"), F.col("misses"), F.col("made"))
    return n.select("*", *rates).withColumns({c: F.round(c, 6) for c in ("precision", "coverage", "honest")})


@query(ET[:-1] + """, p AS (SELECT run_id, k % 7 AS step, max_by(k, ord) AS predictor FROM r WHERE kind = 'signup' GROUP BY ALL)
SELECT r.run_id, r.ord, coalesce(CAST(p.predictor AS VARCHAR), 'mock') AS predictor FROM r LEFT JOIN p ON p.run_id = r.run_id AND p.step = r.k % 7 WHERE r.kind = 'view'""")
def step_predictor(spark, d):
    """The last predictor of a step; mock where there is none."""
    e = trace(spark, d).withColumn("step", F.col("k") % 7)
    last = asof.last_per_key(e.where("kind = 'signup'"), ["run_id", "step"], ["ord"], ["k"]).withColumnRenamed("k", "p")
    return e.where("kind = 'view'").join(last, ["run_id", "step"], "left").select("run_id", "ord", F.coalesce(F.col("p").cast("string"), F.lit("mock")).alias("predictor"))


@query(ET[:-1] + """, c AS (SELECT run_id, k % 7 AS step, max_by(k, ord) AS checkpoint FROM r WHERE kind = 'view' GROUP BY ALL),
v AS (SELECT run_id, k AS checkpoint, min_by(cents % 2 = 0, ord) AS hit FROM r WHERE kind = 'purchase' GROUP BY ALL), x AS (SELECT run_id, k AS checkpoint, min(ord) AS ord FROM r WHERE kind = 'error' GROUP BY ALL)
SELECT p.run_id, p.ord, CASE WHEN v.hit THEN true WHEN x.ord IS NOT NULL OR NOT v.hit THEN false END AS hit
FROM r p LEFT JOIN c ON c.run_id = p.run_id AND c.step = p.k % 7 LEFT JOIN v ON v.run_id = p.run_id AND v.checkpoint = coalesce(c.checkpoint, -1) LEFT JOIN x ON x.run_id = p.run_id AND x.checkpoint = coalesce(c.checkpoint, -1) WHERE p.kind = 'signup'""")
def prediction_hit(spark, d):
    """Prediction, checkpoint of its step, first validation and divergence: true, false or unknown."""
    e = trace(spark, d).withColumn("step", F.col("k") % 7)
    cp = asof.last_per_key(e.where("kind = 'view'"), ["run_id", "step"], ["ord"], ["k"]).withColumnRenamed("k", "cp")
    val = e.where("kind = 'purchase'").groupBy("run_id", F.col("k").alias("cp")).agg(F.min_by(F.col("cents") % 2 == 0, "ord").alias("ok"))
    div = e.where("kind = 'error'").select("run_id", F.col("k").alias("cp"), F.lit(True).alias("div")).distinct()
    rows = e.where("kind = 'signup'").join(cp, ["run_id", "step"], "left").withColumn("cp", F.coalesce("cp", F.lit(-1)))
    rows = rows.join(val, ["run_id", "cp"], "left").join(div, ["run_id", "cp"], "left")
    return rows.select("run_id", "ord", F.when(F.col("ok"), True).when(F.col("div") | ~F.col("ok"), False).alias("hit"))


@query(ET[:-1] + """, f AS (SELECT run_id, resource, min_by(task, ord) AS task FROM r WHERE kind = 'view' GROUP BY ALL)
SELECT r.run_id, r.ord, f.task FROM r LEFT JOIN f USING (run_id, resource) WHERE r.kind = 'signup'""")
def first_task_of_prediction(spark, d):
    """The resource's first task."""
    e = trace(spark, d)
    first = asof.first_per_key(e.where("kind = 'view'"), ["run_id", "resource"], ["ord"], ["task"]).withColumnRenamed("task", "first")
    return e.where("kind = 'signup'").join(first, ["run_id", "resource"], "left").select("run_id", "ord", F.col("first").alias("task"))


@query("""WITH l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 1 THEN NULL ELSE c_acctbal END AS bal, c_custkey % 3 < 2 AS has FROM customer), o AS (SELECT o_custkey AS id, max_by(o_totalprice, o_orderkey) AS bal FROM orders GROUP BY 1)
SELECT l.id, CASE WHEN has THEN l.bal ELSE o.bal END AS bal FROM l LEFT JOIN o USING (id)""")
def merge_fill_missing(spark, d):
    """The right side fills only keys that are absent; a present null stays. Of right duplicates the last wins."""
    c = table(spark, d, "customer")
    left = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 1, F.col("c_acctbal")).alias("bal"), F.when(F.col("c_custkey") % 3 < 2, F.array(F.lit("bal"))).otherwise(F.array().cast("array<string>")).alias("keys"))
    right = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_totalprice", "o_orderkey").alias("bal"))
    return metrics.fill_missing(left, right, "id", ["bal"])


@query(ET[:-1] + """, a AS (SELECT DISTINCT run_id, resource FROM r WHERE kind = 'view' AND k < 50), c AS (SELECT DISTINCT run_id, resource FROM r WHERE kind = 'purchase')
SELECT run_id, count(*) AS missed FROM c WHERE (run_id, resource) NOT IN (SELECT (run_id, resource) FROM a) GROUP BY run_id""")
def missed_opportunities(spark, d):
    """Consumed resources for which no task was admitted."""
    e = trace(spark, d)
    return e.where("kind = 'purchase'").join(e.where("kind = 'view' and k < 50"), ["run_id", "resource"], "left_anti").groupBy("run_id").agg(F.countDistinct("resource").alias("missed"))


@query(ET[:-1] + """, f AS (SELECT run_id, resource, min_by(cents % 2, (t, ord)) AS action FROM r WHERE kind = 'signup' GROUP BY ALL)
SELECT run_id, resource FROM f WHERE action = 0 AND NOT EXISTS (SELECT 1 FROM r WHERE r.run_id = f.run_id AND r.resource = f.resource AND r.kind = 'view' AND r.k < 50)""")
def skipped_without_task(spark, d):
    """First decision a skip, and no task."""
    e = trace(spark, d)
    first = e.where("kind = 'signup'").groupBy("run_id", "resource").agg(F.min_by(F.col("cents") % 2, F.struct(*ORD)).alias("action"))
    return first.where("action = 0").join(e.where("kind = 'view' and k < 50"), ["run_id", "resource"], "left_anti").select("run_id", "resource")


@query(_TASKS + "SELECT g.run_id, g.ord FROM r g WHERE g.kind = 'purchase' AND NOT EXISTS (SELECT 1 FROM tasks x WHERE x.run_id = g.run_id AND x.resource = g.resource AND x.consumed_t IS NOT NULL)")
def unmatched_gates(spark, d):
    """Needs whose resource no task served."""
    served = tasks_of(spark, d).where("consumed_t is not null")
    return trace(spark, d).where("kind = 'purchase'").join(served, ["run_id", "resource"], "left_anti").select("run_id", "ord")


@query(_TASKS + "SELECT x.run_id, x.task FROM tasks x WHERE EXISTS (SELECT 1 FROM tasks y WHERE y.run_id = x.run_id AND y.resource = x.resource AND y.consumed_t IS NOT NULL)")
def used_semi(spark, d):
    """Tasks of resources served by some task."""
    x = tasks_of(spark, d)
    return x.join(x.where("consumed_t is not null").select("run_id", "resource"), ["run_id", "resource"], "left_semi").select("run_id", "task")


@query(_TASKS + "SELECT run_id, resource, bool_or(coalesce(completed_t <= consumed_t + 500000, false)) AS on_time FROM tasks GROUP BY ALL")
def ontime_groups(spark, d):
    """Gate groups with a task on time, half a second of grace."""
    return tasks_of(spark, d).groupBy("run_id", "resource").agg(F.bool_or(F.coalesce(F.col("completed_t") <= F.col("consumed_t") + 500_000, F.lit(False))).alias("on_time"))


@query(ET[:-1] + """, f AS (SELECT run_id, resource, min_by(cents, ord) AS est FROM r WHERE kind = 'signup' GROUP BY ALL)
SELECT run_id, CAST(sum(coalesce(f.est, 0)) AS BIGINT) AS stall FROM r LEFT JOIN f USING (run_id, resource) WHERE r.kind = 'purchase' AND r.k < 30 GROUP BY run_id""")
def no_prefetch_stall(spark, d):
    """The first estimate of each need that had no prefetch."""
    e = trace(spark, d)
    est = asof.first_per_key(e.where("kind = 'signup'"), ["run_id", "resource"], ["ord"], ["cents"]).withColumnRenamed("cents", "est")
    return e.where("kind = 'purchase' and k < 30").join(est, ["run_id", "resource"], "left").groupBy("run_id").agg(F.sum(F.coalesce("est", F.lit(0))).alias("stall"))


@query("SELECT n_regionkey AS tool, string_agg(n_name, '+' ORDER BY n_name) AS resources, count(*) AS n FROM nation GROUP BY 1")
def invert_map(spark, d):
    """The sorted set of resources of each consumer."""
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("tool")).agg(F.array_join(F.array_sort(F.collect_set("n_name")), "+").alias("resources"), F.count(F.lit(1)).alias("n"))


@query("SELECT p.p_partkey, q.p_type AS predicted FROM part p JOIN (SELECT DISTINCT substr(p_type, 1, 4) AS p_type FROM part) q ON starts_with(p.p_type, q.p_type)")
def prefix_theta(spark, d):
    """A tool equals or starts with the predicted consumer: a keyed join for each length of a consumer's name."""
    p = table(spark, d, "part")
    q = p.select(F.substring("p_type", 1, 4).alias("predicted")).distinct()
    return predict.starts_with(p, "p_type", q, "predicted").select("p_partkey", "predicted")


@query("SELECT c.c_custkey, n.n_name, n.n_regionkey FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
def registry_lookup(spark, d):
    """The small registry is broadcast once its size is checked."""
    n = predict.maybe_broadcast(table(spark, d, "nation"))
    c = table(spark, d, "customer")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name", "n_regionkey")


@query(E[:-1] + """, p AS (SELECT ['signup', 'view', 'click', 'purchase'] AS plan)
SELECT run_id, ord, CAST(coalesce(list_position(plan, kind), 0) - 1 AS BIGINT) AS pos, CASE WHEN coalesce(list_position(plan, kind), 0) > 0 THEN plan[list_position(plan, kind) + 1] END AS next_kind FROM e, p""")
def plan_position(spark, d):
    """Place of the current tool in the plan, -1 if absent, and the tool after it."""
    plan = F.array(*map(F.lit, ("signup", "view", "click", "purchase")))
    pos = scalars.plan_index(plan, F.col("kind"))
    return trace(spark, d).select("run_id", "ord", long(pos, "pos"), F.when(pos >= 0, F.get(plan, pos + 1)).alias("next_kind"))


_WALL = """WITH w AS (SELECT c_mktsegment AS workload, o_orderpriority AS config, o_orderkey AS trial, CAST(round(o_totalprice * 100) AS BIGINT) AS wall FROM orders JOIN customer ON o_custkey = c_custkey)
"""


def walls(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("workload"), F.col("o_orderpriority").alias("config"), F.col("o_orderkey").alias("trial"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("wall"))


@query(_WALL + """, s AS (SELECT workload, config, count(wall) AS n, avg(wall) AS mean, CASE WHEN count(wall) = 1 THEN 0.0 ELSE stddev_samp(wall) END AS std FROM w GROUP BY ALL), b AS (SELECT workload, mean AS base FROM s WHERE config = '5-LOW')
SELECT workload, config, n, round(mean, 3) AS mean, round(std, 3) AS std, round(mean / base, 6) AS normalised, round(base / mean, 6) AS speedup FROM s LEFT JOIN b USING (workload)""")
def rollup_vs_baseline(spark, d):
    """Mean, sample deviation, share of and speedup over the baseline's mean."""
    got = metrics.rollup_vs_baseline(walls(spark, d), ["workload"], "config", "5-LOW", "wall")
    return got.select("workload", "config", "n", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"), rounded("normalised", "normalised"), rounded("speedup", "speedup"))


@query(_WALL + "SELECT config, count(*) AS n, round(avg(wall / 1000), 3) AS mean, round(stddev_samp(wall / 1000), 3) AS std FROM w GROUP BY config")
def guard_ablation_pooled(spark, d):
    """Pooled over workloads, scaled."""
    return walls(spark, d).groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("wall") / 1000), 3).alias("mean"), F.round(metrics.sample_std(F.col("wall") / 1000), 3).alias("std"))


@query(_WALL + ", m AS (SELECT workload, config, avg(wall) / 1024 AS m FROM w GROUP BY ALL) SELECT m.workload, m.config, round(m.m, 3) AS mean, round(m.m - b.m, 3) AS delta FROM m LEFT JOIN m b ON b.workload = m.workload AND b.config = '5-LOW'")
def memory_delta(spark, d):
    """Mean and its difference to the baseline."""
    m = walls(spark, d).groupBy("workload", "config").agg((F.avg("wall") / 1024).alias("m"))
    b = m.where("config = '5-LOW'").select("workload", F.col("m").alias("b"))
    return m.join(b, "workload", "left").select("workload", "config", F.round("m", 3).alias("mean"), F.round(F.col("m") - F.col("b"), 3).alias("delta"))


@query(_WALL + ", p AS (SELECT workload, sum(wall) FILTER (config = '5-LOW') AS b, sum(wall) FILTER (config = '1-URGENT') AS f FROM w GROUP BY workload) SELECT workload, CAST(b - f AS BIGINT) AS prevented FROM p WHERE b - f > 5")
def stall_prevented(spark, d):
    """Baseline total less full total, where it is more than 5."""
    p = walls(spark, d).groupBy("workload").pivot("config", ["5-LOW", "1-URGENT"]).sum("wall")
    return p.select("workload", (F.col("5-LOW") - F.col("1-URGENT")).alias("prevented")).where("prevented > 5")


@query(_WALL + "SELECT workload, config, round(avg(wall), 3) AS mean, round(stddev_pop(wall), 3) AS std, min(wall) AS least FROM w GROUP BY ALL")
def walltime_bars(spark, d):
    """Mean, population deviation, minimum."""
    return walls(spark, d).groupBy("workload", "config").agg(F.round(F.avg("wall"), 3).alias("mean"), F.round(F.stddev_pop("wall"), 3).alias("std"), F.min("wall").alias("least"))


@query(_WALL + ", r AS (SELECT *, row_number() OVER (PARTITION BY workload, config ORDER BY wall, trial) AS r, count(*) OVER (PARTITION BY workload, config) AS n FROM w) SELECT workload, config, trial, wall FROM r WHERE r = n // 2 + 1")
def upper_median_trial(spark, d):
    """The trial at the upper median."""
    return ordering.upper_median(walls(spark, d), ["workload", "config"], "wall", "trial")


@query(_WALL + "SELECT workload, config, trial, round(row_number() OVER (PARTITION BY workload, config ORDER BY wall, trial) / count(*) OVER (PARTITION BY workload, config), 6) AS cdf FROM w")
def lead_time_cdf(spark, d):
    """Empirical distribution; ties keep their own steps."""
    return ordering.empirical_cdf(walls(spark, d), ["workload", "config"], "wall", "trial").select("workload", "config", "trial", rounded("cdf", "cdf"))


@query(E[:-1] + """, c AS (SELECT k / 100.0 AS c, CAST(cents % 2 = 0 AS INT) AS hit FROM e), b AS (SELECT *, CASE WHEN c < 0.5 THEN 0.0 WHEN c < 0.6 THEN 0.5 WHEN c < 0.7 THEN 0.6 WHEN c < 0.8 THEN 0.7 WHEN c < 0.9 THEN 0.8 ELSE 0.9 END AS low FROM c)
SELECT CAST(low AS DOUBLE) AS low, CAST(CASE WHEN low = 0 THEN 0.25 ELSE low + 0.05 END AS DOUBLE) AS mid, round(avg(hit), 6) AS hit_rate, count(*) AS n FROM b GROUP BY ALL""")
def calibration(spark, d):
    """Hit rate by bucket of confidence."""
    e = trace(spark, d).select((F.col("k") / 100).alias("c"), (F.col("cents") % 2 == 0).alias("hit"))
    return metrics.calibration(e, "c", "hit").withColumn("hit_rate", F.round("hit_rate", 6))


@query(_TASKS + """, u AS (SELECT DISTINCT run_id, resource FROM tasks WHERE consumed_t IS NOT NULL),
c AS (SELECT x.run_id, CASE WHEN x.consumed_t IS NOT NULL THEN CASE WHEN x.completed_t > x.consumed_t + 500000 THEN 'late' ELSE 'useful' END
  WHEN x.cancelled_t IS NOT NULL AND x.completed_t IS NOT NULL THEN 'wasted' WHEN x.cancelled_t IS NOT NULL THEN 'cancelled'
  WHEN x.completed_t IS NOT NULL THEN CASE WHEN u.resource IS NOT NULL THEN 'duplicate' ELSE 'wasted' END ELSE 'pending' END AS outcome FROM tasks x LEFT JOIN u USING (run_id, resource))
SELECT run_id, outcome, count(*) AS n FROM c GROUP BY ALL""")
def classify_outcome(spark, d):
    """Outcomes of tasks, counted per run."""
    return outcomes(spark, d).groupBy("run_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


def outcomes(spark, d):
    x = tasks_of(spark, d)
    served = x.where("consumed_t is not null").select("run_id", "resource", F.lit(True).alias("served")).distinct()
    out = scalars.task_outcome(F.col("consumed_t").isNotNull(), F.col("cancelled_t").isNotNull() & F.col("completed_t").isNotNull(), F.col("cancelled_t").isNotNull(), F.col("completed_t"), F.col("consumed_t"), F.col("served"), 500_000)
    return x.join(served, ["run_id", "resource"], "left").withColumn("outcome", out)


@query(_TASKS + """, u AS (SELECT DISTINCT run_id, resource FROM tasks WHERE consumed_t IS NOT NULL),
c AS (SELECT x.*, CASE WHEN x.consumed_t IS NOT NULL THEN CASE WHEN x.completed_t > x.consumed_t + 500000 THEN 'late' ELSE 'useful' END
  WHEN x.cancelled_t IS NOT NULL AND x.completed_t IS NOT NULL THEN 'wasted' WHEN x.cancelled_t IS NOT NULL THEN 'cancelled'
  WHEN x.completed_t IS NOT NULL THEN CASE WHEN u.resource IS NOT NULL THEN 'duplicate' ELSE 'wasted' END ELSE 'pending' END AS outcome FROM tasks x LEFT JOIN u USING (run_id, resource)),
q AS (SELECT run_id, count(*) AS admitted, count(*) FILTER (outcome = 'cancelled') AS cancelled, count(*) FILTER (outcome IN ('late', 'useful', 'duplicate')) AS consumed, count(DISTINCT resource) FILTER (outcome = 'useful') AS on_time, count(DISTINCT resource) FILTER (consumed_t IS NOT NULL) AS served FROM c GROUP BY run_id)
SELECT run_id, admitted, cancelled, consumed, round(consumed / nullif(admitted - cancelled, 0), 6) AS precision, round(on_time / nullif(served, 0), 6) AS on_time_rate FROM q""")
def prediction_quality(spark, d):
    """Q3 counts; precision over admitted less cancelled (pending ones count); of the resources served the share that came on
    time; rates null on 0. All of Q3 from traces: ``run_predictions``."""
    o = F.col("outcome")
    q = outcomes(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("admitted"), F.count_if(o == "cancelled").alias("cancelled"), F.count_if(o.isin("late", "useful", "duplicate")).alias("consumed"), F.countDistinct(F.when(o == "useful", F.col("resource"))).alias("on_time"), F.countDistinct(F.when(F.col("consumed_t").isNotNull(), F.col("resource"))).alias("served"))
    return q.select("run_id", "admitted", "cancelled", "consumed", F.round(metrics.ratio(F.col("consumed"), F.col("admitted") - F.col("cancelled")), 6).alias("precision"), F.round(metrics.ratio(F.col("on_time"), F.col("served")), 6).alias("on_time_rate"))


@query(_TASKS + """, f AS (SELECT run_id, min(t) AS d FROM r WHERE kind = 'error' AND k > 90 GROUP BY run_id)
SELECT run_id, CAST(count(*) FILTER (cancelled_t IS NOT NULL) AS BIGINT) AS cancelled, CAST(coalesce(sum(completed_t - started_t) FILTER (consumed_t IS NULL), 0) AS BIGINT) AS speculative,
  CAST(count(*) FILTER (consumed_t IS NULL AND started_t > f.d) AS BIGINT) AS wrong_after FROM tasks LEFT JOIN f USING (run_id) GROUP BY run_id""")
def speculation_cost(spark, d):
    """Cancelled tasks, time spent on tasks never used, and wrong ones started after the first divergence."""
    first = trace(spark, d).where("kind = 'error' and k > 90").groupBy("run_id").agg(F.min("t").alias("d"))
    unused = F.col("consumed_t").isNull()
    return tasks_of(spark, d).join(first, "run_id", "left").groupBy("run_id").agg(F.count("cancelled_t").alias("cancelled"), F.coalesce(F.sum(F.when(unused, F.col("completed_t") - F.col("started_t"))), F.lit(0)).alias("speculative"), F.count_if(unused & (F.col("started_t") > F.col("d"))).alias("wrong_after"))


@query(E[:-1] + """, s AS (SELECT run_id, CASE k % 3 WHEN 0 THEN 'measured' WHEN 1 THEN 'estimated' ELSE 'unknown' END AS source FROM e)
SELECT run_id, coalesce(string_agg(DISTINCT source, '+' ORDER BY source) FILTER (source <> 'unknown'), 'unknown') AS byte_source FROM s GROUP BY run_id""")
def byte_source(spark, d):
    """The sorted sources of a run's bytes."""
    source = F.when(F.col("k") % 3 == 0, "measured").when(F.col("k") % 3 == 1, "estimated").otherwise("unknown")
    return trace(spark, d).groupBy("run_id").agg(metrics.joined_sources(source).alias("byte_source"))


@query(E[:-1] + """, m AS (SELECT run_id, k % 12 AS g, max(cents) AS mx, sum(cents) AS sm FROM e WHERE kind IN ('view', 'click') GROUP BY ALL)
SELECT run_id, CAST(sum(CASE WHEN g = 0 THEN sm ELSE mx END) AS BIGINT) AS exposure FROM m GROUP BY run_id""")
def gate_max_dedup(spark, d):
    """The greatest exposure of each gate plus all ungrouped ones."""
    rows = trace(spark, d).where("kind in ('view', 'click')").withColumn("g", F.when(F.col("k") % 12 != 0, (F.col("k") % 12).cast("string")).otherwise(""))
    return lifecycle.gate_exposure(rows, KEY, "g", "cents")


_CLASS = """, c AS (SELECT *, CASE WHEN cents <= 1 THEN '' WHEN k % 5 = 0 THEN 'no_prediction' WHEN k % 5 = 1 THEN 'policy_skip:low' WHEN k % 5 = 2 THEN 'residual_partial'
  WHEN k < 15 THEN 'no_window' WHEN k < 30 + cents / 100.0 THEN 'window_too_small' WHEN k - 10 < 30 + cents / 100.0 THEN 'late_start' ELSE 'residual_partial' END AS cls, k % 12 AS g FROM e WHERE kind IN ('view', 'click'))
"""


def classed(spark, d):
    k = F.col("k")
    outcome = F.when(k % 5 == 0, "no_prediction").when(k % 5 == 1, "skipped").when(k % 5 == 2, "direct_prefetch").otherwise("")
    cls = scalars.stall_class(F.col("cents") / 10, outcome, F.lit("low"), F.lit(True), F.lit(False), k, F.col("cents") / 100, F.lit(10))
    return trace(spark, d).where("kind in ('view', 'click')").withColumns({"cls": cls, "g": F.when(k % 12 != 0, (k % 12).cast("string")).otherwise("")})


@query(E[:-1] + _CLASS + "SELECT run_id, cls, count(*) AS n FROM c GROUP BY ALL")
def stall_classes(spark, d):
    """Stall classes by ordered rules."""
    return classed(spark, d).groupBy("run_id", "cls").agg(F.count(F.lit(1)).alias("n"))


@query(E[:-1] + _CLASS + """, l AS (SELECT *, max(cents) OVER (PARTITION BY run_id, g ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lead FROM c WHERE g <> 0 AND cls <> ''),
d AS (SELECT *, row_number() OVER (PARTITION BY run_id, g ORDER BY ord DESC) AS r FROM l WHERE lead IS NULL OR cents > lead),
a AS (SELECT kind, cls, CASE WHEN r = 1 THEN cents ELSE 0 END AS s FROM d UNION ALL SELECT kind, cls, cents FROM c WHERE g = 0 AND cls <> '')
SELECT kind, cls, CAST(sum(s) AS BIGINT) AS seconds FROM a GROUP BY ALL""")
def stall_taxonomy(spark, d):
    """One class a gate, displaced ones keep a cell of 0."""
    return lifecycle.taxonomy(classed(spark, d), KEY, ["kind"], "g", "cents", "cls", "ord")


@query(E[:-1] + """, w AS (SELECT run_id, t - lag(t) OVER (PARTITION BY run_id ORDER BY ord) AS dt, k % 3 AS u0, cents % 2 AS u1, k AS m0, cents AS m1 FROM e)
SELECT run_id, CAST(sum(CASE WHEN u0 = 0 AND u1 = 0 THEN dt ELSE 0 END) AS BIGINT) AS idle, CAST(sum(dt) AS BIGINT) AS span, round(avg((u0 + u1) / 2), 6) AS mean_util, max(m0 + m1) AS peak_mem,
  round(sum(CASE WHEN u0 = 0 AND u1 = 0 THEN dt ELSE 0 END) / nullif(sum(dt), 0), 6) AS idle_fraction FROM w WHERE dt IS NOT NULL GROUP BY run_id""")
def sample_delta_idle(spark, d):
    """Idle time of samples and peak memory."""
    e = trace(spark, d).withColumns({"u0": F.col("k") % 3, "u1": F.col("cents") % 2, "m0": F.col("k"), "m1": F.col("cents")})
    e = e.withColumn("_p", F.lag("t").over(Window.partitionBy("run_id").orderBy("ord")))
    got = metrics.idle_stats(e.drop("_p"), KEY, "t", "ord", ["u0", "u1"], ["m0", "m1"])
    return got.select("run_id", long("idle"), long("span"), rounded("mean_util", "mean_util"), "peak_mem", rounded("idle_fraction", "idle_fraction"))


@query(E[:-1] + " SELECT run_id, ord, round(CASE WHEN count(*) OVER (PARTITION BY run_id) < 3 THEN cents ELSE sum(cents) OVER (PARTITION BY run_id ORDER BY t, ord ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 END, 6) AS smooth FROM e")
def moving_avg_zero_pad(spark, d):
    """Three points, zeros beyond the edges."""
    return metrics.moving_average(trace(spark, d), KEY, ORD, "cents").select("run_id", "ord", rounded("smooth", "smooth"))


@query(_WALL + "SELECT workload AS job, min_by(trial, (substr(config, 1, 1), trial)) AS trial FROM w WHERE config <> '' GROUP BY 1")
def first_in_allocation(spark, d):
    """The first run of a job by start text."""
    w = walls(spark, d).withColumn("start", F.substring("config", 1, 1))
    return metrics.first_in_allocation(w, "workload", "start", "trial", "trial").withColumnRenamed("workload", "job")


@query("SELECT l_returnflag AS workload, count(DISTINCT l_linestatus) AS kinds, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN l_returnflag || ' [mixed]' ELSE l_returnflag END AS facet FROM lineitem GROUP BY 1")
def facet_mixed(spark, d):
    """Workloads seen on more than one family get a facet of their own."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("workload")).agg(F.countDistinct("l_linestatus").alias("kinds"))
    return g.withColumn("facet", F.when(F.col("kinds") > 1, F.concat("workload", F.lit(" [mixed]"))).otherwise(F.col("workload")))


@query(_TASKS + """SELECT run_id, 'task' AS origin, resource, started_t, NULL::BIGINT AS cents FROM tasks UNION ALL SELECT run_id, 'skipped', resource, NULL, cents FROM r WHERE kind = 'signup' AND cents % 2 = 0
UNION ALL SELECT run_id, 'unpredicted', resource, NULL, cents FROM r WHERE kind = 'purchase' AND k < 10""")
def union_by_name(spark, d):
    """Tasks, skipped decisions and unpredicted needs in one table."""
    e = trace(spark, d)
    a = tasks_of(spark, d).select("run_id", F.lit("task").alias("origin"), "resource", "started_t")
    b = e.where("kind = 'signup' and cents % 2 = 0").select("run_id", F.lit("skipped").alias("origin"), "resource", "cents")
    c = e.where("kind = 'purchase' and k < 10").select("run_id", F.lit("unpredicted").alias("origin"), "resource", "cents")
    return union_rows(a, b, c)


@query("""WITH a AS (SELECT s_nationkey AS tool, s_suppkey % 5 AS rid, min(s_suppkey) AS spec, 0 AS rank FROM supplier GROUP BY ALL), b AS (SELECT c_nationkey AS tool, c_custkey % 5 AS rid, min(c_custkey) AS spec, 1 AS rank FROM customer GROUP BY ALL)
SELECT tool, rid, min_by(spec, rank) AS spec FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def registry_merge(spark, d):
    """U4: registries merged, the first source's entry stays."""
    a = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("tool"), (F.col("s_suppkey") % 5).alias("rid")).agg(F.min("s_suppkey").alias("spec"))
    b = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("tool"), (F.col("c_custkey") % 5).alias("rid")).agg(F.min("c_custkey").alias("spec"))
    return predict.merge_registries([a, b], ["tool", "rid"])


@query(_TASKS + "SELECT count(*) AS both FROM (SELECT run_id, resource FROM tasks WHERE completed_t <= consumed_t INTERSECT SELECT run_id, resource FROM tasks WHERE consumed_t IS NOT NULL AND task % 2 = 0)")
def ontime_and_served(spark, d):
    """Resources on time that were also served."""
    x = tasks_of(spark, d)
    return x.where("completed_t <= consumed_t").select("run_id", "resource").intersect(x.where("consumed_t is not null and task % 2 = 0").select("run_id", "resource")).agg(F.count(F.lit(1)).alias("both"))


@query(E[:-1] + """, s AS (SELECT run_id, list_sort(list(DISTINCT k % 10) FILTER (kind = 'view')) AS running, list(DISTINCT k % 10) FILTER (kind = 'click' AND k < 60) AS keep FROM e GROUP BY run_id)
SELECT run_id, array_to_string(list_filter(coalesce(running, []), lambda x: NOT list_contains(coalesce(keep, []), x)), '+') AS evicted FROM s""")
def residency_difference(spark, d):
    """Running models that nothing keeps."""
    m = (F.col("k") % 10).cast("int")
    s = trace(spark, d).groupBy("run_id").agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "view", m))).alias("running"), F.collect_set(F.when((F.col("kind") == "click") & (F.col("k") < 60), m)).alias("keep"))
    return s.select("run_id", F.array_join(F.array_except("running", "keep").cast("array<string>"), "+").alias("evicted"))


@query("SELECT DISTINCT label FROM (SELECT l_returnflag AS label FROM lineitem UNION ALL SELECT l_linestatus FROM lineitem)")
def label_union(spark, d):
    """U5."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("label")).union(li.select("l_linestatus")).distinct()


@query(_WALL + ", c AS (SELECT config AS cond, min(wall) AS wall FROM w GROUP BY 1) SELECT c.cond, c.wall - b.wall AS delta FROM c, (SELECT wall FROM c WHERE cond = '1-URGENT') b WHERE c.cond <> '1-URGENT' AND c.wall <> 0")
def sensitivity_rank(spark, d):
    """L4: difference to the full system, greatest first."""
    c = walls(spark, d).groupBy(F.col("config").alias("cond")).agg(F.min("wall").alias("wall"))
    return predict.sensitivity(c, "cond", "wall", "1-URGENT")


@query("SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 2 ELSE 3 END, o_orderkey) AS place FROM orders")
def mode_order(spark, d):
    """L1, L2: a fixed order, unknown ones last, then by id."""
    key = predict.order_key(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "5-LOW"])
    return ordering.placed(table(spark, d, "orders"), [key, F.col("o_orderkey")]).select("o_orderkey", "o_orderpriority", "place")


@query(E[:-1] + ", l AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY cents DESC, ord) AS r FROM e WHERE cents >= 3000) SELECT run_id, ord, cents, row_number() OVER (PARTITION BY run_id ORDER BY t) AS place FROM l WHERE r <= 6")
def longest_phases(spark, d):
    """The six longest of at least 30 s, back in order of start."""
    w = Window.partitionBy("run_id")
    top = trace(spark, d).where("cents >= 3000").withColumn("r", F.row_number().over(w.orderBy(F.desc("cents"), "ord"))).where("r <= 6")
    return top.select("run_id", "ord", "cents", F.row_number().over(w.orderBy("t")).cast("bigint").alias("place"))


@query(E[:-1] + """, q AS (SELECT *, lag(kind) OVER (PARTITION BY run_id ORDER BY t, ord) AS before FROM e), p AS (SELECT run_id, string_agg(kind, '>' ORDER BY t, ord) AS plan, count(*) AS steps FROM q WHERE before IS NULL OR before <> kind GROUP BY run_id),
c AS (SELECT plan, any_value(steps) AS steps, count(*) AS n, min(run_id) AS first FROM p GROUP BY plan)
SELECT 'commonest' AS which, plan, steps, n FROM (SELECT * FROM c ORDER BY n DESC, first LIMIT 1) UNION ALL SELECT 'longest', plan, steps, n FROM (SELECT * FROM c ORDER BY steps DESC, first LIMIT 1)""")
def most_common_plan(spark, d):
    """The commonest whole plan and the longest one, ties by first run; neighbours of one kind are one step."""
    e = sequences.collapse(trace(spark, d).select("run_id", *ORD, "kind"), KEY, ORD, "kind")
    each = sequences.fingerprints(e, KEY, ORD, "kind").groupBy("print", "steps").agg(F.count(F.lit(1)).alias("n"), F.min("run_id").alias("first"))
    row = F.struct("steps", "n", "first")
    best = each.agg(F.min_by(row, F.struct(-F.col("n"), F.col("first"))).alias("commonest"), F.min_by(row, F.struct(-F.col("steps"), F.col("first"))).alias("longest"))
    both = best.select(F.explode(F.array(*[F.struct(F.lit(c).alias("which"), F.col(c).alias("p")) for c in ("commonest", "longest")])).alias("x")).select("x.which", F.col("x.p.steps").alias("steps"), F.col("x.p.n").alias("n"), F.col("x.p.first").alias("run_id"))
    # the plans of two runs alone become texts
    shown = e.join(F.broadcast(both), "run_id").groupBy("which", "steps", "n").agg(F.array_sort(F.collect_list(F.struct(*ORD, "kind"))).alias("items"))
    return shown.select("which", F.array_join(F.transform("items", lambda x: x["kind"]), ">").alias("plan"), "steps", "n")


#: Deltas of a probe around each run's loads: k and cents stand for counters. The verdict's limits are in the operator.
_PROBE = E[:-1] + """, p AS (SELECT run_id, greatest(0, 1 - CAST(sum(k) FILTER (kind = 'view') AS DOUBLE) / nullif(sum(k) FILTER (kind IN ('view', 'click')), 0)) AS hit, CAST(sum(cents) FILTER (kind = 'error') AS DOUBLE) * 1e5 AS net, (max(t) - min(t)) / 1e6 AS elapsed FROM e GROUP BY run_id),
v AS (SELECT run_id, CASE WHEN hit >= 0.9 THEN 3 WHEN hit > 0.15 THEN 1 ELSE 0 END + CASE WHEN net / 1e9 < 0.01 AND elapsed > 10 THEN 1 ELSE 0 END AS cache, CASE WHEN hit <= 0.15 THEN 3 WHEN hit < 0.9 THEN 1 ELSE 0 END + CASE WHEN net / 1e9 > 1.0 THEN 2 ELSE 0 END AS nfs, CASE WHEN hit IS NULL THEN 1 ELSE 0 END AS unknown FROM p)
"""


@query(_PROBE + "SELECT run_id, CASE WHEN cache > nfs AND cache > unknown THEN 'page_cache' WHEN nfs > cache AND nfs > unknown THEN 'nfs' WHEN nfs > 0 AND cache > 0 THEN 'mixed' ELSE 'unknown' END AS verdict FROM v")
def source_verdict(spark, d):
    """Where a load came from, by votes of its cache-hit ratio and the bytes that the network received."""
    of = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("k")))
    probe = trace(spark, d).groupBy("run_id").agg(F.greatest(F.lit(0.0), 1 - metrics.ratio(of("view"), of("view", "click"))).alias("hit"), (F.sum(F.when(F.col("kind") == "error", F.col("cents"))).cast("double") * 1e5).alias("net"), ((F.max("t") - F.min("t")) / 1e6).alias("elapsed"))
    return probe.select("run_id", metrics.source_verdict(F.col("hit"), F.col("net"), F.col("elapsed")).alias("verdict"))


@query(E[:-1] + ", s AS (SELECT run_id, kind, max(t) - min(t) AS dt, max(k) - min(k) AS net, sum(cents) AS bytes FROM e GROUP BY ALL) SELECT run_id, kind, dt, net, round(greatest(0, 1 - net / nullif(bytes, 0)), 6) AS hit_ratio FROM s")
def counter_delta(spark, d):
    """Deltas of counters and the cache-hit ratio, 0 at least, null without reads."""
    s = trace(spark, d).groupBy("run_id", "kind").agg((F.max("t") - F.min("t")).alias("dt"), (F.max("k") - F.min("k")).alias("net"), F.sum("cents").alias("bytes"))
    share = metrics.ratio(F.col("net"), F.col("bytes"))
    return s.select("run_id", "kind", "dt", "net", F.round(F.when(share.isNotNull(), F.greatest(F.lit(0.0), 1 - share)), 6).alias("hit_ratio"))


@query(E[:-1] + " SELECT run_id, ord, name AS metric, value FROM (SELECT run_id, ord, k AS gpu0_util, cents AS gpu0_mem, k % 7 AS gpu1_util FROM e) UNPIVOT (value FOR name IN (gpu0_util, gpu0_mem, gpu1_util))")
def unpivot_profile(spark, d):
    """Profile columns in long form."""
    e = trace(spark, d).select("run_id", "ord", F.col("k").alias("gpu0_util"), F.col("cents").alias("gpu0_mem"), (F.col("k") % 7).alias("gpu1_util"))
    return e.unpivot(["run_id", "ord"], ["gpu0_util", "gpu0_mem", "gpu1_util"], "metric", "value")


@query(E[:-1] + " SELECT run_id, ord, round((k / 100) / ((cents % 100) / 100 + 0.01), 6) AS ratio FROM e")
def cpu_gpu_ratio(spark, d):
    """A39."""
    return trace(spark, d).select("run_id", "ord", rounded((F.col("k") / 100) / ((F.col("cents") % 100) / 100 + 0.01), "ratio"))


@query("SELECT doc_id, substr(md5(source), 1, 12) AS rid, 'cache_' || substr(md5(source), 1, 12) AS cache_id, substr(md5(source), 1, 16) || '_t1' AS task_id FROM documents")
def stable_id(spark, d):
    """Ids by md5 in their dialects."""
    s = F.col("source")
    return table(spark, d, "documents").select("doc_id", scalars.stable_id(s).alias("rid"), scalars.stable_id(s, prefix="cache_").alias("cache_id"), scalars.stable_id(s, 16, suffix="_t1").alias("task_id"))


@query("SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, '{\"event\":\"' || event_type || '\",\"k\":' || regexp_extract(props, '([0-9]+)', 1) || '}' AS json FROM events")
def json_payload(spark, d):
    """A payload read null-safely and written again."""
    e = table(spark, d, "events").withColumn("v", F.try_parse_json("props"))
    k = F.coalesce(F.try_variant_get("v", "$.k", "bigint"), F.lit(0))
    return e.select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_type").alias("event"), k.alias("k"))).alias("json"))


@query(E[:-1] + " SELECT run_id, ord, CASE WHEN k % 4 <> 0 THEN k % 4 WHEN cents % 3 <> 0 THEN cents % 3 ELSE -1 END AS picked, TRY_CAST(CASE WHEN k % 5 = 0 THEN '3.0' WHEN k % 5 = 1 THEN '' ELSE CAST(k AS VARCHAR) END AS BIGINT) IS NULL OR k % 5 = 0 AS not_int FROM e")
def falsy_and_lenient(spark, d):
    """Zero gives way as null does; '3.0' and '' are no integers."""
    k = F.col("k")
    text = F.when(k % 5 == 0, "3.0").when(k % 5 == 1, "").otherwise(k.cast("string"))
    return trace(spark, d).select("run_id", "ord", scalars.falsy_coalesce(k % 4, F.col("cents") % 3, F.lit(-1)).cast("bigint").alias("picked"), scalars.lenient_int(text).isNull().alias("not_int"))


@query(E[:-1] + """, a AS (SELECT run_id, ord, CASE WHEN k % 10 = 1 THEN 'skip already_in_flight_or_complete' WHEN k % 10 = 2 THEN 'skip resource_type_skipped (cache)' WHEN k % 10 = 3 THEN 'start naive_prefetch'
  WHEN k / 100 < 0.4 THEN 'skip confidence_below_threshold (' || printf('%.2f', k / 100) || ' < 0.4)' WHEN cents % 5 > 3 THEN 'skip horizon_exceeded (4 > 3)'
  WHEN k % 2 = 0 AND k / 100 < 0.5 THEN 'skip non_cancellable_resource_requires_higher_confidence' WHEN k % 10 = 4 THEN 'start proactive_swap_compute_window'
  WHEN cents % 7 > 0 AND cents > cents % 7 * 2000 THEN 'skip insufficient_compute_time_for_overlap' ELSE 'start confidence_above_threshold' END AS decision, k FROM e)
SELECT run_id, ord, CASE WHEN k % 10 > 0 THEN decision END AS decision FROM a""")
def admission_policy(spark, d):
    """The scheduler's rules in order."""
    k, cents = F.col("k"), F.col("cents")
    mode = F.when(k % 10 == 0, "observe_only").otherwise("real")
    got = scalars.admission(mode, k % 10 == 1, F.when(k % 10 == 2, "cache").otherwise("model"), ["cache"], k % 10 == 3, k / 100, 0.4, cents % 5, 3, k % 2 != 0, k % 10 == 4, cents, cents % 7 * 1000)
    return trace(spark, d).withColumn("a", got).select("run_id", "ord", F.concat("a.action", F.lit(" "), "a.reason").alias("decision"))


@query(_WALL + "SELECT workload, config, CAST(count(*) FILTER (trial % 3 > 0) AS BIGINT) AS included, CAST(count(*) FILTER (trial % 3 = 0) AS BIGINT) AS excluded, count(*) FILTER (trial % 3 > 0) < 10 AS few, count(DISTINCT CASE WHEN trial % 3 > 0 THEN trial % 2 END) > 1 AS mixed_hardware FROM w GROUP BY ALL")
def validation_flags(spark, d):
    """Trials per status, few trials, mixed hardware."""
    w = walls(spark, d).withColumns({"status": F.when(F.col("trial") % 3 > 0, "completed").otherwise("failed"), "gpu": F.col("trial") % 2})
    return validation_report(w)


@query(E[:-1] + """, p AS (SELECT run_id, string_agg(CASE kind WHEN 'view' THEN 'plan_task' WHEN 'click' THEN 'computation_task' ELSE kind || 'x' END, ' ' ORDER BY t, ord) AS txt FROM e GROUP BY run_id),
m AS (SELECT run_id, list_filter(string_split(txt, ' '), lambda x: x IN ('plan_task', 'computation_task')) AS f FROM p)
SELECT run_id, CAST(len(f) AS BIGINT) AS n_mentions, array_to_string(list_filter(f, lambda x, i: i = 1 OR x <> f[i - 1]), '>') AS tools FROM m WHERE len(list_distinct(f)) >= 2""")
def plan_extract(spark, d):
    """known tools by whole words, in order, neighbours once, two distinct ones at least."""
    from ..operators.sequences import ordered_items

    named = trace(spark, d).withColumn("w", F.when(F.col("kind") == "view", "plan_task").when(F.col("kind") == "click", "computation_task").otherwise(F.concat("kind", F.lit("x"))))
    text = ordered_items(named, KEY, ORD, "w").select("run_id", scalars.extract_plan(F.array_join("items", " "), ["plan_task", "computation_task"]).alias("p"))
    return text.where("p is not null").select("run_id", long("p.n_mentions", "n_mentions"), F.array_join("p.tools", ">").alias("tools"))


@query(E[:-1] + """, a AS (SELECT run_id, kind, row_number() OVER (PARTITION BY run_id ORDER BY t, ord) AS i FROM e WHERE kind IN ('signup', 'view', 'purchase')), p AS (SELECT unnest(['signup', 'view', 'purchase']) AS kind, unnest([1, 2, 3]) AS i), u AS (SELECT DISTINCT run_id FROM e)
SELECT u.run_id, CAST(p.i AS BIGINT) AS step, coalesce(a.kind = p.kind, false) AS ok FROM u CROSS JOIN p LEFT JOIN a ON a.run_id = u.run_id AND a.i = p.i""")
def plan_compliance_strict(spark, d):
    """Plan steps met at their place among the plan's tools."""
    return sequences.strict_match(trace(spark, d), KEY, ORD, "kind", ("signup", "view", "purchase"))


@query(E[:-1] + """, a AS (SELECT run_id, list(kind ORDER BY t, ord) AS items FROM e GROUP BY run_id), plan AS (SELECT ['signup', 'error', 'view', 'purchase'] AS p),
f1 AS (SELECT run_id, items, p, coalesce(list_position(items, p[1]), 0) AS h1 FROM a, plan), f2 AS (SELECT *, h1 AS c1, coalesce(list_position(items[h1 + 1:], p[2]), 0) AS h2 FROM f1), f3 AS (SELECT *, c1 + h2 AS c2, coalesce(list_position(items[c1 + h2 + 1:], p[3]), 0) AS h3 FROM f2), f4 AS (SELECT *, coalesce(list_position(items[c2 + h3 + 1:], p[4]), 0) AS h4 FROM f3)
SELECT run_id, CAST(unnest([0, 1, 2, 3]) AS INT) AS pos, unnest([h1 > 0, h2 > 0, h3 > 0, h4 > 0]) AS ok FROM f4""")
def plan_compliance_greedy(spark, d):
    """A missed step does not move the cursor."""
    return sequences.greedy_match(trace(spark, d), KEY, ORD, "kind", ("signup", "error", "view", "purchase"))


#: The guard's events, numbered in the order it takes them, for a recursion from event to event.
_GUARD = E.replace("WITH e", "WITH RECURSIVE e")[:-1] + """, s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t, ord) AS step FROM e),
v AS (SELECT run_id, ord, CAST(step AS INT) AS step, kind = 'signup' AS made, CASE WHEN kind = 'signup' THEN ['click', 'view', 'pur', 'error', 'purchase'][k % 5 + 1] ELSE kind END AS tool, CAST(step + k % 3 AS INT) AS due, row_number() OVER (PARTITION BY run_id ORDER BY ord) AS i FROM s),
"""


@query(_GUARD + """g AS (SELECT DISTINCT run_id, 0::BIGINT AS i, []::STRUCT(step INT, tool VARCHAR)[] AS pending, 0 AS until, NULL::BIGINT AS ord, NULL::INT AS step, NULL::VARCHAR AS tool, NULL::VARCHAR AS outcome, NULL::VARCHAR AS expected FROM v
UNION ALL SELECT run_id, i, CASE WHEN made THEN CASE WHEN step > until THEN list_append(live, {'step': step, 'tool': tool}) ELSE live END WHEN pos IS NULL THEN live ELSE list_concat(live[:pos - 1], live[pos + 1:]) END,
  CASE WHEN NOT made AND pos IS NOT NULL AND live[pos].tool <> tool THEN step + 3 ELSE until END, ord, step, tool, CASE WHEN made THEN NULL WHEN pos IS NULL THEN 'silent' WHEN live[pos].tool = tool THEN 'hit' ELSE 'diverged' END, CASE WHEN NOT made AND pos IS NOT NULL THEN live[pos].tool END
FROM (SELECT *, CASE WHEN NOT made THEN nullif(list_position(list_transform(live, lambda x: x.step < step AND starts_with(tool, x.tool)), true), 0) END AS pos FROM (SELECT v.*, g.until, CASE WHEN v.made THEN g.pending ELSE list_filter(g.pending, lambda x: v.step - x.step <= 60) END AS live FROM g JOIN v ON v.run_id = g.run_id AND v.i = g.i + 1)))
SELECT run_id, ord, step, tool, outcome, expected, step <= until AS conservative FROM g WHERE outcome IS NOT NULL""")
def guard_replay(spark, d):
    """The prediction guard over each run: signups predict the type of k, other events are tools
    (also held against brute force and against its stream in the tests)."""
    return guard.replay(guard_events(trace(spark, d)), mode="queue")


@query(_GUARD + """g AS (SELECT DISTINCT run_id, 0::BIGINT AS i, NULL::VARCHAR AS pending, NULL::INT AS due, 0 AS until, NULL::BIGINT AS ord, NULL::INT AS step, NULL::VARCHAR AS tool, NULL::VARCHAR AS outcome, NULL::VARCHAR AS expected FROM v
UNION ALL SELECT v.run_id, v.i, CASE WHEN v.made THEN CASE WHEN v.step > g.until THEN v.tool ELSE g.pending END WHEN g.pending IS NULL OR v.step < g.due THEN g.pending END, CASE WHEN v.made AND v.step > g.until THEN v.due ELSE g.due END,
  CASE WHEN NOT v.made AND g.pending IS NOT NULL AND v.step >= g.due AND v.tool <> g.pending THEN v.step + 3 ELSE g.until END, v.ord, v.step, v.tool,
  CASE WHEN v.made THEN NULL WHEN g.pending IS NULL OR v.step < g.due THEN 'silent' WHEN v.tool = g.pending THEN 'hit' ELSE 'diverged' END, CASE WHEN NOT v.made AND v.step >= g.due THEN g.pending END
FROM g JOIN v ON v.run_id = g.run_id AND v.i = g.i + 1)
SELECT run_id, ord, step, tool, outcome, expected, step <= until AS conservative FROM g WHERE outcome IS NOT NULL""")
def rival_guard_replay(spark, d):
    """T4: the guard with one pending slot."""
    return guard.replay(guard_events(trace(spark, d)), mode="slot")


def guard_events(e):
    names = F.array(*map(F.lit, ("click", "view", "pur", "error", "purchase")))
    step = F.row_number().over(Window.partitionBy("run_id").orderBy(*ORD)).cast("int")
    return e.select("run_id", "ord", step.alias("step"), F.when(F.col("kind") == "signup", "prediction").otherwise("tool").alias("kind"), F.when(F.col("kind") == "signup", F.get(names, (F.col("k") % 5).cast("int"))).otherwise(F.col("kind")).alias("tool"), (step + (F.col("k") % 3).cast("int")).alias("expected_at"))


@query(_WALL + ", a AS (SELECT workload, count(*) FILTER (config = '1-URGENT') AS c1, count(*) FILTER (config = '2-HIGH') AS c2, avg(wall) FILTER (config = '1-URGENT') AS m1, avg(wall) FILTER (config = '2-HIGH') AS m2 FROM w GROUP BY 1) SELECT workload, greatest(c1, c2) AS n, round(m1 / 1e9, 9) AS m1, round(m2 / 1e9, 9) AS m2 FROM a WHERE m1 > 0 OR m2 > 0")
def segment_means(spark, d):
    """Means of segments, n the greatest count among them; groups of zeros leave."""
    w = walls(spark, d)
    u, h = F.when(F.col("config") == "1-URGENT", F.col("wall")), F.when(F.col("config") == "2-HIGH", F.col("wall"))
    a = w.groupBy("workload").agg(F.greatest(F.count(u), F.count(h)).alias("n"), F.avg(u).alias("a"), F.avg(h).alias("b"))
    return a.where("a > 0 or b > 0").select("workload", "n", F.round(F.col("a") / 1e9, 9).alias("m1"), F.round(F.col("b") / 1e9, 9).alias("m2"))


@query(_WALL + ", m AS (SELECT config, coalesce(min(nullif(wall, 0)), 1000000000) AS best, avg(coalesce(wall % 7, 0)) AS acc FROM w GROUP BY 1) SELECT config, CAST(best AS BIGINT) AS best, round(acc, 6) AS acc FROM m")
def quick_summary(spark, d):
    """The best run (0 and null last) and a mean with null as 0."""
    return walls(spark, d).groupBy("config").agg(F.coalesce(F.min(F.nullif("wall", F.lit(0))), F.lit(1_000_000_000)).cast("bigint").alias("best"), F.round(F.avg(F.coalesce(F.col("wall") % 7, F.lit(0))), 6).alias("acc"))


@query(E[:-1] + " SELECT run_id, CASE WHEN count(*) FILTER (kind = 'error') > 0 THEN CAST(coalesce(sum(cents) FILTER (kind = 'error' AND k < 2), 0) AS BIGINT) END AS disk_s FROM e GROUP BY run_id")
def load_seconds_null_safe(spark, d):
    """Null without any load event, 0 where none is of the source."""
    is_load = F.col("kind") == "error"
    return trace(spark, d).groupBy("run_id").agg(F.when(F.count_if(is_load) > 0, F.coalesce(F.sum(F.when(is_load & (F.col("k") < 2), F.col("cents"))), F.lit(0))).alias("disk_s"))


@query(E[:-1] + ", v AS (SELECT k % 6 AS predictor, CAST(cents % 2 = 0 AS INT) AS hit FROM e WHERE kind = 'purchase' AND k % 6 < 5), p AS (SELECT DISTINCT k % 6 AS predictor FROM e) SELECT p.predictor, round(coalesce(avg(v.hit), 0), 6) AS accuracy FROM p LEFT JOIN v USING (predictor) GROUP BY 1")
def predictor_accuracy(spark, d):
    """Accuracy per predictor, 0 where nothing was validated."""
    e = trace(spark, d).withColumn("predictor", F.col("k") % 6)
    v = e.where("kind = 'purchase' and predictor < 5").select("predictor", (F.col("cents") % 2 == 0).cast("int").alias("hit"))
    return e.select("predictor").distinct().join(v, "predictor", "left").groupBy("predictor").agg(F.round(F.coalesce(F.avg("hit"), F.lit(0.0)), 6).alias("accuracy"))


@query("SELECT l_returnflag, l_linestatus, count(DISTINCT l_orderkey) AS trials, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS seconds FROM lineitem GROUP BY ALL")
def trials_per_cell(spark, d):
    """Distinct trials and seconds per cell."""
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.countDistinct("l_orderkey").alias("trials"), F.sum(F.round("l_quantity").cast("bigint")).alias("seconds"))


@query("SELECT p_partkey, CASE WHEN p_name IS NULL OR trim(p_name) = '' THEN 'unknown' WHEN contains(p_name, 'L40S') THEN 'L40S' ELSE list_last(string_split(trim(p_name), ' ')) END AS family, substr(p_name, 1, 16) AS label, CASE WHEN starts_with(p_type, 'ECO') THEN 'ECO' ELSE p_type END AS kind FROM part")
def label_rules(spark, d):
    """Families, phase kinds, short labels."""
    return table(spark, d, "part").select("p_partkey", scalars.gpu_family(F.col("p_name")).alias("family"), scalars.shorten(F.col("p_name"), {}).alias("label"), scalars.phase_kind(F.col("p_type"), ["ECO"]).alias("kind"))


@query("SELECT p_partkey, CASE WHEN s >= 1e9 THEN printf('%.1f GB', s / 1e9) WHEN s >= 1e6 THEN printf('%.0f MB', s / 1e6) ELSE printf('%.0f kB', s / 1e3) END AS size, s <= greatest(0, p_size * 10.0 - 120) * 2.78e9 AS hideable FROM (SELECT *, CAST(p_partkey * 7001 * 1001 AS BIGINT) AS s FROM part)")
def hideability(spark, d):
    """sizes as text, and whether a transfer fits its window."""
    s = (F.col("p_partkey") * 7001 * 1001).cast("bigint")
    return table(spark, d, "part").select("p_partkey", scalars.human_bytes(s.cast("double")).alias("size"), scalars.hideable(s, F.col("p_size") * 10.0).alias("hideable"))
