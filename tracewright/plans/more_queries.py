"""Queries on predictors, guard rules in closed form, admission checks and measured volumes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..operators import metrics, predict, sequences
from ..sources import sinks, traces
from .base import BY, ET, ORD, E, long, query, table, trace
from .metric_queries import _TASKS, _WALL, classed, tasks_of, walls
from .sequence_queries import _PAIRS

_REG = ", reg AS (SELECT n_nationkey AS rid, ['click', 'error', 'purchase', 'signup', 'view'][n_regionkey + 1] AS tool, 1 + n_nationkey % 2 AS off, (n_nationkey % 10) / 10 AS confidence FROM nation)\n"


def registry(spark, d):
    names = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    return table(spark, d, "nation").select(F.get(names, F.col("n_regionkey")).alias("tool"), F.col("n_nationkey").cast("bigint").alias("rid"), (1 + F.col("n_nationkey") % 2).cast("bigint").alias("off"), ((F.col("n_nationkey") % 10) / 10).alias("confidence"))


def calls(spark, d):
    return trace(spark, d).select("run_id", "ord", F.col("kind").alias("tool"))


@query(E[:-1] + _REG + ", m AS (SELECT run_id, ord, rid, reg.off, reg.confidence FROM e JOIN reg ON e.kind = reg.tool) SELECT run_id, ord, rid, min(off) OVER (PARTITION BY ord) AS horizon, max(confidence) OVER (PARTITION BY ord) AS best FROM m")
def rule_prediction(spark, d, by=()):
    """Registry rows of each call, with horizon and confidence of the prediction."""
    return predict.rule_predict(calls(spark, d), registry(spark, d), by=by).select("run_id", "ord", "rid", "horizon", "best")


def likely(spark, d):
    return sequences.transition_probs(sequences.pairs_within(trace(spark, d), BY, ORD, "kind", 3))


_TABLE = _REG + """, m AS (SELECT c.run_id, c.ord, x.off, reg.rid FROM e c JOIN x ON x.source = c.kind AND x.rank <= 1 AND x.prob >= 0.2 AND x.off IN (1, 2) JOIN reg ON reg.tool = x.target),
f AS (SELECT *, min(off) OVER (PARTITION BY ord) AS least FROM m)
"""


@query(_PAIRS[:-1] + _TABLE + "SELECT run_id, ord, rid, off FROM f WHERE off = least")
def table_prediction(spark, d, by=()):
    """Rows of the nearest offset whose likely target has resources."""
    got = predict.table_predict(calls(spark, d), likely(spark, d), registry(spark, d).drop("off", "confidence"), top=1, least=0.2, by=by)
    return got.select("run_id", "ord", "rid", long("off"))


@query(_PAIRS[:-1] + _TABLE + """, sig AS (SELECT run_id, ord, k AS rid, 0 AS signal FROM e WHERE kind = 'signup' UNION ALL SELECT run_id, ord, rid, 1 FROM f WHERE off = least UNION ALL SELECT run_id, ord, rid, 2 FROM e JOIN reg ON e.kind = reg.tool)
SELECT run_id, ord, rid, signal FROM (SELECT *, min(signal) OVER (PARTITION BY run_id, ord) AS least FROM sig) WHERE signal = least""")
def learned_prediction(spark, d):
    """Plan, else table, else rules, the first that says anything about a step."""
    plan = trace(spark, d).where("kind = 'signup'").select("run_id", "ord", F.col("k").alias("rid"))
    key = ["run_id", "ord"]  # not run_id alone: a long run would fall to one task
    by_table = table_prediction(spark, d, key).select("run_id", "ord", "rid")
    plan = plan.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key)
    return predict.learned_predict(plan, by_table, rule_prediction(spark, d, key).select("run_id", "ord", "rid"), key).select("run_id", "ord", "rid", "signal")


@query(E[:-1] + """, c AS (SELECT run_id, ord, k >= 90 AS now, CASE kind WHEN 'view' THEN 'chat' WHEN 'error' THEN 'ensemble' END AS cls FROM e)
SELECT run_id, coalesce(arg_min(cls, (NOT now, ord)) FILTER (cls IS NOT NULL), 'graph') AS current_first, coalesce(arg_min(cls, (now, ord)) FILTER (cls IS NOT NULL), 'graph') AS history_first FROM c GROUP BY run_id""")
def infer_workflow(spark, d):
    """The class of the first telling tool, in both orders of current calls (here k from 90 on) and history; graph by default."""
    e = trace(spark, d).select("run_id", "ord", F.col("kind").alias("name"), "k")
    found = [predict.infer_workflow(e.where("k < 90"), e.where("k >= 90"), BY, {"view": "chat", "error": "ensemble"}, "graph", first) for first in (True, False)]
    return found[0].withColumnRenamed("workflow", "current_first").join(found[1].withColumnRenamed("workflow", "history_first"), "run_id")


@query(E[:-1] + """, i AS (SELECT *, CASE WHEN kind IN ('signup', 'view', 'click') THEN 'tool' ELSE 'model' END AS type, row_number() OVER (PARTITION BY run_id ORDER BY t, ord) AS i FROM e),
p AS (SELECT a.type, a.kind AS source, b.i - a.i AS off, b.kind AS target FROM i a JOIN i b ON a.run_id = b.run_id AND b.i - a.i BETWEEN 1 AND 3 AND a.type = b.type),
n AS (SELECT *, count(*) AS cnt FROM p GROUP BY ALL)
SELECT type, source, CAST(off AS INT) AS off, target, cnt, round_even(cnt / sum(cnt) OVER (PARTITION BY type, source, off), 4) AS prob FROM n QUALIFY cnt >= 2""")
def learned_transitions(spark, d):
    """Transitions of tools and models in one sequence, each among its own kind."""
    e = trace(spark, d).withColumn("type", F.when(F.col("kind").isin("signup", "view", "click"), "tool").otherwise("model"))
    return sequences.learn(e, BY, ORD, "kind", "type").select(F.col("kind").alias("type"), "source", "off", "target", "cnt", "prob")


@query(E[:-1] + """, r AS (SELECT run_id, t, ord, kind, k, row_number() OVER (PARTITION BY run_id, kind ORDER BY t, ord) AS n FROM e)
SELECT run_id, ord, 'cache' AS name, 130.0::DOUBLE AS estimated_load_s, 1.0::DOUBLE AS confidence, '' AS consumer_tool FROM r WHERE kind = 'signup' AND n = 1
UNION ALL SELECT run_id, ord, 'worker', 120.0, 1.0, '' FROM r WHERE kind = 'view' AND n = 1 UNION ALL SELECT run_id, ord, 'pool', 120.0, 1.0, '' FROM r WHERE kind = 'error' AND k > 50""")
def adapter_predictions(spark, d):
    """Cache staging and worker boot once a run, a pool boot at each flip."""
    kind = F.col("kind")
    rules = [("cache", kind == "signup", 130.0, True), ("worker", kind == "view", 120.0, True), ("pool", (kind == "error") & (F.col("k") > 50), 120.0, False)]
    return predict.triggered(trace(spark, d), BY, ORD, rules).drop("t")


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'model' WHEN 'Brand#12' THEN 'staging' ELSE 'simulated' END AS executor FROM part")
def executor_routes(spark, d):
    """The executor of each resource by its type."""
    return table(spark, d, "part").select("p_partkey", scalars.route(F.col("p_brand"), {"Brand#11": "model", "Brand#12": "staging"}, "simulated").alias("executor"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '—' ELSE printf('%.2fs', CAST(o_totalprice AS DOUBLE)) END AS seconds, CASE WHEN o_orderkey % 7 = 0 THEN '—' ELSE printf('%.1f%%', (o_orderkey % 1000) / 1000.0::DOUBLE * 100) END AS share, CASE WHEN o_orderkey % 5 = 0 THEN '—' ELSE CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) END AS whole,
  CASE WHEN o_orderkey % 5 = 0 THEN '—' ELSE printf('%.2f', o_custkey / 4.0::DOUBLE) || '×  (' || CASE WHEN o_custkey >= 4 THEN '+' ELSE '' END || printf('%.0fs)', CAST(o_custkey - 4 AS DOUBLE)) END AS speedup FROM orders""")
def report_texts(spark, d):
    """seconds, shares, counts and speedups as reports state them."""
    o, gone = table(spark, d, "orders"), F.col("o_orderkey") % 5 == 0
    price, share = F.when(~gone, F.col("o_totalprice")), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 1000 / 1000)
    return o.select("o_orderkey", scalars.as_seconds(price, 2).alias("seconds"), scalars.as_percent(share).alias("share"), scalars.as_int(price).alias("whole"), scalars.speedup_text(F.when(~gone, F.col("o_custkey")), F.lit(4)).alias("speedup"))


@query(E[:-1] + """, c AS (SELECT run_id, k % 12 AS g FROM e WHERE kind IN ('view', 'click') AND cents > 100), n AS (SELECT run_id, count(DISTINCT g) FILTER (g <> 0) + count(*) FILTER (g = 0) AS n FROM c GROUP BY run_id), r AS (SELECT DISTINCT run_id FROM e)
SELECT round(avg(coalesce(n, 0)) * 15, 6) AS floor_s FROM r LEFT JOIN n USING (run_id)""")
def exposed_gates(spark, d):
    """Mean distinct exposed gates a trial, times the floor of 15 s; over 100 cents stands for being exposed."""
    c = classed(spark, d).where("cents > 100").groupBy("run_id").agg((F.countDistinct(F.when(F.col("g") != "", F.col("g"))) + F.count_if(F.col("g") == "")).alias("n"))
    runs = trace(spark, d).select("run_id").distinct()
    return runs.join(c, "run_id", "left").agg(F.round(F.avg(F.coalesce("n", F.lit(0))) * 15, 6).alias("floor_s"))


@query(_TASKS + "SELECT run_id, task, coalesce(consumed_t, started_t, 1000000000000) AS lane FROM tasks WHERE completed_t IS NOT NULL OR consumed_t IS NOT NULL")
def drawable_lanes(spark, d):
    """Lanes worth drawing with their sort key."""
    return tasks_of(spark, d).where("completed_t is not null or consumed_t is not null").select("run_id", "task", F.coalesce("consumed_t", "started_t", F.lit(10**12)).alias("lane"))


@query(_WALL + "SELECT trial, concat_ws('+', CASE WHEN trial % 7 = 0 THEN 'status' END, CASE WHEN trial % 5 = 0 THEN 'no_times' END, CASE WHEN wall <= 10000000 THEN 'wall' END, CASE WHEN trial % 11 = 0 AND workload <> 'MACHINERY' THEN 'no_trace' END) AS problems FROM w")
def admission_problems(spark, d):
    """P5: what excludes a run; metrics stand in for a trace in one family."""
    t = F.col("trial")
    problems = F.array_compact(F.array(F.when(t % 7 == 0, "status"), F.when(t % 5 == 0, "no_times"), F.when(F.col("wall") <= 10_000_000, "wall"), F.when((t % 11 == 0) & (F.col("workload") != "MACHINERY"), "no_trace")))
    return walls(spark, d).select("trial", F.array_join(problems, "+").alias("problems"))


@query("SELECT o_orderstatus AS workload, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS trace FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1")
def newest_trace(spark, d):
    """The newest completed trace of two configurations."""
    o = table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    return o.groupBy(F.col("o_orderstatus").alias("workload")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("trace"))


@query("SELECT o_orderpriority AS config, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS completed, CAST(count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS BIGINT) AS failed FROM orders GROUP BY 1")
def trial_status(spark, d):
    """Completed, and failed: neither completed nor running."""
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("config")).agg(F.count_if(s == "F").alias("completed"), F.count_if(~s.isin("F", "P")).alias("failed"))


@query(E[:-1] + ", s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t, ord) AS step FROM e), f AS (SELECT run_id, min(step) FILTER (kind NOT IN ('signup', 'view')) AS first FROM s GROUP BY run_id) SELECT run_id, ord, step, coalesce(step < first, true) OR step <= 2 AS in_window FROM s JOIN f USING (run_id)")
def plan_window(spark, d):
    """Steps while a plan may still be read: up to the first tool that is no planning, or the first two."""
    s = trace(spark, d).withColumn("step", F.row_number().over(Window.partitionBy("run_id").orderBy(*ORD)).cast("bigint"))
    first = F.min(F.when(~F.col("kind").isin("signup", "view"), F.col("step"))).over(Window.partitionBy("run_id"))
    return s.select("run_id", "ord", "step", (F.coalesce(F.col("step") < first, F.lit(True)) | (F.col("step") <= 2)).alias("in_window"))


@query(E[:-1] + ", s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t, ord) AS step FROM e), c AS (SELECT run_id, ord, step, max(CASE WHEN kind = 'error' THEN step + 3 END) OVER (PARTITION BY run_id ORDER BY step) AS until FROM s) SELECT run_id, ord, coalesce(step <= until, false) AS conservative FROM c")
def conservative_steps(spark, d):
    """T5 in closed form: within three steps of a divergence."""
    w = Window.partitionBy("run_id").orderBy(*ORD)
    step = F.row_number().over(w).cast("bigint")
    s = trace(spark, d).withColumn("step", step)
    until = F.max(F.when(F.col("kind") == "error", F.col("step") + 3)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return s.select("run_id", "ord", F.coalesce(F.col("step") <= until, F.lit(False)).alias("conservative"))


@query(E[:-1] + ", s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t, ord) AS step, count(*) OVER (PARTITION BY run_id) AS now FROM e) SELECT run_id, ord, now > step + k % 5 + 1 AS expired FROM s WHERE kind = 'signup'")
def checkpoint_expiry(spark, d):
    """Pending checkpoints past their horizon at the run's end."""
    w = Window.partitionBy("run_id")
    s = trace(spark, d).withColumns({"step": F.row_number().over(w.orderBy(*ORD)).cast("bigint"), "now": F.count(F.lit(1)).over(w)})
    return s.where("kind = 'signup'").select("run_id", "ord", (F.col("now") > F.col("step") + F.col("k") % 5 + 1).alias("expired"))


@query(_TASKS + ", c AS (SELECT run_id, k % 10 AS resource, min(t) AS cut FROM e WHERE kind = 'error' AND k > 50 GROUP BY ALL) SELECT x.run_id, x.task, CASE WHEN x.consumed_t < c.cut THEN 'used' WHEN x.completed_t < c.cut THEN 'wasted' ELSE 'cancelled' END AS status FROM tasks x JOIN c ON c.run_id = x.run_id AND c.resource = x.resource WHERE x.started_t < c.cut")
def cancel_cascade(spark, d):
    """What a divergence does to the tasks of its checkpoint: used ones stay, completed ones are wasted."""
    cuts = trace(spark, d).where("kind = 'error' and k > 50").groupBy("run_id", "resource").agg(F.min("t").alias("cut"))
    x = tasks_of(spark, d).join(cuts, ["run_id", "resource"]).where("started_t < cut")
    return x.select("run_id", "task", F.when(F.col("consumed_t") < F.col("cut"), "used").when(F.col("completed_t") < F.col("cut"), "wasted").otherwise("cancelled").alias("status"))


@query(_TASKS + "SELECT run_id, task, consumed_t IS NOT NULL AND completed_t IS NOT NULL AND completed_t <= consumed_t AS stamped, coalesce(completed_t, consumed_t) - started_t AS held FROM tasks")
def consumption_stamps(spark, d):
    """Completed tasks stamped by their consumer; a task's span ends at completion or else consumption."""
    return tasks_of(spark, d).select("run_id", "task", (F.col("consumed_t").isNotNull() & F.col("completed_t").isNotNull() & F.coalesce(F.col("completed_t") <= F.col("consumed_t"), F.lit(False))).alias("stamped"), (F.coalesce("completed_t", "consumed_t") - F.col("started_t")).alias("held"))


@query(E[:-1] + ", s AS (SELECT run_id, kind, row_number() OVER (PARTITION BY run_id ORDER BY t, ord) AS i FROM e) SELECT run_id, i AS task_index, kind AS actual, CASE i % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE 'error' END AS planned FROM s WHERE kind <> CASE i % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE 'error' END")
def specialist_divergence(spark, d):
    """Tasks whose actual specialist is not the planned one."""
    i = F.row_number().over(Window.partitionBy("run_id").orderBy(*ORD)).cast("bigint")
    s = trace(spark, d).select("run_id", i.alias("task_index"), F.col("kind").alias("actual"))
    plan = F.when(F.col("task_index") % 3 == 0, "view").when(F.col("task_index") % 3 == 1, "click").otherwise("error")
    return s.withColumn("planned", plan).where("planned <> actual")


@query(ET[:-1] + ", z AS (SELECT run_id, min(t) FILTER (kind IN ('view', 'click')) AS t0 FROM r GROUP BY run_id) SELECT run_id, ord, CASE WHEN k <> 0 THEN t - t0 END AS rel FROM r JOIN z USING (run_id)")
def relative_time(spark, d):
    """P10: time from the run's zero over some kinds only; a missing (0) stamp stays null."""
    zero = F.min(F.when(F.col("kind").isin("view", "click"), F.col("t"))).over(Window.partitionBy("run_id"))
    return trace(spark, d).select("run_id", "ord", F.when(F.col("k") != 0, F.col("t") - zero).alias("rel"))


_IO = "WITH l AS (SELECT l_returnflag AS app, l_linestatus AS variant, l_suppkey AS file, (l_orderkey * 10 + l_linenumber) * 1000000 + CAST(round(l_extendedprice) AS BIGINT) AS o, CAST(round(l_quantity) AS BIGINT) AS q, CAST(round(l_extendedprice) AS BIGINT) AS p FROM lineitem)\n"


def io_rows(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("app"), F.col("l_linestatus").alias("variant"), F.col("l_suppkey").alias("file"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.round("l_extendedprice").cast("bigint")).alias("o"), F.round("l_quantity").cast("bigint").alias("q"), F.round("l_extendedprice").cast("bigint").alias("p"))


@query(_IO + "SELECT CASE variant WHEN 'F' THEN 'full' ELSE variant END AS variant, round(avg(CASE WHEN q % 10 = 0 THEN 0 ELSE p END), 6) AS mb FROM l WHERE app = 'A' AND (q % 7 = 0 OR q >= 5) GROUP BY 1")
def mean_io(spark, d):
    """Means by renamed variant; unparsable runtimes stay, blanks count as 0."""
    rows = io_rows(spark, d).select("app", "variant", F.when(F.col("q") % 7 == 0, "n/a").otherwise(F.col("q").cast("string")).alias("runtime_s"), F.when(F.col("q") % 10 == 0, "").otherwise(F.col("p").cast("string")).alias("mb"))
    return traces.mean_io(rows, "A", {"F": "full"}, ["mb"]).withColumn("mb", F.round("mb", 6))


@query(_IO + ", f AS (SELECT *, p > 100000 AS big, bool_or(p > 100000) OVER (PARTITION BY app, variant) AS any_big FROM l WHERE q % 10 <> 0) SELECT app, variant, round(avg(p), 6) AS p FROM f WHERE big OR NOT any_big GROUP BY ALL")
def preferred_io(spark, d):
    """Large readings where there are any, all otherwise; blanks are left out."""
    rows = io_rows(spark, d).withColumn("p", F.when(F.col("q") % 10 != 0, F.col("p")))
    return traces.preferred_mean(rows, F.col("p") > 100_000, "p", ["app", "variant"]).withColumn("p", F.round("p", 6))


@query(_IO + ", d AS (SELECT app, file, min_by(p, o) FILTER (q % 2 = 0) AS b, min_by(p, o) FILTER (q % 2 = 1) AS e FROM l GROUP BY ALL) SELECT app, median(CAST(greatest(0, e - b) AS DOUBLE)) AS delta FROM d WHERE b IS NOT NULL AND e IS NOT NULL GROUP BY app")
def counter_growth(spark, d):
    """Median growth of a counter over files."""
    rows = io_rows(spark, d).withColumn("phase", F.when(F.col("q") % 2 == 0, "at begin").otherwise("at end"))
    return traces.counter_delta(rows, ["app"], "file", "o", "phase", "p")


@query(_IO + ", s AS (SELECT app, file, sum(p) FILTER (p < 90000) AS s, count(*) * 6048 AS n FROM l GROUP BY ALL) SELECT app, median(CAST(s AS DOUBLE)) AS bytes, median(CAST(n AS DOUBLE)) AS by_rows FROM s GROUP BY app")
def frame_bytes(spark, d):
    """Median bytes over files, corrupt values left out; by rows where there is no such column."""
    rows = io_rows(spark, d)
    return traces.median_bytes(rows, ["app"], "file", "p", corrupt=90_000).join(traces.median_bytes(rows, ["app"], "file", None).withColumnRenamed("bytes", "by_rows"), "app")


@query(_IO + ", m AS (SELECT avg(q) FILTER (app = 'N') AS t, avg(q) FILTER (app = 'R') AS i FROM l) SELECT o, round(q + t + i, 6) AS cycle FROM l, m WHERE app = 'A'")
def cycle_times(spark, d):
    """Each simulation plus mean training and inference."""
    rows = io_rows(spark, d).withColumn("stage", F.when(F.col("app") == "N", "train").when(F.col("app") == "R", "inference").otherwise("simulation"))
    return traces.cycle_times(rows, "stage", "q", ["o"]).select("o", F.round("cycle", 6).alias("cycle"))


@query("""WITH s AS (SELECT o_orderstatus AS workload, o_orderkey AS trial, coalesce(CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice / 1000 END, 0) AS wall, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' THEN 'scripted' WHEN o_orderpriority = '2-HIGH' THEN 'baseline' WHEN o_orderpriority = '3-MEDIUM' THEN 'real' ELSE 'other' END AS mode FROM orders),
k AS (SELECT *, CASE WHEN mode IN ('scripted', 'baseline') THEN 'noai' ELSE 'agentic' END AS kind, bool_or(mode = 'scripted') OVER (PARTITION BY workload) AS has FROM s WHERE wall >= 10 AND (mode IN ('scripted', 'baseline') OR mode = 'real' AND wall <= 200))
SELECT workload, trial, kind FROM k WHERE NOT (mode = 'baseline' AND has)""")
def wall_times(spark, d):
    """Wall times within their limits; scripted runs where a workload has any, its baselines otherwise."""
    pr, k = F.col("o_orderpriority"), F.col("o_orderkey")
    mode = F.when((pr == "1-URGENT") & (F.col("o_orderstatus") != "F"), "scripted").when(pr == "2-HIGH", "baseline").when(pr == "3-MEDIUM", "real").otherwise("other")
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("workload"), k.alias("trial"), F.when(k % 9 != 0, F.col("o_totalprice") / 1000).alias("wall"), mode.alias("mode"))
    return traces.wall_times(rows, ["workload"], F.col("mode") == "scripted", F.col("mode") == "baseline", F.col("mode") == "real", "wall", 10.0, 200.0).select("workload", "trial", "kind")


@query(_WALL + ", s AS (SELECT workload, sum(wall) FILTER (config = '1-URGENT') AS a, sum(wall) FILTER (config = '2-HIGH') AS b FROM w GROUP BY 1) SELECT workload, CAST(a AS BIGINT) AS load, CAST(CASE WHEN workload = 'BUILDING' THEN 120 ELSE b END AS BIGINT) AS wait, CAST(a + CASE WHEN workload = 'BUILDING' THEN 120 ELSE b END AS BIGINT) AS total FROM s")
def stacked_components(spark, d):
    """Components, one overridden, and their stack."""
    w = walls(spark, d).groupBy("workload").pivot("config", ["1-URGENT", "2-HIGH"]).sum("wall")
    wait = F.when(F.col("workload") == "BUILDING", F.lit(120)).otherwise(F.col("2-HIGH"))
    return w.select("workload", F.col("1-URGENT").alias("load"), wait.alias("wait"), (F.col("1-URGENT") + wait).alias("total"))


@query(E[:-1] + """, a AS (SELECT run_id, kind, row_number() OVER (PARTITION BY run_id ORDER BY t, ord) AS i FROM e WHERE kind IN ('signup', 'view', 'purchase')), p AS (SELECT unnest(['signup', 'view', 'purchase']) AS kind, unnest([1, 2, 3]) AS i), u AS (SELECT DISTINCT run_id FROM e),
c AS (SELECT u.run_id, p.i, coalesce(a.kind = p.kind, false) AS ok FROM u CROSS JOIN p LEFT JOIN a ON a.run_id = u.run_id AND a.i = p.i), f AS (SELECT run_id, bool_and(ok) AS full_ok, avg(CAST(ok AS INT)) AS share FROM c GROUP BY run_id)
SELECT round(avg(share), 6) AS overall, CAST(count(*) FILTER (full_ok) AS BIGINT) AS full_runs FROM f""")
def overall_compliance(spark, d):
    """Overall compliance and runs that follow the plan throughout."""
    from .metric_queries import plan_compliance_strict

    per = plan_compliance_strict(spark, d).groupBy("run_id").agg(F.bool_and("ok").alias("all_ok"), F.avg(F.col("ok").cast("int")).alias("share"))
    return per.agg(F.round(F.avg("share"), 6).alias("overall"), F.count_if("all_ok").alias("full_runs"))


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS turns FROM conversations GROUP BY 1")
def conversation_sequence(spark, d):
    """A conversation's speakers in order."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role").withColumn("turn", F.col("turn"))
    got = sequences.ordered_items(c, ["conv_id"], ["turn"], "role")
    return got.select("conv_id", F.array_join("items", ">").alias("roles"), F.size("items").cast("bigint").alias("turns"))


@query("SELECT event_id, event_type || '_tool' AS name, '{\"k\":' || regexp_extract(props, '([0-9]+)', 1) || '}' AS arguments, event_type AS content FROM events")
def tool_call_parsing(spark, d):
    """tool calls and content of responses in JSON."""
    e = table(spark, d, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1)
    response = F.concat(F.lit('{"choices":[{"message":{"content":"'), F.col("event_type"), F.lit('","tool_calls":[{"function":{"name":"'), F.col("event_type"), F.lit('_tool","arguments":"{\\"k\\":'), k, F.lit('}"}}]}}]}'))
    r = e.select("event_id", response.alias("r")).select("event_id", F.get(text.tool_calls(F.col("r")), F.lit(0)).alias("c"), text.response_content(F.col("r")).alias("content"))
    return r.select("event_id", "c.name", "c.arguments", "content")


@query("SELECT event_id, CASE event_id % 6 WHEN 4 THEN NULL ELSE event_type || '_tool' END AS name FROM events")
def tool_name_parsing(spark, d):
    """tool names in texts: Python calls, fenced and bare JSON, JSON that names no tool (also held against cases in the tests)."""
    e, kind = table(spark, d, "events"), F.col("event_type")
    forms = [("result = ", "_tool(x=1)"), ("see ```json\n{\"name\": \"", "_tool\"}\n```"), ("  {\"tool\": \"", "_tool\", \"x\": 1}"), ("{\"function\": {\"name\": \"", "_tool\"}}"), ("{\"name\": \"", "\"}"), ("```python\nprint(1); ", "_tool()\n```")]
    text_ = F.coalesce(*[F.when(F.col("event_id") % 6 == k, F.concat(F.lit(a), kind, F.lit(b))) for k, (a, b) in enumerate(forms)])
    return e.select("event_id", text.tool_name(text_).alias("name"))


@query()
def transitions_export(spark, d):
    """K6: the transition table as one JSON text (key order is free)."""
    return sinks.transitions_json(likely(spark, d))


@query(E[:-1] + ", m AS (SELECT run_id, avg(CAST(k AS DOUBLE)) AS util, count(DISTINCT kind) AS kinds FROM e WHERE kind <> 'error' GROUP BY run_id) SELECT run_id, round(util, 6) AS util, kinds, kinds > 1 AS mixed FROM m")
def mixed_hardware(spark, d):
    """Groups with several kinds of hardware."""
    e = trace(spark, d).where("kind <> 'error'")
    m = e.groupBy("run_id").agg(F.round(F.avg("k"), 6).alias("util"), F.countDistinct("kind").alias("kinds"))
    return m.withColumn("mixed", F.col("kinds") > 1)


@query(E[:-1] + " SELECT run_id, ord, CASE WHEN kind = 'view' THEN 'measured' WHEN cents % 2 = 0 AND cents <> 0 THEN 'estimated' ELSE 'unknown' END AS source, CAST(CASE WHEN kind = 'view' THEN k WHEN cents % 2 = 0 THEN cents ELSE 0 END AS DOUBLE) AS bytes FROM e")
def byte_provenance(spark, d):
    """Measured bytes, else estimated, else none."""
    b = scalars.bytes_with_source(F.when(F.col("kind") == "view", F.col("k")), F.when(F.col("cents") % 2 == 0, F.col("cents")))
    return trace(spark, d).select("run_id", "ord", b.alias("b")).select("run_id", "ord", "b.source", "b.bytes")


@query(E[:-1] + ", g AS (SELECT run_id, count(*) FILTER (kind = 'view') AS n, count(*) FILTER (kind = 'error') AS made FROM e GROUP BY run_id) SELECT run_id, n, CAST(n AS DOUBLE) / nullif(made, 0) AS share FROM g")
def null_rates(spark, d):
    """A rate without a denominator (a run without errors) is null, not 0."""
    g = trace(spark, d).groupBy("run_id").agg(F.count_if(F.col("kind") == "view").alias("n"), F.count_if(F.col("kind") == "error").alias("made"))
    return g.select("run_id", "n", metrics.ratio(F.col("n"), F.col("made")).alias("share"))


@query(_TASKS + ", s AS (SELECT run_id, count(*) AS n, count(*) FILTER (completed_t - started_t < 3600000000) AS quick FROM tasks GROUP BY run_id) SELECT run_id, n, CAST(quick AS BIGINT) AS quick, quick * 2 > n AS simulated FROM s")
def simulated_runs(spark, d):
    """A run is simulated if more than half of its tasks end too quickly (here: within an hour)."""
    quick = F.coalesce(F.col("completed_t") - F.col("started_t") < 3_600_000_000, F.lit(False))
    return tasks_of(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(quick).alias("quick")).withColumn("simulated", F.col("quick") * 2 > F.col("n"))


@query(E[:-1] + ", s AS (SELECT run_id, CAST(sum(cents) AS BIGINT) AS stall FROM e WHERE kind = 'purchase' GROUP BY run_id), m AS (SELECT run_id, CAST(sum(cents) AS BIGINT) AS measured FROM e WHERE kind = 'error' AND k < 5 GROUP BY run_id) SELECT s.run_id, CASE WHEN s.run_id % 3 = 0 THEN m.measured ELSE s.stall END AS stall FROM s LEFT JOIN m USING (run_id)")
def metrics_override(spark, d):
    """One family takes its stall from the metrics alone, and null where they have none; errors with k under 5 stand for metrics (see also phase_stalls)."""
    e = trace(spark, d)
    s = e.where("kind = 'purchase'").groupBy("run_id").agg(F.sum("cents").alias("own"))
    m = e.where("kind = 'error' and k < 5").groupBy("run_id").agg(F.sum("cents").alias("measured"))
    return s.join(m, "run_id", "left").select("run_id", F.when(F.col("run_id") % 3 == 0, F.col("measured")).otherwise(F.col("own")).alias("stall"))


@query(_TASKS + "SELECT run_id, task, row_number() OVER (PARTITION BY run_id ORDER BY task % 7, started_t, task) AS place FROM tasks")
def prefetch_table_order(spark, d):
    """A run's tasks by predicted step, otherwise as they came."""
    w = Window.partitionBy("run_id").orderBy(F.col("task") % 7, "started_t", "task")
    return tasks_of(spark, d).select("run_id", "task", F.row_number().over(w).cast("bigint").alias("place"))


@query(_PAIRS[:-1] + _REG + """, pl AS (SELECT ['signup', 'view', 'click', 'purchase', 'error'] AS plan), cl AS (SELECT run_id, ord, kind, off, plan[list_position(plan, kind) + off] AS target FROM e, pl, (SELECT unnest([1, 2]) AS off))
SELECT c.run_id, c.ord, CAST(c.off AS BIGINT) AS off, reg.rid, round(greatest(coalesce(x.prob, 0.8), 0.8), 6) AS confidence FROM cl c JOIN reg ON reg.tool = c.target LEFT JOIN x ON x.source = c.kind AND x.off = c.off AND x.target = c.target""")
def plan_prediction(spark, d):
    """What the plan has one and two steps on, with the learned confidence or 0.8 if that is more."""
    plan = F.array(*map(F.lit, ("signup", "view", "click", "purchase", "error")))
    c = calls(spark, d).select("run_id", "ord", "tool", F.explode(F.array(F.lit(1), F.lit(2))).alias("off"))
    c = c.withColumn("target", F.get(plan, scalars.plan_index(plan, F.col("tool")) + F.col("off")))
    learned = predict.maybe_broadcast(likely(spark, d).select(F.col("source").alias("tool"), "off", "target", "prob"))
    rows = c.join(predict.maybe_broadcast(registry(spark, d).select(F.col("tool").alias("target"), "rid")), "target").join(learned, ["tool", "off", "target"], "left")
    return rows.select("run_id", "ord", long("off"), "rid", F.round(F.greatest(F.coalesce("prob", F.lit(0.8)), F.lit(0.8)), 6).alias("confidence"))


@query(E[:-1] + ", m AS (SELECT run_id, ord, k % 5 AS cur, lead(k % 5) OVER (PARTITION BY run_id ORDER BY t, ord) AS nxt, lag(k % 5) OVER (PARTITION BY run_id ORDER BY t, ord) AS prev FROM e) SELECT run_id, ord, prev AS evicted FROM m WHERE prev IS NOT NULL AND prev <> cur AND (nxt IS NULL OR prev <> nxt)")
def residency_eviction(spark, d):
    """At a flip the model before leaves unless the plan needs it next."""
    w, m = Window.partitionBy("run_id").orderBy(*ORD), F.col("k") % 5
    rows = trace(spark, d).select("run_id", "ord", m.alias("cur"), F.lead(m).over(w).alias("nxt"), F.lag(m).over(w).alias("evicted"))
    return rows.where("evicted <> cur and (nxt is null or evicted <> nxt)").select("run_id", "ord", "evicted")
