"""Queries on sequences, pairing and as-of joins over the event traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof, intervals, sequences
from .base import BY, ET, ORD, E, long, query, rounded, trace

_PAIRS = (
    ET[:-1]
    + """, p AS (
  SELECT run_id, kind AS source, off, lead(kind, off) OVER (PARTITION BY run_id, off ORDER BY t, ord) AS target, t, ord
  FROM e, (SELECT unnest([1, 2, 3]) AS off)),
c AS (SELECT source, off, target, count(*) AS cnt, min((t, ord)) AS first FROM p WHERE target IS NOT NULL GROUP BY ALL),
s AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY source, off) AS prob FROM c),
x AS (SELECT source, CAST(off AS BIGINT) AS off, target, cnt, prob, row_number() OVER (PARTITION BY source, off ORDER BY cnt DESC, first) AS rank FROM s WHERE cnt >= 2)
"""
)


@query(_PAIRS + "SELECT source, off, target, cnt, round(prob, 6) AS prob, rank FROM x")
def transition_probs(spark, d):
    """Transition probabilities at offsets 1..3."""
    got = sequences.transition_probs(sequences.pairs_within(trace(spark, d), BY, ORD, "kind", 3))
    return got.select("source", long("off"), "target", "cnt", rounded("prob", "prob"), "rank")


@query(_PAIRS + "SELECT source, off, target, round(prob, 6) AS prob FROM x WHERE rank <= 2")
def next_type_topk(spark, d):
    """L3: the two likeliest targets per source and offset."""
    got = sequences.transition_probs(sequences.pairs_within(trace(spark, d), BY, ORD, "kind", 3))
    return got.where("rank <= 2").select("source", long("off"), "target", rounded("prob", "prob"))


@query(
    E[:-1]
    + """, p AS (SELECT kind AS source, lead(kind) OVER (PARTITION BY run_id ORDER BY t, ord) AS target FROM e),
c AS (SELECT source, target, count(*) AS cnt FROM p WHERE target IS NOT NULL GROUP BY ALL),
kept AS (SELECT source AS item FROM c GROUP BY source HAVING sum(cnt) >= 200),
i AS (SELECT * FROM c WHERE source IN (SELECT item FROM kept) AND target IN (SELECT item FROM kept))
SELECT source, target, round(cnt / sum(cnt) OVER (PARTITION BY source), 6) AS prob FROM i"""
)
def transition_matrix(spark, d):
    """Row-normalised after filtering sources by count."""
    got = sequences.transition_matrix(trace(spark, d), BY, ORD, "kind", 1, 200)
    return got.select("source", "target", rounded("prob", "prob"))


@query(
    E[:-1]
    + """, p AS (SELECT kind AS source, lead(kind) OVER (PARTITION BY run_id ORDER BY t, ord) AS target FROM e)
SELECT source, CAST(count(*) FILTER (target = 'click') AS BIGINT) AS click, CAST(count(*) FILTER (target = 'error') AS BIGINT) AS error,
  CAST(count(*) FILTER (target = 'purchase') AS BIGINT) AS purchase, CAST(count(*) FILTER (target = 'signup') AS BIGINT) AS signup, CAST(count(*) FILTER (target = 'view') AS BIGINT) AS view
FROM p WHERE target IS NOT NULL GROUP BY source"""
)
def transition_pivot(spark, d):
    """A30 as a matrix: one column a target."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    pairs = sequences.pairs_within(trace(spark, d), BY, ORD, "kind", 1)
    return pairs.groupBy("source").pivot("target", kinds).count().na.fill(0)


@query(
    E[:-1]
    + """, p AS (SELECT run_id, t, ord, kind, row_number() OVER (PARTITION BY run_id ORDER BY t, ord) - 1 AS pos FROM e),
c AS (SELECT pos, kind, count(*) AS cnt, min((run_id, t, ord)) AS first FROM p GROUP BY ALL),
r AS (SELECT *, CAST(sum(cnt) OVER (PARTITION BY pos) AS BIGINT) AS n, row_number() OVER (PARTITION BY pos ORDER BY cnt DESC, first) AS r FROM c)
SELECT pos, kind, cnt, n, round(cnt / n, 6) AS share FROM r WHERE r = 1 AND n >= 3"""
)
def step_consistency(spark, d):
    """The modal event of each position."""
    got = sequences.step_consistency(trace(spark, d), BY, ORD, "kind")
    return got.select("pos", "kind", "cnt", "n", rounded("share", "share"))


@query(
    E[:-1]
    + """, s AS (SELECT run_id, kind, row_number() OVER (PARTITION BY run_id ORDER BY t, ord) AS step FROM e)
SELECT a.run_id, count(*) AS steps, CAST(count(*) FILTER (a.kind = b.kind) AS BIGINT) AS hits, CAST(count(*) FILTER (b.kind IS NULL) AS BIGINT) AS unpredicted
FROM s a LEFT JOIN (SELECT * FROM s WHERE run_id = 1) b ON a.step = b.step WHERE a.run_id <> 1 GROUP BY a.run_id"""
)
def oracle_next_hit(spark, d):
    """A reference run predicts the same step of the others."""
    got = sequences.next_by_reference(trace(spark, d), BY, ORD, "kind", {"run_id": 1})
    return got.groupBy("run_id").agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("predicted") == F.col("actual")).alias("hits"), F.count_if(F.col("predicted").isNull()).alias("unpredicted"))


@query(E[:-1] + ", p AS (SELECT *, lag(kind) OVER (PARTITION BY run_id ORDER BY t, ord) AS b FROM e) SELECT run_id, ord, kind FROM p WHERE b IS NULL OR b <> kind")
def adjacent_collapse(spark, d):
    """Without adjacent repeats."""
    return sequences.collapse(trace(spark, d), BY, ORD, "kind").select("run_id", "ord", "kind")


@query(E[:-1] + ", p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t DESC, ord DESC) AS r FROM e) SELECT run_id, ord, kind FROM p WHERE r <= 5 AND kind <> 'error'")
def tail_n(spark, d):
    """The last five rows, then without the blank ones (here: errors)."""
    return sequences.tail(trace(spark, d), BY, ORD, 5).where("kind <> 'error'").select("run_id", "ord", "kind")


@query(E[:-1] + """, p AS (SELECT run_id, kind, t, lag(kind) OVER (PARTITION BY run_id ORDER BY t, ord) AS pk, lag(t) OVER (PARTITION BY run_id ORDER BY t, ord) AS pt FROM e WHERE kind IN ('view', 'click'))
SELECT run_id, count(*) AS spans, CAST(sum(t - pt) AS BIGINT) AS length FROM p WHERE kind = 'click' AND pk = 'view' GROUP BY run_id""")
def span_pairing(spark, d):
    """Spans from the latest start to the end that takes it, summed per run."""
    got = sequences.span_pairs(trace(spark, d), BY, ORD, F.col("kind") == "view", F.col("kind") == "click")
    return got.groupBy("run_id").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("length"))


_QUEUE = E[:-1] + """, s AS (SELECT *, CASE WHEN kind = 'view' THEN 1 ELSE -1 END AS step FROM e WHERE kind IN ('view', 'click')),
b AS (SELECT *, sum(step) OVER (PARTITION BY run_id ORDER BY t, ord) AS bal FROM s),
l AS (SELECT *, coalesce(least(0, min(bal) OVER (PARTITION BY run_id ORDER BY t, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS low FROM b),
k AS (SELECT * FROM l WHERE kind = 'view' OR bal >= low),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id, kind ORDER BY t, ord) AS n FROM k)
"""


@query(_QUEUE + "SELECT a.run_id, a.t AS start, b.t AS \"end\" FROM n a JOIN n b ON a.run_id = b.run_id AND a.n = b.n AND a.kind = 'view' AND b.kind = 'click'")
def fifo_pairing(spark, d):
    """Starts and ends pair first in, first out."""
    return sequences.fifo_pairs(trace(spark, d), BY, ORD, F.col("kind") == "view", F.col("kind") == "click")


@query(_QUEUE + "SELECT run_id, t - cents AS start, t AS \"end\" FROM k WHERE kind = 'click'")
def lifo_spans(spark, d):
    """Spans of ends that find an open start; their length is the end's own."""
    return sequences.lifo_spans(trace(spark, d), BY, ORD, F.col("kind") == "view", F.col("kind") == "click", F.col("cents"))


@query(E[:-1] + """, l AS (SELECT * FROM e WHERE kind = 'purchase'), m AS (
  SELECT l.run_id, l.ord, l.t, max_by(c.k, (c.t, c.ord)) AS k, max(c.t) AS mt FROM l LEFT JOIN e c ON c.run_id = l.run_id AND c.kind = 'click' AND (c.t < l.t OR c.t = l.t) GROUP BY ALL)
SELECT run_id, ord, CASE WHEN t - mt < 3600000000 THEN k END AS k, coalesce(t - mt < 3600000000 AND k % 2 = 1, false) AS discarded FROM m""")
def asof_backward_tolerance(spark, d):
    """The latest click before a purchase, strictly within an hour; the stamp is discarded if its key is odd."""
    e = trace(spark, d)
    got = asof.backward(e.where("kind = 'purchase'").select("run_id", "ord", "t"), e.where("kind = 'click'").select("run_id", F.col("t").alias("ct"), "k", F.col("ord").alias("co")), BY, "t", "ct", ["k"], tie="co")
    near = F.col("t") - F.col("matched_t") < 3_600_000_000
    return got.select("run_id", "ord", F.when(near, F.col("k")).alias("k"), F.coalesce(near & (F.col("k") % 2 == 1), F.lit(False)).alias("discarded"))


@query(ET[:-1] + """, l AS (SELECT * FROM r WHERE kind = 'view'), g AS (SELECT * FROM r WHERE kind = 'purchase'),
f AS (SELECT l.ord, min_by(g.ord, (g.t, g.ord)) AS gate FROM l JOIN g ON g.run_id = l.run_id AND g.resource = l.resource AND g.t >= l.t - 1000000 GROUP BY l.ord),
z AS (SELECT run_id, resource, max_by(ord, (t, ord)) AS gate FROM g GROUP BY ALL)
SELECT l.run_id, l.ord, coalesce(f.gate, z.gate) AS gate FROM l LEFT JOIN f ON f.ord = l.ord LEFT JOIN z ON z.run_id = l.run_id AND z.resource = l.resource""")
def asof_forward_gate(spark, d):
    """The earliest gate of the same model from a second before the anchor on, else the last one; gates are not used up."""
    e = trace(spark, d)
    left = e.where("kind = 'view'").select("run_id", "resource", "ord", (F.col("t") - 1_000_000).alias("anchor"))
    gates = e.where("kind = 'purchase'").select("run_id", "resource", F.col("t").alias("gt"), F.col("ord").alias("gate"))
    return asof.forward(left, gates, ["run_id", "resource"], "anchor", "gt", ["gate"], tie="gate", else_last=True).select("run_id", "ord", "gate")


@query(ET[:-1] + """ SELECT l.run_id, l.ord, min(g.t) AS need FROM r l LEFT JOIN r g ON g.run_id = l.run_id AND g.resource = l.resource AND g.kind = 'purchase' AND g.t >= l.t WHERE l.kind = 'signup' GROUP BY ALL""")
def first_need_after(spark, d):
    """The first need of a predicted resource at or after the prediction."""
    e = trace(spark, d)
    got = asof.forward(e.where("kind = 'signup'").select("run_id", "resource", "ord", "t"), e.where("kind = 'purchase'").select("run_id", "resource", F.col("t").alias("nt")), ["run_id", "resource"], "t", "nt", [])
    return got.select("run_id", "ord", F.col("matched_t").alias("need"))


@query(ET[:-1] + """ SELECT l.run_id, l.ord, max(g.t) AS started FROM r l LEFT JOIN r g ON g.run_id = l.run_id AND g.kind = 'view' AND g.t <= l.t - l.cents * 10000 WHERE l.kind = 'purchase' GROUP BY ALL""")
def asof_start_before_need(spark, d):
    """The latest start at or before a gate's need (its exit less its wait)."""
    e = trace(spark, d)
    left = e.where("kind = 'purchase'").select("run_id", "ord", (F.col("t") - F.col("cents") * 10_000).alias("need"))
    got = asof.backward(left, e.where("kind = 'view'").select("run_id", F.col("t").alias("st")), BY, "need", "st", [])
    return got.select("run_id", "ord", F.col("matched_t").alias("started"))


@query(ET[:-1] + """, i AS (SELECT run_id, resource, ord, t AS s, t + cents * 10000000 AS f FROM r WHERE kind = 'purchase'),
w AS (SELECT run_id, resource, ord AS task, t AS s, t + cents * 10000000 AS f FROM r WHERE kind = 'view')
SELECT i.run_id, i.ord, arg_min(w.task, (w.s, w.task)) AS task FROM i LEFT JOIN w ON w.run_id = i.run_id AND w.resource = i.resource AND w.s <= i.f AND w.f >= i.s - 5000000 GROUP BY ALL""")
def interval_slack_match(spark, d):
    """The first task of the resource whose interval meets the wait's, with five seconds of slack."""
    e = trace(spark, d).select("run_id", "resource", "ord", "kind", F.col("t").alias("start"), (F.col("t") + F.col("cents") * 10_000_000).alias("end"))
    waits, tasks = e.where("kind = 'purchase'").drop("kind"), e.where("kind = 'view'").withColumnRenamed("ord", "task")
    return intervals.first_overlap(waits, tasks, ["run_id", "resource"], 5_000_000, "task").select("run_id", "ord", "task")


_ISLANDS = """, a AS (SELECT run_id, t AS s, t + cents * 1000000 AS f FROM e WHERE kind = 'view'),
m AS (SELECT *, max(f) OVER (PARTITION BY run_id ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM a),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY s, f ROWS UNBOUNDED PRECEDING) AS g FROM m),
u AS (SELECT run_id, min(s) AS s, max(f) AS f FROM g GROUP BY run_id, g)
"""


def _spans(e, kind, factor):
    return e.where(F.col("kind") == kind).select("run_id", F.col("t").alias("start"), (F.col("t") + F.col("cents") * factor).alias("end"))


@query(E[:-1] + _ISLANDS + "SELECT run_id, s AS start, f AS \"end\" FROM u")
def interval_merge(spark, d):
    """The union of the intervals of a run."""
    return intervals.merge(_spans(trace(spark, d), "view", 1_000_000), BY)


@query(E[:-1] + _ISLANDS + """, a2 AS (SELECT run_id, t AS s, t + cents * 1000000 AS f FROM e WHERE kind = 'click'),
m2 AS (SELECT *, max(f) OVER (PARTITION BY run_id ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM a2),
g2 AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY s, f ROWS UNBOUNDED PRECEDING) AS g FROM m2),
u2 AS (SELECT run_id, min(s) AS s, max(f) AS f FROM g2 GROUP BY run_id, g),
x AS (SELECT u.run_id, sum(greatest(0, least(u.f, u2.f) - greatest(u.s, u2.s))) AS o FROM u JOIN u2 ON u.run_id = u2.run_id GROUP BY u.run_id)
SELECT r.run_id, CAST(coalesce(x.o, 0) AS BIGINT) AS overlap FROM (SELECT run_id FROM u UNION SELECT run_id FROM u2) r LEFT JOIN x USING (run_id)""")
def interval_overlap(spark, d):
    """Length of the intersection of two merged interval sets."""
    e = trace(spark, d)
    got = intervals.intersection_length(_spans(e, "view", 1_000_000), _spans(e, "click", 1_000_000), BY)
    return got.select("run_id", long("overlap"))


@query(E[:-1] + _ISLANDS + """, c AS (SELECT run_id, t AS s, t + cents * 100000 AS f FROM e WHERE kind = 'error'),
p AS (SELECT run_id, s AS t FROM u UNION SELECT run_id, f FROM u UNION SELECT run_id, s FROM c UNION SELECT run_id, f FROM c),
q AS (SELECT run_id, t AS s, lead(t) OVER (PARTITION BY run_id ORDER BY t) AS f FROM p),
k AS (SELECT q.* FROM q WHERE EXISTS (SELECT 1 FROM u WHERE u.run_id = q.run_id AND u.s <= q.s AND u.f >= q.f) AND NOT EXISTS (SELECT 1 FROM c WHERE c.run_id = q.run_id AND c.s <= q.s AND c.f >= q.f AND c.f > c.s))
SELECT run_id, CAST(sum(f - s) AS BIGINT) AS length FROM k GROUP BY run_id""")
def interval_subtract(spark, d):
    """What waits leave of the merged spans."""
    e = trace(spark, d)
    got = intervals.subtract(intervals.merge(_spans(e, "view", 1_000_000), BY), _spans(e, "error", 100_000), BY)
    return got.groupBy("run_id").agg(F.sum(F.col("end") - F.col("start")).alias("length"))


@query(E[:-1] + """, w AS (SELECT *, last_value(CASE WHEN kind = 'signup' THEN k % 5 END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY t, ord ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS model FROM e)
SELECT k % 10 AS tool, model, count(*) AS cnt FROM w WHERE kind = 'click' AND model IS NOT NULL AND model <> 4 GROUP BY ALL HAVING count(*) >= 2""")
def nearest_preceding_within_3(spark, d):
    """The nearest call of a model at most three events before a tool; an unmapped model (4) ends the search; pairs seen twice stay."""
    e = trace(spark, d).withColumn("model", asof.within_rows(trace(spark, d), BY, ORD, F.when(F.col("kind") == "signup", F.col("k") % 5), 3))
    return e.where("kind = 'click' and model <> 4").groupBy((F.col("k") % 10).alias("tool"), "model").agg(F.count(F.lit(1)).alias("cnt")).where("cnt >= 2")


@query(ET[:-1] + " SELECT run_id, resource, min_by(k, (t, ord)) AS k, min(t) AS t FROM r WHERE kind = 'signup' GROUP BY ALL")
def first_per_key(spark, d):
    """The first prediction of each resource."""
    return asof.first_per_key(trace(spark, d).where("kind = 'signup'"), ["run_id", "resource"], ORD, ["k", "t"])


@query(E[:-1] + " SELECT run_id, ord, coalesce(nullif(k % 4, 0), row_number() OVER (PARTITION BY run_id ORDER BY t, ord)) AS step FROM e")
def sequential_step(spark, d):
    """A missing or zero step counts on by position."""
    step = F.col("k") % 4
    return trace(spark, d).select("run_id", "ord", F.when(step != 0, step).otherwise(F.row_number().over(Window.partitionBy(*BY).orderBy(*ORD)).cast("bigint")).alias("step"))


@query(ET[:-1] + " SELECT run_id, max_by(k, (t, ord)) FILTER (kind = 'click') AS latest_tool, max_by(k, (t, ord)) FILTER (kind = 'signup') AS latest_model FROM r GROUP BY run_id")
def latest_tool_model(spark, d):
    """A run's latest tool and model."""
    last = lambda kind, name: F.max_by("k", F.when(F.col("kind") == kind, F.struct(*ORD))).alias(name)
    return trace(spark, d).groupBy("run_id").agg(last("click", "latest_tool"), last("signup", "latest_model"))


@query(ET[:-1] + """ SELECT run_id, ord, first_value(CASE WHEN k % 3 = 0 THEN '' ELSE kind END) OVER w AS marker, coalesce(nullif(first_value(CASE WHEN k % 3 = 0 THEN '' ELSE kind END) OVER w, ''), 'plan') AS route
FROM r WINDOW w AS (PARTITION BY run_id, resource ORDER BY t, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def carry_forward_route(spark, d):
    """A marker of a task's first turn holds for its later ones; a blank one gives way to the plan."""
    marker = F.first(F.when(F.col("k") % 3 == 0, "").otherwise(F.col("kind"))).over(Window.partitionBy("run_id", "resource").orderBy(*ORD).rowsBetween(Window.unboundedPreceding, 0))
    return trace(spark, d).select("run_id", "ord", marker.alias("marker"), F.coalesce(F.nullif(marker, F.lit("")), F.lit("plan")).alias("route"))


@query(E[:-1] + " SELECT run_id, ord, t - lag(t) OVER (PARTITION BY run_id ORDER BY t, ord) AS delta FROM e")
def sample_delta(spark, d):
    """Time since the sample before."""
    return trace(spark, d).select("run_id", "ord", F.greatest(F.when(F.lag("t").over(Window.partitionBy(*BY).orderBy(*ORD)).isNotNull(), F.lit(0)), F.col("t") - F.lag("t").over(Window.partitionBy(*BY).orderBy(*ORD))).alias("delta"))
