"""Hand-worked cases of the library: sources, sinks, operators, guard."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.functions import scalars
from tracewright.operators import analyze, asof, intervals, lifecycle, metrics, ordering, predict, sequences, trials
from tracewright.sources import sinks, traces
from tracewright.streaming import guard


def ev(t, step, kind, **payload):
    return json.dumps({"timestamp": "2024-01-01T00:00:00", "epoch_time": t, "run_id": "r", "step": step, "event_type": kind, "payload": payload})


@pytest.fixture
def trace_file(tmp_path):
    r1 = {"resource_id": "R1", "name": "m:medium", "resource_type": "mace_model", "confidence": 0.95, "estimated_load_s": 40.0, "consumer_tool": "run_ase", "unknown": 1}
    lines = [ev(1000, 1, "tool_call", tool="smiles"), "", "{broken", "null", "[1]", ev(1000, 1, "prediction_result", resources=[r1], predictor_id="mock"), ev(1000, 1, "prefetch_started", task_id="T1", resource_id="R1"), '{"event_type": "tool_call", "payload": null}', ev(1042, 2, "prefetch_completed", task_id="T1", elapsed_s=40)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n\n")
    return str(tmp_path / "a.jsonl")


def test_load_events(spark, trace_file):
    """O: blank, broken and non-object lines fall away; defaults hold; line numbers are exact."""
    got = traces.load_events(spark, trace_file).orderBy("line_no").collect()
    assert [r.line_no for r in got] == [0, 5, 6, 7, 8]
    assert (got[3].run_id, got[3].step, got[3].t) == ("unknown", 0, 0.0)
    assert [r.tool for r in traces.load_events(spark, trace_file).select(traces.payload("tool", default="").alias("tool")).collect()].count("smiles") == 1
    p = traces.predictions(traces.load_events(spark, trace_file)).first()
    assert (p.resource_id, p.confidence, p.predictor_id, p.place) == ("R1", 0.95, "mock", 0)


def test_tail_counts_blank_lines(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text(f"{ev(1, 1, 'a')}\n{ev(2, 1, 'b')}\n\n")
    assert traces.tail_events(spark, str(tmp_path / "b.jsonl"), 2).count() == 1


def test_runs_and_summaries(spark, tmp_path):
    for k, text in enumerate(('{"run_id": "x", "workload": "w", "gpus": ["A"]}', "{bad")):
        d = tmp_path / "runs" / "w" / "c" / f"t{k}"
        d.mkdir(parents=True)
        (d / "meta.json").write_text(text)
        (d / "summary.json").write_text('{"hits": 3}')
    got = traces.discover_runs(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].run_id == "x" and got[0].trial_dir.endswith("/t0")
    assert traces.load_summaries(spark, f"{tmp_path}/runs/*/*/*/summary.json", "hits int").count() == 2


def test_csv_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text('run_id,phase,timestamp,duration_s,total_tokens,notes\nr,load:a,2024-01-01T00:00:10,4,,\nr,SUMMARY,2024-01-01T00:00:20,x,3.0,"a=1 b=2=3 skip a=4"\nr,SUMMARY,,1,2,\n')
    got = traces.load_metrics_csv(spark, str(tmp_path / "m.csv")).collect()
    assert len(got) == 1 and got[0].duration_s is None and got[0].total_tokens is None and got[0].notes_map == {"a": "4", "b": "2=3"}
    p = traces.load_phases(spark, str(tmp_path / "m.csv")).first()
    assert (p.kind, p.start, p.end) == ("load", 0.0, 4.0)
    (tmp_path / "p.csv").write_text("t_rel_s,gpu0_util_pct,gpu1_mem_used_mb\n0,-1,5\n1,50,oops\n")
    rows = {(r.t_rel_s, r.gpu, r.metric): r.value for r in traces.load_profile(spark, str(tmp_path / "p.csv")).collect()}
    assert rows == {(0.0, 0, "util_pct"): None, (0.0, 1, "mem_used_mb"): 5.0, (1.0, 0, "util_pct"): 50.0, (1.0, 1, "mem_used_mb"): None}
    (tmp_path / "t.csv").write_text("task,started,hit\na,1.5,True\nb,,false\n")
    assert [(r.started, r.hit) for r in traces.load_timings(spark, str(tmp_path / "t.csv"), ["started"], ["hit"]).orderBy("task").collect()] == [(1.5, True), (None, False)]


def test_registry_and_transitions(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"name": "a", "consumer_tool": "x"}, {"name": "b", "consumer_tool": "x", "_comment": "no"}, {"name": "c"}, {"_comment": "only"}]))
    assert [r.name for r in traces.load_registry(spark, str(tmp_path / "r.json")).collect()] == ["a"]
    assert traces.consumer_map(spark, str(tmp_path / "r.json")).first().names == ["a", "b"]
    table = spark.createDataFrame([("a", 1, "b", 3, 0.75, 1), ("a", 1, "c", 1, 0.25, 2), ("a", 2, "b", 2, 1.0, 1)], "source string, off int, target string, cnt long, prob double, rank long")
    (tmp_path / "t.json").write_text(sinks.transitions_json(table).first().json)
    back = traces.load_transitions(spark, str(tmp_path / "t.json"))
    assert sorted(tuple(r) for r in back.select(*table.columns).collect()) == sorted(tuple(r) for r in table.collect())
    assert traces.load_transitions(spark, str(tmp_path / "none.json")).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    sinks.append_events(df, f"{tmp_path}/e")
    sinks.append_events(df, f"{tmp_path}/e")
    assert spark.read.json(f"{tmp_path}/e").count() == 2
    sinks.append_csv(df, f"{tmp_path}/c")
    sinks.write_table(df.limit(0), f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 0
    u = sinks.union_rows(df, spark.createDataFrame([(2.5,)], "z double"))
    assert u.columns == ["x", "y", "z"] and u.count() == 2
    sinks.write_report_csv(df, ["y", "x"], ["x"], f"{tmp_path}/r")
    assert json.loads(sinks.as_json(df).first().json) == {"x": 1, "y": "a"}
    assert sinks.numbered(df, ["x"]).first().place == 1


def test_io_sources(spark):
    rows = spark.createDataFrame([("a", "v1", "3", "1"), ("a", "v1", "6", "4"), ("a", "v1", "", ""), ("b", "v1", "9", "9")], "app string, variant string, runtime_s string, mb string")
    assert traces.mean_io(rows, "a", {"v1": "V"}, ["mb"]).collect()[0].mb == 2.0
    p = spark.createDataFrame([("w", 100.0), ("w", 300.0), ("w", None), ("u", 5.0)], "k string, v double")
    assert {r.k: r.v for r in traces.preferred_mean(p, F.col("v") > 200, "v", ["k"]).collect()} == {"w": 300.0, "u": 5.0}
    c = spark.createDataFrame([("f", 1, "begin", 5.0), ("f", 2, "end", 9.0), ("g", 3, "begin", 9.0), ("g", 4, "end", 1.0)], "file string, o int, phase string, v double").withColumn("k", F.lit(1))
    assert traces.counter_delta(c, ["k"], "file", "o", "phase", "v").first().delta == 2.0
    b = spark.createDataFrame([("f", 1.0), ("f", 2e12), ("g", 3.0)], "file string, v double").withColumn("k", F.lit(1))
    assert traces.median_bytes(b, ["k"], "file", "v").first().bytes == 2.0 and traces.median_bytes(b, ["k"], "file", None).first().bytes == 9072.0
    s = spark.createDataFrame([("simulation", 10.0), ("train", 2.0), ("train", 4.0)], "stage string, v double")
    assert traces.cycle_times(s, "stage", "v").first().cycle == 13.0


EVENTS = "run int, ord int, t double, kind string, task string, resource string"


def test_lifecycle_cases(spark):
    """A, B and restarts: completion before the last start does not count, save in the analyzer's view."""
    rows = [(1, 1, 1000.0, "s", "T1", "R1"), (1, 2, 1030.0, "u", "T1", "R1"), (1, 3, 1042.0, "c", "T1", "R1"), (1, 4, 1050.0, "c", "T2", "R2"), (1, 5, 1060.0, "s", "T2", "R2"), (1, 6, 1070.0, "s", "T3", "R1")]
    e = spark.createDataFrame(rows, EVENTS)
    got = {r.task: r for r in lifecycle.tasks(e, ["run"], "s", "c", "x", "u").collect()}
    assert got["T1"].completed_t == 1042.0 and got["T1"].consumed_t == 1030.0 and got["T2"].completed_t is None
    stubs = {r.task: r for r in lifecycle.tasks(e.where("ord < 5"), ["run"], "s", "c", "x", "u", stubs=True).collect()}
    assert stubs["T2"].started_t is None and stubs["T2"].completed_t == 1050.0
    res = {r.resource: r for r in lifecycle.resource_timings(e, ["run"], "s", "c", "u").collect()}
    assert (res["R1"].task, res["R1"].started_t, res["R1"].completed_t) == ("T3", 1070.0, 1042.0) and res["R2"].completed_t is None
    assert lifecycle.tasks(e.limit(0), ["run"], "s", "c", "x", "u").count() == 0


def test_timing_arithmetic(spark):
    """M and A: both definitions of benefit and waste."""
    rows = [(100.0, 130.0, 150.0, False), (100.0, 140.0, 120.0, False), (0.0, 1200.0, 2700.0, False), (0.0, 1200.0, 2700.0, True), (0.0, None, 5.0, False)]
    df = spark.createDataFrame(rows, "s double, e double, n double, x boolean")
    t = metrics.task_timing(F.col("s"), F.col("e"), F.col("n"), F.col("x"), F.lit(False))
    assert [tuple(r) for r in df.select(*t.values()).collect()] == [(30.0, 20.0, 0.0), (20.0, 0.0, 20.0), (1200.0, 1500.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    a = metrics.stall_and_benefit(*[F.lit(x) for x in (1000.0, 1042.0, 1030.0, 40.0)])
    assert tuple(df.limit(1).select(*a.values()).first()) == (30.0, 12.0, 28.0, 0.0)
    assert df.limit(1).select(lifecycle.completion_time(F.lit(1000.0), F.lit(40.0), F.lit(1042.0)), lifecycle.completion_time(F.lit(0.0), F.lit(40.0), F.lit(1042.0))).first() == (1040.0, 1042.0)


def test_intervals(spark):
    """E, and merged length never exceeds the sum."""
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 10, 12)], "k int, start int, end int")
    assert sorted(tuple(r) for r in intervals.merge(df, ["k"]).collect()) == [(1, 0, 8), (1, 10, 12)]
    other = spark.createDataFrame([(1, 4, 11), (2, 0, 1)], "k int, start int, end int")
    assert {r.k: r.overlap for r in intervals.intersection_length(df, other, ["k"]).collect()} == {1: 5, 2: 0}
    left = intervals.subtract(df.where("start < 10").groupBy("k").agg(F.min("start").alias("start"), F.max("end").alias("end")), spark.createDataFrame([(1, 2, 3), (1, 8, 9), (1, 5, 5)], "k int, start int, end int"), ["k"])
    assert sorted((r.start, r.end) for r in intervals.merge(left, ["k"]).collect()) == [(0, 2), (3, 8)]
    rng = random.Random(0)
    many = [(rng.randint(0, 3), a := rng.randint(0, 100), a + rng.randint(0, 20)) for _ in range(200)]
    got = {r.k: r.length for r in intervals.total_length(spark.createDataFrame(many, "k int, start int, end int"), ["k"]).collect()}
    for k in got:
        assert got[k] == len({x for kk, a, b in many if kk == k for x in range(a, b)})


def test_transitions_hand_case(spark):
    """D: offsets count every element, only equal kinds pair."""
    seq = spark.createDataFrame([(1, 1, "t", "a"), (1, 2, "m", "m"), (1, 3, "t", "b"), (1, 4, "t", "a"), (1, 5, "t", "b")], "r int, o int, kind string, x string")
    p = sequences.transition_probs(sequences.pairs_within(seq, ["r"], ["o"], "x", 3, "kind"), 1)
    assert {(r.source, r.off, r.target, r.prob) for r in p.collect()} == {("a", 2, "b", 1.0), ("a", 3, "a", 1.0), ("b", 1, "a", 1.0), ("b", 2, "b", 1.0), ("a", 1, "b", 1.0)}
    tools = seq.where("kind = 't'")
    assert {(r.source, r.target): r.prob for r in sequences.transition_matrix(tools, ["r"], ["o"], "x").collect()} == {("a", "b"): 1.0, ("b", "a"): 1.0}
    assert sequences.transition_matrix(tools, ["r"], ["o"], "x", 1, 2).count() == 0


def test_pairing(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 4), k, rng.choice("se")) for k in range(300)]
    df = spark.createDataFrame(rows, "r int, t int, k string")
    got = sorted(tuple(x) for x in sequences.fifo_pairs(df, ["r"], ["t"], F.col("k") == "s", F.col("k") == "e").collect())
    want, queues = [], {}
    for r, t, k in rows:
        q = queues.setdefault(r, [])
        if k == "s":
            q.append(t)
        elif q:
            want.append((r, q.pop(0), t))
    assert got == sorted(want)
    spans = sequences.span_pairs(spark.createDataFrame([(1, 1, "s"), (1, 2, "s"), (1, 3, "e"), (1, 4, "e")], "r int, t int, k string"), ["r"], ["t"], F.col("k") == "s", F.col("k") == "e")
    assert [tuple(x) for x in spans.collect()] == [(1, 2, 3)]


def test_asof_joins(spark):
    left = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 10, "a"), (1, 10, "b"), (1, 15, "c"), (2, 1, "d")], "k int, u int, v string")
    back = {(r.k, r.t): r.v for r in asof.backward(left, right, ["k"], "t", "u", ["v"], tie="v").collect()}
    assert back == {(1, 10): "b", (1, 20): "c", (2, 5): "d"}
    strict = {(r.k, r.t): r.v for r in asof.backward(left, right, ["k"], "t", "u", ["v"], tie="v", equal=False).collect()}
    assert strict[(1, 10)] is None
    ahead = {(r.k, r.t): r.v for r in asof.forward(left, right, ["k"], "t", "u", ["v"], tie="v").collect()}
    assert ahead == {(1, 10): "a", (1, 20): None, (2, 5): None}
    last = {(r.k, r.t): r.v for r in asof.forward(left, right, ["k"], "t", "u", ["v"], tie="v", else_last=True).collect()}
    assert last == {(1, 10): "a", (1, 20): "c", (2, 5): "d"}


def test_moving_average_median_cdf_idle(spark):
    """F, J, I, H."""
    s = spark.createDataFrame([(1, 1, 3), (1, 2, 6), (1, 3, 9), (2, 1, 4)], "k int, o int, v int")
    assert [r.smooth for r in metrics.moving_average(s, ["k"], ["o"], "v").orderBy("k", "o").collect()] == [3, 6, 5, 4]
    m = spark.createDataFrame([(1, v, i) for i, v in enumerate((10, 20, 30, 40))], "k int, v int, i int")
    assert ordering.upper_median(m, ["k"], "v", "i").first().v == 30
    c = spark.createDataFrame([(1, v, i) for i, v in enumerate((5, 5, 7))], "k int, v int, i int")
    assert sorted(round(r.cdf, 6) for r in ordering.empirical_cdf(c, ["k"], "v", "i").collect()) == [0.333333, 0.666667, 1.0]
    g = spark.createDataFrame([(1, 0, 0, 0, 10, 20), (1, 2, 0, 0, 10, 30), (1, 5, 50, 0, 20, 30)], "k int, t int, a int, b int, x int, y int")
    r = metrics.idle_stats(g, ["k"], "t", "t", ["a", "b"], ["x", "y"]).first()
    assert (r.idle, r.idle_fraction, r.mean_util, r.peak_mem) == (2, 0.4, 12.5, 50)
    w = spark.createDataFrame([("w", "baseline", 100.0), ("w", "full", 80.0), ("w", "full", 90.0)], "wl string, c string, v double")
    roll = {r.c: r for r in metrics.rollup_vs_baseline(w, ["wl"], "c", "baseline", "v").collect()}
    assert roll["baseline"]["std"] == 0.0 and round(roll["full"]["std"], 2) == 7.07 and round(roll["full"].speedup, 4) == 1.1765


def test_taxonomy_displaced_cells(spark):
    """G: a class that led and lost keeps a cell of 0; a smaller one that came later leaves none."""
    schema = "run int, cfg string, g string, o int, e double, cls string"
    rows = [(1, "c", "g1", 1, 38.0, "no_window"), (1, "c", "g1", 2, 120.0, "residual")]
    got = lambda r: {x.cls: x.seconds for x in lifecycle.taxonomy(spark.createDataFrame(r, schema), ["run"], ["cfg"], "g", "e", "cls", "o").collect()}
    assert got(rows) == {"no_window": 0.0, "residual": 120.0}
    assert got([(1, "c", "g1", 1, 120.0, "residual"), (1, "c", "g1", 2, 38.0, "no_window")]) == {"residual": 120.0}
    assert lifecycle.gate_exposure(spark.createDataFrame([*rows, (1, "c", "", 3, 5.0, "x"), (1, "c", "", 4, 6.0, "x")], schema), ["run"], "g", "e").first().exposure == 131.0


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(scalars.falsy_coalesce(F.lit(0), F.lit(None).cast("int"), F.lit(3))) == 3
    assert value(scalars.falsy_coalesce(F.lit(""), F.lit("b"))) == "b"
    assert value(scalars.lenient_int(F.lit("3.0"))) is None and value(scalars.lenient_int(F.lit(" 3 "))) == 3
    assert value(scalars.gpu_family(F.lit("NVIDIA RTX PRO 6000"))) == "Blackwell" and value(scalars.gpu_family(F.lit(" "))) == "unknown"
    assert value(scalars.condition_label(F.lit(""), F.lit("baseline"), F.lit("x"))) == "baseline"
    assert value(scalars.bytes_with_source(F.lit(None).cast("long"), F.lit(0)))["source"] == "unknown"
    assert value(scalars.specialist_marker(F.lit("go [specialist:  Chem] now"))) == "chem"
    p = value(scalars.extract_plan(F.lit("First plan_task, then plan_task again, computation_task_NEB and computation_task."), ["plan_task", "computation_task", "computation_task_NEB"]))
    assert (p.n_mentions, p.tools) == (4, ["plan_task", "computation_task_NEB", "computation_task"])
    plan = F.array(*map(F.lit, "abc"))
    actual = F.array(*map(F.lit, "axc"))
    assert value(scalars.greedy_match(plan, actual)) == [True, False, True] and value(scalars.strict_match(plan, actual)) == [True, False, False]
    assert value(scalars.merged_class(F.lit("policy_skip:low"))) == "policy_skip" and value(scalars.simulated(F.lit(None).cast("string"), F.lit(0.2), F.lit(2e9)))
    assert value(scalars.shorten(F.lit("a" * 30), {"b": "c"})) == "a" * 16 and value(scalars.shorten(F.lit("b"), {"b": "c"})) == "c"
    assert value(scalars.human_bytes(F.lit(2.5e9))) == "2.5 GB"


def test_merge_fill_and_registry(spark):
    """N: a present null stays."""
    left = spark.createDataFrame([("r", None, ["x"]), ("s", None, [])], "id string, x int, keys array<string>")
    got = {r.id: r.x for r in metrics.fill_missing(left, spark.createDataFrame([("r", 9), ("s", 8)], "id string, x int"), "id", ["x"]).collect()}
    assert got == {"r": None, "s": 8}
    a = spark.createDataFrame([("t", 1, "first")], "tool string, rid int, v string")
    b = spark.createDataFrame([("t", 1, "second"), ("t", 2, "own")], "tool string, rid int, v string")
    assert {r.rid: r.v for r in predict.merge_registries([a, b], ["tool", "rid"]).collect()} == {1: "first", 2: "own"}
    calls = spark.createDataFrame([(1, "a"), (2, "z")], "step int, tool string")
    registry = spark.createDataFrame([("a", "m1", 1, 0.9), ("a", "m2", 2, 0.5), ("b", "m3", 1, 0.8)], "tool string, name string, off int, confidence double")
    rule = predict.rule_predict(calls, registry)
    assert {(r.name, r.horizon, r.best) for r in rule.collect()} == {("m1", 1, 0.9), ("m2", 1, 0.9)}
    table = spark.createDataFrame([("a", "c", 1, 0.9, 1), ("a", "b", 2, 0.6, 1), ("z", "b", 1, 0.2, 1)], "source string, target string, off int, prob double, rank int")
    by_table = predict.table_predict(calls, table, registry.drop("off"))
    assert [(r.step, r.name) for r in by_table.collect()] == [(1, "m3")]
    best = predict.learned_predict(rule.limit(0).select("step", "name"), by_table.select("step", "name"), rule.select("step", "name"), ["step"])
    assert [(r.step, r.name, r.signal) for r in best.collect()] == [(1, "m3", 1)]
    ranks = predict.sensitivity(spark.createDataFrame([("full", 10), ("a", 12), ("b", 12), ("c", 0)], "c string, w int"), "c", "w", "full")
    assert [(r.c, r.delta) for r in ranks.collect()] == [("b", 2), ("a", 2)]


@pytest.mark.parametrize("small", [100_000, 0])
def test_learned_predictions_move_calls_not_rows(spark, monkeypatch, small):
    """Calls that are dealt before they multiply bring the rows of null, repeated and unknown calls as others do; then no exchange stands above
    the union of the signals, and the table is not worked out again. Rows that are not few are joined without."""
    monkeypatch.setattr(predict, "SMALL", small)
    calls = spark.createDataFrame([(r, k % 40, t) for r in (1, 1, 2, None) for k in range(41) for t in ("a", "z", None)] + [(3, None, "a"), (None, None, "z"), (4, 1, "none")], "run_id long, ord long, tool string")
    registry = spark.createDataFrame([("a", 1, 1, 0.9), ("a", 2, 2, 0.5), ("a", 2, 2, 0.5), ("c", 3, 1, 0.8), ("c", None, 1, 0.7), ("z", 4, 1, None), (None, 5, 1, 0.1)], "tool string, rid long, off int, confidence double")
    table = spark.createDataFrame([("a", "c", 1, 0.9, 1), ("a", "b", 2, 0.6, 1), ("z", "b", 1, 0.2, 1), (None, "c", 1, 0.9, 1)], "source string, target string, off int, prob double, rank int")
    plan, key = calls.where("ord % 7 = 3").select("run_id", "ord", F.lit(9).cast("long").alias("rid")), ["run_id", "ord"]

    def signals(by):
        own = plan.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by) if by else plan
        told = [predict.table_predict(calls, table, registry.drop("off", "confidence"), by=by), predict.rule_predict(calls, registry, by=by)]
        return predict.learned_predict(own, *[x.select(*key, "rid") for x in told], key)

    got, want = ([tuple(r) for r in signals(by).collect()] for by in (key, ()))
    assert sorted(map(str, got)) == sorted(map(str, want)) and {s for *_, s in got} == {0, 1, 2} and {r for r, *_ in got} == {1, 2, 3, None}
    text = signals(key)._jdf.queryExecution().executedPlan().toString()
    if small:
        assert text.index("Union") < text.index("Exchange") and text.count("Window [") == 1
    else:
        assert "BroadcastHashJoin" not in text.split("Union")[0] and "REPARTITION_BY_NUM" in text


def test_guard_cases():
    """L: hit, divergence by prefix, silent, not eligible; conservative steps."""
    g = guard.Guard()
    g.feed(1, "prediction", "computation_task", 2)
    assert g.feed(1, "tool", "computation_task", 0)[0] == "silent"
    assert g.feed(2, "tool", "other", 0) == ("silent", None, False)
    assert g.feed(2, "tool", "computation_task_NEB", 0) == ("diverged", "computation_task", True)
    assert g.feed(5, "tool", "x", 0)[2] and not g.feed(6, "tool", "x", 0)[2]
    g.feed(5, "prediction", "x", 6)
    assert g.pending == []
    old = guard.Guard()
    old.feed(1, "prediction", "x", 2)
    assert old.feed(62, "tool", "x", 0)[0] == "silent"
    slot = guard.Guard("slot")
    slot.feed(1, "prediction", "a", 4)
    assert slot.feed(2, "tool", "b", 0)[0] == "silent" and slot.feed(4, "tool", "ab", 0)[0] == "diverged"


@pytest.mark.parametrize("mode", ["queue", "slot"])
def test_guard_stream_equals_batch(spark, tmp_path, mode):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(1)
    rows = [(r, o, o, rng.choice(["prediction", "tool"]), rng.choice(["a", "ab", "b"]), o + rng.randint(0, 2)) for r in range(3) for o in range(1, 60)]
    schema = "run_id long, ord long, step int, kind string, tool string, expected_at int"
    for k in range(3):  # three files, in order
        spark.createDataFrame([x for x in rows if (x[1] - 1) // 20 == k], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = guard.stream(source, mode).writeStream.format("memory").queryName(f"out_{mode}").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = guard.replay(spark.createDataFrame(rows, schema), mode).toPandas().sort_values(["run_id", "ord"]).reset_index(drop=True)
    live = spark.table(f"out_{mode}").toPandas().sort_values(["run_id", "ord"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(batch, live)
    machine = {}
    want = [v[0] for x in rows if (v := machine.setdefault(x[0], guard.Guard(mode)).feed(*x[2:]))]
    assert list(batch.outcome) == want


def test_agent_responses(spark):
    from tracewright.functions import text

    assert text.tool_name_in('see ```json\n{"name": "run_ase", "x": 1}\n``` ok') == "run_ase"
    assert text.tool_name_in('{"tool": "make_file"}') == "make_file"
    assert text.tool_name_in("x = run_it(3)\nprint(x)") == "run_it"
    assert text.tool_name_in("print(3)") is None and text.tool_name_in(None) is None and text.tool_name_in("call foo(") is None
    r = json.dumps({"choices": [{"message": {"content": "hi", "tool_calls": [{"function": {"name": "a_b", "arguments": "not json"}}, {"function": {"name": "c_d", "arguments": '{"k": 1}'}}]}}]})
    df = spark.createDataFrame([(r,), ("{}",), (None,)], "r string").select(text.tool_calls(F.col("r")).alias("c"), text.response_content(F.col("r")).alias("t"))
    got = df.collect()
    assert [(c["name"], c["arguments"]) for c in got[0].c] == [("a_b", "{}"), ("c_d", '{"k": 1}')] and got[0].t == "hi"
    assert got[1].c == [] and got[2].t == ""
    plan = spark.createDataFrame([('{"worker_tasks": [{"prompt": "a"}, {"prompt": "b"}]}',), ("x",)], "m string").select(text.planner_prompts(F.col("m")).alias("p"))
    assert [x.p for x in plan.collect()] == ["a b", ""]


def test_greedy_plan_query_against_a_fold(spark):
    from tracewright.plans import metric_queries
    from tracewright.plans.base import trace

    sf = "/root/testdata/sf0.001"
    runs: dict[int, list] = {}
    for e in trace(spark, sf).orderBy("t", "ord").collect():
        runs.setdefault(e.run_id, []).append(e.kind)
    got = {(r.run_id, r.pos): r.ok for r in metric_queries.plan_compliance_greedy(spark, sf).collect()}
    for run, actual in runs.items():
        at = 0
        for pos, step in enumerate(("signup", "error", "view", "purchase")):
            ok = step in actual[at:]
            at = actual.index(step, at) + 1 if ok else at
            assert got[run, pos] == ok


def test_tool_names_of_all_events(spark, tmp_path):
    from tracewright import plans

    rows = [(k, kind) for k, kind in enumerate(["view", "click", "error"] * 400)]
    spark.createDataFrame(rows, "event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.event_id, r.name) for r in plans.QUERIES["tool_name_parsing"](spark, str(tmp_path)).collect()}
    # one form in six is JSON whose name is no tool's
    assert got == {(k, None if k % 6 == 4 else f"{kind}_tool") for k, kind in rows}


def summary(spark, tmp_path, *lines, consumers=None):
    (tmp_path / "t.jsonl").write_text("\n".join(lines) + "\n")
    events = traces.load_events(spark, str(tmp_path / "t.jsonl"))
    pairs = spark.createDataFrame(consumers or [("none", "none")], "name string, tool string")
    return analyze.analyze(events).first(), analyze.evaluate(events, consumers=pairs).first()


def spec(rid, est, **more):
    return {"resource_id": rid, "name": f"name-{rid}", "resource_type": "mace_model", "confidence": 0.95, "estimated_load_s": est, "consumer_tool": "run_ase", **more}


def test_one_late_task(spark, tmp_path):
    """Fixture A: the analyzer's clock and the evaluation's differ."""
    a, q = summary(
        spark, tmp_path, ev(1000, 1, "tool_call", tool="smiles"), ev(1000, 1, "prediction_result", resources=[spec("R1", 40.0)], predictor_id="mock"), ev(1000, 1, "checkpoint_created", checkpoint_id="C1"), ev(1000, 1, "prefetch_decision", resource_id="R1", action="start", estimated_load_s=40.0),
        ev(1000, 1, "prefetch_started", task_id="T1", resource_id="R1"), ev(1030, 2, "tool_call", tool="run_ase"), ev(1030, 2, "prediction_validated", hit=True, checkpoint_id="C1"), ev(1030, 2, "resource_consumed", resource_id="R1", task_id="T1", status="used"), ev(1042, 2, "prefetch_completed", task_id="T1", elapsed_s=40.0), consumers=[("name-R1", "run_ase")],
    )
    assert (a.hit_count, a.miss_count, a.precision, a.coverage, a.honest_accuracy) == (1, 0, 1.0, 1.0, 1.0)
    assert (a.total_overlap_s, a.total_stall_s, a.total_benefit_s, a.total_waste_s) == (30.0, 12.0, 28.0, 0.0)
    assert (q.n_late, q.n_useful, q.residual_other_s, q.mean_lead_s, q.precision, q.recall, q.on_time_rate, q.n_expired) == (1, 0, 10.0, 30.0, 1.0, 1.0, 0.0, 0)


def test_divergence_wastes_a_completed_task(spark, tmp_path):
    """Fixture B."""
    a, q = summary(
        spark, tmp_path, ev(1000, 1, "prediction_result", resources=[spec("R2", 20.0)]), ev(1000, 1, "prefetch_started", task_id="T2", resource_id="R2"), ev(1010, 1, "prefetch_completed", task_id="T2", elapsed_s=10.0),
        ev(1015, 2, "tool_call", tool="other"), ev(1015, 2, "divergence_detected", checkpoint_id="C2"), ev(1015, 2, "prefetch_cancelled", task_id="T2", wasted=True), ev(1015, 2, "conservative_mode", duration_steps=3),
    )
    assert (a.miss_count, a.precision, a.honest_accuracy, a.total_stall_s, a.total_waste_s, a.wasted_prefetch, a.prefetch_cancelled) == (1, 0.0, 0.0, 0.0, 10.0, 1, 1)
    assert (q.n_wasted, q.precision, q.recall, q.n_wrong_after, q.conservative_steps, q.speculative_read_s, q.mean_lead_s) == (1, 0.0, None, 0, 3, 10.0, None)


def test_consumed_without_a_prefetch(spark, tmp_path):
    """Fixture C, and a stamp of a tool that does not consume the resource."""
    a, q = summary(spark, tmp_path, ev(1, 1, "prediction_result", resources=[spec("R3", 50.0)]), ev(1, 1, "prefetch_decision", resource_id="R3", action="skip", estimated_load_s=50.0), ev(9, 2, "resource_consumed", resource_id="R3", task_id=None, status="no_prefetch"))
    assert a.total_stall_s == 50.0 and (q.no_prefetch_stall_s, q.exposed_stall_s, q.n_admitted, q.n_skipped) == (50.0, 50.0, 0, 1)
    rows = [ev(1, 1, "prediction_result", resources=[spec("R4", 5.0)]), ev(1, 1, "prefetch_started", task_id="T4", resource_id="R4"), ev(2, 1, "tool_call", tool="wrong"), ev(2.1, 1, "resource_consumed", resource_id="R4", task_id="T4", status="used"), ev(7, 1, "prefetch_completed", task_id="T4", elapsed_s=0)]
    _, q = summary(spark, tmp_path, *rows, consumers=[("name-R4", "right")])
    assert (q.n_wasted, q.n_late) == (1, 0)
    _, q = summary(spark, tmp_path, *rows, consumers=[("name-R4", "wrong")])
    assert (q.n_wasted, q.n_late) == (0, 1)


def test_line_numbers_of_split_files(spark, tmp_path):
    """Places are exact however many splits a file is read in."""
    (tmp_path / "long.txt").write_text("".join(f"line {k}\n" for k in range(40_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = traces.lines(spark, str(tmp_path / "long.txt"))
        assert got.where("line <> concat('line ', line_no)").count() == 0 and got.count() == 40_000
        assert got.select(F.spark_partition_id()).distinct().count() >= 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_transitions_reload(spark, tmp_path):
    from tracewright.plans import more_queries, trace_queries

    sf = "/root/testdata/sf0.001"
    columns = ["source", "off", "target", "prob", "cnt", "rank"]
    assert sorted(map(tuple, trace_queries.transitions_reloaded(spark, sf).select(*columns).collect())) == sorted(map(tuple, more_queries.likely(spark, sf).select(*columns).collect()))


def test_places_and_prefixes_of_empty_tables(spark):
    none = spark.createDataFrame([], "a string, b long")
    assert ordering.placed(none, [F.col("b")]).count() == 0
    assert predict.starts_with(none, "a", none.select(F.col("a").alias("p")), "p").count() == 0
    two = spark.createDataFrame([("abc", 1), (None, 2), ("ab", 3)], "a string, b long")
    p = spark.createDataFrame([("ab",), ("abc",), ("x",), (None,)], "p string")
    assert sorted((r.a, r.p) for r in predict.starts_with(two, "a", p, "p").collect()) == [("ab", "ab"), ("abc", "ab"), ("abc", "abc")]


def test_votes_for_a_source(spark):
    rows = [(0.95, 0.0, 20.0, "page_cache"), (0.1, 2e9, 5.0, "nfs"), (0.5, None, 1.0, "mixed"), (None, 0.0, 20.0, "unknown"), (None, None, 1.0, "unknown"), (None, 2e9, 1.0, "nfs"), (0.95, 2e9, 1.0, "page_cache")]
    df = spark.createDataFrame(rows, "h double, n double, e double, want string")
    assert df.where(metrics.source_verdict(F.col("h"), F.col("n"), F.col("e")) != F.col("want")).count() == 0


def test_first_overlap(spark):
    left = spark.createDataFrame([(1, 0, 10), (1, 30, 31), (2, 0, 1)], "k int, start int, end int")
    right = spark.createDataFrame([(1, 8, 9, "b"), (1, 2, 3, "a"), (1, 20, 26, "c"), (1, 21, 40, "d")], "k int, start int, end int, v string")
    got = {(r.k, r.start): r.v for r in intervals.first_overlap(left, right, ["k"], 5, "v").collect()}
    assert got == {(1, 0): "a", (1, 30): "c", (2, 0): None}


def test_trial_rows(spark, tmp_path):
    """A gated engine with its cache in time, a skip that was needed, a lone gate fetched by the adapter, a load from disk, and what was
    consumed without a prefetch."""
    engine = spec("E", 90.0, name="big", resource_type="vllm_model", consumer_tool="run")
    cache, other = spec("C", 10.0, name="big", resource_type="model_cache"), spec("S", 30.0, consumer_tool="late_tool")
    lines = [
        ev(100, 1, "tool_call", tool="plan"), ev(100, 1, "prediction_result", resources=[engine, cache, other], predictor_id="m"), ev(101, 1, "prefetch_decision", resource_id="S", action="skip", reason="low"),
        ev(102, 1, "prefetch_started", task_id="T1", resource_id="E"), ev(103, 1, "prefetch_started", task_id="T2", resource_id="C"), ev(140, 1, "prefetch_completed", task_id="T2", elapsed_s=20.0),
        ev(150, 2, "aggregator_prefetch_start"), ev(160, 2, "tool_call", tool="late_tool"), ev(220, 2, "prefetch_completed", task_id="T1", elapsed_s=118.0), ev(220, 2, "worker_swap_wait", model="big", wait_s=60.0),
        ev(300, 3, "aggregator_swap_wait", model="agg", wait_s=5.0, prefetch_started=True), ev(310, 3, "mace_load", model="mp", source="disk", duration_s=7.0), ev(320, 3, "resource_consumed", resource_id="X", status="no_prefetch"),
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(lines) + "\n")
    got = {(r["name"], r["type"]): r for r in trials.trial_rows(traces.load_events(spark, str(tmp_path / "t.jsonl"))).collect()}
    e, c = got["big", "vllm_model"], got["big", "model_cache"]
    assert (e.need_source, e.t_needed, e.exposure_s, e.window_s, e.stall_class, e.gate_group) == ("swap_wait", 60.0, 60.0, 60.0, "gpu_serialization_residual", "swap_wait:big:0")
    assert (c.t_completed, c.lead_s, c.start_delay_s, c.gate_group, c.stall_class) == (23.0, 37.0, 3.0, "swap_wait:big:0", "residual_partial")
    s = got["name-S", "mace_model"]
    assert (s.outcome, s.exposure_s, s.t_needed, s.stall_class) == ("skipped", 30.0, 60.0, "policy_skip:low")
    g = got["agg", "vllm_model"]
    assert (g.outcome, g.t_started, g.t_needed, g.exposure_s, g.stall_class) == ("direct_prefetch", 50.0, 195.0, 5.0, "residual_partial")
    assert (got["mp", "mace_model"].exposure_s, got["mp", "mace_model"].stall_class) == (7.0, "no_prediction") and got["X", ""].outcome == "no_prediction" and len(got) == 6
