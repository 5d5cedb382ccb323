"""Orders of any size, keyed state over batches and streams, typed events, predictors, plans and learning in parts."""

import json
import random
import re
from functools import reduce

import duckdb
import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright import plans
from tracewright.functions import scalars
from tracewright.operators import analyze, ordering, predictors, sequences
from tracewright.sources import sinks, traces
from tracewright.streaming import lifecycles, scheduler

from .oracle import compare

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture()
def conf(spark):
    """Set session settings for one test."""
    before = {}

    def put(**settings):
        for k, v in settings.items():
            k = k.replace("__", ".")
            before.setdefault(k, spark.conf.get(k, None))
            spark.conf.set(k, v)

    yield put
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# --- orders ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_places_with_more_columns_than_the_order(spark, tmp_path, conf, coalesce):
    """Six files, eight partitions, a column besides the order: ranges and their counts are of the same rows."""
    conf(spark__sql__shuffle__partitions="8", spark__sql__adaptive__coalescePartitions__enabled=coalesce)
    rng = random.Random(1)
    rows = [(k, rng.randrange(300), rng.random()) for k in range(60_000)]
    spark.createDataFrame(rows, "id long, v long, other double").repartition(6).write.parquet(f"{tmp_path}/in")
    got = ordering.placed(spark.read.parquet(f"{tmp_path}/in"), [F.col("v"), F.col("id")])
    assert got.columns == ["id", "v", "other", "place"]
    want = {r[0]: (n, r[2]) for n, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}
    assert {r.id: (r.place, r.other) for r in got.collect()} == want


def grouped_rows(spark):
    rng = random.Random(3)
    rows = [(g, k, v) for g, n in (("a", 900), ("b", 41), ("c", 1), (None, 60)) for k, v in enumerate(rng.choice([None, 5.0, 5.0, 7.5, rng.random() * 9]) for _ in range(n))]
    rows += [("same", k, 2.0) for k in range(300)] + [("ends", k, 1.0 if k < 149 else 3.0) for k in range(300)] + [("none", 1, None)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, k long, v double").repartition(5)


def by_group(rows):
    out = {}
    for g, k, v in rows:
        out.setdefault(g, []).append((k, v))
    return out


@pytest.mark.parametrize("window", [20, 10**6])
def test_ranks_and_places_of_large_groups(spark, monkeypatch, window):
    """The same with windows and without, for groups of ties, of one value and of nulls."""
    monkeypatch.setattr(ordering, "WINDOW", window)
    monkeypatch.setattr(ordering, "BUCKETS", 8)
    rows, df = grouped_rows(spark)
    real = {g: sorted((v, k) for k, v in x if v is not None) for g, x in by_group(rows).items()}
    real = {g: x for g, x in real.items() if x}
    got = {r.g: (r.v, r.k) for r in ordering.upper_median(df, ["g"], "v", "k").collect()}
    assert got == {g: x[len(x) // 2] for g, x in real.items()}
    medians = {r.g: r.median for r in ordering.median(df, ["g"], "v").collect()}
    assert medians == {g: pd.Series([v for v, _ in x]).median() for g, x in real.items()}
    cdf = {(r.g, r.k): round(r.cdf, 9) for r in ordering.empirical_cdf(df.where("v is not null"), ["g"], "v", "k").collect()}
    assert cdf == {(g, k): round((n + 1) / len(x), 9) for g, x in real.items() for n, (_, k) in enumerate(x)}
    before = {(r.g, r.k): r.b for r in ordering.with_previous(df, ["g"], ["k"], "v", "b").collect()}
    assert before == {(g, k): (dict(x).get(k - 1) if (k - 1) in dict(x) else None) for g, x in by_group(rows).items() for k, _ in x}


def test_places_of_an_empty_table(spark):
    none = spark.createDataFrame([], "g string, k long, v double")
    assert ordering.upper_median(none, ["g"], "v", "k").collect() == ordering.median(none, ["g"], "v").collect() == ordering.empirical_cdf(none, ["g"], "v", "k").collect() == []
    assert ordering.nth(none, ["g"], "v", F.lit(0)).collect() == []


# --- plans ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("window", [3, 10**6])
def test_fingerprints_tell_orders_apart(spark, monkeypatch, window):
    monkeypatch.setattr(ordering, "WINDOW", window)
    runs = {1: "abc", 2: "acb", 3: "abc", 4: "ab", 5: "abca", 6: "aabbc", 7: "a", 8: "bca"}
    df = spark.createDataFrame([(r, k, x) for r, items in runs.items() for k, x in enumerate(items)], "r long, k long, x string").repartition(3)
    prints = {r.r: (r.steps, tuple(r.print)) for r in sequences.fingerprints(sequences.collapse(df, ["r"], ["k"], "x"), ["r"], ["k"], "x").collect()}
    assert prints[1] == prints[3] == prints[6] and len(set(prints.values())) == 6
    assert {r: n for r, (n, _) in prints.items()} == {1: 3, 2: 3, 3: 3, 4: 2, 5: 4, 6: 3, 7: 1, 8: 3}


def test_plan_matching_in_one_pass(spark):
    """Random runs and plans, against the rules on arrays; runs without any of the plan's items miss all steps."""
    rng = random.Random(7)
    for plan in (["a", "b", "c"], ["a", "b", "a", "c", "b"], ["c"], ["a", "a", "a"]):
        runs = {k: [rng.choice("abcx") for _ in range(rng.randint(1, 9))] for k in range(60)} | {60: ["x"]}
        df = spark.createDataFrame([(r, k, x) for r, items in runs.items() for k, x in enumerate(items)], "r long, k long, x string").repartition(3)
        arrays = df.groupBy("r").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("items"))
        wanted = F.array(*map(F.lit, plan))
        want = {r.r: (r.greedy, r.strict) for r in arrays.select("r", scalars.greedy_match(wanted, F.col("items")).alias("greedy"), scalars.strict_match(wanted, F.col("items")).alias("strict")).collect()}
        greedy, strict = {}, {}
        for r in sequences.greedy_match(df, ["r"], ["k"], "x", plan).orderBy("pos").collect():
            greedy.setdefault(r.r, []).append(r.ok)
        for r in sequences.strict_match(df, ["r"], ["k"], "x", plan).orderBy("step").collect():
            strict.setdefault(r.r, []).append(r.ok)
        assert {k: (greedy[k], strict[k]) for k in runs} == want


def test_learning_in_parts_is_learning_at_once(spark):
    rng = random.Random(2)
    rows = [(r, k, rng.choice("abcd")) for r in range(12) for k in range(rng.randint(1, 15))]
    df = spark.createDataFrame(rows, "r long, k long, x string")
    table = stored = None
    for part in range(3):
        new = sequences.counts_of(df.where(F.col("r") % 3 == part), ["r"], ["k"], "x", 2, part)
        table = sequences.ranked_counts(new) if stored is None else sequences.updated_table(table, stored, new)
        stored = new if stored is None else sequences.merged_counts(stored, new)
    whole = sequences.transition_probs(sequences.pairs_within(df, ["r"], ["k"], "x", 2))
    pick = lambda t: {(r.source, r.off, r.target): (r.cnt, round(r.prob, 9)) for r in t.collect()}
    assert pick(table) == pick(whole) and table.count() > 10
    assert sorted((r.source, r.off, r["rank"]) for r in table.collect()) == sorted((r.source, r.off, r["rank"]) for r in whole.collect())


# --- admission ------------------------------------------------------------------------------------------------------------------


def test_scheduler_by_hand():
    s = scheduler.Scheduler()
    start = ("start", "ok")
    assert [x[0] for x in s.feed(1, "predicted", "r", "c1", *start)] == ["prefetch_decision", "prefetch_started"]
    assert s.feed(2, "predicted", "r", "c1", *start)[0][3:5] == ("skip", "already_in_flight_or_complete")
    assert s.feed(3, "diverged", None, "other", None, None) == []
    assert s.feed(4, "completed", "r", None, None, None)[0][2] == "T1"
    assert s.feed(5, "predicted", "r", "c2", *start)[0][3] == "skip"
    assert s.feed(6, "diverged", None, "c1", None, None) == [("prefetch_cancelled", "r", "T1", None, None, "completed", True)]
    assert s.feed(7, "consumed", "r", None, None, None)[0][5] == "no_prefetch"
    assert s.feed(8, "predicted", "r", "c3", *start)[1][2] == "T8"  # what was wasted may be fetched again
    assert s.feed(9, "diverged", None, "c3", None, None) == [("prefetch_cancelled", "r", "T8", None, None, "in_progress", False)]
    assert [x[3] for x in s.feed(10, "predicted", "r", "c4", "skip", "low")] == ["skip"]
    assert s.feed(11, "predicted", "r", "c4", None, None) == []
    s.feed(12, "predicted", "r", "c5", *start)
    assert s.feed(13, "consumed", "r", None, None, None) == [("resource_consumed", "r", "T12", None, None, "used", None)]
    assert s.feed(14, "completed", "r", None, None, None) == [] and s.feed(15, "diverged", None, "c5", None, None) == []
    assert s.feed(16, "consumed", "never", None, None, None)[0][5] == "no_prefetch"


@pytest.mark.parametrize("files", [4])
def test_scheduler_stream_equals_batch(spark, tmp_path, conf, files):
    conf(spark__sql__streaming__stateStore__providerClass=ROCKS)
    rng = random.Random(5)
    rows = [(r, o, rng.choice(["predicted", "predicted", "completed", "diverged", "consumed"]), rng.choice("xyz"), rng.choice("pq"), *rng.choice([("start", "s"), ("start", "s"), ("skip", "low"), (None, None)])) for r in range(4) for o in range(60)]
    schema = "run_id long, ord long, kind string, resource string, checkpoint string, action string, reason string"
    for k in range(files):
        spark.createDataFrame([x for x in rows if x[1] * files // 60 == k], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    scheduler.stream(source).writeStream.format("memory").queryName(f"fetches_{files}").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    order = ["run_id", "ord", "place"]
    batch = scheduler.replay(spark.createDataFrame([*rows, (None, 1, "predicted", "x", "p", "start", "s")], schema).repartition(3)).toPandas().sort_values(order).reset_index(drop=True)
    live = spark.table(f"fetches_{files}").toPandas().sort_values(order).reset_index(drop=True)
    assert set(batch.event) == {"prefetch_decision", "prefetch_started", "prefetch_completed", "prefetch_cancelled", "resource_consumed"}
    pd.testing.assert_frame_equal(batch, live)


# --- lifecycles -------------------------------------------------------------------------------------------------------------------


def line(t, event_type, run="r", step=1, **payload):
    return json.dumps({"run_id": run, "step": step, "epoch_time": t, "event_type": event_type, "payload": payload})


def random_lines(n=240):
    rng = random.Random(9)
    out = []
    for k in range(n):
        t, task, run = 1000 + k * 0.5, f"T{rng.randrange(8)}", f"r{rng.randrange(3)}"
        out.append(rng.choice([line(t, "prefetch_started", run, k % 7, task_id=task, resource_id=f"R{rng.randrange(3)}"), line(t, "prefetch_completed", run, k % 7, task_id=task, elapsed_s=rng.choice([0, 3.5]), bytes_staged=rng.choice([None, 10.0])), line(t, "prefetch_cancelled", run, k % 7, task_id=task, wasted=rng.random() < 0.5), line(t, "resource_consumed", run, k % 7, task_id=rng.choice([task, None]), resource_id="R0", status="used"), line(t, "tool_call", run, tool="x"), "{broken", ""]))
    return out


COLUMNS = ["run_id", "task", "resource", "started_t", "completed_t", "cancelled_t", "consumed_t", "consumed_step", "elapsed_s", "status", "measured"]


def end_of_stream(spark, path, tmp_path, name, timeout_s=None, at_once=1):
    rows = lifecycles.stream(lifecycles.lines(spark, path, at_once), timeout_s)
    q = rows.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.read.schema(lifecycles.SCHEMA).parquet(f"{tmp_path}/{name}")


@pytest.mark.parametrize("cuts", [[240], [1, 90, 240]])
def test_streamed_lifecycles_equal_the_batch(spark, tmp_path, conf, cuts):
    """For any cut into files, and across a restart after each of them."""
    conf(spark__sql__streaming__stateStore__providerClass=ROCKS)
    rows, path, at = random_lines(), f"{tmp_path}/bus", 0
    for end in cuts:
        text = spark.createDataFrame([(x,) for x in rows[at:end]], "value string").coalesce(1)
        text.write.mode("append").text(path)
        live = end_of_stream(spark, path, tmp_path, "out")  # each call is a new run from the checkpoint
        at = end
    whole = f"{tmp_path}/whole"
    spark.createDataFrame([(x,) for x in rows], "value string").coalesce(1).write.text(whole)
    want = analyze.tasks(traces.load_events(spark, whole)).select(*COLUMNS).toPandas().sort_values(["run_id", "task"]).reset_index(drop=True)
    got = lifecycles.latest(live).select(*COLUMNS).toPandas().sort_values(["run_id", "task"]).reset_index(drop=True)
    assert len(want) > 15
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("cuts", [[240], [1, 90, 240]])
def test_updated_lifecycles_equal_the_batch(spark, tmp_path, conf, cuts):
    """The same rows without a Python call a task: the state is Spark's aggregates, across restarts."""
    conf(spark__sql__streaming__stateStore__providerClass=ROCKS)
    rows, path, at = random_lines(), f"{tmp_path}/bus", 0
    for end in cuts:
        spark.createDataFrame([(x,) for x in rows[at:end]], "value string").coalesce(1).write.mode("append").text(path)
        q = lifecycles.append_updates(lifecycles.updates(lifecycles.lines(spark, path)), f"{tmp_path}/out", f"{tmp_path}/cp")
        q.awaitTermination(180)
        assert [o.operatorName for o in q.lastProgress.stateOperators] == ["stateStoreSave"]
        at = end
    whole = f"{tmp_path}/whole"
    spark.createDataFrame([(x,) for x in rows], "value string").coalesce(1).write.text(whole)
    pick = lambda df: df.select(*COLUMNS).toPandas().sort_values(["run_id", "task"]).reset_index(drop=True)
    want = pick(analyze.tasks(traces.load_events(spark, whole)))
    got = lifecycles.latest(spark.read.schema(lifecycles.SCHEMA).parquet(f"{tmp_path}/out"))
    assert len(want) > 15
    pd.testing.assert_frame_equal(pick(got), want, check_dtype=False)
    assert pick(lifecycles.updates(traces.load_events(spark, whole))).equals(pick(got))


def test_silent_tasks_are_closed_by_time(spark, tmp_path, conf):
    conf(spark__sql__streaming__stateStore__providerClass=ROCKS)
    path = f"{tmp_path}/bus"
    for k, rows in enumerate(([line(1000, "prefetch_started", task_id="old", resource_id="R")], [line(1500, "prefetch_started", task_id="new", resource_id="R")], [line(1501, "prefetch_completed", task_id="new", elapsed_s=1.0)])):
        spark.createDataFrame([(x,) for x in rows], "value string").coalesce(1).write.mode("append").text(path)
        live = end_of_stream(spark, path, tmp_path, "out", timeout_s=100.0)
    closed = [r for r in live.collect() if r.closed]
    assert [(r.task, r.started_t, r.completed_t) for r in closed] == [("old", 1000.0, None)]


# --- events and files ------------------------------------------------------------------------------------------------------------


def test_typed_events_keep_scalar_extras(spark, tmp_path):
    rows = [line(1, "prefetch_completed", task_id="T", elapsed_s=2.5, status="completed", bytes_staged=7, gb_per_s=0.5, direct=True, note="x", shards=[1], more={"a": 1}, none=None), line(2, "tool_call", tool="t"), line(3, "unheard_of", a=1, b="two"), json.dumps({"event_type": "tool_call"}), json.dumps({"event_type": "tool_call", "payload": "text"})]
    (tmp_path / "t.jsonl").write_text("\n".join(rows) + "\n")
    got = {r.line_no: r for r in traces.typed_events(traces.load_events(spark, str(tmp_path / "t.jsonl"))).collect()}
    assert got[0].prefetch_completed.asDict() == {"task_id": "T", "elapsed_s": 2.5, "status": "completed"}
    assert got[0].extras == {"bytes_staged": "7", "gb_per_s": "0.5", "direct": "true", "note": "x"}
    assert got[1].tool_call.tool == "t" and got[1].extras == {} and got[1].prefetch_completed is None
    assert got[2].extras == {"a": "1", "b": "two"} and got[2].tool_call is None
    assert got[3].extras == {} and got[3].tool_call.tool is None and got[4].extras == {}


def test_phases_of_many_runs_in_a_file(spark, tmp_path):
    """Each run counts from its own first row; a swap inside two agents counts once; what touches is one."""
    (tmp_path / "m.csv").write_text("run_id,phase,timestamp,duration_s\n" + "".join(f"{r},{p},2024-01-01T00:00:{e:02d},{d}\n" for r, p, e, d in [
        (1, "agent:x", 10, 10), (2, "agent:x", 30, 5), (1, "model_swap_wait:m", 12, 6), (1, "agent:y", 14, 6), (2, "llm:inference", 33, 3), (2, "SUMMARY", 40, 40), (3, "model_swap_wait:m", 9, 2), (3, "model_swap_wait:m", 11, 2)]))
    phases = traces.load_phases(spark, str(tmp_path / "m.csv"), ["run_id"])
    assert sorted((r.run_id, r.start, r.end) for r in phases.where("phase = 'agent:x'").collect()) == [("1", 0.0, 10.0), ("2", 0.0, 5.0)]
    got = {r.run_id: (r.tool_s, r.swap_s, r.reasoning_s) for r in analyze.phase_stalls(phases, ["run_id"]).collect()}
    assert got == {"1": (8.0, 6.0, 0.0), "2": (5.0, None, 3.0), "3": (0.0, 4.0, 0.0)}


def test_files_of_phases_do_not_grow_with_the_runs(spark, tmp_path):
    events = spark.range(2000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).cast("timestamp_ntz").alias("ts"), (F.col("id") % 400).alias("user_id"), F.element_at(F.array(*map(F.lit, ("signup", "view", "click", "error"))), (F.col("id") % 4 + 1).cast("int")).alias("event_type"), (F.col("id") % 7 / 1.0).alias("value"), F.lit('{"k": 5}').alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = plans.QUERIES["phase_stalls"](spark, str(tmp_path))
    assert len(got.inputFiles()) <= 4
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    compare(got.toPandas(), con.execute(plans.SQL["phase_stalls"]).df())


def test_small_negative_readings_are_unmeasured(spark, tmp_path):
    """A reading of -0.3 is negative, though it rounds to -0."""
    rows = [(1, -0.3, 4), (2, 0.3, 5), (4, 0.5, 6), (5, -0.5, 7), (7, 0.0, 8), (8, -12.7, 9), (9, 7.49, 10), (10, None, 11)]
    spark.createDataFrame(rows, "s_suppkey long, s_acctbal double, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    compare(plans.QUERIES["profile_metrics"](spark, str(tmp_path)).toPandas(), con.execute(plans.SQL["profile_metrics"]).df())


def test_traces_in_the_order_of_their_paths(spark, tmp_path):
    for name, text in (("b", line(1, "x") + "\n" + line(2, "y")), ("a", ""), ("c", "{broken\n\n"), ("d", line(3, "z")), ("other.txt", line(9, "no"))):
        (tmp_path / (name if "." in name else f"{name}.jsonl")).write_text(text)
    got = traces.load_traces(spark, str(tmp_path), "*.jsonl")
    assert sorted((r.trace, r.line_no, r.event_type) for r in got.collect()) == [(0, 0, "x"), (0, 1, "y"), (1, 0, "z")]


def test_newest_trace_by_modification_time(spark, tmp_path):
    import os

    def trial(workload, config, name, at, status="completed", trace=True):
        d = tmp_path / "runs" / workload / config / name
        d.mkdir(parents=True)
        (d / "meta.json").write_text(json.dumps({"status": status}) if status else "{broken")
        if trace:
            (d / "trace.jsonl").write_text(line(1, "x"))
            os.utime(d / "trace.jsonl", (at, at))

    trial("w", "baseline", "t01", 100_000)
    trial("w", "full_system", "t02", 300_000)
    trial("w", "other", "t03", 900_000)
    trial("w", "baseline", "t04", 800_000, status="failed")
    trial("w", "baseline", "t05", 800_000, status=None)
    trial("w", "baseline", "t06", 0, trace=False)
    trial("v", "baseline", "t01", 5_000)
    got = {r.workload: r.trial_dir.rsplit("/", 1)[1] for r in traces.newest_traces(spark, str(tmp_path), ("baseline", "full_system")).collect()}
    assert got == {"w": "t02", "v": "t01"}


# --- predictors ---------------------------------------------------------------------------------------------------------------------


def test_steps_are_given_or_counted(spark):
    df = spark.createDataFrame([("r", 1, None, "a"), ("r", 2, 0, "b"), ("r", 3, None, ""), ("r", 4, 7, "c"), ("r", 5, None, "d"), ("r", 6, 2, "e")], "run_id string, line_no long, step int, tool string")
    assert sorted((r.step, r.tool) for r in predictors.steps_of(df).collect()) == [(1, "a"), (2, "e"), (4, "d"), (7, "c")]


def known(spark, **more):
    reg = spark.createDataFrame([("c", "R1", "b", 1, 0.9), ("c", "R1", "a", 2, 0.5), ("c", "R2", "b", 1, 0.7), ("d", "R3", "c", 1, 0.6)], "consumer_tool string, resource_id string, tool string, off int, confidence double")
    table = spark.createDataFrame([("a", 1, "c", 0.9, 1), ("a", 2, "d", 0.9, 1), ("b", 1, "x", 0.9, 1), ("b", 2, "d", 0.5, 1), ("c", 1, "d", 0.2, 1)], "source string, off int, target string, prob double, rank long")
    return predictors.Knowledge(reg, table, **more)


def test_predictors_share_a_contract(spark):
    calls = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b"), ("r", 3, "c"), ("r", 4, "d")], "run_id string, step long, tool string")
    plans = spark.createDataFrame([("r", 0, "b"), ("r", 1, "c"), ("r", 2, "d")], "run_id string, place int, tool string")
    k = known(spark, plans=plans, reference=calls.select("step", "tool"))
    rows = lambda name: sorted((r.step, r.resource_id, r.consumer_tool, r.expected_at_step, r.confidence) for r in predictors.predict(name, calls, k).collect())
    assert rows("oracle") == [(2, "R1", "c", 3, 1.0), (2, "R2", "c", 3, 1.0), (3, "R3", "d", 4, 1.0)]
    assert rows("rules") == [(1, "R1", "c", 3, 0.5), (2, "R1", "c", 3, 0.9), (2, "R2", "c", 3, 0.7), (3, "R3", "d", 4, 0.6)]
    assert rows("table") == [(1, "R1", "c", 2, 0.9), (1, "R2", "c", 2, 0.9), (2, "R3", "d", 4, 0.5)]
    assert rows("plan") == [(1, "R1", "c", 3, 0.8), (1, "R2", "c", 3, 0.8), (2, "R1", "c", 3, 0.8), (2, "R2", "c", 3, 0.8), (2, "R3", "d", 4, 0.8), (3, "R3", "d", 4, 0.8)]
    assert rows("learned") == rows("plan")
    assert {(r[0], r[1]) for r in map(tuple, predictors.predict("learned", calls, known(spark, plans=plans.where("run_id = 'none'"), reference=None)).select("step", "resource_id").collect())} == {(1, "R1"), (1, "R2"), (2, "R3"), (3, "R3")}
    score = predictors.judge(predictors.predict("oracle", calls, k), calls).first()
    assert (score.made, score.hits, score.calls_covered, score.precision) == (3, 3, 2, 1.0)
    with pytest.raises(KeyError):
        predictors.predict("none such", calls, k)


def test_learned_is_the_first_signal_and_predictions_stay_where_calls_are(spark, conf):
    """Random calls, plans, tables and a registry with repeated rows, against the rows of each signal; only calls are shuffled."""
    conf(spark__sql__adaptive__enabled="false")
    rng = random.Random(4)
    calls = spark.createDataFrame([(r, s, rng.choice("abcdef")) for r in range(30) for s in range(1, 9)], "run_id long, step long, tool string").repartition(4, "run_id")
    plans = spark.createDataFrame([(r, p, rng.choice("abcx")) for r in range(12) for p in range(rng.randint(1, 6))], "run_id long, place int, tool string")
    reg = spark.createDataFrame([(rng.choice("abcd"), f"R{rng.randrange(4)}", rng.choice("abd"), rng.randint(1, 2), rng.choice([0.3, 0.6, 0.9])) for _ in range(25)], "consumer_tool string, resource_id string, tool string, off int, confidence double")
    table = spark.createDataFrame([(x, o, y, 0.4, 1) for x, o, y in (("c", 1, "x"), ("c", 2, "a"), ("e", 1, "b"), ("a", 1, "b"))], "source string, off int, target string, prob double, rank long")
    k = predictors.Knowledge(reg, table, plans=plans, reference=None)
    rows = {n: [tuple(r)[:6] for r in predictors.predict(n, calls, k).collect()] for n in ("plan", "table", "rules", "learned")}
    want, said = [], set()
    for n in ("plan", "table", "rules"):
        assert len({(r[0], r[1], r[2], r[4]) for r in rows[n]}) == len(rows[n]) > 0
        want += [r for r in rows[n] if r[:2] not in said]
        said |= {r[:2] for r in rows[n]}
    assert sorted(rows["learned"]) == sorted(want)
    tools = {(r.run_id, r.step): r.tool for r in calls.collect()}
    all_ = reduce(DataFrame.unionByName, [predictors.predict(n, calls, k) for n in rows])
    scores = predictors.judge(all_, calls)
    for r in scores.collect():
        mine = want if r.predictor_id == "learned" else rows[r.predictor_id]
        assert (r.made, r.hits, r.calls_covered) == (len(mine), sum(tools.get((x[0], x[4]), "") == x[3] for x in mine), len({x[:2] for x in mine}))
    moved = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", scores._jdf.queryExecution().executedPlan().toString())
    assert moved and not [m for m in moved if "step" in m]
