"""Readers of traces and experiment trees (S1-S19): Spark file sources with explicit ordinals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import iso_seconds, lenient_float, lenient_int, non_negative
from ..operators.ordering import median, placed

RESOURCE = "resource_id string, resource_type string, name string, path string, model_endpoint string, estimated_size_bytes bigint, estimated_load_s double, expected_at_step int, confidence double, cancellation_safe boolean, consumer_tool string, consumer_step_offset int, proactive_swap boolean"
META = "workload string, config string, trial_index int, run_id string, command string, runtime_mode string, predictor string, extra_flags array<string>, git_commit string, node string, gpus array<string>, slurm_job_id string, conda_python string, start_time string, status string, exit_code int, end_time string, wall_time_s double"


def numbered(rows: DataFrame) -> DataFrame:
    """The rows of a file scan with file and line_no: each row's place in its file from 0, however the file is split.

    Rows of a split are numbered in order as they are read; what stands before a split is counted, a row a split."""
    marked = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    splits = marked.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.withColumn("_before", before - F.col("_first")).drop("_first", "_n")
    return marked.join(splits, ["file", "_block"]).withColumn("line_no", F.col("_before") + F.col("_id")).drop("_block", "_id", "_before")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0, blank lines count), line; large files are read in splits."""
    return numbered(spark.read.text(path)).select("file", "line_no", F.col("value").alias("line"))


def parsed_lines(text: DataFrame) -> DataFrame:
    """S1-S3 on lines (file, line_no, line), of a batch or a stream; see ``load_events``."""
    rows = text.where(F.trim("line") != "").withColumn("v", F.try_parse_json("line")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    get = lambda p, kind: F.try_variant_get("v", f"$.{p}", kind)
    payload = F.get_json_object("line", "$.payload")
    return rows.select("file", F.col("line_no").cast("long").alias("line_no"), F.coalesce(get("run_id", "string"), F.lit("unknown")).alias("run_id"), F.coalesce(get("step", "int"), F.lit(0)).alias("step"), F.coalesce(get("epoch_time", "double"), F.lit(0.0)).alias("t"), get("timestamp", "string").alias("timestamp"), F.coalesce(get("event_type", "string"), F.lit("")).alias("event_type"), F.coalesce(payload, F.lit("{}")).alias("payload"))


def load_events(spark: SparkSession, path: str) -> DataFrame:
    """File, line_no, run_id, step, t, timestamp, event_type, payload (JSON text). Blank and broken lines and
    lines that are no object fall away; run_id defaults to unknown, step to 0 (hazard 21), t to 0."""
    return parsed_lines(lines(spark, path))


def load_traces(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The events of all trace files under ``path`` whose names match, with trace: the file's place (from 0) in the order of paths
    among those with an event. Files that are empty or hold nothing parsable take no place."""
    events = load_events(spark, f"{path}/{pattern}")
    files = events.select("file").distinct()  # a row a file
    return events.join(placed(files, [F.col("file")], "_at").select("file", (F.col("_at") - 1).alias("trace")), "file")


def newest_traces(spark: SparkSession, root: str, configs: Sequence[str], trace: str = "trace.jsonl", meta: str = "meta.json") -> DataFrame:
    """Workload, trial_dir, modified: of each workload's completed trials of some configurations under
    runs/<workload>/<config>/<trial> the one whose trace was modified last (ties: the greater path). Trials without a trace or with an unreadable
    meta take no part."""
    done = discover_runs(spark, root, meta).where((F.col("status") == "completed"))
    place = F.regexp_extract("trial_dir", "/runs/([^/]+)/([^/]+)/[^/]+$", 1).alias("_workload"), F.regexp_extract("trial_dir", "/runs/([^/]+)/([^/]+)/[^/]+$", 2).alias("_config")
    done = done.select("trial_dir", *place).where(F.col("_config").isin(*configs))
    # the listing alone: no line of a trace is read
    found = spark.read.format("binaryFile").load(f"{root}/runs/*/*/*/{trace}").select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("_dir"), F.col("modificationTime").alias("modified"))
    own = done.join(found, F.regexp_replace("trial_dir", "^file:/+", "/") == F.regexp_replace("_dir", "^file:/+", "/"))
    return own.groupBy(F.col("_workload").alias("workload")).agg(F.max_by(F.struct("trial_dir", "modified"), F.struct("modified", "trial_dir")).alias("r")).select("workload", "r.*")


#: The fields of each event type's payload that are read by name.
TYPED = {
    "prediction_result": "predictor_id string, confidence double, horizon int, checkpoint_id string",
    "prefetch_decision": "resource_id string, action string, reason string, estimated_load_s double",
    "prefetch_started": "task_id string, resource_id string, executor string",
    "prefetch_completed": "task_id string, elapsed_s double, status string",
    "prefetch_cancelled": "task_id string, reason string, status_before string, wasted boolean",
    "resource_consumed": "resource_id string, task_id string, status string",
    "prediction_validated": "checkpoint_id string, hit boolean",
    "divergence_detected": "checkpoint_id string, expected string, actual string",
    "tool_call": "tool string, node string",
    "llm_call": "model string, node string",
}


def typed_events(events: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Events with a column for each type (its payload as a struct, null in rows of other types) and extras: a map
    of the payload's other fields that are scalars, as text. The payload is parsed once, to a variant; nested and null extras fall away, as do
    payloads that are no object."""
    types = types or TYPED
    rows = events.withColumn("_v", F.try_parse_json("payload"))
    of = F.col("event_type")
    names = {k: [f.split()[0] for f in fields.split(", ")] for k, fields in types.items()}
    columns = {k: F.when(of == k, F.struct(*[F.try_variant_get("_v", f"$.{f.split()[0]}", f.split()[1]).alias(f.split()[0]) for f in fields.split(", ")])).alias(k) for k, fields in types.items()}
    known = F.coalesce(F.try_element_at(F.create_map(*[x for k, n in names.items() for x in (F.lit(k), F.array(*map(F.lit, n)))]), of), F.array().cast("array<string>"))
    object_ = F.when(F.schema_of_variant("_v").startswith("OBJECT"), F.expr("try_cast(_v as map<string, variant>)"))
    is_scalar = lambda v: ~F.coalesce(F.schema_of_variant(v).rlike("^(OBJECT|ARRAY|VOID)"), F.lit(True))
    extras = F.map_filter(object_, lambda k, v: ~F.array_contains(known, k) & is_scalar(v))
    text = F.transform_values(extras, lambda _, v: F.try_variant_get(v, "$", "string"))
    return rows.select(*events.columns, *columns.values(), F.coalesce(text, F.create_map().cast("map<string,string>")).alias("extras"))


def payload(name: str, kind: str = "string", default=None) -> Column:
    """A payload field, null-safe, with a default."""
    got = F.try_variant_get(F.try_parse_json("payload"), f"$.{name}", kind)
    return got if default is None else F.coalesce(got, F.lit(default))


def tail_events(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The last n lines of each file, blank ones counted, then without them."""
    last = Window.partitionBy("file").orderBy(F.desc("line_no"))
    text = lines(spark, path)
    return text.withColumn("_r", F.row_number().over(last)).where((F.col("_r") <= n) & (F.trim("line") != "")).drop("_r")


def predictions(events: DataFrame) -> DataFrame:
    """A row for each predicted resource of each prediction_result event."""
    kind = f"struct<resources:array<struct<{','.join(x.strip().replace(' ', ':', 1) for x in RESOURCE.split(','))}>>,predictor_id:string>"
    rows = events.where("event_type = 'prediction_result'").withColumn("p", F.from_json("payload", kind))
    return rows.select("file", "line_no", "run_id", "step", "t", F.col("p.predictor_id").alias("predictor_id"), F.posexplode("p.resources").alias("place", "r")).select("*", "r.*").drop("r")


def discover_runs(spark: SparkSession, root: str, name: str = "meta.json") -> DataFrame:
    """A row for each readable meta.json (or files of another ``name``) under runs/<workload>/<config>/<trial>, its fields and
    trial_dir."""
    text = spark.read.text(f"{root}/runs/*/*/*/{name}", wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    ok = text.where(F.try_parse_json("value").isNotNull()).withColumn("m", F.from_json("value", META))
    return ok.select(F.regexp_extract("file", r"^(.*)/[^/]*$", 1).alias("trial_dir"), "m.*")


def load_summaries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Summaries with _source (file name); unreadable ones fall away."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("_source"), "value")
    return text.where(F.try_parse_json("value").isNotNull()).select("_source", F.from_json("value", schema).alias("s")).select("_source", "s.*")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with file and row place."""
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return numbered(rows).withColumnRenamed("line_no", "ord")


def load_metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    """Each file's first SUMMARY row with lenient numbers and its notes as a map of k=v tokens (the last of a key wins)."""
    first = _csv(spark, path).where("phase = 'SUMMARY'").withColumn("_r", F.row_number().over(Window.partitionBy("file").orderBy("ord"))).where("_r = 1").drop("_r", "ord")
    tokens = F.filter(F.split(F.coalesce("notes", F.lit("")), "\\s+"), lambda x: x.contains("="))
    pairs = F.transform(tokens, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.substring(x, F.instr(x, "=") + 1, F.length(x)).alias("value")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.lit(0), F.size(pairs) - i - 1)), lambda y: y.key == x.key))
    return first.withColumns({"duration_s": lenient_float(F.col("duration_s")), "total_tokens": lenient_int(F.col("total_tokens")), "notes_map": F.map_from_entries(last)})


def load_profile(spark: SparkSession, path: str) -> DataFrame:
    """File, ord, t_rel_s and each gpu's metrics in long form (gpu, metric, value); negative or unparsable values are null."""
    rows = _csv(spark, path)
    wide = [c for c in rows.columns if c.startswith("gpu") and "_" in c and c[3 : c.index("_")].isdigit()]
    base = rows.select("file", "ord", non_negative(F.col("t_rel_s")).alias("t_rel_s"), *wide)
    long = base.unpivot(["file", "ord", "t_rel_s"], wide, "name", "text")
    return long.select("file", "ord", "t_rel_s", F.regexp_extract("name", "^gpu(\\d+)_", 1).cast("int").alias("gpu"), F.regexp_extract("name", "^gpu\\d+_(.*)$", 1).alias("metric"), non_negative(F.col("text")).alias("value"))


def load_phases(spark: SparkSession, path: str, by: Sequence[str] = ()) -> DataFrame:
    """Phases as intervals relative to the start of the file's first row; kind is the part before a colon. Where a file holds many
    runs, ``by`` names the columns that tell them apart: they are kept, and each run's first row in the file is its start."""
    rows = _csv(spark, path).where("phase <> 'SUMMARY'").withColumns({"_end": iso_seconds(F.col("timestamp")), "_d": F.coalesce(lenient_float(F.col("duration_s")), F.lit(0.0))}).where("_end is not null")
    zero = F.first(F.col("_end") - F.col("_d")).over(Window.partitionBy("file", *by).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("file", "ord", *by, "phase", F.substring_index("phase", ":", 1).alias("kind"), (F.col("_end") - F.col("_d") - zero).alias("start"), (F.col("_end") - zero).alias("end"))


def load_timings(spark: SparkSession, path: str, numbers: list[str], flags: list[str]) -> DataFrame:
    """Timing records; '' is null, flags are true for any case of 'true'."""
    rows = _csv(spark, path).drop("ord")
    return rows.withColumns({c: lenient_float(F.col(c)) for c in numbers} | {c: F.lower(c) == "true" for c in flags})


def load_transitions(spark: SparkSession, path: str, kind: str = "tool_transitions") -> DataFrame:
    """Source, off, target, prob, cnt, rank from a transition table's JSON; no file, no rows."""
    entry = "struct<target:string,target_type:string,probability:double,count:bigint,offset:int>"
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception as e:  # the reader reports a missing path when it plans
        if "PATH_NOT_FOUND" not in str(e):
            raise
        text = spark.createDataFrame([], "value string")
    m = text.select(F.from_json("value", f"struct<{kind}:map<string,map<string,array<{entry}>>>>")[kind].alias("m"))
    rows = m.select(F.explode("m").alias("source", "by")).select("source", F.explode("by").alias("off", "targets")).select("source", F.col("off").cast("int").alias("off"), F.posexplode("targets").alias("place", "e"))
    return rows.select("source", "off", F.col("e.target").alias("target"), F.col("e.probability").alias("prob"), F.col("e.count").alias("cnt"), (F.col("place") + 1).cast("long").alias("rank"))


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """Resource specs in file order; entries with a key that starts with _ or without a consumer_tool fall away."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("rows"))
    rows = text.select(F.posexplode("rows").alias("place", "row")).where(F.try_parse_json("row").isNotNull())
    keys = F.json_object_keys("row")
    ok = rows.where(keys.isNotNull() & ~F.exists(keys, lambda k: k.startswith("_")))
    return ok.select("place", F.from_json("row", RESOURCE).alias("r")).select("place", "r.*").where(F.coalesce("consumer_tool", F.lit("")) != "")


def consumer_map(spark: SparkSession, path: str) -> DataFrame:
    """Tool and its resource names in file order; commented entries stay if they have a consumer_tool."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<struct<consumer_tool:string,name:string>>")).alias("place", "r"))
    return text.where(F.coalesce("r.consumer_tool", F.lit("")) != "").groupBy(F.col("r.consumer_tool").alias("tool")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("r.name", F.lit("")).alias("name")))), lambda x: x["name"]).alias("names"))


# --- measured volumes and times (S14-S19) --------------------------------------------------------------


def mean_io(rows: DataFrame, app: str, names: dict[str, str], numbers: list[str], least_runtime: float = 5.0) -> DataFrame:
    """Mean of each number by (renamed) variant of an app; unparsable runtimes stay, blanks count as 0."""
    runtime = lenient_float(F.col("runtime_s"))
    kept = rows.where((F.col("app") == app) & (runtime.isNull() | (runtime >= least_runtime)))
    variant = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col("variant")), F.col("variant")) if names else F.col("variant")
    return kept.groupBy(variant.alias("variant")).agg(*[F.avg(F.coalesce(lenient_float(F.col(c)), F.lit(0.0))).alias(c) for c in numbers])


def preferred_mean(rows: DataFrame, flag: Column, value: str, by: list[str]) -> DataFrame:
    """Mean of ``value`` over the flagged rows of a key, over all where none is; nulls are left out."""
    real = rows.where(F.col(value).isNotNull()).withColumn("_f", F.coalesce(flag, F.lit(False)))
    means = real.groupBy(*by).agg(F.avg(F.when(F.col("_f"), F.col(value))).alias("_flagged"), F.avg(value).alias("_all"))
    return means.select(*by, F.coalesce("_flagged", "_all").alias(value))


def counter_delta(rows: DataFrame, by: list[str], file: str, ord_: str, phase: str, value: str) -> DataFrame:
    """Median over files of the growth from the first 'begin' row to the first 'end' row, 0 at least."""
    first = lambda word: F.min_by(value, F.when(F.col(phase).contains(word), F.col(ord_)))
    per = rows.groupBy(*by, file).agg(first("begin").alias("_b"), first("end").alias("_e")).where("_b is not null and _e is not null")
    return median(per.withColumn("_d", F.greatest(F.lit(0), F.col("_e") - F.col("_b"))), by, "_d").withColumnRenamed("median", "delta")


def median_bytes(rows: DataFrame, by: list[str], file: str, value: str | None, per_row: int = 6048, corrupt: float = 1e12) -> DataFrame:
    """Median over files of the bytes of all frames; corrupt values count nothing; without a column each row counts ``per_row``."""
    size = F.sum(F.when(F.col(value) < corrupt, F.col(value))) if value else F.count(F.lit(1)) * per_row
    per = rows.groupBy(*by, file).agg(size.alias("_s"))
    every = per.select(*by).distinct()
    return every.join(median(per, by, "_s"), by, "left").withColumnRenamed("median", "bytes")


def cycle_times(rows: DataFrame, stage: str, value: str, columns: Sequence[str] = ()) -> DataFrame:
    """Each simulation's duration plus the mean training and the mean inference, with further columns of its row."""
    means = rows.agg(F.coalesce(F.avg(F.when(F.col(stage) == "train", F.col(value))), F.lit(0.0)).alias("_t"), F.coalesce(F.avg(F.when(F.col(stage) == "inference", F.col(value))), F.lit(0.0)).alias("_i"))
    return rows.where(F.col(stage) == "simulation").join(F.broadcast(means)).select(*columns, (F.col(value) + F.col("_t") + F.col("_i")).alias("cycle"))


def wall_times(rows: DataFrame, by: list[str], scripted: Column, baseline: Column, agentic: Column, wall: str, least: float, most: float | None = None) -> DataFrame:
    """``rows`` with kind: noai (scripted runs, or where a key has none its baselines) or agentic. Walls under ``least`` (a missing
    one is 0) do not count, nor agentic ones over ``most``; other rows leave."""
    t, yes = F.coalesce(wall, F.lit(0.0)), lambda c: F.coalesce(c, F.lit(False))
    near = yes(agentic) if most is None else yes(agentic) & (t <= most)
    kind = F.when(yes(scripted) | yes(baseline), "noai").when(near, "agentic")
    kept = rows.where(t >= least).withColumns({"kind": kind, "_scripted": yes(scripted)}).where("kind is not null")
    has = kept.where("_scripted").select(*by).distinct()  # a row a key
    plain = kept.where((F.col("kind") == "noai") & ~F.col("_scripted")).join(has, by, "left_anti")
    return kept.where((F.col("kind") == "agentic") | F.col("_scripted")).unionByName(plain).drop("_scripted")
