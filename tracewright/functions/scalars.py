"""Scalar rules of trace analytics as Column expressions (survey rows P*, F*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """f(value) with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def falsy_coalesce(*columns: Column) -> Column:
    """The first value that is neither null nor 0 nor ''; the last one as it is."""
    *first, last = columns
    return F.coalesce(*[F.when((c.cast("string") != "") & (F.coalesce(c.try_cast("double"), F.lit(1.0)) != 0), c) for c in first], last)


def lenient_int(c: Column) -> Column:
    """Null where Python's int() would fail; '3.0' fails."""
    return F.trim(c).try_cast("bigint")


def lenient_float(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def non_negative(c: Column) -> Column:
    """Negative or unparsable is unmeasured."""
    x = lenient_float(c)
    return F.when(x >= 0, x)


def stable_id(c: Column, n: int = 12, prefix: str = "", suffix: str = "") -> Column:
    """The first ``n`` hex digits of the md5 of the UTF-8 text."""
    return F.concat(F.lit(prefix), F.substring(F.md5(c.cast("binary")), 1, n), F.lit(suffix))


def condition_label(condition: Column, mode: Column, run_id: Column) -> Column:
    """P6."""
    return F.coalesce(F.when(condition != "", condition), F.when(mode == "baseline", F.lit("baseline")), F.substring(run_id, 1, 12))


def gpu_family(name: Column) -> Column:
    """A known family by substring, else the last word, else unknown."""
    words = F.split(F.trim(name), "\\s+")
    return F.when(name.isNull() | (F.trim(name) == ""), "unknown").when(name.contains("L40S"), "L40S").when(name.contains("Blackwell") | name.contains("RTX PRO"), "Blackwell").when(name.contains("V100"), "V100").otherwise(F.element_at(words, -1))


def merged_class(c: Column) -> Column:
    """P9."""
    return F.when(c.startswith("policy_skip"), "policy_skip").otherwise(c)


def bytes_with_source(measured: Column, estimated: Column) -> Column:
    """struct(bytes, source)."""
    return F.when(measured.isNotNull(), F.struct(measured.cast("double").alias("bytes"), F.lit("measured").alias("source"))).when(F.coalesce(estimated, F.lit(0)) != 0, F.struct(estimated.cast("double").alias("bytes"), F.lit("estimated").alias("source"))).otherwise(F.struct(F.lit(0.0).alias("bytes"), F.lit("unknown").alias("source")))


def task_outcome(used: Column, wasted: Column, cancelled: Column, completed_t: Column, consumed_t: Column, served: Column, grace) -> Column:
    """Ordered rules; null flags are false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(used) & consumed_t.isNotNull(), F.when(completed_t > consumed_t + grace, "late").otherwise("useful"))
        .when(yes(wasted), "wasted")
        .when(yes(cancelled), "cancelled")
        .when(completed_t.isNotNull(), F.when(yes(served), "duplicate").otherwise("wasted"))
        .otherwise("pending")
    )


def stall_class(exposure: Column, outcome: Column, reason: Column, is_model: Column, group_on_time: Column, window: Column, load: Column, delay: Column, minimum=0.1, no_window=15.0, spin_up=30.0) -> Column:
    """Ten labels by ordered rules; '' where there is no exposure to speak of."""
    need = F.coalesce(load, F.lit(0)) + F.when(is_model, spin_up).otherwise(0)
    by_outcome = F.when(outcome == "no_prefetch_config", F.lit("baseline_no_prefetch")).when(outcome == "no_prediction", F.lit("no_prediction")).when(outcome == "skipped", F.concat(F.lit("policy_skip:"), F.coalesce(reason, F.lit("")))).when(outcome == "direct_prefetch", F.lit("residual_partial"))
    by_window = F.when(window.isNull(), "unattributed").when(window < no_window, "no_window").when(window < need, "window_too_small").when(delay.isNotNull() & (window - delay < need), "late_start").otherwise("residual_partial")
    return F.when(exposure.isNull() | (exposure <= minimum), "").otherwise(F.coalesce(by_outcome, F.when(is_model & F.coalesce(group_on_time, F.lit(False)), "gpu_serialization_residual"), by_window))


def simulated(mode: Column, elapsed: Column, bytes_: Column) -> Column:
    """P15."""
    return F.coalesce(mode == "simulated", F.lit(False)) | F.coalesce((elapsed > 0) & (elapsed < 0.5) & (bytes_ > 1e9), F.lit(False))


def phase_kind(phase: Column, prefixes: Sequence[str]) -> Column:
    """The first prefix that fits, else the part before a colon."""
    out = F.split(phase, ":").getItem(0)
    for p in reversed(prefixes):
        out = F.when(phase.startswith(p), p).otherwise(out)
    return out


def shorten(name: Column, names: dict[str, str], width: int = 16) -> Column:
    """P20: by table, else the first characters."""
    if not names:
        return F.substring(name, 1, width)
    table = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    return F.coalesce(F.get(F.array(F.element_at(table, name)), F.lit(0)), F.substring(name, 1, width))


#: Reasons of the admission rules; fixed values of the decision events.
REASONS = ("already_in_flight_or_complete", "naive_prefetch", "non_cancellable_resource_requires_higher_confidence", "proactive_swap_compute_window", "insufficient_compute_time_for_overlap", "confidence_above_threshold")


def admission(mode: Column, in_flight: Column, kind: Column, skipped_kinds: Sequence[str], naive: Column, confidence: Column, threshold: float, offset: Column, horizon: int, safe: Column, proactive: Column, load_s: Column, compute_s: Column) -> Column:
    """struct(action, reason), rule by rule; null where the mode schedules nothing."""
    flying, is_naive, unsafe, swap, short, enough = map(F.lit, REASONS)
    says = lambda action, reason: F.struct(F.lit(action).alias("action"), reason.alias("reason"))
    return (
        F.when(mode.isin("baseline", "observe_only"), None)
        .when(in_flight, says("skip", flying))
        .when(kind.isin(*skipped_kinds), says("skip", F.concat(F.lit("resource_type_skipped ("), kind, F.lit(")"))))
        .when(naive, says("start", is_naive))
        .when(confidence < threshold, says("skip", F.format_string(f"confidence_below_threshold (%.2f < {threshold})", confidence)))
        .when(offset > horizon, says("skip", F.format_string(f"horizon_exceeded (%d > {horizon})", offset)))
        .when(~safe & (confidence < min(0.9, threshold + 0.1)), says("skip", unsafe))
        .when(proactive, says("start", swap))
        .when(load_s.isNotNull() & (compute_s > 0) & (load_s > compute_s * 2), says("skip", short))
        .otherwise(says("start", enough))
    )


def human_bytes(n: Column) -> Column:
    """F10."""
    return F.when(n >= 1e9, F.format_string("%.1f GB", n / 1e9)).when(n >= 1e6, F.format_string("%.0f MB", n / 1e6)).otherwise(F.format_string("%.0f kB", n / 1e3))


#: What stands for a missing value in reports.
NONE = "\u2014"


def as_seconds(v: Column, places: int = 1) -> Column:
    """'12.3s', a dash for null."""
    return F.when(v.isNull(), NONE).otherwise(F.format_string(f"%.{places}fs", v.cast("double")))


def as_percent(v: Column, places: int = 1) -> Column:
    """'12.3%' of a share, a dash for null."""
    return F.when(v.isNull(), NONE).otherwise(F.format_string(f"%.{places}f%%", v.cast("double") * 100))


def as_int(v: Column) -> Column:
    """the whole part, a dash for null."""
    return F.coalesce(v.cast("bigint").cast("string"), F.lit(NONE))


def speedup_text(base: Column, run: Column) -> Column:
    """ratio and seconds saved, a dash where either is missing or the run took no time."""
    saved = base - run
    text = F.concat(F.format_string("%.2f\u00d7  (", base / run), F.when(saved >= 0, "+").otherwise(""), F.format_string("%.0fs)", saved.cast("double")))
    return F.when(base.isNotNull() & (run > 0), text).otherwise(NONE)


def route(kind: Column, routes: dict[str, str], default: str) -> Column:
    """The executor of a resource type."""
    out = F.lit(default)
    for name, executor in routes.items():
        out = F.when(kind == name, executor).otherwise(out)
    return out


def hideable(bytes_: Column, window: Column, rate: float = 2.78e9, spin_up: float = 120.0) -> Column:
    """whether a transfer fits in the window left after spin-up."""
    return bytes_ <= F.greatest(F.lit(0.0), window - spin_up) * rate


def clamp(c: Column, low, high) -> Column:
    """F8: held between two bounds; null stays null (``greatest`` and ``least`` alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def iso_seconds(c: Column) -> Column:
    """seconds since 1970 of an ISO date and time in the session's zone (UTC is meant), null where it is none."""
    return F.unix_micros(F.try_to_timestamp(c)) / 1e6


def int_keys(m: Column) -> Column:
    """a map with text keys by number; keys that are no whole number leave."""
    whole = F.map_filter(m, lambda k, _: k.rlike("^-?[0-9]{1,18}$"))
    return F.transform_keys(whole, lambda k, _: k.cast("bigint"))


def specialist_marker(text: Column) -> Column:
    """lower-cased name of a [SPECIALIST: x] marker, else ''."""
    return F.lower(F.regexp_extract(text, r"(?i)\[SPECIALIST:\s*(\w+)\]", 1))


def plan_mentions(text: Column, known: Sequence[str]) -> Column:
    """known names in order of mention, whole words only (longest first, so names may be prefixes of others)."""
    names = "|".join(sorted(known, key=lambda k: (-len(k), k)))
    return F.regexp_extract_all(text, F.lit(rf"(?U)\b({names})\b"), F.lit(1))


def collapse_adjacent(values: Column) -> Column:
    """Equal neighbours once."""
    return let(values, lambda v: F.filter(v, lambda x, i: (i == 0) | (x != F.get(v, i - 1))))


def extract_plan(text: Column, known: Sequence[str], least: int = 2) -> Column:
    """struct(n_mentions, tools), null with fewer than ``least`` distinct tools."""
    return let(plan_mentions(text, known), lambda found: F.when(F.size(F.array_distinct(found)) >= least, F.struct(F.size(found).alias("n_mentions"), collapse_adjacent(found).alias("tools"))))


def plan_index(plan: Column, tool: Column) -> Column:
    """Zero-based place of the tool in the plan, -1 if absent."""
    return F.array_position(plan, tool).cast("int") - 1


def strict_match(plan: Column, actual: Column) -> Column:
    """Per plan step, whether the actual calls, filtered to plan tools, have it at the same place."""
    kept = F.filter(actual, lambda x: F.array_contains(plan, x))
    return let(kept, lambda own: F.transform(plan, lambda x, i: F.coalesce(F.get(own, i) == x, F.lit(False))))


def greedy_match(plan: Column, actual: Column) -> Column:
    """Per plan step, whether it occurs in the actual calls after the last step that did; a miss does not move on."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<boolean>").alias("hits"))

    def step(s: Column, x: Column) -> Column:
        found = F.array_position(F.slice(actual, s.at + 1, F.greatest(F.lit(0), F.size(actual) - s.at)), x).cast("int")
        return F.struct((s.at + found).alias("at"), F.concat(s.hits, F.array(found > 0)).alias("hits"))

    return F.aggregate(plan, start, step, lambda s: s.hits)
