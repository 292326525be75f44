"""Measurements that compare a window with another span, in full: baselines, onsets, weather, strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions.physics import Plant, significance
from heliograph.operators.measures import KEYS, _r, in_windows_days, onset, performance_ratio, string_shares
from heliograph.plans.ordered import change_points
from heliograph.sources.panels import in_windows

# Rows that a baseline needs, the band between two levels, and the share of a season's norm that makes a dim day.
BASELINE_ROWS, BAND, DIM = 96, 0.15, 0.6


def trailing_windows(panel: DataFrame, days: int = 14, step: int = 7, time: str = "ts") -> DataFrame:
    """Sweeps every ``step`` days over each system's record; a sweep at day *now* looks at the ``days`` days before it."""
    span = panel.groupBy("system_id").agg(F.to_date(F.min(time)).alias("lo"), F.to_date(F.max(time)).alias("hi"))
    nows = span.select("system_id", F.posexplode(F.sequence(F.date_add("lo", days), F.greatest(F.date_add("hi", 1), F.date_add("lo", days)), F.expr(f"interval {step} days"))).alias("window_id", "now"))
    return nows.select("system_id", "window_id", "now", F.date_sub("now", days).alias("start_day"), F.date_sub("now", 1).alias("end_day"))


def baseline(panel: DataFrame, windows: DataFrame, plant: Plant = Plant(), baseline_days: int = 30, carry: tuple[str, ...] = ()) -> DataFrame:
    """The window's corrected ratio against that of the days before it, in units of the baseline's daily scatter.

    A window with fewer than ``BASELINE_ROWS`` rows before it is undefined.  Both roles are measured in
    one pass over windows that unfold to (role, day).
    """
    roles = F.explode(F.array(
        F.struct(F.lit("now").alias("role"), F.col("start_day").alias("a"), F.col("end_day").alias("b")),
        F.struct(F.lit("prior").alias("role"), F.date_sub("start_day", baseline_days).alias("a"), F.date_sub("start_day", 1).alias("b")),
    )).alias("r")
    spans = windows.select("system_id", "window_id", roles).select("system_id", "window_id", "r.role", F.col("r.a").alias("start_day"), F.col("r.b").alias("end_day"))
    days = spans.select("system_id", "window_id", "role", F.explode(F.sequence("start_day", "end_day")).alias("on_day"))
    rows = panel.withColumn("on_day", F.to_date("ts")).join(days, ["system_id", "on_day"])
    keys = [*KEYS, *carry]
    whole = performance_ratio(rows, plant, keys=[*keys, "role"])
    daily = performance_ratio(rows.where("role = 'prior'"), plant, keys=[*keys, "on_day"]).groupBy(*keys).agg(F.stddev_samp("pr_temperature_corrected").alias("s"), F.count("pr_temperature_corrected").alias("n"))
    before = rows.where("role = 'prior'").groupBy(*keys).agg(F.count("*").alias("rows_before")).where(F.col("rows_before") >= BASELINE_ROWS)
    of = lambda role, c, name: F.max(F.when(F.col("role") == role, F.col(c))).alias(name)
    both = whole.groupBy(*keys).agg(
        of("now", "pr_temperature_corrected", "pr_corrected_window"), of("prior", "pr_temperature_corrected", "pr_corrected_baseline"), of("now", "pr", "pr_raw_window"), of("prior", "pr", "pr_raw_baseline"),
        of("prior", "samples_used", "baseline_intervals_used"), of("prior", "data_completeness", "baseline_completeness"),
    ).where("pr_corrected_window is not null and pr_corrected_baseline is not null").join(before, keys).join(daily, keys, "left")
    change = F.round(F.col("pr_corrected_window") - F.col("pr_corrected_baseline"), 6)
    spread = F.when(F.col("n") > 2, _r(F.col("s"))).otherwise(F.lit(0.0))
    return both.select(
        *KEYS, "pr_corrected_window", "pr_corrected_baseline", change.alias("change"), "pr_raw_window", "pr_raw_baseline", spread.alias("baseline_day_to_day_spread"), _r(significance(change, spread), 4).alias("change_over_spread"),
        F.lit(baseline_days).alias("baseline_days_requested"), "baseline_intervals_used", "baseline_completeness",
    )


def onset_in_full(days: DataFrame, value: str, keys: list[str], order: str = "day") -> DataFrame:
    """``onset`` with the relative change and the days spent between the two levels."""
    found = onset(days, value, keys, order)
    levels = change_points(days.where(F.col(value).isNotNull()), keys, order, value).select(*keys, F.col("level_before").alias("b"), F.col("level_after").alias("a"))
    inside = days.where(F.col(value).isNotNull()).join(levels, keys)
    size = F.abs(F.col("a") - F.col("b"))
    between = (size > 1e-9) & (F.col(value) > F.least("a", "b") + BAND * size) & (F.col(value) < F.greatest("a", "b") - BAND * size)
    transit = inside.groupBy(*keys).agg(F.count_if(between).alias("days_in_transition"), F.first("a").alias("a"), F.first("b").alias("b"))
    relative = F.coalesce(F.try_divide(F.col("a") - F.col("b"), "b"), F.lit(0.0))
    return found.join(transit, keys).select(*found.columns, _r(relative).alias("relative_change"), _r(F.abs(F.col("a") - F.col("b")), 4).alias("change_magnitude"), "days_in_transition")


def trend_ends(days: DataFrame, value: str, keys: list[str], order: str = "day", recovery_step: float = 0.02) -> DataFrame:
    """The first and last day's values and the largest recovery, beside the threshold that makes one."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = days.where(F.col(value).isNotNull()).withColumn("step", F.col(value) - F.lag(value).over(w))
    big = F.round("step", 9) >= recovery_step
    return rows.groupBy(*keys).agg(
        F.count("*").alias("days"), _r(F.min_by(value, order)).alias("first_day_value"), _r(F.max_by(value, order)).alias("last_day_value"),
        _r(F.coalesce(F.max(F.when(big, F.col("step"))), F.lit(0.0))).alias("largest_recovery"), F.lit(recovery_step).alias("recovery_threshold"),
    ).where("days >= 5")


def weather(days: DataFrame, windows: DataFrame) -> DataFrame:
    """Insolation against the season's norm, with the dim days and the extremes; a window without a norm is undefined."""
    here = in_windows_days(days, windows, "start_day", "end_day").where("poa_wm2 is not null")
    span = here.groupBy(*KEYS, "start_day", "end_day").agg(F.min(F.dayofyear("day")).alias("lo"), F.max(F.dayofyear("day")).alias("hi"))
    doy = span.select(*KEYS, "start_day", "end_day", F.explode(F.sequence("lo", "hi")).alias("doy"))
    others = days.where("poa_wm2 is not null").withColumn("doy", F.dayofyear("day")).join(doy, ["system_id", "doy"]).where(~F.col("day").between(F.col("start_day"), F.col("end_day")))
    norms = others.groupBy(*KEYS).agg(F.avg("poa_wm2").alias("norm"), F.count("*").alias("seasonal_days_compared")).where("norm > 0")
    rows = here.join(norms, KEYS)
    mean = F.avg("poa_wm2")
    return rows.groupBy(*KEYS).agg(
        _r(F.first("norm"), 3).alias("seasonal_norm"), _r(mean / F.first("norm")).alias("relative_to_norm"), _r(100 * (mean / F.first("norm") - 1), 4).alias("percent_vs_norm"),
        F.count_if(F.col("poa_wm2") < DIM * F.col("norm")).alias("dim_days"), F.count("*").alias("days_in_window"), _r(F.max("poa_wm2"), 3).alias("brightest_day"), _r(F.min("poa_wm2"), 3).alias("dimmest_day"),
        F.when(F.count("*") > 1, _r(F.stddev_samp("poa_wm2"), 3)).alias("day_to_day_spread"), F.lit(100 * DIM).alias("dim_day_threshold_pct_of_norm"), F.first("seasonal_days_compared").alias("seasonal_days_compared"),
    )


def most_changed(onsets: DataFrame, strings: DataFrame, keys: list[str], time: str = "day") -> DataFrame:
    """Of the strings' onsets the one that stands out most: by significance, then size, then the first string."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("change_over_scatter"), F.desc(F.abs("absolute_change")), "string_idx"))
    first = onsets.withColumn("rank", rank).where("rank = 1")
    shares = string_shares(strings, keys, time)
    count = shares.groupBy(*keys).agg(F.count_distinct("string_idx").alias("strings_compared"))
    scored = shares.groupBy(*keys, time).agg(F.count("*").alias("here")).join(count, keys).where("here = strings_compared").groupBy(*keys, "strings_compared").agg(F.count("*").alias("days_scored"))
    return first.join(scored, keys).select(*keys, F.col("string_idx").alias("most_changed_string"), F.col("absolute_change").alias("its_share_change"), F.col("change_over_scatter").alias("its_change_over_scatter"), "onset_day", "days_scored", "strings_compared")


def energy_removed(before: DataFrame, after: DataFrame, interval_h: Column | float, keys: list[str]) -> DataFrame:
    """What an injection truly took: the sum of base less injected power, times the interval."""
    both = before.select("system_id", "ts", *[k for k in keys if k != "system_id"], F.col("ac_power_kw").alias("base")).join(after.select("system_id", "ts", F.col("ac_power_kw").alias("now")), ["system_id", "ts"])
    return both.groupBy(*keys).agg(_r(F.sum((F.col("base") - F.col("now")) * interval_h), 3).alias("energy_removed_kwh"))


def swept(measure: Callable[[DataFrame], DataFrame], panel: DataFrame, windows: DataFrame) -> DataFrame:
    """``measure`` over the windows of all sweeps since the record's start, each under its *now*."""
    return measure(in_windows(panel, windows)).join(windows.select(*KEYS, "now"), KEYS)
