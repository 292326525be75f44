"""Measurements over many windows in one job.

Each takes a windowed panel (``sources.panels.in_windows``) and returns one row per window.  A
window for which a measure is undefined yields NULL (or no row where its rule says so), never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions.physics import STC_IRRADIANCE, Plant, correction_factor, expected_ac, faiman, local_hour, significance
from heliograph.plans.ordered import change_points, first_half, islands

KEYS = ["system_id", "window_id"]


def _r(column: Column, digits: int = 6) -> Column:
    return F.round(column, digits)


def modal_interval_hours(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent step between consecutive samples, the smallest on ties."""
    step = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(Window.partitionBy(*keys).orderBy("ts")))
    return rows.withColumn("step", step).groupBy(*keys).agg((F.mode("step", True) / 3600.0).alias("interval_h"))


def performance_ratio(rows: DataFrame, plant: Plant = Plant(), min_poa: float = 200.0, keys: list[str] = KEYS) -> DataFrame:
    """Raw and temperature-corrected ratio with one mask for numerator and denominator.

    Module temperature is used if any row under the mask has it, and then without a row fallback.
    """
    lit = F.coalesce(F.col("poa_wm2") >= min_poa, F.lit(False))
    used = lit & F.col("ac_power_kw").isNotNull()
    module = F.max(F.when(used & F.col("temp_module_c").isNotNull(), 1).otherwise(0)).over(Window.partitionBy(*keys)) == 1
    cell = F.when(module, F.col("temp_module_c")).otherwise(faiman(F.col("poa_wm2"), F.coalesce("temp_ambient_c", F.lit(25.0)), F.col("wind_speed_ms")))
    marked = rows.withColumn("cell", cell).withColumn("used", used).withColumn("lit", lit)
    power = F.when(F.col("used"), F.col("ac_power_kw"))
    sums = marked.groupBy(*keys).agg(
        F.sum(power).alias("p"), F.sum(power / correction_factor(F.col("cell"), plant.gamma)).alias("pc"), F.sum(F.when(F.col("used"), F.col("poa_wm2"))).alias("g"),
        F.avg(F.when(F.col("used"), F.col("cell"))).alias("cell"), F.count_if("used").alias("samples_used"), F.count_if(F.col("lit") & F.col("ac_power_kw").isNull()).alias("samples_missing_power"),
    )
    out = sums.join(modal_interval_hours(rows, keys), keys, "left")
    hours = F.coalesce("interval_h", F.lit(0.0))
    reference = plant.capacity_kw * F.col("g") / STC_IRRADIANCE
    return out.where("samples_used > 0").select(
        *keys, _r(F.try_divide("p", reference)).alias("pr"), _r(F.try_divide("pc", reference)).alias("pr_temperature_corrected"), _r(1 - F.try_divide("p", "pc")).alias("temperature_loss_fraction"),
        _r(F.col("p") * hours, 3).alias("energy_kwh"), _r(F.col("g") * hours / 1000, 6).alias("insolation_kwh_m2"), _r(F.col("cell"), 4).alias("mean_cell_temp_c"),
        _r(F.try_divide("samples_used", F.col("samples_used") + F.col("samples_missing_power"))).alias("data_completeness"), "samples_used", "samples_missing_power",
    )


def with_expectation(rows: DataFrame, plant: Plant = Plant()) -> DataFrame:
    """Adds ``expected_kw``: irradiance NULL counts as 0, module temperature falls back to Faiman by row."""
    poa = F.coalesce("poa_wm2", F.lit(0.0))
    cell = F.coalesce("temp_module_c", faiman(poa, F.coalesce("temp_ambient_c", F.lit(25.0)), F.col("wind_speed_ms")))
    return rows.withColumn("expected_kw", expected_ac(poa, cell, plant))


def expected_output(rows: DataFrame, plant: Plant = Plant(), keys: list[str] = KEYS) -> DataFrame:
    """Deficit against the expectation over intervals expecting 1 kW or more; missing power counts as no production."""
    lit = with_expectation(rows, plant).where("expected_kw >= 1").withColumn("measured", F.coalesce("ac_power_kw", F.lit(0.0)))
    days = lit.groupBy(*keys, "on_day").agg(F.sum("expected_kw").alias("e"), F.sum("measured").alias("m"))
    halves = days.withColumn("first", first_half(keys, "on_day"))
    deficit = lambda part: 1 - F.try_divide(F.sum(F.when(part, F.col("m"))), F.sum(F.when(part, F.col("e"))))
    return halves.groupBy(*keys).agg(
        _r(F.sum("e"), 3).alias("expected_kwh"), _r(F.sum("m"), 3).alias("measured_kwh"), _r(deficit(F.lit(True))).alias("deficit_fraction"), _r(deficit(F.col("first"))).alias("deficit_first_half"),
        _r(deficit(~F.col("first"))).alias("deficit_second_half"), F.min_by("on_day", F.struct(F.round(F.col("m") - F.col("e"), 6), "on_day")).alias("worst_day"), F.count("*").alias("days_compared"),
    )


def time_of_day_profile(rows: DataFrame, plant: Plant = Plant(), keys: list[str] = KEYS) -> DataFrame:
    """Measured over expected by local hour, and its shape against the window's median hour."""
    lit = with_expectation(rows, plant).where(F.col("expected_kw") >= 0.05 * plant.capacity_kw).withColumn("hour", local_hour(F.col("ts"), plant))
    hours = lit.groupBy(*keys, "hour").agg(F.try_divide(F.sum(F.coalesce("ac_power_kw", F.lit(0.0))), F.sum("expected_kw")).alias("ratio"))
    middle = hours.groupBy(*keys).agg(F.median("ratio").alias("median_ratio"))
    return hours.join(middle, keys).select(*keys, "hour", _r(F.col("ratio")).alias("ratio"), _r(F.try_divide("ratio", "median_ratio")).alias("shape"))


def dc_to_ac(rows: DataFrame, plant: Plant = Plant(), keys: list[str] = KEYS) -> DataFrame:
    lit = rows.where((F.col("dc_power_kw") >= 0.05 * plant.capacity_kw) & F.col("ac_power_kw").isNotNull()).withColumn("ratio", F.col("ac_power_kw") / F.col("dc_power_kw"))
    days = lit.groupBy(*keys, "on_day").agg(F.median("ratio").alias("daily")).withColumn("first", first_half(keys, "on_day"))
    halves = days.groupBy(*keys).agg(_r(F.median(F.when(F.col("first"), F.col("daily")))).alias("conversion_first_half"), _r(F.median(F.when(~F.col("first"), F.col("daily")))).alias("conversion_second_half"), F.count("*").alias("days_compared"))
    whole = lit.groupBy(*keys).agg(
        _r(F.median("ratio")).alias("median_conversion"), _r(F.percentile("ratio", F.lit(0.05))).alias("conversion_5th_percentile"),
        _r(F.percentile("ratio", F.lit(0.95))).alias("conversion_95th_percentile"), F.count("*").alias("intervals_scored"),
    )
    return whole.join(halves, keys)


def temperature_sensor(rows: DataFrame, min_poa: float = 300.0, keys: list[str] = KEYS) -> DataFrame:
    """Module sensor against the Faiman model, where both can be told; fewer than 20 pairs are undefined."""
    both = rows.where((F.col("poa_wm2") >= min_poa) & F.col("temp_module_c").isNotNull() & F.col("temp_ambient_c").isNotNull())
    off = both.withColumn("off", F.col("temp_module_c") - faiman(F.col("poa_wm2"), F.col("temp_ambient_c"), F.col("wind_speed_ms")))
    return off.groupBy(*keys).agg(
        _r(F.median("off"), 4).alias("median_offset_from_model_c"), _r(F.percentile("off", F.lit(0.05)), 4).alias("offset_5th_percentile_c"), _r(F.percentile("off", F.lit(0.95)), 4).alias("offset_95th_percentile_c"),
        _r(F.median(F.col("temp_module_c") - F.col("temp_ambient_c")), 4).alias("median_rise_above_ambient_c"), F.count("*").alias("intervals_scored"),
    ).where("intervals_scored >= 20")


def ac_ceiling(rows: DataFrame, flatness: float = 0.005, min_run: int = 3, keys: list[str] = KEYS) -> DataFrame:
    """Plateaus near the peak, by gaps and islands over consecutive daylight rows."""
    peak = F.max("ac_power_kw").over(Window.partitionBy(*keys))
    day = rows.where("ac_power_kw is not null").withColumn("peak", peak).where((F.col("peak") > 0) & (F.col("ac_power_kw") > 0.15 * F.col("peak")))
    step = F.abs(F.col("ac_power_kw") - F.lag("ac_power_kw").over(Window.partitionBy(*keys).orderBy("ts")))
    flat = day.withColumn("flat", (F.col("ac_power_kw") >= 0.98 * F.col("peak")) & F.coalesce(step <= flatness * F.col("peak"), F.lit(False)))
    runs = islands(flat, keys, "ts", ~F.col("flat"))
    runs = runs.withColumn("length", F.count_if("flat").over(Window.partitionBy(*keys, "island")))
    pinned = F.col("flat") & (F.col("length") >= min_run)
    return runs.groupBy(*keys).agg(
        _r(F.max("peak"), 4).alias("peak_ac_kw"), _r(F.count_if(pinned) / F.count("*")).alias("flat_ceiling_share"), F.max("length").alias("longest_flat_run_intervals"),
        F.count_distinct(F.when(pinned, F.col("on_day"))).alias("days_with_a_plateau"), F.count("*").alias("generating_intervals"),
    )


def stuck_channels(rows: DataFrame, channels: list[str], min_run: int = 8, tolerance: float = 1e-9, keys: list[str] = KEYS) -> DataFrame:
    """Share of lit intervals in which a channel repeats its value ``min_run`` times or more."""
    long = rows.where("poa_wm2 >= 50").unpivot([*keys, "ts"], channels, "channel", "value").where("value is not null")
    own = [*keys, "channel"]
    same = F.coalesce(F.abs(F.col("value") - F.lag("value").over(Window.partitionBy(*own).orderBy("ts"))) < tolerance, F.lit(False))
    runs = islands(long.withColumn("same", same), own, "ts", ~F.col("same"))
    runs = runs.withColumn("length", F.count_if("same").over(Window.partitionBy(*own, "island")))
    return runs.groupBy(*own).agg(_r(F.count_if(F.col("length") >= min_run - 1) / F.count("*")).alias("stuck_share"), F.count("*").alias("samples"))


def data_quality(rows: DataFrame, plant: Plant = Plant(), keys: list[str] = KEYS) -> DataFrame:
    """Coverage against the modal interval, and the issue counts of the window."""
    lit = F.coalesce(F.col("poa_wm2") >= 200, F.lit(False))
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("actual_samples"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("span"), F.count_if(lit).alias("lit_intervals"),
        F.count_if(lit & F.col("ac_power_kw").isNull()).alias("lit_intervals_without_power"), F.count_if(F.col("poa_wm2").isNull()).alias("missing_poa"), F.count_if(F.col("ac_power_kw").isNull()).alias("missing_ac_power"),
        F.count_if(F.coalesce((F.col("poa_wm2") < 5) & (F.col("ac_power_kw") > 0.5), F.lit(False))).alias("night_generation"), F.count_if(F.coalesce(F.col("ac_power_kw") > 1.2 * plant.capacity_kw, F.lit(False))).alias("out_of_range"),
    )
    out = sums.join(modal_interval_hours(rows, keys), keys, "left")
    expected = (F.floor(F.col("span") / (F.col("interval_h") * 3600)) + 1).cast("long")
    return out.select(
        *keys, expected.alias("expected_samples"), "actual_samples", _r(F.try_divide("actual_samples", expected)).alias("coverage"), "lit_intervals", "lit_intervals_without_power",
        _r(1 - F.try_divide("lit_intervals_without_power", "lit_intervals")).alias("lit_interval_completeness"), "missing_poa", "missing_ac_power", "night_generation", "out_of_range",
    )


def daily_completeness(rows: DataFrame) -> DataFrame:
    day = F.to_date("ts").alias("day")
    return rows.groupBy("system_id", day).agg(_r(F.count("ac_power_kw") / F.count("*")).alias("completeness"), (F.count("ac_power_kw") == 0).alias("missing"))


def onset(days: DataFrame, value: str, keys: list[str], order: str = "day") -> DataFrame:
    """The single change point of a daily series of six days or more."""
    found = change_points(days.where(F.col(value).isNotNull()), keys, order, value).where("n >= 6")
    change = F.col("level_after") - F.col("level_before")
    return found.select(
        *keys, F.col(order).alias("onset_day"), _r(F.col("level_before"), 4).alias("level_before"), _r(F.col("level_after"), 4).alias("level_after"), _r(change, 4).alias("absolute_change"),
        F.col("k").cast("long").alias("days_before"), (F.col("n") - F.col("k")).alias("days_after"), F.col("scatter").alias("day_to_day_scatter"), _r(significance(change, F.col("scatter"))).alias("change_over_scatter"),
    )


def trend(days: DataFrame, value: str, keys: list[str], order: str = "day", recovery_step: float = 0.02) -> DataFrame:
    """Least squares over the day numbers, and the recoveries of at least ``recovery_step``."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = days.where(F.col(value).isNotNull()).select(*keys, order, F.col(value).alias("y"), (F.row_number().over(w) - 1).cast("double").alias("x"), (F.col(value) - F.lag(value).over(w)).alias("step"))
    fit = rows.groupBy(*keys).agg(
        F.regr_slope("y", "x").alias("slope"), F.when(F.min("y") == F.max("y"), F.lit(0.0)).otherwise(F.regr_r2("y", "x")).alias("r2"), F.count("*").alias("days"),
        F.count_if(F.coalesce(F.round("step", 9) >= recovery_step, F.lit(False))).alias("recovery_count"), F.max("step").alias("largest"),
    )
    return fit.where("days >= 5").select(*keys, _r(F.col("slope"), 9).alias("slope_per_day"), _r(F.col("slope") * F.col("days")).alias("change_across_window"), _r(F.col("r2")).alias("r_squared"), "days", "recovery_count", _r(F.col("largest")).alias("largest_step"))


def soiling_recovery(days: DataFrame, keys: list[str], wash_quantile: float = 0.35) -> DataFrame:
    """Slopes of dry stretches of three days or more, and the change around each wet day."""
    middle = days.groupBy(*keys).agg(F.median("insolation").alias("middle"), F.count("*").alias("days_scored"))
    rows = days.join(middle.where("days_scored >= 10"), keys).withColumn("wet", F.col("insolation") < F.col("middle") * wash_quantile)
    w = Window.partitionBy(*keys).orderBy("day")
    around = rows.withColumn("jump", F.avg("pr").over(w.rowsBetween(1, 2)) - F.avg("pr").over(w.rowsBetween(-2, -1)))
    runs = islands(around, keys, "day", F.col("wet")).where(~F.col("wet")).withColumn("x", F.row_number().over(Window.partitionBy(*keys, "island").orderBy("day")).cast("double"))
    slopes = runs.groupBy(*keys, "island").agg(F.regr_slope("pr", "x").alias("slope"), F.count("*").alias("n")).where("n >= 3")
    dry = slopes.groupBy(*keys).agg(F.count("*").alias("dry_stretches"), _r(F.avg("slope"), 8).alias("mean_dry_slope_per_day"), _r(F.min("slope"), 8).alias("steepest_dry_slope_per_day"))
    wet = around.groupBy(*keys).agg(F.count_if("wet").alias("candidate_wash_days"), _r(F.avg(F.when(F.col("wet"), F.col("jump"))), 8).alias("mean_change_after_a_wash"), F.count("*").alias("days_scored"))
    return wet.join(dry, keys, "left").withColumn("dry_stretches", F.coalesce("dry_stretches", F.lit(0)))


def string_shares(strings: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Each string's share of the total at every usable time: total above a fifth of the group's median total."""
    totals = strings.withColumn("total", F.sum("current_a").over(Window.partitionBy(*keys, time)))
    middle = totals.select(*keys, time, "total").distinct().groupBy(*keys).agg(F.median("total").alias("middle"))
    return totals.join(middle, keys).where(F.col("total") > F.greatest(0.2 * F.col("middle"), F.lit(1e-6))).withColumn("share", F.col("current_a") / F.col("total"))


def string_balance(strings: DataFrame, keys: list[str], time: str = "day") -> DataFrame:
    """Mean share of each string against an even split; a group with one string is undefined."""
    means = string_shares(strings, keys, time).groupBy(*keys, "string_idx").agg(F.avg("share").alias("share"))
    n = F.count("*").over(Window.partitionBy(*keys))
    below = 1 - F.col("share") * F.col("n")
    return means.withColumn("n", n).where("n >= 2").select(*keys, "string_idx", _r(F.col("share")).alias("mean_share"), _r(1 / F.col("n")).alias("even_share"), _r(below).alias("below_even"), (F.round(below, 9) > 0.10).alias("over_10pct_below"), (F.round(below, 9) > 0.25).alias("over_25pct_below"))


def string_profiles(strings: DataFrame, keys: list[str], time: str = "day") -> DataFrame:
    """Correlation with and slope against the median string; a constant string gives 0 and 0."""
    middle = strings.groupBy(*keys, time).agg(F.median("current_a").alias("reference"))
    both = strings.join(middle, [*keys, time])
    flat = F.min("current_a") == F.max("current_a")
    fit = both.groupBy(*keys, "string_idx").agg(F.when(flat, F.lit(0.0)).otherwise(F.regr_slope("current_a", "reference")).alias("level"), flat.alias("flat"), F.regr_r2("current_a", "reference").alias("r2"), F.count("*").alias("samples"))
    shape = F.when(F.col("flat"), F.lit(0.0)).otherwise(F.signum("level") * F.sqrt("r2"))
    return fit.select(*keys, "string_idx", _r(shape).alias("shape_match"), _r(F.col("level")).alias("level"), "samples")


def string_onset(strings: DataFrame, keys: list[str], time: str = "day") -> DataFrame:
    """The change point of each string's daily share, over days on which every string reports."""
    shares = string_shares(strings, keys, time)
    count = shares.groupBy(*keys).agg(F.count_distinct("string_idx").alias("strings"))
    whole = shares.withColumn("here", F.count("*").over(Window.partitionBy(*keys, time))).join(count, keys).where("here = strings and strings >= 2")
    return onset(whole, "share", [*keys, "string_idx"], time)


def trailing_baseline(days: DataFrame, windows: DataFrame, baseline_days: int = 30) -> DataFrame:
    """The window's ratio against the days before it, in units of the baseline's daily scatter."""
    roles = windows.select("system_id", "window_id", F.explode(F.array(
        F.struct(F.lit("now").alias("role"), F.col("start_day").alias("a"), F.col("end_day").alias("b")),
        F.struct(F.lit("prior").alias("role"), F.date_sub("start_day", baseline_days).alias("a"), F.date_sub("start_day", 1).alias("b")),
    )).alias("r")).select("system_id", "window_id", "r.role", F.explode(F.sequence("r.a", "r.b")).alias("day"))
    both = days.join(roles, ["system_id", "day"])
    ratio = lambda role: F.try_divide(F.sum(F.when(F.col("role") == role, F.col("ac_power_kw"))), F.sum(F.when(F.col("role") == role, F.col("poa_wm2"))))
    daily = F.when((F.col("role") == "prior") & (F.col("poa_wm2") > 0), F.col("ac_power_kw") / F.col("poa_wm2"))
    out = both.groupBy("system_id", "window_id").agg(ratio("now").alias("now"), ratio("prior").alias("prior"), F.count(daily).alias("baseline_days_used"), F.stddev_samp(daily).alias("spread"))
    change = F.col("now") - F.col("prior")
    spread = F.when(F.col("baseline_days_used") > 2, F.col("spread")).otherwise(F.lit(0.0))
    return out.where("now is not null and prior is not null").select("system_id", "window_id", _r(F.col("now")).alias("ratio_window"), _r(F.col("prior")).alias("ratio_baseline"), _r(change).alias("change"), _r(spread).alias("baseline_day_to_day_spread"), "baseline_days_used")


def weather_context(days: DataFrame, windows: DataFrame) -> DataFrame:
    """Insolation against the record's other days of the same day-of-year span (the whole year if it wraps)."""
    here = in_windows_days(days, windows, "start_day", "end_day")
    span = here.groupBy("system_id", "window_id", "start_day", "end_day").agg(F.min(F.dayofyear("day")).alias("lo"), F.max(F.dayofyear("day")).alias("hi"), F.avg("poa_wm2").alias("mean"), F.count("*").alias("days_in_window"))
    doy = span.select("system_id", "window_id", "start_day", "end_day", "mean", "days_in_window", F.explode(F.sequence("lo", "hi")).alias("doy"))
    others = days.withColumn("doy", F.dayofyear("day")).join(doy, ["system_id", "doy"]).where(~F.col("day").between(F.col("start_day"), F.col("end_day")))
    return others.groupBy("system_id", "window_id").agg(
        _r(F.first("mean"), 3).alias("mean_daily_insolation"), _r(F.avg("poa_wm2"), 3).alias("seasonal_norm"), _r(F.try_divide(F.first("mean"), F.avg("poa_wm2"))).alias("relative_to_norm"),
        F.first("days_in_window").alias("days_in_window"), F.count("*").alias("seasonal_days_compared"),
    )


def flatline(rows: DataFrame, channels: list[str], min_run: int = 12, keys: list[str] = KEYS) -> DataFrame:
    """Share of samples in runs of ``min_run`` equal values; a NULL breaks a run.

    Irradiance and AC power count only while irradiance is above 50, as they stand still at night.
    """
    lit = F.coalesce(F.col("poa_wm2") > 50, F.lit(False))
    shown = rows.select(*keys, "ts", *(F.when(lit, F.col(c)).alias(c) if c in ("poa_wm2", "ac_power_kw") else F.col(c) for c in channels))
    long = shown.unpivot([*keys, "ts"], channels, "channel", "value")
    own = [*keys, "channel"]
    same = F.coalesce(F.col("value") == F.lag("value").over(Window.partitionBy(*own).orderBy("ts")), F.lit(False))
    runs = islands(long.withColumn("same", same), own, "ts", ~F.col("same")).withColumn("length", F.count("value").over(Window.partitionBy(*own, "island")))
    return runs.groupBy(*own).agg(_r(F.count_if(F.col("length") >= min_run) / F.count("*")).alias("flat_share"), F.max("length").alias("longest_run"))


def against_history(now: DataFrame, before: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """A string's value in the window beside its value over the record before; without a history the change is NULL, not 0.

    ``now`` and ``before`` hold keys, string_idx and ``value``.
    """
    past = before.select(*keys, "string_idx", F.col(value).alias("baseline"))
    joined = now.join(past, [*keys, "string_idx"], "left")
    return joined.select(*keys, "string_idx", value, "baseline", _r(F.col(value) - F.col("baseline")).alias("change"))


def string_history(strings: DataFrame, windows: DataFrame, min_samples: int = 100) -> tuple[DataFrame, DataFrame]:
    """The strings' rows inside each window, and those of the record before it where that is at least as long.

    ``strings``: system_id, day, string_idx, current_a.  Days unfold to the windows they precede through a
    join on the system; windows are few a system, and each needs the whole record before it.
    """
    inside = in_windows_days(strings, windows)
    past = strings.join(windows.select("system_id", "window_id", "start_day"), "system_id").where(F.col("day") < F.col("start_day")).drop("start_day")
    length = lambda f: f.groupBy("system_id", "window_id").agg(F.count_distinct("day").alias("n"))
    enough = length(past).alias("p").join(length(inside).alias("i"), ["system_id", "window_id"]).where((F.col("p.n") >= F.col("i.n")) & (F.col("p.n") >= min_samples)).select("system_id", "window_id")
    return inside, past.join(enough, ["system_id", "window_id"], "left_semi")


def in_windows_days(rows: DataFrame, windows: DataFrame, *carry: str) -> DataFrame:
    days = windows.select("system_id", "window_id", *carry, F.explode(F.sequence("start_day", "end_day")).alias("day"))
    return rows.join(days, ["system_id", "day"])
