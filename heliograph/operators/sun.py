"""Measurements against the sun: clear-sky consistency, night offset, and the logger's UTC offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions.physics import Plant
from heliograph.functions.solar import Site, with_clearsky, with_sun
from heliograph.plans.ordered import first_half

KEYS = ["system_id", "window_id"]
#: Half-hour steps of the offset scan, -12 to +14 hours.
OFFSETS = range(-24, 29)


def _r(column: Column, digits: int = 6) -> Column:
    return F.round(column, digits)


def clearsky_consistency(rows: DataFrame, site: Site = Site(), quantile: float = 0.9, clear: float = 0.85, keys: list[str] = KEYS) -> DataFrame:
    """The irradiance sensor on its clearest days against the modelled sky, whole and by halves.

    A window without a day to compare has no row.
    """
    bright = with_clearsky(rows, site).where((F.col("clearsky_poa") > 300) & F.col("poa_wm2").isNotNull())
    days = bright.groupBy(*keys, "on_day").agg(F.median(F.col("poa_wm2") / F.col("clearsky_poa")).alias("ratio"), F.count("*").alias("samples")).withColumn("first", first_half(keys, "on_day"))
    at = lambda part: F.percentile(F.when(part, F.col("ratio")), F.lit(quantile))
    out = days.groupBy(*keys).agg(
        F.percentile("ratio", F.lit(quantile)).alias("c"), at(F.col("first")).alias("a"), at(~F.col("first")).alias("b"), F.count("*").alias("days_compared"), F.sum("samples").alias("samples_used"),
        F.count_if(F.col("first") & (F.col("ratio") >= clear)).alias("clear_days_first_half"), F.count_if(~F.col("first") & (F.col("ratio") >= clear)).alias("clear_days_second_half"),
    ).withColumn("a", F.coalesce("a", "c"))
    change = F.col("b") - F.col("a")
    return out.select(
        *keys, _r(F.col("c")).alias("clearest_day_ratio"), _r(F.greatest(1 - F.col("c"), F.lit(0.0))).alias("shortfall_vs_clearsky"), _r(F.col("a")).alias("ratio_first_half"), _r(F.col("b")).alias("ratio_second_half"),
        _r(change).alias("ratio_change_across_window"), _r(change / F.col("days_compared")).alias("ratio_change_per_day"), "days_compared", "samples_used", "clear_days_first_half", "clear_days_second_half",
    )


def night_offset(rows: DataFrame, site: Site = Site(), plant: Plant = Plant(), keys: list[str] = KEYS) -> DataFrame:
    """What the sensors read while the sun is ten degrees and more below the horizon."""
    night = with_sun(rows, site).where("sun_zenith > 100")
    return night.groupBy(*keys).agg(
        F.count("*").alias("night_intervals"), _r(F.median("poa_wm2"), 4).alias("median_night_irradiance_wm2"), _r(F.max("poa_wm2"), 4).alias("max_night_irradiance_wm2"), _r(F.median("ac_power_kw"), 4).alias("median_night_ac_kw"),
        _r(F.max("ac_power_kw"), 4).alias("max_night_ac_kw"), F.count_if(F.col("ac_power_kw") > 0.01 * plant.capacity_kw).alias("night_generation_intervals"),
    )


def clearest_days(rows: DataFrame, keep: int = 30, value: str = "poa_wm2") -> DataFrame:
    """Rows above 20 of the ``keep`` smoothest days of each system: mean absolute second difference over peak.

    A day needs 12 samples above 50 and a peak of 200; a system without such a day keeps all its rows.
    """
    own = Window.partitionBy("system_id", "__day").orderBy("ts")
    dated = rows.where(F.col(value).isNotNull()).withColumn("__day", F.to_date("ts"))
    bent = dated.where(F.col(value) > 50).withColumn("__bend", F.abs(F.col(value) - 2 * F.lag(value).over(own) + F.lag(value, 2).over(own)))
    days = bent.groupBy("system_id", "__day").agg(F.count("*").alias("n"), F.max(value).alias("peak"), F.avg("__bend").alias("bend")).where("n >= 12 and peak >= 200")
    rank = F.row_number().over(Window.partitionBy("system_id").orderBy(F.round(F.col("bend") / F.col("peak"), 9), "__day"))
    chosen = days.withColumn("rank", rank).where(F.col("rank") <= keep).select("system_id", "__day", F.lit(True).alias("__chosen"))
    some = chosen.select("system_id").distinct().withColumn("__some", F.lit(True))
    marked = dated.join(chosen, ["system_id", "__day"], "left").join(some, "system_id", "left")
    return marked.where(F.col("__some").isNull() | (F.col("__chosen") & (F.col(value) > 20))).drop("__day", "__chosen", "__some")


def offset_curve(rows: DataFrame, site: Site = Site(), value: str = "poa_wm2", max_samples: int = 20_000) -> DataFrame:
    """system_id, offset_hours, correlation of the readings with the sky at every half-hour offset.

    The offsets unfold next to each row, so that all systems and offsets are one job.  ``max_samples``
    thins a long record by an even stride, as only the timing of the curve counts.
    """
    own = Window.partitionBy("system_id")
    stride = F.greatest(F.floor(F.count("*").over(own) / max_samples), F.lit(1))
    thin = rows.withColumn("__stride", stride).withColumn("__at", F.row_number().over(own.orderBy("ts")) - 1).where("__at % __stride = 0").drop("__at", "__stride")
    tried = thin.withColumn("__half", F.explode(F.lit(list(OFFSETS)))).withColumn("ts", F.timestamp_seconds(F.unix_timestamp("ts") - F.col("__half") * 1800))
    sky = with_clearsky(tried, site)
    spread = F.stddev_pop(value) * F.stddev_pop("clearsky_poa")
    found = sky.groupBy("system_id", (F.col("__half") / 2).alias("offset_hours")).agg(F.covar_pop(value, "clearsky_poa").alias("c"), spread.alias("s"))
    return found.where("s > 1e-9").select("system_id", "offset_hours", _r(F.col("c") / F.col("s")).alias("correlation"))


def utc_offset(rows: DataFrame, site: Site = Site(), value: str = "poa_wm2", keep: int = 30) -> DataFrame:
    """The best offset of each system's logger, its runner-up, and whether the answer can be trusted."""
    clear = clearest_days(rows, keep, value)
    curve = offset_curve(clear, site, value)
    order = Window.partitionBy("system_id").orderBy(F.desc("correlation"), F.abs("offset_hours"), "offset_hours")
    best = curve.withColumn("rank", F.row_number().over(order)).where("rank <= 2").groupBy("system_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("offset_hours"))).alias("offset_hours"), F.max(F.when(F.col("rank") == 1, F.col("correlation"))).alias("correlation"),
        F.max(F.when(F.col("rank") == 2, F.col("offset_hours"))).alias("runner_up_hours"), F.max(F.when(F.col("rank") == 2, F.col("correlation"))).alias("runner_up_correlation"),
    )
    margin = F.round(F.col("correlation") - F.coalesce("runner_up_correlation", "correlation"), 6)
    return best.withColumns({"margin": margin, "trustworthy": (F.col("correlation") >= 0.95) & (margin >= 0.01)})
