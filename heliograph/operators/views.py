"""What a dashboard asks for: recent rows, series by period, string map, scatter, gap calendar, summary, latest plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions.physics import Plant
from heliograph.operators import measures

# Rows of the recent view, points of the scatter, bands of the gap calendar.
RECENT, POINTS = 400, 4000
BANDS = ((0.0, "missing"), (0.5, "poor"), (0.95, "partial"))


def recent(panel: DataFrame, k: int = RECENT) -> DataFrame:
    """The last ``k`` rows of each system's record."""
    back = F.row_number().over(Window.partitionBy("system_id").orderBy(F.desc("ts")))
    return panel.withColumn("__back", back).where(F.col("__back") <= k).drop("__back").select("system_id", "ts", F.round("ac_power_kw", 4).alias("ac_power_kw"), F.round("poa_wm2", 4).alias("poa_wm2"))


def period_of(freq: str):
    """The label of a row's period: weeks by their Sunday, months by their last day."""
    return {
        "15min": F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 900) * 900), "1H": F.date_trunc("hour", "ts"), "1D": F.to_date("ts"),
        "1W": F.date_add(F.to_date(F.date_trunc("week", "ts")), 6), "1ME": F.last_day("ts"),
    }[freq]


def pr_series(panel: DataFrame, freq: str, plant: Plant = Plant()) -> DataFrame:
    """Performance ratio by period, with periods of low completeness marked; one with a single row is left out."""
    rows = panel.withColumn("period", period_of(freq))
    many = rows.withColumn("__n", F.count("*").over(Window.partitionBy("system_id", "period"))).where("__n >= 2").drop("__n")
    out = measures.performance_ratio(many, plant, keys=["system_id", "period"])
    return out.select("system_id", "period", "pr", "pr_temperature_corrected", "energy_kwh", "data_completeness", (F.col("data_completeness") < 0.5).alias("shaded"))


def string_map(strings: DataFrame) -> DataFrame:
    """Daily mean share of each string over usable times."""
    return measures.string_shares(strings, ["system_id"], "day").groupBy("system_id", "day", "string_idx").agg(F.round(F.avg("share"), 6).alias("share"))


def scatter(panel: DataFrame, points: int = POINTS, plant: Plant = Plant()) -> DataFrame:
    """Measured against expected power where more than 1 kW is expected, every n-th row so that about ``points`` stay."""
    lit = measures.with_expectation(panel, plant).where("expected_kw > 1 and ac_power_kw is not null")
    own = Window.partitionBy("system_id")
    stride = F.greatest(F.floor(F.count("*").over(own) / points), F.lit(1))
    thin = lit.withColumn("__at", F.row_number().over(own.orderBy("ts")) - 1).withColumn("__stride", stride).where("__at % __stride = 0")
    return thin.select("system_id", "ts", F.round("expected_kw", 4).alias("expected_kw"), F.round("ac_power_kw", 4).alias("ac_power_kw"))


def gap_calendar(panel: DataFrame) -> DataFrame:
    band = F.lit("complete")
    for limit, name in reversed(BANDS):
        band = F.when(F.col("completeness") <= limit if limit == 0 else F.col("completeness") < limit, name).otherwise(band)
    return measures.daily_completeness(panel).select("system_id", "day", "completeness", band.alias("band"))


def plant_summary(panel: DataFrame) -> DataFrame:
    return panel.groupBy("system_id").agg(F.unix_timestamp(F.min("ts")).alias("first_second"), F.unix_timestamp(F.max("ts")).alias("last_second"), F.count("*").alias("intervals"), F.round(F.max("ac_power_kw"), 4).alias("peak_ac_kw"))


def latest_plan(trace: DataFrame, key: str, order: str, plan: str, planner: str) -> DataFrame:
    """The last plan of each investigation; rows of other nodes don't replace it."""
    return trace.where(planner).groupBy(key).agg(F.max(order).alias("step_index"), F.max_by(plan, order).alias("plan"))
