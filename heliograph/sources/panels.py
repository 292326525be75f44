"""Telemetry panels over the stored tables, one row per system and interval.

Sums run over DECIMAL so that their value doesn't depend on the order of rows; a missing channel is
NULL, never zero.  Filters on the raw timestamp columns stay on the stored type and reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STRINGS = 7


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_sum(value: Column) -> Column:
    return F.sum(value.cast("decimal(18,4)")).cast("double")


def exact_avg(value: Column) -> Column:
    return F.try_divide(F.sum(value.cast("decimal(18,4)")).cast("double"), F.count(value))


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view, purchase, signup, error and click values as irradiance, AC, DC, module temperature, wind."""
    of = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    rows = read(spark, sf_dir, "events").groupBy(F.lit(1).alias("system_id"), F.date_trunc("hour", "ts").cast("timestamp").alias("ts"))
    return rows.agg(
        exact_sum(of("view")).alias("poa_wm2"), exact_sum(of("purchase")).alias("ac_power_kw"), exact_sum(of("signup")).alias("dc_power_kw"),
        (exact_avg(of("error")) / 10).alias("temp_module_c"), F.lit(20.0).alias("temp_ambient_c"), (exact_avg(of("click")) / 100).alias("wind_speed_ms"),
    )


def lineitem_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy(F.lit(1).alias("system_id"), F.to_date("l_shipdate").alias("day"))
    return rows.agg(exact_sum(F.col("l_extendedprice")).alias("poa_wm2"), exact_sum((F.col("l_extendedprice").cast("decimal(18,4)") * (1 - F.col("l_discount").cast("decimal(6,4)"))).cast("decimal(18,4)")).alias("ac_power_kw"))


def lineitem_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of the per-string currents: system_id, day, string_idx, current_a."""
    index = (F.col("l_suppkey") % STRINGS + 1).cast("int").alias("string_idx")
    return read(spark, sf_dir, "lineitem").groupBy(F.lit(1).alias("system_id"), F.to_date("l_shipdate").alias("day"), index).agg(exact_sum(F.col("l_quantity")).alias("current_a"))


def events_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of the signup values by user group, as per-string currents."""
    index = (F.col("user_id") % STRINGS + 1).cast("int").alias("string_idx")
    rows = read(spark, sf_dir, "events").where("event_type = 'signup' and user_id is not null")
    return rows.groupBy(F.lit(1).alias("system_id"), F.to_date("ts").alias("day"), index).agg(exact_sum(F.col("value")).alias("current_a"))


def windows_of(panel: DataFrame, days: int, time: str = "ts") -> DataFrame:
    """Consecutive windows of whole days over each system's record: window_id, start_day, end_day (inclusive)."""
    span = panel.groupBy("system_id").agg(F.to_date(F.min(time)).alias("lo"), F.to_date(F.max(time)).alias("hi"))
    starts = span.select("system_id", F.posexplode(F.sequence("lo", "hi", F.expr(f"interval {days} days"))).alias("window_id", "start_day"))
    return starts.withColumn("end_day", F.date_add("start_day", days - 1))


def in_windows(panel: DataFrame, windows: DataFrame, time: str = "ts") -> DataFrame:
    """Rows of every window: windows unfold to days, and (system, day) is an equi-join, not a range scan."""
    days = windows.select("system_id", "window_id", "start_day", "end_day", F.explode(F.sequence("start_day", "end_day")).alias("__day"))
    return panel.withColumn("__day", F.to_date(time)).join(days, ["system_id", "__day"]).withColumnRenamed("__day", "on_day")
