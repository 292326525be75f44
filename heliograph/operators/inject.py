"""Fault injection: rows inside a window are changed, all others pass through.

Each function takes a panel with ``ts`` and a boolean Column that marks the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POWER = ("ac_power_kw", "dc_power_kw")


def scaled(panel: DataFrame, inside: Column, factor: Column, columns: tuple[str, ...] = POWER) -> DataFrame:
    return panel.withColumns({c: F.when(inside, F.col(c) * factor).otherwise(F.col(c)) for c in columns if c in panel.columns})


def outage(panel: DataFrame, inside: Column, share: float, fraction_lost: float = 1.0, ramp_rows: int = 0) -> DataFrame:
    """One string's loss, seen by the plant; the ramp's first row loses nothing."""
    if not ramp_rows:
        return scaled(panel, inside, F.lit(1 - fraction_lost * share))
    at = F.row_number().over(Window.partitionBy("system_id", inside).orderBy("ts")) - 1
    profile = F.least(at / max(ramp_rows - 1, 1), F.lit(1.0)) * fraction_lost
    return scaled(panel.withColumn("__p", profile), inside, 1 - F.col("__p") * share).drop("__p")


def shading(panel: DataFrame, inside: Column, hour_start: int, hour_end: int, depth: float, affected: int = 1, strings: int = 7) -> DataFrame:
    return scaled(panel, inside & (F.hour("ts") >= hour_start) & (F.hour("ts") < hour_end), F.lit(1 - depth * affected / strings))


def soiling(panel: DataFrame, inside: Column, rate: float, most: float, rain_resets: bool = True) -> DataFrame:
    """Loss grows by ``rate`` a dry day up to ``most``; a day under 0.35 of the window's median mean irradiance washes it off."""
    days = panel.where(inside).groupBy("system_id", F.to_date("ts").alias("__day")).agg(F.avg("poa_wm2").alias("__g"))
    middle = F.percentile("__g", F.lit(0.5)).over(Window.partitionBy("system_id"))
    wet = F.coalesce(F.col("__g") < 0.35 * middle, F.lit(False)) if rain_resets else F.lit(False)
    w = Window.partitionBy("system_id").orderBy("__day").rowsBetween(Window.unboundedPreceding, 0)
    marked = days.withColumn("__wet", wet).withColumn("__spell", F.sum(F.col("__wet").cast("int")).over(w))
    dry = F.count_if(~F.col("__wet")).over(Window.partitionBy("system_id", "__spell").orderBy("__day").rowsBetween(Window.unboundedPreceding, 0))
    loss = marked.select("system_id", "__day", F.least(dry * rate, F.lit(most)).alias("__loss"))
    joined = panel.withColumn("__day", F.to_date("ts")).join(loss, ["system_id", "__day"], "left")
    return scaled(joined, inside, 1 - F.coalesce("__loss", F.lit(0.0))).drop("__day", "__loss")


def power_cap(panel: DataFrame, inside: Column, ceiling_kw: float) -> DataFrame:
    """Clipping and curtailment: the same mathematics under two names."""
    over = inside & F.coalesce(F.col("ac_power_kw") > ceiling_kw, F.lit(False))
    return scaled(panel.withColumn("__f", ceiling_kw / F.col("ac_power_kw")), over, F.col("__f")).drop("__f")


def sensor_drift(panel: DataFrame, inside: Column, rate: float, most: float) -> DataFrame:
    day = F.dense_rank().over(Window.partitionBy("system_id", inside).orderBy(F.to_date("ts"))) - 1
    return scaled(panel.withColumn("__d", F.greatest(F.least(day * rate, F.lit(most)), F.lit(0.0))), inside, 1 + F.col("__d"), ("poa_wm2",)).drop("__d")


def telemetry_gap(panel: DataFrame, inside: Column, columns: tuple[str, ...] = ("ac_power_kw",)) -> DataFrame:
    return panel.withColumns({c: F.when(~inside, F.col(c)) for c in columns})


INJECTORS = {"string_outage": outage, "shading": shading, "soiling": soiling, "clipping": power_cap, "curtailment": power_cap, "sensor_drift": sensor_drift, "telemetry_gap": telemetry_gap}


def string_share(strings: DataFrame, inside: Column, string_idx: int, fraction_lost: float = 1.0) -> DataFrame:
    """system_id, share: what the plant loses with one string, as the median over the window's instants.

    The string's current before the outage is set against the total after it, so a whole outage of one of
    n even strings weighs 1/(n-1); where no instant tells, the share is 1/n.
    """
    lost = F.when(F.col("string_idx") == string_idx, F.col("current_a") * (1 - fraction_lost)).otherwise(F.col("current_a"))
    totals = strings.where(inside).groupBy("system_id", "ts").agg(F.max(F.when(F.col("string_idx") == string_idx, F.col("current_a"))).alias("own"), F.sum(lost).alias("total"))
    known = strings.groupBy("system_id").agg((1 / F.count_distinct("string_idx")).alias("even"))
    shares = totals.groupBy("system_id").agg(F.median(F.when(F.col("total") != 0, F.col("own") / F.col("total"))).alias("share"))
    return known.join(shares, "system_id", "left").select("system_id", F.coalesce("share", "even").alias("share"))


def outage_of_string(panel: DataFrame, strings: DataFrame, inside: Column, string_idx: int, fraction_lost: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The plant's panel and its strings after one string's loss, with the plant's share taken from the strings."""
    share = string_share(strings, inside, string_idx, fraction_lost)
    joined = panel.join(share, "system_id", "left")
    plant = scaled(joined, inside, 1 - fraction_lost * F.coalesce("share", F.lit(0.0))).drop("share")
    return plant, scaled(strings, inside & (F.col("string_idx") == string_idx), F.lit(1 - fraction_lost), ("current_a",))


def shaded_strings(strings: DataFrame, inside: Column, hour_start: int, hour_end: int, depth: float, first: int, affected: int, count: int = 7) -> DataFrame:
    """The strings under a shadow: ``affected`` neighbours from ``first`` on, around the end of the row."""
    hit = F.pmod(F.col("string_idx") - first, F.lit(count)) < affected
    return scaled(strings, inside & hit & (F.hour("ts") >= hour_start) & (F.hour("ts") < hour_end), F.lit(1 - depth), ("current_a",))


def soiled_strings(strings: DataFrame, panel: DataFrame, inside: Column, rate: float, most: float, rain_resets: bool = True) -> DataFrame:
    """All strings of a soiled plant, by the loss of each day that ``soiling`` finds for the plant."""
    marked = soiling(panel.withColumn("ac_power_kw", F.lit(1.0)), inside, rate, most, rain_resets)
    kept = marked.groupBy("system_id", F.to_date("ts").alias("__day")).agg(F.min("ac_power_kw").alias("__kept"))
    joined = strings.withColumn("__day", F.to_date("ts")).join(kept, ["system_id", "__day"], "left")
    return scaled(joined, inside, F.coalesce("__kept", F.lit(1.0)), ("current_a",)).drop("__day", "__kept")
