"""Detectors of a sweep and the rule cascade, over one wide ledger row per window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Detector, measure, threshold and side.
DETECTORS = (("data_completeness", "lit_interval_completeness", 0.80, "below"), ("performance_ratio_drop", "change", -0.05, "below"), ("string_imbalance", "string_deficit", 0.22, "above"), ("flat_ceiling", "flat_ceiling_share", 0.02, "above"))


def signals(ledger: DataFrame) -> DataFrame:
    """One row for each detector that fires, with its severity; a measure that is absent fires nothing."""
    rows = []
    for name, key, limit, side in DETECTORS:
        value = F.col(key) if key in ledger.columns else F.lit(None).cast("double")
        fires = value < limit if side == "below" else value > limit
        rows.append(F.when(fires, F.struct(F.lit(name).alias("detector"), value.alias("value"), F.lit(limit).alias("threshold"), F.abs(value / limit).alias("severity"))))
    found = ledger.select("system_id", "window_id", F.explode(F.array_compact(F.array(*rows))).alias("s"))
    return found.select("system_id", "window_id", "s.detector", F.round("s.value", 6).alias("value"), "s.threshold", F.round("s.severity", 6).alias("severity"))


def _of(ledger: DataFrame, key: str, default: float) -> Column:
    return F.coalesce(F.col(key), F.lit(default)) if key in ledger.columns else F.lit(default)


def verdicts(ledger: DataFrame) -> DataFrame:
    """The ordered rules; the first that fits commits.  A missing string measure leaves rule 4 undecided."""
    m = lambda key, default=0.0: _of(ledger, key, default)
    whole = (m("lit_interval_completeness", 1.0) < 0.80) | (m("coverage", 1.0) < 0.80) | F.col("pr").isNull() | (m("data_completeness", 1.0) < 0.80)
    sensor = (m("clear_days") >= 3) & ((m("ratio_change_per_day") < -0.004) | (m("shortfall_vs_clearsky") > 0.12))
    cause = (
        F.when(whole, "telemetry_gap").when(sensor, "sensor_drift").when(m("flat_ceiling_share") > 0.02, "clipping")
        .when((m("string_deficit") > 0.22) & (m("shape_spread") > 0.25), "shading").when(m("string_deficit") > 0.22, "string_outage")
        .when(m("relative_to_norm", 1.0) < 0.85, "weather")
        .when((m("slope_per_day") < -0.0015) | (m("deficit_change") > 0.04) | (m("deficit_fraction") > 0.05), "soiling")
        .otherwise("seasonal_temperature_derating")
    )
    category = (
        F.when(F.col("cause").isin("telemetry_gap", "sensor_drift", "weather"), "not_the_plant").when(F.col("cause").isin("shading", "string_outage"), "fault")
        .when(F.col("cause") == "soiling", "recoverable").otherwise("by_design")
    )
    return ledger.select("system_id", "window_id", cause.alias("cause")).withColumn("category", category)
