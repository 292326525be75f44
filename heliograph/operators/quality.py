"""The issue table of a window: what is missing, stuck, impossible or out of hours, and the worst of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.operators.measures import KEYS, _r, modal_interval_hours, string_shares
from heliograph.plans.ordered import islands

# Irradiance of a night, power that a meter may show then, samples of a stuck run, and the margin over the rating.
NIGHT_POA, NIGHT_POWER, STUCK_RUN, MARGIN, DAYLIGHT = 5.0, 0.5, 12, 1.2, 50.0


def issues(rows: DataFrame, channels: list[str], capacity: Column, keys: list[str] = KEYS, min_run: int = STUCK_RUN) -> DataFrame:
    """kind, channel, count, fraction, first_seen, last_seen, rank of every issue; the worst is rank 1.

    All kinds are flags over one long table, counted in one aggregation; ties go to the order of the
    kinds (missing, night generation, flatline, out of range), then to that of the channels.
    """
    day = F.coalesce(F.col("poa_wm2") > DAYLIGHT, F.lit(False))
    night = F.coalesce((F.col("poa_wm2") < NIGHT_POA) & (F.col("ac_power_kw") > NIGHT_POWER), F.lit(False))
    beyond = F.coalesce(F.col("ac_power_kw") > MARGIN * capacity, F.lit(False))
    shown = lambda c: F.when(day, F.col(c)) if c in ("poa_wm2", "ac_power_kw") else F.col(c)
    cells = F.array(*(F.struct(F.lit(k).alias("at"), F.lit(c).alias("channel"), F.col(c).isNull().alias("missing"), shown(c).alias("value")) for k, c in enumerate(channels)))
    power = F.col("cell.channel") == "ac_power_kw"
    long = rows.select(*keys, "ts", night.alias("night"), beyond.alias("beyond"), F.explode(cells).alias("cell"))
    long = long.select(*keys, "ts", "cell.*", (power & F.col("night")).alias("night"), (power & F.col("beyond")).alias("beyond"))
    own = [*keys, "channel"]
    same = F.coalesce(F.col("value") == F.lag("value").over(Window.partitionBy(*own).orderBy("ts")), F.lit(False))
    runs = islands(long.withColumn("same", same), own, "ts", ~F.col("same")).withColumn("length", F.count("value").over(Window.partitionBy(*own, "island")))
    stuck = F.col("value").isNotNull() & (F.col("length") >= min_run)
    flags = [("missing", F.col("missing")), ("night_generation", F.col("night")), ("flatline", stuck), ("out_of_range", F.col("beyond"))]
    kinds = F.array(*(F.when(flag, F.struct(F.lit(k).alias("order"), F.lit(name).alias("kind"))) for k, (name, flag) in enumerate(flags)))
    total = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    hits = runs.select(*keys, "ts", "at", "channel", F.explode(F.array_compact(kinds)).alias("k")).groupBy(*keys, "channel", "at", "k").agg(F.count("*").alias("count"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    found = hits.join(total, keys).withColumn("fraction", F.col("count") / F.col("total"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("fraction"), "k.order", "at"))
    return found.select(*keys, "k.kind", "channel", "count", _r(F.col("fraction"), 5).alias("fraction"), F.unix_timestamp("first").alias("first_seen"), F.unix_timestamp("last").alias("last_seen"), rank.alias("rank"))


def profile(rows: DataFrame, found: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """A window's data quality in one row: coverage, lit completeness, missing days and the worst issue."""
    lit = F.coalesce(F.col("poa_wm2") >= 200, F.lit(False))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("actual_samples"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("span"), F.count_if(lit).alias("lit_intervals"), F.count_if(lit & F.col("ac_power_kw").isNull()).alias("lit_intervals_without_power"))
    days = rows.groupBy(*keys, "on_day").agg((F.count("ac_power_kw") == 0).alias("gone")).where("gone").groupBy(*keys).agg(F.count("*").alias("missing_days"), F.min("on_day").alias("first_missing_day"), F.max("on_day").alias("last_missing_day"))
    worst = found.groupBy(*keys).agg(F.count("*").alias("issue_count"), F.max(F.when(F.col("rank") == 1, F.col("fraction"))).alias("worst_issue_share"), F.max(F.when(F.col("rank") == 1, F.col("kind"))).alias("worst_issue"), F.max(F.when(F.col("rank") == 1, F.col("channel"))).alias("worst_issue_channel"))
    out = sums.join(modal_interval_hours(rows, keys), keys, "left").join(days, keys, "left").join(worst, keys, "left")
    expected = F.coalesce((F.floor(F.col("span") / (F.col("interval_h") * 3600)) + 1).cast("long"), F.lit(1).cast("long"))
    complete = F.coalesce(1 - F.try_divide("lit_intervals_without_power", "lit_intervals"), F.lit(1.0))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        *keys, expected.alias("expected_samples"), "actual_samples", _r(F.col("actual_samples") / expected).alias("coverage"), "lit_intervals", "lit_intervals_without_power", _r(complete).alias("lit_interval_completeness"),
        zero("missing_days"), "first_missing_day", "last_missing_day", zero("issue_count"), "worst_issue_share", "worst_issue", "worst_issue_channel",
    )


def balance_summary(strings: DataFrame, keys: list[str], time: str = "day") -> DataFrame:
    """Mean, deviation and count of each string's share, beside the even share."""
    shares = string_shares(strings, keys, time).groupBy(*keys, "string_idx").agg(F.avg("share").alias("mean"), F.stddev_samp("share").alias("deviation"), F.count("*").alias("samples"))
    even = 1 / F.count("*").over(Window.partitionBy(*keys))
    return shares.select(*keys, "string_idx", _r(F.col("mean")).alias("mean_share"), _r(F.col("deviation")).alias("share_deviation"), "samples", _r(even).alias("expected_share"))
