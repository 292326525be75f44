"""From raw logger files to a canonical panel: channel choice, dedup, masking, resampling, UTC shift."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Quantity:
    name: str
    include: tuple[str, ...]
    exclude: tuple[str, ...]
    low: float
    high: float
    required: bool = False

    def fits(self, column: str) -> bool:
        found = lambda patterns: any(re.search(p, column, re.IGNORECASE) for p in patterns)
        return found(self.include) and not found(self.exclude)


# Which raw names may stand for a quantity, and the band its largest value must lie in.
QUANTITIES = (
    Quantity("poa_wm2", ("irradiance_poa", "^poa_irradiance", "poa.*irrad"), ("_ghi_", "diffuse", "albedo"), 300, 1500, True),
    Quantity("ghi_wm2", ("irradiance_ghi", "^ghi", "global_horizontal"), ("_poa_", "diffuse"), 300, 1400),
    Quantity("temp_ambient_c", ("temperature_ambient", "^ambient_temp", "air_temp"), ("module", "inverter", "cell"), 5, 60, True),
    Quantity("temp_module_c", ("temperature_module", "^module_temp", "back_of_module"), ("ambient", "inverter"), 20, 95),
    Quantity("wind_speed_ms", ("wind_speed", "^wind_spd"), ("direction", "_other_"), 1, 45),
    Quantity("ac_power_kw", ("^ac_power_inv", "^ac_power__", "^metered_ac_power", "^ac_power$"), ("_other_", "meter", "voltage", "current"), 1, 100_000, True),
    Quantity("dc_power_kw", ("^dc_power_inv", "^dc_power__", "^dc_power$"), ("_other_", "voltage", "current", "_1__", "_2__"), 1, 100_000),
)
STRING_CURRENT = r"(?i)shuntcurrent_a_avg|string\d*current|inv\d+_dc_current"


def resolve(wide: DataFrame, quantities: tuple[Quantity, ...] = QUANTITIES) -> DataFrame:
    """quantity, column, non_null, highest, reason, chosen: every candidate with why it was turned down.

    One aggregation looks at all candidates; names match on the driver, where the schema is.  Among
    those without a reason the fullest column is chosen, the first by name on ties.
    """
    pairs = [(q, c) for q in quantities for c in sorted(wide.columns) if q.fits(c)]
    schema = "quantity string, column string, non_null long, highest double, reason string, chosen boolean"
    if not pairs:
        return wide.sparkSession.createDataFrame([], schema)
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    stats = [F.struct(F.lit(q.name).alias("quantity"), F.lit(c).alias("column"), F.count(number(c)).alias("non_null"), F.max(number(c)).alias("highest"), F.lit(float(q.low)).alias("low"), F.lit(float(q.high)).alias("high")) for q, c in pairs]
    found = wide.agg(F.array(*stats).alias("s")).select(F.inline("s"))
    reason = F.when(F.col("non_null") == 0, "no values").when(F.col("highest") < F.col("low"), "wrong units: maximum below the band").when(F.col("highest") > F.col("high"), "wrong units: maximum above the band")
    judged = found.withColumn("reason", reason)
    rank = F.row_number().over(Window.partitionBy("quantity").orderBy(F.col("reason").isNotNull(), F.desc("non_null"), "column"))
    return judged.withColumn("chosen", (rank == 1) & F.col("reason").isNull()).select("quantity", "column", "non_null", "highest", "reason", "chosen")


def string_channels(columns: list[str]) -> list[str]:
    """Per-string current channels in the order of their trailing numbers."""
    return sorted((c for c in columns if re.search(STRING_CURRENT, c)), key=lambda c: (int((re.findall(r"\d+", c) or ["0"])[-1]), c))


def canonical(wide: DataFrame, resolved: DataFrame, keep: tuple[str, ...] = ("system_id", "ts")) -> DataFrame:
    """The chosen columns under their canonical names; channels nobody reports stay as NULL columns."""
    chosen = {r["quantity"]: r["column"] for r in resolved.where("chosen").collect()}  # one row a quantity
    missing = [q.name for q in QUANTITIES if q.required and q.name not in chosen]
    if missing:
        raise ValueError(f"no plausible channel for {', '.join(missing)}")
    strings = string_channels(wide.columns)
    value = lambda q: F.expr(f"try_cast(`{chosen[q]}` AS double)") if q in chosen else F.lit(None).cast("double")
    return wide.select(*keep, *(value(q.name).alias(q.name) for q in QUANTITIES), *(F.expr(f"try_cast(`{c}` AS double)").alias(f"string_current_a_{k}") for k, c in enumerate(strings, 1)))


def strings_long(panel: DataFrame, keys: tuple[str, ...] = ("system_id", "ts")) -> DataFrame:
    columns = [c for c in panel.columns if c.startswith("string_current_a_")]
    return panel.unpivot(list(keys), columns, "string_idx", "current_a").withColumn("string_idx", F.substring_index("string_idx", "_", -1).cast("int"))


def first_per_instant(rows: DataFrame, order: str) -> DataFrame:
    """Of rows that share system and instant the one that was ingested first."""
    rank = F.row_number().over(Window.partitionBy("system_id", "ts").orderBy(order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def masked(rows: DataFrame, capacity_kw: float) -> DataFrame:
    """Implausible values become NULL, small negatives of irradiance 0; a NULL stays NULL."""
    light = lambda c: F.when(F.col(c) >= -20, F.greatest(F.col(c), F.lit(0.0)))
    power = lambda c: F.when(F.col(c) >= -0.05 * max(capacity_kw, 1.0), F.col(c))
    rules = {"poa_wm2": light, "ghi_wm2": light, "ac_power_kw": power, "dc_power_kw": power}
    return rows.withColumns({c: f(c) for c, f in rules.items() if c in rows.columns})


def resampled(rows: DataFrame, channels: list[str], minutes: int = 15) -> DataFrame:
    """Means of whole intervals, with a row of NULLs for every empty interval in between."""
    step = minutes * 60
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / step) * step)
    bins = rows.groupBy("system_id", start.alias("ts")).agg(*(F.avg(c).alias(c) for c in channels))
    span = bins.groupBy("system_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    spine = span.select("system_id", F.explode(F.sequence("lo", "hi", F.expr(f"interval {minutes} minutes"))).alias("ts"))
    return spine.join(bins, ["system_id", "ts"], "left")


def to_utc(rows: DataFrame, offset_hours: float) -> DataFrame:
    return rows.withColumn("ts", F.timestamp_seconds(F.unix_timestamp("ts") - round(offset_hours * 3600)))


def ac_rating(model: Column) -> Column:
    """The rating in kW that an inverter's name carries, such as "PVP 260kW"; NULL where it has none."""
    found = F.regexp_extract(F.regexp_replace(F.upper(model), "-", " "), r"([0-9]+(?:\.[0-9]+)?) *KW", 1)
    return F.nullif(found, F.lit("")).cast("double")


def day_paths(spark: SparkSession, system_id: int, first: str, last: str) -> DataFrame:
    """day and its partition folder, for every calendar day, both ends included."""
    days = spark.sql("SELECT explode(sequence(to_date(:first), to_date(:last))) AS day", {"first": first, "last": last})
    return days.select("day", F.format_string("system_id=%d/year=%d/month=%d/day=%d", F.lit(system_id), F.year("day"), F.month("day"), F.day("day")).alias("folder"))


def read_csv(spark: SparkSession, paths: list[str], time_column: str = "measured_on") -> DataFrame:
    """Raw files with their time column as ``ts``; rows without a readable time go."""
    raw = spark.read.option("header", True).csv(paths)
    return raw.withColumn("ts", F.try_to_timestamp(F.col(time_column))).where("ts is not null").drop(time_column)
