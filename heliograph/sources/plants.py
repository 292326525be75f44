"""Plants as a table: metadata records, module coefficients, and panels of many systems.

A measure takes its plant from columns of the rows (``with_plant``), so systems with different ratings,
coefficients and offsets are measured in one job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.physics import Plant
from heliograph.sources.ingest import ac_rating
from heliograph.sources.panels import exact_avg, exact_sum, read

# The coefficient of a module that no table knows, and the azimuth of a mount that states none.
DEFAULT_GAMMA, DEFAULT_AZIMUTH = -0.004, 180.0
PLANT_COLUMNS = ("capacity_kw", "gamma", "utc_offset_hours")
_GROUP = "map<string,map<string,string>>"
_RECORD = f"struct<System:map<string,string>,Site:map<string,string>,Mount:{_GROUP},Inverters:{_GROUP},Modules:{_GROUP}>"


def metadata(records: DataFrame, json: str = "record") -> DataFrame:
    """system_id and the typed fields of each metadata record; of repeated groups the first counts.

    What is absent or no number becomes the field's default: 0, an empty text, the default azimuth.
    """
    r = F.from_json(F.col(json), _RECORD)
    first = lambda group: F.try_element_at(F.map_values(r[group]), F.lit(1))
    text = lambda group, key, default="": F.coalesce(F.try_element_at(group, F.lit(key)), default if isinstance(default, Column) else F.lit(default))
    number = lambda group, key, default=0.0: F.coalesce(F.try_element_at(group, F.lit(key)).try_cast("double"), F.lit(default))
    system, site, mount, inverter, module = r["System"], r["Site"], first("Mount"), first("Inverters"), first("Modules")
    model = text(inverter, "model")
    return records.select(
        "system_id", text(system, "public_name", F.concat(F.lit("system_"), F.col("system_id").cast("string"))).alias("name"), number(site, "latitude").alias("latitude"), number(site, "longitude").alias("longitude"),
        number(site, "elevation").alias("altitude_m"), F.trim(text(site, "location")).alias("location"), number(system, "power").alias("dc_capacity_kw"), number(mount, "tilt").alias("tilt_deg"),
        number(mount, "azimuth", DEFAULT_AZIMUTH).alias("azimuth_deg"), (~F.lower(text(mount, "tracking", "f")).isin("f", "false", "")).alias("tracking"), text(module, "model").alias("module_model"),
        number(module, "quantity").cast("int").alias("module_quantity"), number(inverter, "modules_per_string").cast("int").alias("modules_per_string"), number(inverter, "num_strings").cast("int").alias("strings"),
        model.alias("inverter_model"), ac_rating(model).alias("ac_capacity_kw_hint"),
    )


def module_gamma(names: DataFrame, modules: DataFrame) -> DataFrame:
    """name, gamma: the coefficient a degree of each module name.

    ``modules``: module, gamma_percent.  An exact name, without regard to case and separators, counts
    first, then a table entry that ends in the name if it is the only one; else gamma is NULL.
    """
    plain = lambda c: F.lower(F.regexp_replace(c, "[- ]", "_"))
    asked = names.select("name").distinct().withColumn("key", plain(F.col("name"))).where("key <> ''")
    known = modules.select(F.lower("module").alias("module"), (F.col("gamma_percent") / 100).alias("gamma"))
    exact = asked.join(known, asked["key"] == known["module"]).groupBy("name").agg(F.first("gamma").alias("exact"))
    # every ending of an entry that follows an underscore, so that endings meet names in an equi-join
    parts = F.split("module", "_")
    endings = known.select("module", "gamma", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.greatest(F.size(parts), F.lit(1))), "_"))).alias("key")).where("key <> ''")
    tail = asked.join(endings, "key").groupBy("name").agg(F.when(F.count_distinct("module") == 1, F.first("gamma")).alias("tail"))
    return names.select("name").distinct().join(exact, "name", "left").join(tail, "name", "left").select("name", F.coalesce("exact", "tail").alias("gamma"))


def with_plant(rows: DataFrame, plants: DataFrame) -> DataFrame:
    """Rows of known systems with their plant's columns."""
    return rows.join(plants.select("system_id", *PLANT_COLUMNS), "system_id")


def measured(measure: Callable, rows: DataFrame, keys: list[str], **options) -> DataFrame:
    """``measure`` over rows that carry their plant's columns, each system by its own plant."""
    plant = Plant(F.col("capacity_kw"), F.col("gamma"), F.col("utc_offset_hours"))
    own = [*keys, *PLANT_COLUMNS]
    return measure(rows, plant=plant, keys=own, **options).drop(*PLANT_COLUMNS)


# --- the stored tables as plants ---

SYSTEMS = 25


def stored_plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as plants, their regions as module types; two regions have no coefficient and take the default."""
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("system_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("r_regionkey"))
    regions = read(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("module"))
    table = read(spark, sf_dir, "region").where("r_regionkey < 3").select(F.concat(F.lit("Maker_"), "r_name").alias("module"), (-0.3 - F.col("r_regionkey") * 0.02).alias("gamma_percent"))
    named = nations.join(regions, "r_regionkey")
    gamma = module_gamma(named.select(F.col("module").alias("name")), table).withColumnRenamed("name", "module")
    return named.join(gamma, "module").select(
        "system_id", "name", "module", (F.col("system_id") * 5 + 60.0).alias("capacity_kw"), F.coalesce("gamma", F.lit(DEFAULT_GAMMA)).alias("gamma"), (F.col("r_regionkey") - 2).cast("double").alias("utc_offset_hours"),
    )


def events_by_system(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """The telemetry panel of many systems: each user group's events are one plant's."""
    of = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    rows = read(spark, sf_dir, "events").groupBy((F.col("user_id") % SYSTEMS).cast("int").alias("system_id"), F.date_trunc(unit, "ts").cast("timestamp").alias("ts"))
    return rows.agg(
        exact_sum(of("view")).alias("poa_wm2"), exact_sum(of("purchase")).alias("ac_power_kw"), exact_sum(of("signup")).alias("dc_power_kw"),
        (exact_avg(of("error")) / 10).alias("temp_module_c"), F.lit(20.0).alias("temp_ambient_c"), (exact_avg(of("click")) / 100).alias("wind_speed_ms"),
    )
