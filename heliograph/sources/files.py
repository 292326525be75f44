"""Files as tables: listings and hashes, the day-by-day ingest with its manifest, JSON lines, text corpora, descriptions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.sources import ingest


class IncompleteRecord(RuntimeError):
    """Some days could not be read, so a record would be short without saying so."""


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modified, sha256 of every file below ``path``, from any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def prefixes(files: DataFrame, below: str) -> DataFrame:
    """prefix, files: the folders directly under ``below``."""
    rest = F.substring_index(F.col("path"), below.rstrip("/") + "/", -1)
    return files.where(F.contains("path", F.lit(below)) & F.contains(rest, F.lit("/"))).groupBy(F.substring_index(rest, "/", 1).alias("prefix")).agg(F.count("*").alias("files"))


def day_status(wanted: DataFrame, present: DataFrame, failed: DataFrame) -> DataFrame:
    """day, folder, status: ``ok``, ``gap`` where the archive has no such day, ``failed`` where nothing was learned of it.

    ``wanted``: day, folder; ``present``: folder; ``failed``: folder, those whose reading raised after all attempts.
    """
    status = F.when(F.col("__failed"), "failed").when(F.col("__here"), "ok").otherwise("gap")
    mark = lambda f, name: f.select("folder").distinct().withColumn(name, F.lit(True))
    return wanted.join(mark(present, "__here"), "folder", "left").join(mark(failed, "__failed"), "folder", "left").select("day", "folder", status.alias("status"))


def present_folders(spark: SparkSession, root: str) -> DataFrame:
    """The day folders below ``root`` that hold a CSV file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root).select("path")
    return files.select(F.regexp_extract("path", r"(system_id=[^/]+/year=[^/]+/month=[^/]+/day=[^/]+)/[^/]*$", 1).alias("folder")).where("folder <> ''").distinct()


def ingest_days(spark: SparkSession, root: str, system_id: int, first: str, last: str, target: str, capacity_kw: float, offset_hours: float = 0.0, failed: DataFrame | None = None, allow_partial: bool = False, stride_parts: int = 20) -> dict:
    """Read a system's days, choose its channels on a stride sample of the days, normalise, and write Parquet by system with a manifest.

    Days that failed stop the job before anything is written, unless ``allow_partial``; gaps are data.
    """
    wanted = ingest.day_paths(spark, system_id, first, last)
    failed = spark.createDataFrame([], "folder string") if failed is None else failed
    status = day_status(wanted, present_folders(spark, root), failed).orderBy("day").collect()  # one row a day
    lost, found = [str(r["day"]) for r in status if r["status"] == "failed"], [r["folder"] for r in status if r["status"] == "ok"]
    if lost and not allow_partial:
        raise IncompleteRecord(f"{len(lost)} of {len(status)} days could not be read: {', '.join(lost[:6])}")
    if not found:
        raise LookupError(f"system {system_id} has no day between {first} and {last}")
    raw = ingest.read_csv(spark, [f"{root}/{f}" for f in found]).withColumn("system_id", F.lit(system_id))
    sample = ingest.read_csv(spark, [f"{root}/{f}" for f in found[:: max(1, len(found) // stride_parts)]])
    resolved = ingest.resolve(sample)
    panel = ingest.canonical(raw, resolved)
    channels = [c for c in panel.columns if c not in ("system_id", "ts")]
    once = panel.groupBy("system_id", "ts").agg(*(F.first(c, ignorenulls=True).alias(c) for c in channels))
    rows = ingest.to_utc(ingest.resampled(ingest.masked(once, capacity_kw), channels), offset_hours)
    rows.write.mode("overwrite").partitionBy("system_id").parquet(f"{target}/panel")
    chosen = {r["quantity"]: r["column"] for r in resolved.where("chosen").collect()}
    manifest = {"system_id": system_id, "first": first, "last": last, "days": len(found), "gaps": [str(r["day"]) for r in status if r["status"] == "gap"], "failed": lost, "utc_offset_hours": offset_hours, "channels": chosen, "capacity_kw": capacity_kw}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/manifest")
    return manifest


def append_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line, added to what is there."""
    rows.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, skip_bad: bool = False) -> DataFrame:
    """The records of JSON lines.  A broken line is skipped or, by default, fails the read and names its file and text."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    parsed = lines.withColumn("record", F.from_json("value", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    bad = F.col("record").isNull() | F.col("record.__bad").isNotNull()
    if skip_bad:
        return parsed.where(~bad).select("record.*").drop("__bad")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("broken line in "), "file", F.lit(": "), F.substring("value", 1, 80))).cast("string"))
    return parsed.where(checked.isNull()).select("record.*").drop("__bad")


def text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """name, text, sha256, position: the .txt files, then the .md files, by name; a README is no part of it."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    kind = F.when(F.endswith("name", F.lit(".txt")), 0).when(F.endswith("name", F.lit(".md")), 1)
    kept = files.withColumn("kind", kind).where("kind is not null and upper(name) <> 'README.MD'")
    return kept.select("name", "text", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.struct("kind", "name").alias("position"))


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, mean, min, max of each numeric column, rounded to two digits, in one pass."""
    stats = [F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.round(F.avg(c), 2).alias("mean"), F.round(F.min(c).cast("double"), 2).alias("min"), F.round(F.max(c).cast("double"), 2).alias("max")) for c in columns]
    return rows.agg(F.array(*stats).alias("s")).select(F.inline("s"))
