"""The sweep as Structured Streaming: hourly telemetry from raw events under a watermark.

Late events within the watermark still count; each closed hour leaves once, in append mode, and
``foreachBatch`` appends it to the panel that batch measures read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.operators import findings


def hourly(events: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """The streaming twin of ``sources.panels.events_hourly``: the same sums over event-time windows."""
    of = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("value").cast("decimal(18,4)"))).cast("double")
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    rows = timed.groupBy(F.window("ts", "1 hour")).agg(of("view").alias("poa_wm2"), of("purchase").alias("ac_power_kw"), of("signup").alias("dc_power_kw"))
    return rows.select(F.lit(1).alias("system_id"), F.col("window.start").alias("ts"), "poa_wm2", "ac_power_kw", "dc_power_kw")


def start(events: DataFrame, panel_path: str, checkpoint: str, watermark: str = "2 hours"):
    """Append closed hours to ``panel_path``; a batch that is replayed overwrites its own folder."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{panel_path}/epoch={epoch}")

    return hourly(events, watermark).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put).start()


def watch(sweeps: DataFrame, path: str, checkpoint: str):
    """The findings' lifecycle over a stream of sweeps: identity (NULL: the sweep was quiet), sweep.

    Each batch takes up the state that the batch before it left, appends its log rows and leaves its
    own state, both in folders of its own, so a replayed batch overwrites what it wrote.  Sweeps must
    arrive in order; those of one batch are folded together.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        state = spark.read.parquet(f"{path}/state/epoch={epoch - 1}") if epoch else None
        rows = batch.select("identity", F.col("sweep").cast("long").alias("sweep"))
        ticks = rows.select("sweep").distinct()
        findings.lifecycle(rows, ticks, state).write.mode("overwrite").parquet(f"{path}/log/epoch={epoch}")
        findings.state_after(rows, ticks, state).write.mode("overwrite").parquet(f"{path}/state/epoch={epoch}")

    return sweeps.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).start()
