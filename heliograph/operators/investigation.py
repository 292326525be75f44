"""Data operators of an investigation: the ledger of its measurements, ruled-out causes, planned and unrun tools, arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ledger(results: DataFrame, key: str) -> DataFrame:
    """key, name, value: all measurements of an investigation in one table; a name measured again keeps its last value.

    ``results``: key, step_index, tool, values (map of name to value).
    """
    rows = results.select(key, "step_index", "tool", F.explode("values").alias("name", "value"))
    return rows.groupBy(key, "name").agg(F.max_by(F.struct("tool", "value"), "step_index").alias("r")).select(key, "name", "r.tool", "r.value")


def excluded(hypotheses: DataFrame, exclusions: DataFrame, key: str) -> DataFrame:
    """The hypotheses with the status of those that a measurement ruled out, by id or by cause, set to excluded.

    ``hypotheses``: key, hypothesis_id, cause, status; ``exclusions``: key, excluded.
    """
    named = hypotheses.select(key, "hypothesis_id", F.explode(F.array("hypothesis_id", "cause")).alias("excluded"))
    out = named.join(exclusions.select(key, "excluded").distinct(), [key, "excluded"], "left_semi").select(key, "hypothesis_id", F.lit(True).alias("__out")).distinct()
    joined = hypotheses.join(out, [key, "hypothesis_id"], "left")
    return joined.withColumn("status", F.when(F.col("__out"), "excluded").otherwise(F.col("status"))).drop("__out")


def was_planned(calls: DataFrame, plans: DataFrame, key: str) -> DataFrame:
    """key, step_index, tool, was_planned: a call was planned if its tool is in the plan and it is the first of the tool.

    ``calls``: key, step_index, tool; ``plans``: key, tool.
    """
    first = F.row_number().over(Window.partitionBy(key, "tool").orderBy("step_index")) == 1
    marked = calls.withColumn("__first", first).join(plans.select(key, "tool").distinct().withColumn("__planned", F.lit(True)), [key, "tool"], "left")
    return marked.select(key, "step_index", "tool", (F.col("__first") & F.coalesce("__planned", F.lit(False))).alias("was_planned"))


def narrowed(calls: DataFrame, accepted: DataFrame) -> DataFrame:
    """The calls with ``args`` (a map) cut down to what their tool accepts; an unknown tool keeps all.

    ``accepted``: tool, fields (an array), one row a tool.
    """
    kept = F.when(F.col("fields").isNull(), F.col("args")).otherwise(F.map_filter("args", lambda k, _: F.array_contains("fields", k)))
    return calls.join(F.broadcast(accepted), "tool", "left").withColumn("args", kept).drop("fields")  # as many rows as there are tools


def unrun(answers: DataFrame, tools: list[str], calls: DataFrame, key: str) -> DataFrame:
    """key, tool: the tools that an answer's text names and its investigation never ran."""
    named = F.filter(F.array(*(F.when(F.contains("text", F.lit(t)), F.lit(t)) for t in tools)), lambda t: t.isNotNull())
    said = answers.where("text is not null").select(key, F.explode(named).alias("tool")).distinct()
    return said.join(calls.select(key, "tool").distinct(), [key, "tool"], "left_anti")
