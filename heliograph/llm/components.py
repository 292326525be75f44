"""Connected components by alternating large-star and small-star rounds, with checkpoints.

Edges never leave the executors; a round is two grouped minima joined back, and every round's
edges are written to the shared checkpoint folder, so lost executors cost one round at most.

A hub's edges don't meet in one task.  Minima are combined before the shuffle, and vertices of more than
``max(HUB_EDGES, 2 * edges / MOST_HUBS)`` edges get theirs by a broadcast: their degrees add up to at most
twice the edges, so there are never more than MOST_HUBS of them, whatever the input.  All others join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Bound on the rows of the broadcast table of hubs, and the fewest edges of a hub.
MOST_HUBS, HUB_EDGES = 10_000, 200


def _tied(near: DataFrame, least: DataFrame, count: int) -> DataFrame:
    """Every edge (u, v) with u's minimum m; hubs' edges are spread by ``salt`` and meet no row of the join."""
    many = max(HUB_EDGES, 2 * count // MOST_HUBS)
    hubs = F.broadcast(least.where(F.col("n") > many).select("u", F.col("m").alias("hub_m")))
    spread = F.when(F.col("hub_m").isNotNull(), F.pmod(F.xxhash64("v"), F.lit(1024)) + 1).otherwise(F.lit(0)).cast("long")
    # a column and not a literal, which the optimizer would take out of the join's keys
    others = least.select("u", "m", F.when(F.col("n") > many, -1).otherwise(0).cast("long").alias("salt"))
    marked = near.join(hubs, "u", "left").withColumn("salt", spread)
    return marked.join(others, ["u", "salt"], "left").select("u", "v", F.coalesce("hub_m", "m").alias("m"))


def _round(edges: DataFrame, large: bool, count: int) -> DataFrame:
    """Rewire every vertex's larger (or smaller) neighbours to its smallest neighbour.  ``count`` edges or fewer."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = edges.unionByName(back) if large else edges
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    tied = _tied(near, least, count)
    if large:
        return tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    hung = tied.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    # the filter keeps every row, and n with it: all uses of the minima share one exchange
    return hung.unionByName(least.where("n > 0").select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable); nodes without edges are absent."""
    loose = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = checkpointed(loose)
    mark = _mark(now)
    while mark[0]:
        now = checkpointed(_round(_round(now, True, mark[0]), False, mark[0]))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
