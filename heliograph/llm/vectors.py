"""Embedding near-duplicates with a forest of random-projection trees.

Every tree splits by one random direction a level, at the median of each node; vectors within
``spill`` of a threshold go to both sides.  A node where that takes ``HALT`` of the rows or more is
not split: there links straddle a threshold too often, and splitting saves few comparisons, so
recall would fall with every level.  Trees grow in rounds of at most ``STEP`` levels, until a leaf holds
about ``LEAF`` vectors, however many there are.  The first round's thresholds come from a sample of
``JUDGED`` vectors a node and are broadcast (``TREES * 2**STEP`` numbers at most); in a later round each
node of the round before is split by its own sample, its rows in chunks of ``CHUNK``.  Every vector is
routed, and all vectors that share a leaf are compared by exact cosine in double precision.  Leaves of
more than ``PIECE`` vectors are dealt into pieces, and every pair of pieces meets, so no task holds more
than two pieces and nothing is capped.

A pair that shares several leaves counts in the first of them only (each vector carries the list
of its earlier leaves), so links are counted without listing pairs; of the links only a spanning forest
leaves a leaf, which ``components`` then unites.

Equal vectors are one class with a weight, named by a 128-bit hash; classes, not copies, are routed.
Vectors stored in single precision travel so, which loses nothing.

Defined results.  A vector that is null, empty, zero or holds null or non-finite components links
with nothing and is its own component; vectors of different lengths don't link.  Rows that repeat
a vec_id are counted as vectors of their own.  A row without an id is kept unless its component holds
one with an id; a component without any id has a null name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, checkpointed, ship
from .components import components

THRESHOLD = 0.9
TREES, LEAF, SPILL, STEP = 8, 512, 0.02, 10
PIECE, CHUNK = 2048, 50_000
HALT, JUDGED = 0.3, 64


def usable(v: object) -> np.ndarray | None:
    """The vector in double precision, or None if it can't link."""
    if v is None or len(v) == 0:
        return None
    x = np.array([np.nan if c is None else c for c in v], np.float64) if not isinstance(v, np.ndarray) or v.dtype == object else v.astype(np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    return x + 0.0


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by the largest component first, so that nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def directions(tree: int, first: int, depth: int, size: int) -> np.ndarray:
    """A direction for each of ``depth`` levels from level ``first`` on."""
    r = np.array([np.random.default_rng([7, tree, size, first + level]).standard_normal(size) for level in range(depth)]).reshape(depth, size)
    return (r / np.linalg.norm(r, axis=1, keepdims=True)).T


def spill(size: int) -> float:
    """``SPILL`` at 64 dimensions; projections of a given distance shrink with the root of the size."""
    return SPILL * math.sqrt(64 / size)


def fit_tree(x: np.ndarray, tree: int, depth: int, first: int = 0) -> list[np.ndarray]:
    """Thresholds of each level's nodes, as medians of the sample; infinite where a node isn't split.

    A node with fewer than ``JUDGED`` rows of the sample is judged by its nearest ancestor with as many.
    """
    levels, node, p = [], np.zeros(len(x), np.int64), x @ directions(tree, first, depth, x.shape[1])
    judges, halted = [np.arange(len(x))], np.zeros(1, bool)
    for level in range(depth):
        cuts = np.zeros(1 << level)
        order = np.lexsort((p[:, level], node))
        ends = np.searchsorted(node[order], np.arange(1 << level), side="right")
        start = 0
        for k, end in enumerate(ends):
            if end > start:
                cuts[k] = p[order[(start + end) // 2], level]
            if end - start >= JUDGED:
                judges[k] = order[start:end]
            seen = p[judges[k], level]
            halted[k] |= (np.abs(seen - np.median(seen)) <= spill(x.shape[1])).mean() >= HALT
            start = end
        cuts[halted] = np.inf
        levels.append(cuts)
        judges, halted = [j for j in judges for _ in range(2)], np.repeat(halted, 2)
        node = node * 2 + (p[:, level] > cuts[node])
    return levels


def route(x: np.ndarray, tree: int, levels: list[np.ndarray], first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and leaf numbers, one for each leaf that a row reaches."""
    p = x @ directions(tree, first, len(levels), x.shape[1])
    row, node, wide = np.arange(len(x)), np.zeros(len(x), np.int64), spill(x.shape[1])
    for level, cuts in enumerate(levels):
        off = p[row, level] - cuts[node]
        left, right = off <= wide, off > -wide
        row, node = np.concatenate((row[left], row[right])), np.concatenate((node[left] * 2, node[right] * 2 + 1))
    return row, node


def compare(x: np.ndarray, side: np.ndarray, own: np.ndarray, leaf: int, weight: np.ndarray, cross: bool) -> tuple[np.ndarray, Forest]:
    """Weighted link counts of the pairs whose first common leaf this is, and the forest of all links.

    The counts are taken within the components of the links, where a product of leaf incidences
    tells which pairs have met in a leaf before.
    """
    n = len(x)
    counts, forest = np.zeros(n, np.int64), Forest(n)
    for a in range(0, n, 512):
        i, j = np.nonzero(x[a : a + 512] @ x[a:].T >= THRESHOLD)
        i, j = i + a, j + a
        keep = (i < j) & (side[i] != side[j]) if cross else i < j
        i, j = i[keep], j[keep]
        for u, lo, hi in zip(*(k.tolist() for k in _groups(i)), strict=True):
            if (forest.up[j[lo:hi]] != forest.up[u]).any():
                forest.join(u, j[lo:hi])
    roots = forest.roots()
    order = np.argsort(roots, kind="stable")
    for _, lo, hi in zip(*_groups(roots[order]), strict=True):
        if hi - lo < 2:
            continue
        m = order[lo:hi]
        earlier, at = np.unique(np.where((own[m] < leaf) & (own[m] >= 0), own[m], -1), return_inverse=True)
        met = np.zeros((len(m), len(earlier)), np.float32)
        np.put_along_axis(met, at.reshape(len(m), -1), 1, axis=1)
        met[:, earlier == -1] = 0
        for a in range(0, len(m), 512):
            part = m[a : a + 512]
            linked = (x[part] @ x[m].T >= THRESHOLD) & (met[a : a + 512] @ met.T == 0) & (part[:, None] != m[None, :])
            if cross:
                linked &= side[part][:, None] != side[m][None, :]
            counts[part] = linked @ weight[m]
    return counts, forest


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, start and end of each run of equal values."""
    if not len(values):
        return values, values, values
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[first], first, np.append(first[1:], len(values))


NODE_BITS = 40  # of a leaf's number; then come 4 for the tree, then the length of the vectors


def _levels(total: int) -> list[int]:
    """The levels of each round."""
    depth = min(NODE_BITS, max(0, math.ceil(math.log2(max(total, 1) / LEAF))))
    return [STEP] * (depth // STEP) + [depth % STEP] * (depth % STEP > 0)


def _split_further(vectors: DataFrame, routed: DataFrame, first: int, depth: int, kind: np.dtype) -> DataFrame:
    """key, leaves: one more round, with thresholds from each node's own sample."""
    rows = checkpointed(routed.select("key", F.explode("leaves").alias("leaf")).join(vectors.select("key", "x"), "key"))
    sizes = rows.groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.count("*").alias("members"))
    wanted = F.least(F.lit(1.0), F.lit(1.5 * JUDGED * (1 << depth)) / F.col("members"))
    sample = rows.join(sizes, "leaf").where(F.pmod(F.xxhash64("key", "leaf"), F.lit(1 << 30)) < wanted * (1 << 30)).select("leaf", "x", "chunks")

    def fitted(batch: pd.DataFrame) -> pd.DataFrame:
        leaf = int(batch["leaf"].iat[0])
        x = unit(np.frombuffer(b"".join(batch["x"]), kind).reshape(len(batch), -1).astype(np.float64))
        levels = fit_tree(x, leaf >> NODE_BITS & 15, depth, first)
        return pd.DataFrame({"leaf": [leaf], "chunks": batch["chunks"].iat[0], "cuts": [np.concatenate(levels).tobytes()]})

    cuts = sample.groupBy("leaf").applyInPandas(fitted, "leaf long, chunks int, cuts binary")
    cuts = cuts.select("leaf", "cuts", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    dealt = rows.join(sizes, "leaf").select("leaf", "key", "x", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int").alias("chunk"))

    def sent(rows: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"key": [], "leaf": []}).astype({"leaf": "int64"})
        leaf = int(rows["leaf"].iat[0])
        x = unit(np.frombuffer(b"".join(rows["x"]), kind).reshape(len(rows), -1).astype(np.float64))
        flat = np.frombuffer(cuts["cuts"].iat[0]) if len(cuts) else np.full((1 << depth) - 1, np.inf)
        row, node = route(x, leaf >> NODE_BITS & 15, [flat[(1 << k) - 1 : (2 << k) - 1] for k in range(depth)], first)
        low = leaf & ((1 << NODE_BITS) - 1)
        return pd.DataFrame({"key": rows["key"].to_numpy()[row], "leaf": leaf - low + (low << depth) + node})

    moved = dealt.groupBy("leaf", "chunk").cogroup(cuts.groupBy("leaf", "chunk")).applyInPandas(sent, "key binary, leaf long")
    return checkpointed(moved.groupBy("key").agg(F.array_sort(F.collect_list("leaf")).alias("leaves")))  # a vector's own leaves, a few a tree


def forest(vectors: DataFrame, total: int, kind: np.dtype) -> DataFrame:
    """key, leaves (the numbers of all leaves that a vector reaches), and after one round also weight and x."""
    rounds = _levels(total)
    depth = rounds[0] if rounds else 0
    wanted = 2 * JUDGED << depth
    share = min(1.0, 0.9 * wanted / max(total, 1))
    sample = vectors.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("x").limit(wanted).collect()
    by_size: dict[int, list[np.ndarray]] = {}
    for r in sample:
        by_size.setdefault(len(r["x"]) // kind.itemsize, []).append(np.frombuffer(r["x"], kind).astype(np.float64))
    fitted = {size: [fit_tree(unit(np.array(xs)), t, depth) for t in range(TREES)] for size, xs in by_size.items()}
    trees = vectors.sparkSession.sparkContext.broadcast(fitted)

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby(batch["x"].map(len) // kind.itemsize, sort=False):
                x = unit(np.frombuffer(b"".join(part["x"]), kind).reshape(-1, size).astype(np.float64))
                at, leaf = [], []
                # lengths that the sample lacks aren't split yet
                for t, levels in enumerate(trees.value.get(size) or [[np.full(1 << k, np.inf) for k in range(depth)]]):
                    row, node = route(x, t, levels)
                    at.append(row)
                    leaf.append(node + (t << NODE_BITS) + (size << NODE_BITS + 4))
                row, leaf = np.concatenate(at), np.concatenate(leaf)
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                yield part.assign(leaves=np.split(leaf, np.flatnonzero(np.diff(row)) + 1))

    routed = vectors.select("key", "weight", "x").mapInPandas(leaves, "key binary, weight long, x binary, leaves array<long>")
    done = depth
    for more in rounds[1:]:
        routed = _split_further(vectors, routed, done, more, kind)
        done += more
    return routed


def near_duplicates(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    ship(rows.sparkSession)
    id_type = dict(rows.dtypes)[id_column]
    kind = np.dtype(np.float32 if dict(rows.dtypes)[vector] == "array<float>" else np.float64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [usable(v) for v in batch.column(1).to_pylist()]
            raw = [None if x is None else x.astype(kind).tobytes() for x in got]
            keys = [None if b is None else hashlib.blake2b(b, digest_size=16).digest() for b in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["id", "key", "x"])

    every = checkpointed(rows.select(F.col(id_column).alias("id"), F.col(vector).alias("v")).mapInArrow(keyed, f"id {id_type}, key binary, x binary"))
    classes = every.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("x").alias("x"))
    classes = checkpointed(classes)
    total = classes.count()
    routed = forest(classes, total, kind)
    sizes = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    one_round = len(_levels(total)) < 2  # then the forest has a bounded number of leaves
    found = routed if one_round else classes.select("key", "weight", "x").join(routed, "key")
    dealt = found.select("key", "weight", "x", "leaves", F.explode("leaves").alias("leaf")).join(F.broadcast(sizes) if one_round else sizes, "leaf")
    here, other = F.pmod(F.xxhash64("key"), "pieces").cast("int"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    earlier = F.filter("leaves", lambda other_leaf: other_leaf < F.col("leaf"))
    dealt = dealt.select("leaf", "key", "weight", "x", earlier.alias("own"), here.alias("side"), other.alias("other"))
    dealt = dealt.select("leaf", "key", "weight", "x", "own", "side", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"))

    def compared(batch: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.frombuffer(b"".join(batch["x"]), kind).reshape(len(batch), -1).astype(np.float64))
        own = np.full((len(batch), max(1, max(map(len, batch["own"])))), -1, np.int64)
        for i, entries in enumerate(batch["own"]):
            own[i, : len(entries)] = entries
        p, q = batch["p"].iat[0], batch["q"].iat[0]
        counts, united = compare(x, batch["side"].to_numpy(), own, int(batch["leaf"].iat[0]), batch["weight"].to_numpy(), p != q)
        keys, roots = batch["key"].to_numpy(), united.roots()
        hit = (counts > 0) | (roots != np.arange(len(keys)))
        return pd.DataFrame({"key": keys[hit], "links": counts[hit], "root": keys[roots[hit]]})

    partial = checkpointed(dealt.groupBy("leaf", "p", "q").applyInPandas(compared, "key binary, links long, root binary"))
    united = components(partial.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = partial.groupBy("key").agg(F.sum("links").alias("links"))
    named = classes.select("key", "id", "weight").join(links, "key", "left").join(united.withColumnRenamed("node", "key"), "key", "left")
    named = named.select("key", "id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "key").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(least, "component").select("key", "n_links", "component_id")
    out = every.select("id", "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def oracle() -> str:
    return """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
r(node, least) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.least FROM r JOIN l ON l.a = r.node WHERE r.least < l.b),
c AS (SELECT node, min(least) AS component FROM r GROUP BY node)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links, c.component AS component_id, c.component = e.vec_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id"""
