"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

*Sketch.*  An element falls, in round i, into a hashed one of ``WIDTH`` bins with a value that any
later round can't beat; after ``WIDTH`` rounds, round WIDTH+j puts every element into bin j.  So each
coordinate fills after at most 2*WIDTH rounds, most sets fill them in one, and the share of equal
coordinates concentrates around the Jaccard similarity.

*Banding.*  ``BANDS`` bands of ``ROWS`` coordinates; documents meeting in a band are candidates.  At a
similarity of 0.85 a pair meets nowhere with probability (1 - 0.85^4)^25, below 1e-8; at 0.8, 2e-6.

*From candidates to links.*  Documents of one shingle set are one class, named by the hash of the
set and seen through its smallest id.  In a band bucket classes whose sketches might reach the threshold are chained into clusters
(a spanning forest, never all pairs); the full shingle sets of a cluster then meet, split into blocks
of ``BLOCK`` members so that no task holds more than two blocks, and are compared until each
block pair has nothing left that isn't already connected.  Only verified links count.

Defined results.  A null, empty or blank text has the empty set: n_shingles 0, linked with nothing.
Rows that repeat id and text are one document; different texts under one id are judged each on its
own set.  Ties go to the smallest id, null ids last, then to the smaller md5 of the text.  A row without
an id is kept unless its group holds one with an id; a group without any id has a null component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, checkpointed, fresh, mix, ship
from .components import components

WIDTH, BANDS, ROWS = 100, 25, 4
#: Members of a cluster that one side of a verification task holds.
BLOCK = 2000
#: A bucket's sketches are chained in pieces of this size, each against the ones before by leaders.
PIECE = 4000
#: Links need 100 * common >= percent * union: by contract 85 in the query, 80 where a corpus is deduplicated.
PERCENT, CORPUS_PERCENT = 85, 80


class WordHashes(dict):
    """word -> 64-bit hash, computed once; starts anew when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes, words: int = 5) -> np.ndarray:
    """The distinct hashed shingles, sorted."""
    ws = text.encode("utf-8", "replace").lower().split() if text else []
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    n = min(words, len(h))
    if not n:
        return h
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out + h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def sketch(s: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """``width`` coordinates of 32 bits for a set that isn't empty."""
    out, free = np.zeros(width, np.uint32), np.ones(width, bool)
    for i in range(2 * width):
        h = mix(s + np.uint64((i + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        if i < width:
            bins = ((h >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.intp)
            best = np.full(width, 0xFFFFFFFF, np.uint32)
            np.minimum.at(best, bins, low)
            filled = np.zeros(width, bool)
            filled[bins] = True
            take = filled & free
            out[take] = best[take]
            free &= ~filled
        elif free[i - width]:
            out[i - width] = low.min()
            free[i - width] = False
        if not free.any():
            break
    return out


def _md5() -> F.Column:
    """16 bytes that tell the texts of one id apart; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _first() -> F.Column:
    """The representative of rows: smallest id, null ids last, then the smaller md5."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "md5"))


def _same(a: DataFrame, b: DataFrame) -> F.Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["md5"] == b["md5"])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, md5 of the text, n_shingles, class (128 bits of the set), sketch (low 16 bits of each coordinate), bands."""
    ship(docs.sparkSession)
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for doc_id, md5, text in zip(batch["doc_id"], batch["md5"], batch["text"], strict=True):
                s = shingles(text, hashes)
                if not len(s):
                    rows.append((doc_id, md5, 0, None, None, None))
                    continue
                full = sketch(s)
                bands = full[: BANDS * ROWS].reshape(BANDS, ROWS)
                keys = [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(bands)]
                rows.append((doc_id, md5, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), full.astype(np.uint16).tobytes(), keys))
            yield pd.DataFrame(rows, columns=["doc_id", "md5", "n_shingles", "class", "sketch", "bands"])

    return docs.select("doc_id", _md5().alias("md5"), "text").mapInPandas(run, f"doc_id {id_type}, md5 binary, n_shingles long, class binary, sketch binary, bands array<long>")


def chain(ids: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, percent: int = PERCENT) -> list[tuple]:
    """Edges of a spanning forest of the pairs whose sketches agree in ``percent`` - 25 of 100 coordinates.

    That lies six standard deviations below the threshold, so no link is lost here.
    """
    least = percent / 100 - 0.25
    order = np.argsort(ids, kind="stable")
    ids, sizes, sketches = ids[order], sizes[order], sketches[order]
    forest = Forest(len(ids))
    for i in range(len(ids)):
        rest = np.flatnonzero(forest.roots() != forest.up[i])
        if not len(rest):
            break
        rest = rest[(100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i]))]
        near = rest[(sketches[rest] == sketches[i]).mean(1) >= least] if len(rest) else rest
        if len(near):
            forest.join(i, near)
    roots = forest.roots()
    return [(ids[i], ids[r]) for i, r in enumerate(roots) if i != r]


def verify(ids: list, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple]:
    """Edges of a spanning forest of the pairs that are links, found by leaders.

    Every element is marked by number, so a leader meets all members in one pass over their sets;
    members of its own component need no comparison.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(-sizes, kind="stable")
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    marked = np.zeros(flat.max() + 1, np.int32)
    forest, edges = Forest(len(ids)), []
    for i in order:
        roots = forest.roots()
        if not (roots != roots[i]).any():
            break
        open_ = (roots != roots[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        if not open_.any():
            continue
        rest = np.flatnonzero(open_)
        own = flat[starts[i] : ends[i]]
        marked[own] = 1
        if len(rest) * 2 > len(ids):
            common = np.add.reduceat(marked[flat], starts)[rest]
        else:
            common = np.array([marked[flat[starts[j] : ends[j]]].sum() for j in rest])
        marked[own] = 0
        linked = rest[100 * common >= percent * (sizes[rest] + sizes[i] - common)]
        if len(linked):
            edges += [(ids[i], ids[j]) for j in linked]
            forest.join(i, linked)
    return edges


def links(docs: DataFrame, signed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: verified links that span every component, between classes."""
    classes = signed.where("n_shingles > 0").groupBy("class").agg(_first().alias("at"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    classes = classes.withColumnRenamed("class", "node")
    buckets = classes.select(F.explode("bands").alias("bucket"), "node")
    shared = buckets.groupBy("bucket").count().where("count > 1")
    # only now, for the few members of shared buckets, do sketches travel
    met = buckets.join(shared, "bucket").join(classes.select("node", "n_shingles", "sketch"), "node")
    pieces = F.ceil(F.col("count") / PIECE).cast("int")
    # a bucket beyond PIECE members is dealt into pieces, and every pair of pieces meets
    here = F.pmod(F.xxhash64("node"), pieces).cast("int")
    other = F.explode(F.sequence(F.lit(0), pieces - 1))
    dealt = met.select("bucket", "node", "n_shingles", "sketch", here.alias("here"), other.alias("other"))
    dealt = dealt.select("bucket", F.least("here", "other").alias("p"), F.greatest("here", "other").alias("q"), "node", "n_shingles", "sketch")

    def in_buckets(batch: pd.DataFrame) -> list[tuple]:
        rows: list[tuple] = []
        for _, g in batch.groupby(["bucket", "p", "q"], sort=False):
            if len(g) > 1:
                sketches = np.frombuffer(b"".join(g["sketch"]), np.uint16).reshape(len(g), WIDTH)
                rows += chain(g["node"].to_numpy(), g["n_shingles"].to_numpy(), sketches, percent)
        return rows

    def chained(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(in_buckets(batch), columns=["a", "b"])

    # whole buckets share a group, as most are tiny; a bucket in pieces goes by its pieces
    group = F.when((F.col("p") == 0) & (F.col("q") == 0), F.pmod("bucket", F.lit(4096))).otherwise(F.xxhash64("bucket", "p", "q"))
    candidates = dealt.withColumn("g", group).groupBy("g").applyInPandas(chained, "a binary, b binary").distinct()
    clusters = checkpointed(components(candidates))

    size = clusters.groupBy("component").agg(F.count("*").alias("members"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    tasks = clusters.join(size, "component").select("node", "component", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    tasks = tasks.select("node", "component", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))
    tasks = tasks.join(classes.select("node", "at.doc_id", "at.md5"), "node")
    every = docs.select("doc_id", _md5().alias("md5"), "text")
    texts = every.join(tasks, _same(every, tasks)).select("node", "component", "p", "q", "text")

    def verified(batch: pd.DataFrame) -> pd.DataFrame:
        hashes, rows = WordHashes(), []
        for _, g in batch.groupby(["component", "p", "q"], sort=False):
            g = g.drop_duplicates("node")
            rows += verify(list(g["node"]), [shingles(t, hashes) for t in g["text"]], percent)
        return pd.DataFrame(rows, columns=["a", "b"])

    group = F.when((F.col("p") == 0) & (F.col("q") == 0), F.pmod(F.xxhash64("component"), F.lit(1024))).otherwise(F.xxhash64("component", "p", "q"))
    return texts.withColumn("g", group).groupBy("g").applyInPandas(verified, "a binary, b binary")


def _named(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signatures, and class, ``first`` (the representative of its group)."""
    signed = checkpointed(signatures(docs))
    found = components(links(docs, signed, percent))
    least = signed.where("n_shingles > 0").groupBy("class").agg(_first().alias("least"))
    grouped = least.join(found, least["class"] == found["node"], "left").select("class", "least", F.coalesce("component", "class").alias("component"))
    firsts = grouped.groupBy("component").agg(F.min("least").alias("first"))
    return signed, grouped.join(firsts, "component").select("class", "first")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    signed, named = _named(docs, percent)
    out = signed.select("doc_id", "n_shingles", "class").join(named, "class", "left")
    component = F.coalesce("first.doc_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = CORPUS_PERCENT) -> DataFrame:
    """One row of ``docs`` for each group: a row of its representative.

    Rows without words form no group: one row stays for each id and text, and all of those without an id.
    """
    signed, named = _named(docs, percent)
    firsts = named.select("first.doc_id", "first.md5").distinct()
    keys = signed.groupBy("doc_id", "md5").agg(F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles"))
    keys = keys.where("n_shingles = 0").unionByName(keys.where("n_shingles > 0").join(firsts, _same(keys, firsts), "left_semi"))
    keys = keys.withColumn("single", (F.col("n") == 1) | ((F.col("n_shingles") == 0) & F.col("doc_id").isNull()))
    mark = fresh("md5", docs.columns)
    every = docs.withColumn(mark, _md5())
    single, repeated = keys.where("single"), keys.where(~F.col("single"))
    same = lambda k: every["doc_id"].eqNullSafe(k["doc_id"]) & (every[mark] == k["md5"])
    # only rows that repeat are shuffled whole
    alone = every.join(single, same(single), "left_semi")
    one = every.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", mark])
    return alone.unionByName(one).select(*(F.col(f"`{c}`") for c in docs.columns))
