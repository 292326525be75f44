"""Retrieval over text chunks: BM25, n-gram cosine over counts, reciprocal rank fusion, rerank, metrics."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.operators import scores

K1, B, RRF_K, DIGITS = 1.5, 0.75, 60, 9
_BLANK = r"[\s\x1c-\x1f]"

# Words that carry no meaning in queries.
STOP_WORDS = "a an and are as at be been but by can could do does for from had has have if in into is it its may more most no not of on or that the their then there these they this to was were what when which while who will with would".split()


def tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: ~t.isin(STOP_WORDS))


def bm25(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, id, score, rank: the ``k`` best chunks of each query that share a term; a term repeated in a query counts as often."""
    return top(scores.bm25(chunks, queries, STOP_WORDS, k, K1, B, DIGITS), k)


def ngram_cosine(chunks: DataFrame, queries: DataFrame, k: int, n: int = 4) -> DataFrame:
    """qid, id, score, rank: the ``k`` best chunks of each query by the cosine over raw n-gram counts, of those that share one."""
    return top(scores.cosine(chunks, queries, F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"(?U)\s+", " "), n, k, DIGITS), k)


def top(rows: DataFrame, k: int, digits: int = DIGITS) -> DataFrame:
    """Rank from 1 by score, the smaller id first on ties."""
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", digits)), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(rankings: list[DataFrame], k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of rankings with ranks from 1; without ``k`` all that any of them holds."""
    rows = None
    for r in rankings:
        part = r.select("qid", "id", (1.0 / (RRF_K + F.col("rank"))).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    return top(rows.groupBy("qid", "id").agg(F.sum("s").alias("score")), k if k is not None else 2**31 - 1)


def rerank(fused: DataFrame, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Twice the coverage of the query's terms, 1.5 for the phrase itself, and the fused position."""
    rows = fused.join(chunks.withColumnRenamed("text", "chunk"), "id").join(queries.withColumnRenamed("text", "query"), "qid")
    terms = F.array_distinct(tokens(F.col("query")))
    coverage = F.coalesce(F.try_divide(F.size(F.array_intersect(terms, tokens(F.col("chunk")))), F.size(terms)), F.lit(0.0))
    said = F.regexp_replace(F.lower("query"), rf"(?U)^{_BLANK}+|{_BLANK}+$", "")
    phrase = F.when((said != "") & F.contains(F.lower("chunk"), said), 1.5).otherwise(0.0)
    return top(rows.select("qid", "id", (2 * coverage + phrase + 1.0 / F.col("rank")).alias("score")), k)


def ablation(chunks: DataFrame, queries: DataFrame, k: int = 10, candidates: int = 30) -> DataFrame:
    """configuration, qid, id, score, rank: the search with either stage alone, both fused, and both fused and reranked."""
    n = max(candidates, k)
    # n rows a query each, read by three configurations
    words, grams = (r.persist(StorageLevel.MEMORY_AND_DISK) for r in (bm25(chunks, queries, n), ngram_cosine(chunks, queries, n)))
    both = fuse([words, grams])
    found = {"bm25 only": top(fuse([words]), k), "vectors only": top(fuse([grams]), k), "hybrid, no rerank": top(both.drop("rank"), k), "hybrid + rerank": rerank(both, chunks, queries, k)}
    out = None
    for name, ranked in found.items():
        part = ranked.select(F.lit(name).alias("configuration"), "qid", "id", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def corpus_stats(chunks: DataFrame, source: str) -> DataFrame:
    """Chunks and tokens by source, and over all (source NULL)."""
    sized = chunks.select(F.col(source).alias("source"), F.size(tokens(F.col("text"))).alias("tokens"))
    return sized.groupingSets([["source"], []], "source").agg(F.grouping("source").alias("all_sources"), F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))


def knowledge_chunks(entries: DataFrame) -> DataFrame:
    """id, source, text: a chunk of each entry of the knowledge base, its names and its body.  ``entries``: kind, key, plain_name, body."""
    return entries.select(F.concat_ws(":", "kind", "key").alias("id"), F.col("kind").alias("source"), F.concat_ws("\n", F.concat_ws(" - ", "key", "plain_name"), "body").alias("text"))


def corpus_hash(chunks: DataFrame, buckets: int = 4096) -> DataFrame:
    """One digest of a corpus, whatever the order of its rows: digests of buckets by id, digested in their order."""
    rows = chunks.select(F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"), F.sha2(F.concat_ws("\0", F.col("id").cast("string"), "text").cast("binary"), 256).alias("h"))
    parts = rows.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "").cast("binary"), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda b: b["h"]), "").cast("binary"), 256).alias("corpus_sha256"))
