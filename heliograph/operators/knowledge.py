"""The knowledge base as tables: matching of free-text causes, the brief for a set of causes, and its lint.

``signatures``: key, position, plain_name, body.  ``tests``: test_key, first, second, body; a test
separates two causes, in either order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shapes that a decision rule takes in prose, which the knowledge base must not hold.
RULES = (r"[<>]=?\s*-?\d", r"\b(?:greater|less|more|fewer)\s+than\s+-?\d", r"\b(?:above|below|over|under|exceeds?|at\s+least)\s+-?\d+(?:\.\d+)?\s*%", r"(?i)\bthreshold\b")


def long_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: F.length(w) > 3))


def match(phrases: DataFrame, signatures: DataFrame, limit: int = 6) -> DataFrame:
    """qid, key, overlap, rank: the keys that share most long words with any one phrase of a question.

    ``phrases``: qid, phrase_no, phrase.  Ties go by the phrase that met the key first, then by the
    key's position.  Words meet in an equi-join; the signatures are the small side, of any size.
    """
    asked = phrases.select("qid", "phrase_no", F.explode(long_words(F.col("phrase"))).alias("word"))
    known = signatures.select("key", "position", F.explode(long_words(F.concat_ws(" ", "key", "plain_name"))).alias("word"))
    overlaps = asked.join(known, "word").groupBy("qid", "key", "position", "phrase_no").agg(F.count("*").alias("overlap"))
    best = overlaps.groupBy("qid", "key", "position").agg(F.max("overlap").alias("overlap"), F.min("phrase_no").alias("met"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("overlap"), "met", "position", "key"))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit).select("qid", "key", "overlap", "rank")


def brief(causes: DataFrame, signatures: DataFrame, tests: DataFrame) -> DataFrame:
    """qid, block_no, key, body: the signatures of a question's causes in order, then each test between two of them once.

    ``causes``: qid, rank, key.  Causes the base doesn't know have no block.
    """
    wanted = causes.join(signatures.select("key", "body"), "key")
    own = wanted.select("qid", F.lit(0).alias("part"), F.col("rank").cast("long").alias("at"), "key", "body")
    named = wanted.select("qid", "key", "rank")
    pairs = tests.join(named.withColumnsRenamed({"key": "first", "rank": "rank_a"}), "first").join(named.withColumnsRenamed({"key": "second", "rank": "rank_b"}), ["qid", "second"]).where("first <> second")
    lower_first = F.when(F.col("first") < F.col("second"), F.struct("rank_a", "rank_b")).otherwise(F.struct(F.col("rank_b").alias("rank_a"), F.col("rank_a").alias("rank_b")))
    between = pairs.withColumn("o", lower_first).groupBy("qid", "test_key").agg(F.min(F.struct("o", "body")).alias("m"))
    order = F.row_number().over(Window.partitionBy("qid").orderBy("m.o", "test_key")).cast("long")
    shown = between.select("qid", F.lit(1).alias("part"), order.alias("at"), F.col("test_key").alias("key"), "m.body")
    number = F.row_number().over(Window.partitionBy("qid").orderBy("part", "at", "key"))
    return own.unionByName(shown).select("qid", number.alias("block_no"), "key", "body")


def rule_like(rows: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """id, found: texts that read as a decision rule, with the first pattern's match."""
    hit = F.coalesce(*(F.nullif(F.regexp_extract(F.col(text), p, 0), F.lit("")) for p in RULES))
    return rows.select(F.col(id_column).alias("id"), hit.alias("found")).where("found is not null")
