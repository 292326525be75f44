"""Prose as data: passages of documents, the numbers of an answer against its ledger, retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the chunker and of the grounding check.
TARGET_WORDS, OVERLAP_WORDS = 160, 30
FREE_INTEGER = 24
MASKS = (r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?", r"\b\d{1,2}:\d{2}(?::\d{2})?\b", r"\bH\d+\b", r"\b[A-Za-z_]+_\d+\b", r"(?i)\bstep \d+\b")
NUMBER = r"(?<![\d.])[-+]?\d[\d,]*(?:\.\d+)?\s*%?"
_BLANK = r"[\s\x1c-\x1f]"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, rf"(?U){_BLANK}+"), lambda w: w != "")


def slug(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 40)


def chunks(docs: DataFrame, id_column: str, text: str = "text", target: int = TARGET_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """id, chunk_no, chunk_id, text: whole paragraphs packed up to ``target`` words, each passage opening
    with the last ``overlap`` words of the one before.

    One fold over a document's paragraphs; a text without words has no passage.
    """
    parts = F.filter(F.transform(F.split(F.col(text), rf"\n(?U){_BLANK}*\n"), lambda p: F.regexp_replace(p, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, paragraph: Column) -> Column:
        words = F.size(_words(paragraph))
        full = (acc["n"] > 0) & (acc["n"] + words > target)
        tail = F.slice(_words(acc["open"]), -F.least(F.lit(overlap), F.size(_words(acc["open"]))), F.lit(overlap)) if overlap else F.array().cast("array<string>")
        carried = F.when(full, F.array_join(tail, " ")).otherwise(acc["open"])
        count = F.when(full, F.size(tail)).otherwise(acc["n"])
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"),
            F.when(carried == "", paragraph).otherwise(F.concat(carried, F.lit("\n\n"), paragraph)).alias("open"), (count + words).alias("n"),
        )

    folded = docs.select(F.col(id_column).alias("id"), F.aggregate(parts, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))).alias("all"))
    out = folded.select("id", F.posexplode("all").alias("chunk_no", "text"))
    return out.select("id", "chunk_no", F.concat(slug(F.col("id").cast("string")), F.format_string(":%03d", "chunk_no")).alias("chunk_id"), "text")


def numbers(rows: DataFrame, id_column: str, text: str = "text", mask: bool = True) -> DataFrame:
    """id, literal, value, decimals of every numeral; with ``mask`` dates, clock times and names don't count."""
    shown = F.col(text)
    for pattern in MASKS if mask else ():
        shown = F.regexp_replace(shown, pattern, " ")
    found = rows.select(F.col(id_column).alias("id"), F.explode(F.regexp_extract_all(shown, F.lit(NUMBER), F.lit(0))).alias("literal"))
    literal = F.regexp_replace(F.col("literal"), r"^\s+|\s+$", "")
    body = F.regexp_replace(literal, r"[,%\s]", "")
    decimals = F.when(F.contains(body, F.lit(".")), F.length(F.substring_index(body, ".", -1))).otherwise(0)
    return found.select("id", literal.alias("literal"), body.try_cast("double").alias("value"), decimals.alias("decimals")).where("value is not null")


def grounding(answers: DataFrame, ledger: DataFrame, id_column: str = "id", text: str = "text") -> DataFrame:
    """id, literal, value, grounded: an answer's numerals that need a measurement, and whether one stands behind them.

    ``ledger``: id, value; the measured and quotable numbers of the same investigation, met also as
    percentages and with the other sign, within half a unit of the last digit shown.  Integers up to
    24 are free.  An investigation's ledger is one array, bounded by what its measurements returned.
    """
    claims = numbers(answers, id_column, text).where((F.col("decimals") > 0) | (F.abs("value") > FREE_INTEGER))
    known = ledger.where("value is not null").groupBy("id").agg(F.collect_set("value").alias("known"))
    tolerance = 0.5 * F.pow(F.lit(10.0), -F.col("decimals")) + 1e-9 + F.abs("value") * 1e-9
    near = F.exists("known", lambda k: F.least(*(F.abs(F.abs("value") - F.abs(k) * f) for f in (1.0, 100.0, 0.01))) <= tolerance)
    return claims.join(known, "id", "left").select("id", "literal", "value", F.coalesce(near, F.lit(False)).alias("grounded"))


def retrieval_quality(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """By kind and over all (kind NULL): hit rates at 1, 3 and 10, and the mean reciprocal rank.

    ``hits``: qid, id, rank from 1; ``relevant``: qid, kind, id.  A query whose passages are all missed counts 0.
    """
    best = relevant.join(hits, ["qid", "id"], "left").groupBy("qid", "kind").agg(F.min("rank").alias("rank"))
    at = lambda k: F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 4).alias(f"hit_at_{k}")
    return best.groupingSets([["kind"], []], "kind").agg(F.count("*").alias("queries"), at(1), at(3), at(10), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 4).alias("reciprocal_rank"))
