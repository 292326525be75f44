"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Native: every step is a DataFrame expression, local to its row, so nothing is shuffled.

The entropy method walks each candidate string once.  The state holds how often each symbol of
the string's class occurs in the last ``WINDOW`` characters and the running sum of c*log2(c); a
step adds the entering character and takes off the leaving one, so a window's Shannon entropy
log2(W) - S/W costs O(1) sums.  A string is reported from its first to its last window at or above
the threshold of its class, unless the allow-list suppresses it or a base span covers it whole.

Defined results.  A null or empty text has no spans: zero counts, an empty ``spans`` and the hash
of the empty string.  Repeated rows are scanned each on its own.  Spans are in code points, end
exclusive.  Further columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sha256_text

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that holds AKIA is taken from its first AKIA to its end, so the length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
#: Maximal runs of at least 24, which is what dropping shorter maximal runs leaves.
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
WINDOW = 20

#: Class, the whole strings in it, its symbols, and the bits a window must reach (log2(20) is 4.32).
CLASSES = (
    ("hex", r"^[0-9a-f]+$|^[0-9A-F]+$", "0123456789abcdefABCDEF", 3.0),
    ("alnum", r"^[A-Za-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 3.75),
    ("base64", r"^[A-Za-z0-9+/=_-]+$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/=_-", 3.75),
)

#: Candidates that are no secrets: without a digit or without a letter, UUIDs, counting strings,
#: documentation keys and hashes of the empty input.
ALLOWED = (
    r"^[^0-9]*$", r"^[^A-Za-z]*$", r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"(?i)0123456789|abcdefghij|EXAMPLE|^[A-Za-z]+(?:[-_/][A-Za-z]+)*[-_/]?[0-9]{1,8}$",
    r"^da39a3ee5e6b4b0d3255bfef95601890afd80709$|^d41d8cd98f00b204e9800998ecf8427e$|^e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855$",
)

SPAN = "array<struct<s:int,e:int,k:int,text:string,value:string>>"


def matches(text: Column, regex: str, kind: int, group: int = 0) -> Column:
    """Leftmost non-overlapping matches with their places: the gaps between them give the offsets."""
    whole, value = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.regexp_extract_all(text, F.lit(regex), F.lit(group))
    parts = F.arrays_zip(F.split(text, regex, -1).alias("gap"), whole.alias("text"), value.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def step(acc: Column, part: Column) -> Column:
        s = acc["at"] + F.length(part["gap"])
        e = s + F.length(F.coalesce(part["text"], F.lit("")))
        span = F.struct(s.alias("s"), e.alias("e"), F.lit(kind).alias("k"), part["text"].alias("text"), part["value"].alias("value"))
        return F.struct(e.alias("at"), F.when(part["text"].isNull(), acc["found"]).otherwise(F.array_append(acc["found"], span)).alias("found"))

    return F.when(F.regexp_like(text, F.lit(regex)), F.aggregate(parts, start, step)["found"]).otherwise(F.array().cast(SPAN))


def _c_log_c(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def entropy_range(value: Column, alphabet: str, threshold: float, window: int = WINDOW) -> Column:
    """struct(lo, hi, best): from the first to the end of the last window at or above ``threshold``."""
    import math

    place = lambda i: F.instr(F.lit(alphabet), F.substring(value, i, F.lit(1)))  # noqa: E731  1-based
    start = F.struct(F.transform(F.sequence(F.lit(1), F.lit(len(alphabet))), lambda _: F.lit(0)).alias("n"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"), F.lit(0.0).alias("best"))

    def step(acc: Column, i: Column) -> Column:
        into, out = place(i), F.when(i > window, place(i - window)).otherwise(F.lit(0))
        plus = F.element_at(acc["n"], into)
        left = F.when(out > 0, F.element_at(acc["n"], F.greatest(out, F.lit(1))) + F.when(out == into, 1).otherwise(0)).otherwise(F.lit(0))
        total = acc["sum"] - _c_log_c(plus) + _c_log_c(plus + 1) - _c_log_c(left) + _c_log_c(left - 1)
        counts = F.transform(acc["n"], lambda c, j: c + F.when(j + 1 == into, 1).otherwise(0) - F.when(j + 1 == out, 1).otherwise(0))
        bits = F.when(i >= window, F.lit(math.log2(window)) - total / window).otherwise(F.lit(0.0))
        hot = bits >= threshold
        return F.struct(
            counts.alias("n"), total.alias("sum"), F.when(hot & acc["lo"].isNull(), i - window).otherwise(acc["lo"]).alias("lo"),
            F.when(hot, i).otherwise(acc["hi"]).alias("hi"), F.greatest(acc["best"], bits).alias("best"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.length(value)), start, step)


def entropy_spans(text: Column) -> Column:
    """Spans of kind 3 over candidate strings that pass the allow-list and reach their class's threshold."""
    kept = F.filter(matches(text, CANDIDATE, 3), lambda m: ~F.regexp_like(m["text"], F.lit("|".join(f"(?:{a})" for a in ALLOWED))))

    def placed(m: Column) -> Column:
        walk = None
        for _, whole, alphabet, bits in CLASSES:
            r = entropy_range(m["text"], alphabet, bits)
            hit = F.struct((m["s"] + r["lo"]).alias("s"), (m["s"] + r["hi"]).alias("e"), m["k"].alias("k"), m["text"].alias("text"), m["value"].alias("value"))
            walk = F.when(F.regexp_like(m["text"], F.lit(whole)), hit) if walk is None else walk.when(F.regexp_like(m["text"], F.lit(whole)), hit)
        return walk

    return F.when(F.size(kept) > 0, F.filter(F.transform(kept, placed), lambda m: m["s"].isNotNull())).otherwise(F.array().cast(SPAN))


KINDS = ("assign", "access", "hex", "entropy")


def _digest(spans: Column) -> Column:
    kind = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(F.array_sort(F.transform(spans, lambda m: F.struct(m["s"].alias("s"), m["k"].alias("k"), m["e"].alias("e")))), lambda m: F.concat_ws(":", kind(m["k"]), m["s"], m["e"])), ",")


def scan(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """id, and arrays of spans (s, e, k, text, value): ``base`` and ``added``."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(F.filter(matches(t, ASSIGN, 0, 2), lambda m: F.length(m["value"]) >= 6), matches(t, ACCESS, 1), matches(t, HEX, 2))
    found = docs.select(F.col(id_column), base.alias("base"), entropy_spans(t).alias("near"))
    covered = lambda m: F.exists("base", lambda b: (b["s"] <= m["s"]) & (b["e"] >= m["e"]))
    return found.select(id_column, "base", F.filter("near", lambda m: ~covered(m)).alias("added"))


def report(docs: DataFrame) -> DataFrame:
    """The counts and digests of ``scan``."""
    of = lambda k: F.size(F.filter("base", lambda m: m["k"] == k)).cast("long")
    return scan(docs).select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), sha256_text(_digest(F.col("base"))).alias("base_sha256"),
        _digest(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_entropy"),
    )
