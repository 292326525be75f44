"""URL filtering by pattern rules that are indexed under their rarest literal token.

Native: every step is a DataFrame expression.  A rule is filed under that one of its literal
tokens which the fewest URLs of the table hold; a URL's own tokens fetch the rules filed under
them, and only these candidates run their regular expressions.

Defined results.  A null URL, or one without ``://``, has an empty host and path; no host rule
can fit, and the pattern rules see an empty address, so the verdict is ``allow``.  Rows that
repeat are judged each on its own, and any further columns of the input are left out of the
result.  An empty table gives an empty result.  Among fitting host rules the longest wins; among
pattern rules an ``allow`` beats a ``block``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beyond this many rules the index is joined instead of being written into the plan.
MAX_INLINE_RULES = 2000


@dataclass(frozen=True)
class Rule:
    """``text`` is what the result names, ``regex`` runs over ``.host/path`` in one line.

    ``literals`` are the tokens ``[a-z0-9]+`` that every fitting address holds as whole tokens.
    """

    text: str
    action: str
    regex: str
    literals: tuple[str, ...]
    is_host_rule: bool


def host_rule(action: str, text: str) -> Rule:
    """A rule ``host/path``: it fits the host and its subdomains where the path has that prefix."""
    host, slash, path = text.partition("/")
    whole = text if re.search(r"[^A-Za-z0-9]$", text) else text[: max(len(host), *(m.end() for m in re.finditer(r"[^A-Za-z0-9]", text)))]
    return Rule(text, action, rf"^[^/]*\.{_quoted(host)}{_quoted(slash + path) if slash else '(?:/|$)'}", tuple(dict.fromkeys(re.findall(r"[a-z0-9]+", whole.lower()))), True)


def pattern_rule(action: str, words: str, regex: str) -> Rule:
    """A rule whose ``words`` (space-separated whole tokens) must all occur for ``regex`` to fit."""
    return Rule(regex, action, regex, tuple(words.split()), False)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


#: The rules of the contract.
HOST_RULES = (host_rule("block", "net/"), host_rule("allow", "example.net/en/"), host_rule("block", "example.com/de/"), host_rule("allow", "org/fr/"))

#: The method's own rules, for addresses that no host rule decides.
PATTERN_RULES = (
    pattern_rule("block", "bets", r"^[^/]*[.-]bets\."),
    pattern_rule("block", "adult", r"^[^/]*[.-]adult[.-]"),
    pattern_rule("block", "casino", r"[./-]casino[./-]"),
    pattern_rule("block", "xxx", r"[./-]xxx[./-]"),
    pattern_rule("block", "porn", r"[./-]porn[./-]"),
    pattern_rule("block", "free pills", r"[./-]free-pills[./-]"),
    pattern_rule("block", "doubleclick net", r"\.doubleclick\.net(?:/|$)"),
    pattern_rule("block", "ads", r"^[^/]*\.ads\."),
    pattern_rule("block", "banner", r"/banner/[0-9]+"),
    pattern_rule("allow", "about", r"^[^/]*/about/?$"),
)


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)://([^/?#]*)", 1)
    ascii_upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(raw, ascii_upper, ascii_upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(address: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.array_distinct(F.regexp_extract_all(F.translate(address, upper, upper.lower()), F.lit("([a-z0-9]+)"), F.lit(1)))


def rarest_tokens(urls: DataFrame, address: Column, rules: tuple[Rule, ...]) -> dict[str, list[int]]:
    """The index: token -> numbers of the rules filed under it.

    Counts are taken over all rows; only the counts of tokens that rules hold come back, so what
    the driver sees is bounded by the rule list.
    """
    wanted = sorted({t for r in rules for t in r.literals})
    held = F.array_intersect(_tokens(address), F.array(*map(F.lit, wanted))) if wanted else F.array().cast("array<string>")
    rows = urls.select(F.explode(held).alias("token")).groupBy("token").count().collect() if wanted else []
    seen = {r["token"]: r["count"] for r in rows}
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        key = min(rule.literals, key=lambda t: (seen.get(t, 0), t), default="")
        index.setdefault(key, []).append(i)
    return index


def judge(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES, max_inline_rules: int = MAX_INLINE_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and pattern (the method's rule, if one decided)."""
    base = pages.select("page_id", "url").select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    address = F.concat(F.lit("."), F.col("host"), F.col("path"))
    index = rarest_tokens(base, address, rules)
    if len(rules) <= max_inline_rules:
        found = base.withColumn("fits", _fits_inline(address, rules, index))
    else:
        found = _fits_joined(base, address, rules, index)
    best_host = F.try_element_at(F.filter("fits", lambda r: r["host"]), F.lit(-1))
    best_pattern = F.try_element_at(F.filter("fits", lambda r: ~r["host"]), F.lit(-1))
    return found.select(
        "page_id", "host", "path", best_host["text"].alias("rule"),
        F.coalesce(best_host["action"], best_pattern["action"], F.lit("allow")).alias("verdict"),
        F.when(best_host.isNull(), best_pattern["text"]).alias("pattern"),
    )


RULE_TYPE = "struct<host:boolean,rank:int,text:string,action:string,regex:string>"


def _rank(rule: Rule) -> int:
    """The winner among fitting rules has the highest rank: the longest host rule, else an allowing pattern."""
    return len(rule.text) if rule.is_host_rule else int(rule.action == "allow")


def _fits_inline(address: Column, rules: tuple[Rule, ...], index: dict[str, list[int]]) -> Column:
    def struct(i: int) -> Column:
        r = rules[i]
        return F.struct(F.lit(r.is_host_rule).alias("host"), F.lit(_rank(r)).alias("rank"), F.lit(r.text).alias("text"), F.lit(r.action).alias("action"), F.lit(r.regex).alias("regex"))

    none = F.array().cast(f"array<{RULE_TYPE}>")
    if not index:
        return none
    filed = F.create_map(*(x for token, ids in sorted(index.items()) for x in (F.lit(token), F.array(*map(struct, ids)))))
    keys = F.array_intersect(F.array_append(_tokens(address), F.lit("")), F.array(*map(F.lit, sorted(index))))
    candidates = F.flatten(F.transform(keys, lambda t: F.coalesce(F.try_element_at(filed, t), none)))
    return F.array_sort(F.filter(candidates, lambda r: F.regexp_like(address, r["regex"])))


def _fits_joined(base: DataFrame, address: Column, rules: tuple[Rule, ...], index: dict[str, list[int]]) -> DataFrame:
    """The same by joins, for rule lists of any length: distinct URLs ask the index, answers return by URL."""
    spark = base.sparkSession
    rows = [(t, rules[i].is_host_rule, _rank(rules[i]), rules[i].text, rules[i].action, rules[i].regex) for t, ids in index.items() for i in ids]
    filed = spark.createDataFrame(rows, "token string, host_rule boolean, rank int, text string, action string, regex string")
    asked = base.select(address.alias("address")).distinct().select("address", F.explode(F.array_append(_tokens(F.col("address")), F.lit(""))).alias("token"))
    answers = asked.join(filed, "token").where(F.regexp_like("address", F.col("regex")))
    best = answers.groupBy("address").agg(F.array_sort(F.collect_list(F.struct(F.col("host_rule").alias("host"), "rank", "text", "action", "regex"))).alias("fits"))
    joined = base.withColumn("address", address).join(best, "address", "left")
    return joined.withColumn("fits", F.coalesce("fits", F.array().cast(f"array<{RULE_TYPE}>"))).drop("address")


def oracle() -> str:
    """The same verdicts in DuckDB SQL, for the default rules."""
    host_rows = ", ".join(f"('{r.action}', '{r.text}', '{r.text.partition('/')[0]}', '/{r.text.partition('/')[2]}')" for r in HOST_RULES)
    pattern_rows = ", ".join(f"('{r.action}', '{r.regex}')" for r in PATTERN_RULES)
    return f"""
WITH u AS (SELECT page_id, url, row_number() OVER () AS k,
  translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h(action, text, rule_host, rule_path) AS (VALUES {host_rows}),
p(action, regex) AS (VALUES {pattern_rows}),
hr AS (SELECT k, arg_max(text, length(text)) AS rule, arg_max(action, length(text)) AS action FROM u JOIN h
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY k),
pr AS (SELECT k, max((action = 'allow')::int::varchar || regex) AS best FROM u JOIN p ON regexp_matches('.' || host || path, regex) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(hr.action, CASE left(best, 1) WHEN '1' THEN 'allow' WHEN '0' THEN 'block' END, 'allow') AS verdict,
  CASE WHEN rule IS NULL THEN substr(best, 2) END AS pattern
FROM u LEFT JOIN hr USING (k) LEFT JOIN pr USING (k)"""
