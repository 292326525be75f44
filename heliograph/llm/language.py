"""Language ID by hierarchical discrimination.

First the language family, then, within it, one-versus-one linear support vector machines that
separate its languages.  Features are hashed byte 1- to 4-grams of the lower-cased text, as square
roots of their shares, over the whole text.

The machines are fitted on a bounded sample: at most ``per_language`` labelled documents of each
language, those with the smallest hash of their id, and fewer where there are so many languages that
``SAMPLE_ROWS`` would be passed (but ``LEAST`` of each, so no language is left out).  Scoring is local
to each row.

Defined results.  A text that is null or holds no letter is ``und`` with score 0, as is every text
if there is nothing to learn from.  With one learned language all other texts are that language
with score 1.  Rows that repeat are judged each on its own; ids are never features, and a null id is
outside the fold.  Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, fresh, ship

#: Bounds of the fit: documents of each language, of all languages, and the least of each.
PER_LANGUAGE, SAMPLE_ROWS, LEAST = 400, 20_000, 20
BITS = 12
SIZE = 1 << BITS

#: Families of language codes.  A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi".split(),
    "romance": "ast ca es fr gl it la oc pt ro sc".split(),
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk".split(),
    "indo-aryan": "as bn gu hi mr ne pa si ur".split(),
    "turkic": "az kk ky tk tr tt ug uz".split(),
    "uralic": "et fi hu se".split(),
    "semitic": "am ar he mt".split(),
    "baltic": "lt lv".split(),
    "celtic": "br cy ga gd".split(),
}


def family(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes), code)


def features(text: str) -> np.ndarray:
    """Unit vector of hashed byte n-grams; every text has at least the blanks around it."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    counts = np.zeros(SIZE)
    gram = np.zeros(len(b), np.uint32)
    for n in range(1, 5):
        gram = (gram[: len(b) - n + 1] if n > 1 else gram) | (b[n - 1 :] << np.uint32(8 * (n - 1)))
        if not len(gram):
            break
        counts += np.bincount(((gram * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS), minlength=SIZE)
    return np.sqrt(counts / counts.sum())


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12) -> np.ndarray:
    """Linear SVM with squared hinge loss by dual coordinate descent; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    diagonal, weights, alpha = 0.5 / c, np.zeros(x.shape[1]), np.zeros(len(x))
    norms = (x * x).sum(1) + diagonal
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            step = max(alpha[i] - (y[i] * (weights @ x[i]) - 1 + diagonal * alpha[i]) / norms[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                weights += step * y[i] * x[i]
    return weights


@dataclass
class Duel:
    """One-versus-one machines among ``names``; ``weights`` has a column for each pair."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> Duel:
        names = sorted(set(labels))
        pairs = list(combinations(range(len(names)), 2))
        columns = []
        for a, b in pairs:
            own = np.isin(labels, (names[a], names[b]))
            columns.append(svm(x[own], np.where(labels[own] == names[a], 1.0, -1.0)))
        return cls(names, pairs, np.array(columns).T.reshape(x.shape[1] + 1, len(pairs)))

    def decide(self, v: np.ndarray) -> tuple[str, float]:
        """The name with most wins (then the largest sum of margins), and its weakest duel as a probability."""
        if not self.pairs:
            return self.names[0], 1.0
        margins = v @ self.weights[:-1] + self.weights[-1]
        wins, sums, least = np.zeros(len(self.names)), np.zeros(len(self.names)), np.full(len(self.names), np.inf)
        for (a, b), m in zip(self.pairs, margins, strict=True):
            wins[a if m >= 0 else b] += 1
            for k, own in ((a, m), (b, -m)):
                sums[k] += own
                least[k] = min(least[k], own)
        best = max(range(len(self.names)), key=lambda k: (wins[k], sums[k]))
        return self.names[best], float(1 / (1 + np.exp(-np.clip(4 * least[best], -50, 50))))


@dataclass
class Hierarchy:
    families: Duel | None
    within: dict[str, Duel]

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> Hierarchy:
        if not len(labels):
            return cls(None, {})
        groups = np.array([family(lang) for lang in labels])
        return cls(Duel.fit(x, groups), {g: Duel.fit(x[groups == g], labels[groups == g]) for g in sorted(set(groups))})

    def predict(self, text: str | None) -> tuple[str, float]:
        if self.families is None or not has_letter(text):
            return "und", 0.0
        v = features(text)
        group, p = self.families.decide(v)
        lang, q = self.within[group].decide(v)
        return lang, p * q


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, held_out: F.Column | None = None) -> Hierarchy:
    """Fit on text and non-null lang of the documents outside the fold, within the bounds."""
    ship(docs.sparkSession)
    held_out = (fold("doc_id", 3) == 1) if held_out is None else held_out
    rows = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    spread = F.xxhash64("doc_id")
    counts = rows.groupBy("lang").count().collect()
    per_language = min(per_language, max(LEAST, SAMPLE_ROWS // max(len(counts), 1)))
    # a few more than needed by the hash, so that the sort below sees a bounded number of rows
    shares = {r["lang"]: min(1.0, 1.5 * (per_language + 50) / r["count"]) for r in counts}
    if not shares:
        return Hierarchy(None, {})
    share = F.try_element_at(F.create_map(*(F.lit(v) for kv in shares.items() for v in kv)), F.col("lang"))
    sample = rows.where(F.pmod(spread, F.lit(1_000_003)) < share * 1_000_003).select("lang", spread.alias("spread"), "text")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[has_letter(t) for t in batch["text"]]]
            vectors = [features(t).astype(np.float32) for t in batch["text"]]
            at = [np.flatnonzero(v).astype(np.uint16) for v in vectors]
            yield pd.DataFrame({"lang": batch["lang"], "spread": batch["spread"], "at": [i.tobytes() for i in at], "value": [v[i].tobytes() for v, i in zip(vectors, at, strict=True)]})

    got = sorted(sample.mapInPandas(featured, "lang string, spread long, at binary, value binary").collect(), key=lambda r: (r["spread"], r["value"]))
    kept: dict[str, list] = {}
    for r in got:
        if len(own := kept.setdefault(r["lang"], [])) < per_language:
            own.append(r)
    chosen = [r for lang in sorted(kept) for r in kept[lang]]
    x = np.zeros((len(chosen), SIZE), np.float32)
    for i, r in enumerate(chosen):
        x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["value"], np.float32)
    return Hierarchy.fit(x, np.array([r["lang"] for r in chosen]))


def predict(docs: DataFrame, model: Hierarchy, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns of ``docs`` and, named by ``into``, the language and its score."""
    ship(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", `{into[0]}` string, `{into[1]}` double"
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge: Hierarchy = shipped.value
        for batch in batches:
            got = [judge.predict(t) for t in batch.column(at).to_pylist()]
            made = [pa.array([lang for lang, _ in got], pa.string()), pa.array([p for _, p in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *into])

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    model = fit(docs)
    return predict(docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The documents whose language is known (score above ``least``), with ``lang`` set to it."""
    into = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    found = predict(docs, fit(docs), into).where((F.col(into[0]) != "und") & (F.col(into[1]) > least))
    return found.withColumn("lang", F.col(into[0])).select(*(F.col(f"`{c}`") for c in docs.columns))

