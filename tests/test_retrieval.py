"""Rankings against plain Python, over odd ids and texts, in pieces far smaller than usual."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from heliograph.operators import retrieval, scores

SCHEMA = "{} string, text string"


def tables(spark):
    draw = random.Random(5)
    word = lambda: draw.choice("sun Sun panel string dust İz ombré 雨量 of the a1 b2 x".split())
    text = lambda most: draw.choice([" ", "\n\t", "-"]).join(word() for _ in range(draw.randrange(most)))
    chunks = [(f"c{k % 110:03}" if k % 17 else None, text(30)) for k in range(150)] + [(f"e{k}", t) for k, t in enumerate(("", " ", "ab", "𝒳𝒳𝒳𝒳 sun"))] + [(f"t{k:02}", "dust panel") for k in range(40)]
    asked = [(f"q{k % 9}" if k else None, text(12)) for k in range(12)] + [("same", "panel dust"), ("none", "zzzz"), ("empty", "")]
    return chunks, asked, spark.createDataFrame(chunks, SCHEMA.format("id")).repartition(5), spark.createDataFrame(asked, SCHEMA.format("qid"))


def best(pairs, k):
    """The k best ids by question, with scores; a pair is (qid, id): score."""
    by = defaultdict(list)
    for (q, d), s in pairs.items():
        if s > 0:
            by[q].append((-round(s, 9), d))
    return {(q, d): (rank, -s) for q, rows in by.items() for rank, (s, d) in enumerate(sorted(rows)[:k], 1)}


def same(frame, wanted):
    got = {(r["qid"], r["id"]): (r["rank"], r["score"]) for r in frame.collect()}
    assert got.keys() == wanted.keys()
    assert all(got[x][0] == wanted[x][0] and math.isclose(got[x][1], wanted[x][1], abs_tol=2e-9) for x in got)


@pytest.fixture
def tiny(monkeypatch):
    """Several passes, blocks, pieces and slices; workers have their own PIECE, ROWS and CELLS."""
    for name, value in {"PASS": 90, "BLOCK": 2, "PIECE": 90, "ROWS": 7, "CELLS": 5}.items():
        monkeypatch.setattr(scores, name, value)


def bm25(chunks, asked):
    tokens = lambda t: [w for w in re.findall("[a-z0-9]+", t.lower()) if w not in retrieval.STOP_WORDS]
    tf, df, lengths, qf = defaultdict(Counter), Counter(), defaultdict(list), defaultdict(Counter)
    for d, t in chunks:
        tf[d].update(tokens(t))
        lengths[d].append(len(tokens(t)))
    for d in tf:
        df.update(tf[d].keys())
    for q, t in asked:
        qf[q].update(tokens(t))
    n, mean = len(chunks), sum(map(sum, lengths.values())) / len(chunks)
    weight = lambda d, w, c: sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * max(x, 1) / mean)) for x in lengths[d])
    return {(q, d): sum(weight(d, w, c) * qf[q][w] for w, c in tf[d].items() if w in qf[q]) for q in qf for d in tf if d is not None}


def cosine(chunks, asked):
    def counts(rows):
        out = defaultdict(Counter)
        for key, t in rows:
            t = re.sub(r"\s+", " ", t.lower())
            out[key].update(t[i : i + 4] for i in range(len(t) - 3))
        return {k: c for k, c in out.items() if k is not None and c}

    docs, qs = counts(chunks), counts(asked)
    norm = lambda c: math.sqrt(sum(x * x for x in c.values()))
    return {(q, d): sum(x * docs[d][g] for g, x in qs[q].items()) / (norm(docs[d]) * norm(qs[q])) for q in qs for d in docs}


def test_bm25_is_exact(spark):
    chunks, asked, left, right = tables(spark)
    same(retrieval.bm25(left, right, 4), best(bm25(chunks, asked), 4))
    same(retrieval.bm25(left, right, 500), best(bm25(chunks, asked), 500))


def test_cosine_is_exact(spark):
    chunks, asked, left, right = tables(spark)
    same(retrieval.ngram_cosine(left, right, 4), best(cosine(chunks, asked), 4))
    same(retrieval.ngram_cosine(left.where("id is not null").dropDuplicates(["id", "text"]), right, 500), best(cosine({*chunks}, asked), 500))


def test_one_grams_and_many_letters():
    """Numbers of grams stay exact where letters to the n-th power are beyond 62 bits."""
    draw = random.Random(3)
    texts = ["".join(chr(draw.choice((draw.randrange(40, 44), draw.randrange(0x4E00, 0x9FFF), draw.randrange(0x20000, 0x2A000)))) for _ in range(9000)) * 2 for _ in range(3)]
    for n in (1, 4, 9):
        owner, gram, count = scores.grams(texts, np.array([0, 1, 1]), n)
        wanted = [Counter(texts[0][i : i + n] for i in range(18001 - n)), Counter(t[i : i + n] for t in texts[1:] for i in range(18001 - n))]
        assert [sorted(count[owner == k]) for k in (0, 1)] == [sorted(c.values()) for c in wanted]
        assert len({*gram}) == len(wanted[0].keys() | wanted[1].keys())


def test_pieces_and_blocks(spark, tiny):
    """The same rankings where a block has two questions and a pass a few; pieces and slices leave nothing out."""
    chunks, asked, left, right = tables(spark)
    rows = left.coalesce(1)
    assert sum(1 for _ in scores.passes(right, retrieval.F.col("text"))) > 2
    same(retrieval.bm25(rows, right, 4), best(bm25(chunks, asked), 4))
    same(retrieval.ngram_cosine(rows, right, 4), best(cosine(chunks, asked), 4))
    held = [["ab"] * (k % 4) + ["é" * (k * 9)] for k in range(30)]
    batch = pa.RecordBatch.from_pydict({"id": [*range(30)], "texts": held}).slice(3)
    pieces = [*scores._pieces([batch])]
    assert len(pieces) > 6 and [(i, t) for ids, texts, group in pieces for t, i in zip(texts.to_pylist(), ids.take(pa.array(group)).to_pylist(), strict=True)] == [(i, t) for i in range(3, 30) for t in held[i]]
    draw = np.random.default_rng(1)
    a, b = draw.integers(0, 3, (4, 6)), draw.integers(0, 3, (5, 6))
    postings = scores._postings(*np.nonzero(b), b[np.nonzero(b)], 6)
    assert np.array_equal(scores._sums(*np.nonzero(a), a[np.nonzero(a)], postings, 4, 5), b @ a.T)


def test_few_rows_leave_a_task(spark):
    """Every pair shares a term; no more than the best of a task travel, and no join makes rows of pairs."""
    left = spark.range(10000).selectExpr("id", "concat('dust panel ', repeat('sun ', int(id % 7))) as text").repartition(2)
    right = spark.range(50).selectExpr("id as qid", "concat('dust panel q', id) as text")
    text = retrieval.F.col("text")
    for sent in (scores.bm25(left, right, retrieval.STOP_WORDS, 10, 1.5, 0.75, 9), scores.cosine(left, right, text, 4, 10, 9)):
        assert 500 <= sent.count() <= 6 * 50 * 10
    for ranked in (retrieval.bm25(left, right, 10), retrieval.ngram_cosine(left, right, 10)):
        assert "Join" not in ranked._jdf.queryExecution().executedPlan().toString() and ranked.count() == 500


def test_long_text(spark):
    """A text of 300,000 characters: its 4-grams take time in proportion to its length."""
    left = spark.createDataFrame([(1, "dust on the panel " * 17000), (2, "dust")], "id long, text string")
    right = spark.createDataFrame([(7, "dust on the panel")], "qid long, text string")
    got = [(r["id"], r["rank"]) for r in retrieval.ngram_cosine(left, right, 5).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]


def test_no_questions(spark):
    _, _, left, right = tables(spark)
    assert retrieval.bm25(left, right.limit(0), 3).count() == retrieval.ngram_cosine(left, right.where("qid is null"), 3).count() == 0


def test_ablation_ranks_once(spark):
    """Four configurations in plain Python; both rankings are kept for the configurations that read them."""
    chunks, asked, _, _ = tables(spark)
    chunks, asked = [*{d: (d, t) for d, t in chunks if d}.values()], [*{q: (q, t) for q, t in asked if q}.values()]
    found = retrieval.ablation(spark.createDataFrame(chunks, SCHEMA.format("id")), spark.createDataFrame(asked, SCHEMA.format("qid")), 3, 6)
    first, second = best(bm25(chunks, asked), 6), best(cosine(chunks, asked), 6)
    alone = lambda ranks: {x: 1 / (60 + r) for x, (r, _) in ranks.items()}
    both = {x: alone(first).get(x, 0) + alone(second).get(x, 0) for x in first.keys() | second.keys()}
    for name, wanted in (("bm25 only", alone(first)), ("vectors only", alone(second)), ("hybrid, no rerank", both)):
        same(found.where(found.configuration == name), best(wanted, 3))
    # of the fused ones, the reranked are the best by coverage, phrase and position
    position, text, ask = best(both, 99), dict(chunks), dict(asked)
    tokens = lambda t: {w for w in re.findall("[a-z0-9]+", t.lower()) if w not in retrieval.STOP_WORDS}
    score = lambda q, d: (2 * len(tokens(ask[q]) & tokens(text[d])) / len(tokens(ask[q])) if tokens(ask[q]) else 0) + 1.5 * (ask[q].strip().lower() != "" and ask[q].strip().lower() in text[d].lower())
    same(found.where(found.configuration == "hybrid + rerank"), best({x: score(*x) + 1 / r for x, (r, _) in position.items()}, 3))
    assert found._jdf.queryExecution().withCachedData().toString().count("InMemoryRelation") == 6


def test_holding(spark):
    """First words in a row, across blanks and signs, in any text of an id; not across texts, nor for shorter questions."""
    chunks, asked, left, right = tables(spark)
    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    for size in (1, 2, 3):
        phrases = {(q, tuple(words(t)[:size])) for q, t in asked if len(words(t)) >= size}
        runs = [(d, {tuple(words(t)[i : i + size]) for i in range(len(words(t)) - size + 1)}) for d, t in chunks]
        got = [tuple(r) for r in scores.holding(left, right, size).collect()]
        assert sorted(got, key=str) == sorted({(q, d) for q, p in phrases for d, r in runs if p in r}, key=str) and len(got) > 3
    assert scores.holding(left, right, 40).count() == scores.holding(left.limit(0), right, 1).count() == scores.holding(left, right.limit(0), 1).count() == 0
    plan = scores.holding(left, right, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
