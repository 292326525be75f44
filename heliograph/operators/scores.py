"""Exact scores of texts against questions, in Arrow batches of the texts.

The questions travel to the texts, at most PASS characters of them in one pass.  A task works on pieces of
its texts and on blocks of questions, so its arrays are bounded; of each piece it passes on only what
can still be among the best of a question.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.sources.package import ship

PASS, BLOCK, PIECE, ROWS, CELLS = 1 << 25, 256, 1 << 20, 2048, 1 << 21
_RUN = np.zeros(256, bool)
_RUN[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True


def merged(texts: DataFrame, text: Column) -> DataFrame:
    """id, texts: an id's texts count as one; they are gathered only where an id stands twice."""
    if texts.groupBy("id").count().where("count > 1").isEmpty():
        return texts.select("id", F.array(text).alias("texts"))
    return texts.groupBy("id").agg(F.collect_list(text).alias("texts"))


def passes(queries: DataFrame, text: Column) -> Iterator[pa.Table]:
    """qid, texts of the questions, in tables of at most PASS characters or of one question."""
    rows = queries.groupBy("qid").agg(F.collect_list(text).alias("texts")).toArrow().combine_chunks()
    sizes = np.cumsum([sum(map(len, t)) for t in rows["texts"].to_pylist()], dtype=np.int64)
    yield from (rows.slice(i, j - i) for i, j in _cuts(sizes, PASS, 1 << 30))


def _cuts(ends: np.ndarray, size: int, rows: int) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(ends):
        j = min(max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, "right"))), i + rows)
        yield i, j
        i = j


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """ids, texts, and the position of each text's id."""
    for batch in batches:
        column = batch.column("texts")
        held = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))])
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(column.flatten()).to_numpy(zero_copy_only=False), dtype=np.int64)])[held[1:]]
        for i, j in _cuts(ends, PIECE, ROWS):
            yield batch.column("id").slice(i, j - i), column.slice(i, j - i).flatten(), np.repeat(np.arange(j - i), np.diff(held[i : j + 1]))


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs of a-z and 0-9 in lower-cased texts, and the position of each one's text."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at -= at[0]
    inside = _RUN[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    opens = at[:-1][at[:-1] < len(raw)]
    first[opens] = inside[opens]
    begins, kept = np.flatnonzero(first), raw[inside]
    cuts = np.append((np.cumsum(inside) - 1)[begins], len(kept)).astype(np.int32)
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(cuts), pa.py_buffer(kept)), np.searchsorted(at, begins, "right") - 1


def _codes(tokens: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(tokens, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)


def grams(texts: list[str], owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, gram, count of the n-grams of code points, in order; a gram's number is exact, not a hash."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    letters = int(seen.sum())
    points = (np.cumsum(seen) - 1)[points]
    keys, span = points, max(letters, 1)
    rank = lambda keys: np.unique(keys, return_inverse=True)[1]
    for j in range(1, n):
        if span * letters >= 2**62:
            keys, span = rank(keys), len(keys) + 1
        keys, span = keys[:-1] * letters + points[j:], span * max(letters, 1)
    whole = text[: len(keys)] == text[n - 1 :]
    keys, owners = keys[whole], owner[text[: len(whole)][whole]]
    if span * (int(owner.max(initial=0)) + 1) >= 2**62:
        keys, span = rank(keys), len(keys) + 1
    both, counts = np.unique(owners * span + keys, return_counts=True)
    return both // span, both % span, counts.astype(float)


def _postings(owner: np.ndarray, key: np.ndarray, value: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start by key, owner, value."""
    order = np.argsort(key, kind="stable")
    return np.searchsorted(key[order], np.arange(keys + 1)), owner[order], value[order]


def _sums(row: np.ndarray, key: np.ndarray, value: np.ndarray, postings: tuple, rows: int, asked: int) -> np.ndarray:
    """asked x rows: the sum over shared keys of both values' product."""
    start, who, weight = postings
    n = start[key + 1] - start[key]
    out = np.zeros(asked * rows)
    for i, j in _cuts(np.cumsum(n), CELLS, len(n)):
        m = n[i:j]
        at = np.repeat(start[key[i:j]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        out += np.bincount(who[at] * rows + np.repeat(row[i:j], m), np.repeat(value[i:j], m) * weight[at], asked * rows)
    return out.reshape(asked, rows)


class _Best:
    """What of each piece can be among the ``k`` best of a question by rounded score, then id."""

    def __init__(self, qids: pa.Array, k: int, digits: int, schema: pa.Schema):
        self.qids, self.k, self.digits, self.schema, self.floor = qids, k, digits, schema, np.zeros(len(qids))

    def of(self, ids: pa.Array, first: int, scores: np.ndarray) -> pa.RecordBatch:
        asked, rows = scores.shape
        rounded = np.where(scores > 0, np.round(scores, self.digits), -1.0)
        floor = self.floor[first : first + asked]
        if rows >= self.k:
            np.maximum(floor, np.partition(rounded, rows - self.k, axis=1)[:, rows - self.k], out=floor)
        q, d = np.nonzero(rounded >= floor[:, None])
        order = np.lexsort((pc.rank(ids, sort_keys="ascending", tiebreaker="first").to_numpy()[d], -rounded[q, d], q))
        q, d = q[order], d[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        q, d = q[kept], d[kept]
        return pa.RecordBatch.from_arrays([self.qids.take(pa.array(q + first)), ids.take(pa.array(d)), pa.array(scores[q, d])], schema=self.schema)


def _scored(texts: DataFrame, queries: DataFrame, work: Callable) -> DataFrame:
    ship(texts.sparkSession)
    fields = [T.StructField("qid", queries.schema["qid"].dataType), T.StructField("id", texts.schema["id"].dataType), T.StructField("score", T.DoubleType())]
    return texts.where("id is not null").mapInArrow(work, T.StructType(fields))


def _together(parts: Iterable[DataFrame], queries: DataFrame, texts: DataFrame) -> DataFrame:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out if out is not None else queries.crossJoin(texts.select("id")).select("qid", "id", F.lit(0.0).alias("score")).limit(0)


def _schema(qids: pa.Array, ids: pa.Array) -> pa.Schema:
    return pa.schema([("qid", qids.type), ("id", ids.type), ("score", pa.float64())])


def bm25(chunks: DataFrame, queries: DataFrame, stop: list[str], k: int, k1: float, b: float, digits: int) -> DataFrame:
    """qid, id, score: at least the ``k`` best chunks of each question; two passes over the chunks."""
    lower = F.lower(F.coalesce("text", F.lit("")))
    texts = merged(chunks, lower)

    def one(part: pa.Table) -> DataFrame:
        qids, flat = part["qid"].combine_chunks(), part["texts"].combine_chunks()
        found, at = words(flat.flatten())
        owner = np.repeat(np.arange(len(qids)), pc.list_value_length(flat).to_numpy(zero_copy_only=False))[at]
        plain = _codes(found, pa.array(stop)) < 0
        found, owner = found.filter(pa.array(plain)), owner[plain]
        terms = pc.unique(found)
        vocabulary, size, skip = pa.concat_arrays([pa.array(stop), terms]), len(terms), len(stop)
        both, times = np.unique(owner * max(size, 1) + _codes(found, terms), return_counts=True)
        owner, term, times = both // max(size, 1), both % max(size, 1), times.astype(float)

        def read(piece: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """row, term, times of the questions' terms; the length of each text."""
            _, text, group = piece
            tokens, at = words(text)
            code = _codes(tokens, vocabulary)
            raw = np.bincount(at[(code < 0) | (code >= skip)], minlength=len(text))
            asked = code >= skip
            both, times = np.unique(group[at[asked]] * max(size, 1) + (code[asked] - skip), return_counts=True)
            return both // max(size, 1), both % max(size, 1), times, raw

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df = np.zeros(size + 2, np.int64)
            for piece in _pieces(batches):
                _, term, _, raw = read(piece)
                df[:size] += np.bincount(term, minlength=size)
                df[size:] += len(raw), raw.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2)), pa.array(df)], ["term", "df"])

        ship(chunks.sparkSession)
        counted = texts.mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        df = np.zeros(size + 2)
        df[counted["term"].to_numpy()] = counted["df"].to_numpy()
        n, total, df = df[size], df[size + 1], df[:size]
        mean = total / n if total > 0 else 1.0
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        blocks = []
        for i in range(0, len(qids), BLOCK):
            own = (owner >= i) & (owner < i + BLOCK)
            blocks.append((i, min(BLOCK, len(qids) - i), _postings(owner[own] - i, term[own], times[own], size)))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for piece in _pieces(batches):
                ids, text, group = piece
                best = best or _Best(qids, k, digits, _schema(qids, ids))
                row, term, tf, raw = read(piece)
                # each text of an id weighs the id's counts by its own length
                norm = k1 * (1 - b + b * np.maximum(raw, 1) / mean)
                held = np.bincount(group, minlength=len(ids))
                at = np.repeat((np.cumsum(held) - held)[row], held[row]) + np.arange(held[row].sum()) - np.repeat(np.cumsum(held[row]) - held[row], held[row])
                entry = np.repeat(np.arange(len(row)), held[row])
                weight = np.bincount(entry, (idf[term] * tf * (k1 + 1))[entry] / (tf[entry] + norm[at]), len(row))
                for first, asked, postings in blocks:
                    yield best.of(ids, first, _sums(row, term, weight, postings, len(ids), asked))

        return _scored(texts, queries, score)

    return _together(map(one, passes(queries, F.lower(F.coalesce("text", F.lit(""))))), queries, chunks)


def cosine(chunks: DataFrame, queries: DataFrame, text: Column, n: int, k: int, digits: int) -> DataFrame:
    """qid, id, score: at least the ``k`` best chunks of each question by the cosine of n-gram counts of ``text``."""
    texts = merged(chunks, text)

    def one(part: pa.Table) -> DataFrame:
        part = part.filter(pc.is_valid(part["qid"]))
        qids, asked = part["qid"].combine_chunks(), part["texts"].to_pylist()

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for ids, held, group in _pieces(batches):
                best = best or _Best(qids, k, digits, _schema(qids, ids))
                own = held.to_pylist()
                for first in range(0, len(asked), BLOCK):
                    block = asked[first : first + BLOCK]
                    m = len(block)
                    owner = np.concatenate([np.repeat(np.arange(m), [len(t) for t in block]), m + group])
                    row, gram, count = grams([x for t in block for x in t] + own, owner, n)
                    norm = np.sqrt(np.bincount(row, count * count, m + len(ids)))
                    cut = np.searchsorted(row, m)
                    keys = np.unique(gram[:cut])
                    postings = _postings(row[:cut], np.searchsorted(keys, gram[:cut]), count[:cut], len(keys))
                    at = np.searchsorted(keys, gram[cut:])
                    shared = np.append(keys, -1)[at] == gram[cut:]
                    dots = _sums(row[cut:][shared] - m, at[shared], count[cut:][shared], postings, len(ids), m)
                    with np.errstate(invalid="ignore"):
                        yield best.of(ids, first, np.nan_to_num(dots / (norm[None, m:] * norm[:m, None])))

        return _scored(texts, queries, score)

    return _together(map(one, passes(queries, text)), queries, chunks)


def holding(chunks: DataFrame, queries: DataFrame, size: int) -> DataFrame:
    """qid, id: the chunks that hold the first ``size`` words of a question in a row; a shorter question is in none."""
    ship(chunks.sparkSession)
    lower = F.lower(F.coalesce("text", F.lit("")))

    def one(part: pa.Table) -> DataFrame:
        qids, flat = part["qid"].combine_chunks(), part["texts"].combine_chunks()
        found, at = words(flat.flatten())
        vocabulary = pc.unique(found)
        codes, ends = _codes(found, vocabulary).astype(np.int64), np.bincount(at, minlength=int(pc.sum(pc.list_value_length(flat)).as_py() or 0))
        starts = (np.cumsum(ends) - ends)[ends >= size]
        of = np.repeat(np.arange(len(qids)), pc.list_value_length(flat).to_numpy(zero_copy_only=False))[ends >= size]
        # a number for each beginning of a phrase, level by level
        width, state, levels = max(len(vocabulary), 1), np.zeros(len(starts), np.int64), []
        for j in range(size):
            known, state = np.unique(state * width + codes[starts + j], return_inverse=True)
            levels.append(known)
        by_state = _postings(of, state, of, len(levels[-1]))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, texts, group in _pieces(batches):
                tokens, text = words(texts)
                code = _codes(tokens, vocabulary).astype(np.int64)
                spot = np.flatnonzero(text[: len(text) - size + 1] == text[size - 1 :]) if len(text) >= size else np.zeros(0, np.int64)
                state = np.zeros(len(spot), np.int64)
                for j, known in enumerate(levels):
                    word = code[spot + j]
                    key = state * width + word
                    at = np.searchsorted(known, key)
                    met = (word >= 0) & (np.append(known, -1)[at] == key)
                    spot, state = spot[met], at[met]
                n = by_state[0][state + 1] - by_state[0][state]
                at = np.repeat(by_state[0][state] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                pairs = np.unique(by_state[1][at] * max(len(ids), 1) + np.repeat(group[text[spot]], n))
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(pairs // max(len(ids), 1))), ids.take(pa.array(pairs % max(len(ids), 1)))], ["qid", "id"])

        fields = [T.StructField("qid", queries.schema["qid"].dataType), T.StructField("id", chunks.schema["id"].dataType)]
        return chunks.select("id", F.array(lower).alias("texts")).mapInArrow(find, T.StructType(fields))

    return _together(map(one, passes(queries, lower)), queries, chunks).select("qid", "id").distinct()
