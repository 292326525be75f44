"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton of all items (words as letters) is built once; each training text streams through it
left to right, and the state together with the longest matching length tells at every word which
item strings end there.  A word is hit where a window (13 item words, or a whole shorter item)
covers it.

The items are shipped to the executors in automata of at most ``max_words`` item words each; a
benchmark beyond that bound makes several passes, whose hits are united, so that no broadcast
grows with it.

Defined results.  A null or wordless text has no words and no hits and is not contaminated.  A null
or wordless item has no window.  Items that repeat count once per item_id; the windows of an item
without an id hit words, but the item is not listed.  Other columns may have any names.  Repeated documents are judged each on its own.  With an empty benchmark nothing is hit.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, ship

WINDOW = 13
#: Item words of one automaton, which takes about 100 MB in each worker then.
MAX_ITEM_WORDS = 250_000

_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().translate(_TABLE).split() if text else []


class Automaton:
    """Suffix automaton over the words of many items."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.code: dict[bytes, int] = {}
        self.arcs: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        coded = [(i, [self.code.setdefault(w, len(self.code)) for w in ws]) for i, ws in items]
        for _, item in coded:
            last = 0
            for w in item:
                last = self._extend(last, w)
        #: (window length, items) of the windows whose string lies in a state
        self.accept: dict[int, list[tuple[int, set]]] = {}
        for item_id, item in coded:
            state = length = 0
            size = min(window, len(item))
            for w in item:
                state, length = self._step(state, length, w)
                if length >= size:
                    self._mark(state, size, item_id)
                    if size < window:
                        break
        self._inherit()
        # frozen: one table of arcs, packed lengths and links, and equal acceptances only once
        self.arc = {s << 32 | w: t for s, arcs in enumerate(self.arcs) for w, t in arcs.items()}
        self.length, self.link = array("i", self.length), array("i", self.link)
        once: dict = {}
        self.accept = {s: once.setdefault(a, a) for s, a in ((s, tuple((k, tuple(sorted(ids, key=str))) for k, ids in a)) for s, a in self.accept.items())}
        del self.arcs

    def _new(self, length: int, arcs: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.arcs.append(arcs)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.arcs[q]), self.link[q])
        while p >= 0 and self.arcs[p].get(w) == q:
            self.arcs[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.arcs[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        state = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.arcs[p]:
            self.arcs[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.arcs[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return state

    def _step(self, state: int, length: int, w: int) -> tuple[int, int]:
        while state and w not in self.arcs[state]:
            state = self.link[state]
            length = self.length[state]
        nxt = self.arcs[state].get(w)
        return (nxt, length + 1) if nxt is not None else (0, 0)

    def _mark(self, state: int, size: int, item_id: object) -> None:
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        for k, ids in self.accept.setdefault(state, []):
            if k == size:
                if item_id is not None:
                    ids.add(item_id)
                return
        self.accept[state].append((size, set() if item_id is None else {item_id}))

    def _inherit(self) -> None:
        """Along the suffix links: every state learns the windows of its shorter suffixes."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            if above := self.accept.get(self.link[state]):
                self.accept[state] = self.accept.get(state, []) + above
        self.accept = {s: sorted(a, key=lambda x: -x[0]) for s, a in self.accept.items()}

    def match(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged hit ranges over the words, and the items whose windows occur."""
        code, arc, link, lengths, accept = self.code.get, self.arc.get, self.link, self.length, self.accept
        state = length = 0
        ranges: list[tuple[int, int]] = []
        found: set = set()
        for i, w in enumerate(map(code, ws)):
            if w is None:
                state = length = 0
                continue
            nxt = arc(state << 32 | w)
            if nxt is None:
                while nxt is None:
                    state = link[state]
                    nxt = arc(state << 32 | w)
                length = lengths[state] + 1
            else:
                length += 1
            state = nxt
            if state in accept:
                fits = [a for a in accept[state] if a[0] <= length]
                if fits:
                    start = i + 1 - fits[0][0]
                    if ranges and start <= ranges[-1][1]:
                        while len(ranges) > 1 and start <= ranges[-2][1]:
                            start = min(start, ranges.pop(-2)[0])
                        ranges[-1] = (min(start, ranges[-1][0]), i + 1)
                    else:
                        ranges.append((start, i + 1))
                    for _, ids in fits:
                        found.update(ids)
        return _united(ranges), found


def _united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automata(benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_ITEM_WORDS) -> Iterator[Automaton]:
    """Automata over all items, each within the word bound; items arrive one partition at a time."""
    batch: list = []
    size = 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        if not (ws := words(row["text"])):
            continue
        if batch and size + len(ws) > max_words:
            yield Automaton(batch, window)
            batch, size = [], 0
        batch.append((row["item_id"], ws))
        size += len(ws)
    yield Automaton(batch, window)


FOUND = ("n_words", "starts", "ends", "items")
FOUND_KINDS = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))


def _schema(docs: DataFrame, columns: list[str]) -> str:
    types = dict(docs.dtypes)
    return ", ".join(f"`{c}` {types[c]}" for c in columns)


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, max_words: int, kept: list[str], into: tuple[str, ...], finish: Callable[[list[pa.Array], list[tuple]], pa.RecordBatch] | None = None) -> DataFrame:
    """One pass per automaton over the columns ``kept``; each adds to the hits of the passes before it.

    The last pass hands the columns of a batch and its rows of hits to ``finish``, which returns a batch
    of ``kept``: a pass of its own would hold another Python worker beside each one that matches.
    """
    ship(docs.sparkSession)
    n_words, starts, ends, items = into
    plain = _schema(docs, kept)
    schema = plain + f", `{n_words}` long, `{starts}` array<int>, `{ends}` array<int>, `{items}` array<string>"
    at, width = kept.index("text"), len(kept)
    out = docs.select(*(F.col(f"`{c}`") for c in kept))
    todo = automata(benchmark, window, max_words)
    automaton, k = next(todo), 0
    while automaton is not None:
        shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(automaton, protocol=5))
        automaton = next(todo, None)
        ending = finish if automaton is None else None

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, first=k == 0, ending=ending) -> Iterator[pa.RecordBatch]:
            tester: Automaton = pickle.loads(shipped.value)
            for batch in batches:
                before = [None] * len(batch) if first else list(zip(*(batch.column(width + j).to_pylist() for j in (1, 2, 3)), strict=True))
                rows = []
                for text, old in zip(batch.column(at).to_pylist(), before, strict=True):
                    ws = words(text)
                    ranges, ids = tester.match(ws)
                    ids = set(map(str, ids))
                    if old is not None:
                        ranges = _united([*ranges, *zip(old[0], old[1], strict=True)])
                        ids |= set(old[2])
                    rows.append((len(ws), [a for a, _ in ranges], [b for _, b in ranges], sorted(ids)))
                if ending is not None:
                    yield ending(batch.columns[:width], rows)
                    continue
                made = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(FOUND_KINDS)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=[*kept, *into])

        out = out.mapInArrow(run, schema if ending is None else plain)
        k += 1
    return out


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_ITEM_WORDS, carry: tuple[str, ...] = (), into: tuple[str, ...] = FOUND) -> DataFrame:
    """doc_id, text, the columns of ``carry``, and under the names of ``into``: the number of words, the
    starts and ends of hit ranges over words, and the items.
    """
    return _passes(docs, benchmark, window, max_words, list(dict.fromkeys(("doc_id", "text", *carry))), into)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest: a document is contaminated if its hit words are a twentieth of its words or more."""
    hit = F.coalesce(F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))
    return find(docs, benchmark).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )


def cut(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the words of the ranges and what separates them."""
    raw = text.encode("utf-8", "replace")
    flags = np.frombuffer(raw.lower().translate(_TABLE), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    begin, end = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in ranges:
        out.append(raw[at : begin[a]])
        at = int(end[b - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def clean(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.05, max_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """Rows of ``docs``: those with hit words at ``max_share`` or more go, shorter hits are cut out of the text."""
    columns = docs.columns
    at = columns.index("text")

    def cleaned(batch: list[pa.Array], rows: list[tuple]) -> pa.RecordBatch:
        hit = [sum(ends) - sum(starts) for _, starts, ends, _ in rows]
        stays = pa.array([h == 0 or h < max_share * r[0] for h, r in zip(hit, rows, strict=True)], pa.bool_())
        texts = [cut(t, list(zip(starts, ends, strict=True))) if starts else t for t, (_, starts, ends, _) in zip(batch[at].to_pylist(), rows, strict=True)]
        made = [pa.array(texts, pa.string()) if j == at else column for j, column in enumerate(batch)]
        return pa.RecordBatch.from_arrays(made, names=columns).filter(stays)

    into = tuple(fresh(name, columns) for name in FOUND)
    return _passes(docs, benchmark, WINDOW, max_words, columns, into, cleaned)


def oracle() -> str:
    return r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT k, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
covered AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hits) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT k, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (k) LEFT JOIN items USING (k)"""
