"""LM scoring with a weighted backoff automaton.

*Model.*  Trigrams, smoothed by a Dirichlet prior from the next lower order, over the unigram base:

    p(w)    = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w|v)  = (c(vw) + A p(w)) / (c(v) + A)
    p(w|uv) = (c(uvw) + B p(w|v)) / (c(uv) + B)

A seen context is a state.  A seen n-gram is an arc with its smoothed log-probability, leading to the
longest context that the text then ends in; every state has a failure arc to the context without its
first word, weighing A / (c(v) + A) or B / (c(uv) + B); the root has an arc for every token, the unknown
ones sharing one weight.  A text is one left-to-right traversal from the start state to its end token,
which carries the state, takes failure arcs until an arc fits, and adds up the weights.

*At scale.*  Counts cover all training documents and nothing is pruned.  The automaton of a large corpus
fits no single machine, so it is never broadcast: each block of documents learns the counts of its own
n-grams (``exchange``), builds the states and arcs that its texts can take, and traverses.  As a
smoothed weight needs counts of n-grams only, no task ever gathers the followers of one context.

Defined results.  A null text counts as empty: one token, the end.  With nothing to learn from every
token has p = 0.5 / 0.5 = 1.  Repeated rows count and are scored each on its own; a null id is in the
training fold.  Further columns of the input are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_count, fold, mix, ship
from .exchange import KIND, answers, deal, gathered, questions, shape, tally

BLOCK_BYTES = 10_000_000
START, END = 0, 1  # numbers of the start of a text, and of its end token
#: Weights of the lower order, A for pairs and B for triples.
PRIOR_PAIR, PRIOR_TRIPLE = 10.0, 4.0
#: Texts are traversed side by side, in stretches of so many tokens.
STRETCH = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The number of each word, the words of each text, and the distinct words; the first two numbers are taken."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    filled = pc.not_equal(flat, "")  # white space at either end splits off empty strings
    coded = flat.filter(filled).dictionary_encode()
    number = coded.indices.to_numpy() + 2
    return number, np.bincount(parent.filter(filled).to_numpy(), minlength=len(texts)), coded.dictionary.to_pylist()


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values start."""
    return np.flatnonzero(np.concatenate((np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1])))


class Block:
    """The tokens of a block's texts and its distinct n-grams, whatever the order of the texts."""

    def __init__(self, texts: pa.Array, train: np.ndarray):
        number, per, distinct = words(texts)
        self.n = n = len(distinct) + 2
        self.sizes = per + 1
        self.ends = np.cumsum(self.sizes)
        self.firsts = self.ends - self.sizes
        self.token = np.full(int(self.sizes.sum()), END, np.int32)
        last = np.zeros(len(self.token), bool)
        last[self.ends - 1] = True
        self.token[~last] = number
        del number
        before = np.concatenate((np.full(1, START, np.int32), self.token[:-1]))[: len(self.token)]
        before[self.firsts] = START
        learning = np.repeat(train, self.sizes)
        single_counts = np.bincount(self.token[learning], minlength=n)
        single_counts[START] = train.sum()
        pair = before.astype(np.int64) * n + self.token
        order = np.argsort(pair)
        pair = pair[order]
        first = _runs(pair)
        self.pairs, at = pair[first], np.empty(len(pair), np.int32)
        at[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(pair))))
        pair_counts = np.bincount(at[learning], minlength=len(first))
        del pair, order, first
        inner = np.flatnonzero(before != START)
        triple = (at[inner - 1].astype(np.int64) * n + self.token[inner]) * 2 + learning[inner]
        del at, before, inner
        triple.sort()
        first = _runs(triple >> 1)
        self.triples = triple[first] >> 1
        triple_counts = np.add.reduceat(triple & 1, first) if len(first) else np.zeros(0, np.int64)
        del triple, first
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, ["\n", " ", *distinct]), np.uint64, n)  # no word has white space
        # the lowest bit marks what counts as a token
        one = mix(hashes) | np.uint64(1)
        one[START] ^= np.uint64(1)
        two = mix(mix(hashes[self.pairs // n] + _ODD) + hashes[self.pairs % n] * _ODD)
        three = mix(two[self.triples // n] * _ODD + hashes[self.triples % n]) & ~np.uint64(1)
        keys = np.concatenate((one, two & ~np.uint64(1), three))
        self.order = np.argsort(keys)
        self.keys, self.counts = keys[self.order], np.concatenate((single_counts, pair_counts, triple_counts))[self.order]


def totals(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All training tokens, and the distinct ones."""
    token = (keys & np.uint64(1)).astype(bool)
    return np.array([counts[token].sum(), (counts[token] > 0).sum()], np.int64)


class Slots:
    """Distinct non-negative keys in a table with open addressing."""

    def __init__(self, keys: np.ndarray):
        self.mask = (1 << (len(keys) + len(keys) // 3 + 1).bit_length()) - 1
        self.keys, self.number = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]  # of several keys for a slot the last one gets it
            won = self.keys[slot] == keys[left]
            self.number[slot[won]] = left[won]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Which key each one is, or -1."""
        out, left, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._slot(keys)
        while len(left):
            held = self.keys[slot]
            same = held == keys[left]
            out[left[same]] = self.number[slot[same]]
            on = ~same & (held >= 0)
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out


class Automaton:
    """The states and arcs that a block's texts can take.

    State 0 is the root, 1 + v the context v, 1 + n + k the context of the block's k-th pair.
    """

    def __init__(self, block: Block, total: np.ndarray, sums: np.ndarray):
        n, pairs, triples = block.n, block.pairs, block.triples
        count = np.empty(len(sums), np.int64)
        count[block.order] = sums
        del sums, block.order, block.keys, block.counts  # the largest arrays, no longer needed
        one, two, three = np.split(count, [n, n + len(pairs)])
        self.n, self.total = n, int(total[0])
        self.known = one > 0
        p1 = (one + 0.5) / (total[0] + 0.5 * (total[1] + 1))
        u, v = pairs // n, pairs % n
        p2 = (two + PRIOR_PAIR * p1[v]) / (one[u] + PRIOR_PAIR)
        at, w = triples // n, triples % n
        lower = np.searchsorted(pairs, v[at] * n + w)
        p3 = (three + PRIOR_TRIPLE * p2[lower]) / (two[at] + PRIOR_TRIPLE)
        self.root = np.log10(p1)
        word = np.arange(n)
        self.root_to = np.where((one > 0) & (word > END), 1 + word, 0)
        seen2, seen3 = two > 0, three > 0
        self.arcs = Slots(np.concatenate(((1 + u)[seen2] * n + v[seen2], (1 + n + at[seen3]) * n + w[seen3])))
        self.weight = np.log10(np.concatenate((p2[seen2], p3[seen3])))
        del p2, p3
        self.to = np.concatenate((np.where(v == END, 0, 1 + n + np.arange(len(pairs)))[seen2], np.where(w == END, 0, 1 + n + lower)[seen3])).astype(np.int32)
        self.fail = np.log10(np.concatenate(([1.0], PRIOR_PAIR / (one + PRIOR_PAIR), PRIOR_TRIPLE / (two + PRIOR_TRIPLE))))
        self.back = np.concatenate((np.zeros(1 + n, np.int64), np.where(one[v] > 0, 1 + v, 0))).astype(np.int32)
        self.start = 1 + START if one[START] else 0

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and the weights of the failure arcs and the arc taken."""
        gained, to = np.zeros(len(state)), np.zeros(len(state), np.int64)
        open_ = np.arange(len(state))
        while len(open_):
            here, t = state[open_], token[open_]
            top = here == 0
            done = open_[top]
            gained[done] += self.root[token[done]]
            to[done] = self.root_to[token[done]]
            open_, here, t = open_[~top], here[~top], t[~top]
            if not len(open_):
                break
            arc = self.arcs.find(here * self.n + t)
            fits = arc >= 0
            gained[open_[fits]] += self.weight[arc[fits]]
            to[open_[fits]] = self.to[arc[fits]]
            open_, here = open_[~fits], here[~fits]
            gained[open_] += self.fail[here]
            state[open_] = self.back[here]
        return to, gained

    def traverse(self, block: Block) -> np.ndarray:
        """The texts' scores.  Long texts are cut into stretches; as a state recalls two tokens at most,
        a stretch that reads the two tokens before it, unweighed, starts in the state of the whole text."""
        pieces = -(-block.sizes // STRETCH)
        doc = np.repeat(np.arange(len(pieces)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = block.firsts[doc] + nth * STRETCH
        size = np.minimum(block.ends[doc] - begin, STRETCH)
        order = np.argsort(-size, kind="stable")
        doc, nth, begin, size = doc[order], nth[order], begin[order], size[order]
        score, state = np.zeros(len(doc)), np.where(nth == 0, self.start, 0)
        later = np.flatnonzero(nth > 0)
        for back in (2, 1):
            state[later], _ = self.step(state[later], block.token[begin[later] - back])
        active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        for t, k in enumerate(active.tolist()):
            state[:k], gained = self.step(state[:k], block.token[begin[:k] + t])
            score[:k] += gained
        return np.bincount(doc, weights=score, minlength=len(pieces))


def score(docs: DataFrame, held_out: F.Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    ship(docs.sparkSession)
    blocks = block_count(docs, "text", block_bytes)
    bits = shape(blocks)[1]
    held_out = (fold("doc_id", 5) == 1) if held_out is None else held_out
    dealt = deal(docs.select("doc_id", "text", held_out.alias("held_out")), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def built(table: pa.Table) -> Block:
        pa.set_memory_pool(pa.system_memory_pool())  # gives back at once what a block has used
        return Block(table.column("text").combine_chunks(), ~table.column("held_out").to_numpy())

    def ask(batch: pd.DataFrame) -> pd.DataFrame:
        block = built(gathered(list(batch["rows"])))
        return questions(int(batch["g"].iat[0]), block.keys, block.counts, bits)

    def scored(rows: pa.Table, told: pa.Table) -> pa.Table:
        table = gathered(rows.column("rows").to_pylist())
        block = built(table)
        automaton = Automaton(block, *answers(told.to_pandas()))
        doc, n = np.repeat(np.arange(len(block.sizes)), block.sizes), len(block.sizes)
        known = np.bincount(doc, weights=automaton.known[block.token], minlength=n).astype(np.int64)
        base = np.bincount(doc, weights=automaton.root[block.token], minlength=n)
        made = [block.sizes, known, np.full(n, automaton.total), base, automaton.traverse(block)]
        return pa.table([table.column("doc_id"), table.column("held_out"), *map(pa.array, made)], names=[x.split()[0] for x in kinds])

    kinds = [f"doc_id {dict(docs.dtypes)['doc_id']}", "held_out boolean", "n_tokens long", "n_known long", "train_tokens long", "base_score double", "score double"]
    told = tally(dealt.groupBy("g").applyInPandas(ask, KIND), blocks, totals)
    return dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(scored, ", ".join(kinds))
