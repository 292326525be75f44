"""Suffix-array dedup: remove bytes of 100-byte strings that also start earlier.

1. A window's key is the least hash of the 32-byte strings in it, so equal windows have equal keys.
   Consecutive windows with one key form a run.  Keys with a single place in the whole corpus
   belong to unique strings, and drop out; the places are counted along a tree of key ranges.
2. A key with more than ``HOT`` places is split: its runs are cut further by the least hashes under
   other functions, as many as its count asks for.  Equal windows still share all of them.
3. The runs that stay are sent, once per block and string, to the shard of their keys; empty messages
   aren't sent.  A shard concatenates the distinct strings; it builds their suffix array by induced
   sorting (classify suffixes, sort the leftmost-smaller substrings, name them and sort the names by
   doubling, induce the larger and the smaller suffixes bucket by bucket), computes the permuted common
   prefixes up to the window length, and finds for every window the earliest start among its equals.
   A string that is alone under its keys and doesn't repeat in itself has no equals but its own copies.
4. Blocks unite the removed windows of their documents.

Defined results.  A null text counts as empty; a text under 100 bytes loses nothing.  Of rows that
share a doc_id (or have none) none starts earlier than the other, as (id, start) decides; rows without
an id come after all others.  Ids that are no integers are ordered as text.  Other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_count, mix, ship
from .exchange import KIND, answers, deal, gathered, pack, questions, shape, tally, unpack

WINDOW, GRAM = 100, 32
BLOCK_BYTES = 12_000_000
CHUNK = 1 << 16
#: Places of a key beyond which its runs are split, and the most functions that split them.
HOT, MOST_CUTS = 4000, 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Rolling:
    """Hashes of all substrings of a length, by prefix sums modulo 2^64."""

    def __init__(self):
        self.power = self.back = np.ones(1, np.uint64)

    def __call__(self, b: np.ndarray, *lengths: int) -> list[np.ndarray]:
        n = len(b)
        if len(self.power) <= n:
            size = max(n + 1, CHUNK * 2)
            self.power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, _BASE))))
            self.back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, _INVERSE))))
        total = np.concatenate(([np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.power[:n])))
        return [mix((total[k:] - total[:-k]) * self.back[: n - k + 1]) if n >= k else np.zeros(0, np.uint64) for k in lengths]


SPAN = WINDOW - GRAM + 1  # gram starts in a window


def sliding(m: np.ndarray, least: bool) -> np.ndarray:
    """Minimum or maximum of every ``SPAN`` consecutive values."""
    pick, width = np.minimum if least else np.maximum, 1
    while width * 2 <= SPAN:
        m = pick(m[:-width], m[width:])
        width *= 2
    return pick(m[: len(m) - (SPAN - width)], m[SPAN - width :])


def runs(texts: list[bytes], rolling: Rolling) -> tuple[np.ndarray, ...]:
    """document number, first start, number of starts and key of each run; then the key of each place
    of a least gram, and whether the key was already there so close that a run may repeat in itself.
    """
    found: list[tuple] = []
    places: list[tuple] = []

    def flush(part: list[int]) -> None:
        b = np.frombuffer(b"".join(texts[i] for i in part), np.uint8)
        (grams,) = rolling(b, GRAM)
        keys = sliding(grams, True)
        sizes = np.array([len(texts[i]) for i in part], np.int64)
        starts = np.cumsum(sizes) - sizes
        own = np.repeat(np.arange(len(part)), sizes - WINDOW + 1)
        place = np.arange(len(own)) - np.repeat(np.cumsum(sizes - WINDOW + 1) - (sizes - WINDOW + 1), sizes - WINDOW + 1)
        valid = starts[own] + place
        inside = np.zeros(len(keys) + 2 * (SPAN - 1), np.uint64)
        inside[valid + SPAN - 1] = keys[valid]
        at = np.flatnonzero(sliding(inside, False) == grams)
        order = np.lexsort((at, grams[at]))
        o, g = at[order], grams[at][order]
        close = np.zeros(len(at), bool)
        close[order[1:]] = (g[1:] == g[:-1]) & (o[1:] - o[:-1] <= SPAN)
        places.append((mix(grams[at]), close))
        keys = keys[valid]
        first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (own[1:] != own[:-1]))))
        # least hashes are small; mixed again they spread over all key ranges
        found.append((np.array(part)[own[first]], place[first], np.diff(np.append(first, len(keys))), mix(keys[first])))

    part, size = [], 0
    for i, t in enumerate(texts):
        if len(t) >= WINDOW:
            part.append(i)
            size += len(t)
            if size >= CHUNK:
                flush(part)
                part, size = [], 0
    if part:
        flush(part)
    if not found:
        return tuple(np.zeros(0, d) for d in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    return (*map(np.concatenate, zip(*found, strict=True)), *map(np.concatenate, zip(*places, strict=True)))


# --- suffix arrays ---


def _bucket_place(sa: np.ndarray, heads: np.ndarray, s: np.ndarray, j: np.ndarray, down: bool) -> None:
    """Append suffixes ``j``, in order, to the heads (or, downwards, the tails) of their buckets."""
    if not len(j):
        return
    c = s[j]
    order = np.argsort(c, kind="stable")
    c, j = c[order], j[order]
    first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    per = np.diff(np.append(first, len(c)))
    nth = np.arange(len(c)) - np.repeat(first, per)
    letters = c[first]
    if down:
        sa[heads[c] - 1 - nth] = j
        heads[letters] -= per
    else:
        sa[heads[c] + nth] = j
        heads[letters] += per


def induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    """All suffixes, induced from leftmost-smaller suffixes that are given in order.

    A bucket is scanned in batches: what a batch adds to its own bucket is the next batch, so the
    order is that of the one-by-one scan.
    """
    n = len(s)
    ends = np.cumsum(np.bincount(s, minlength=letters))
    starts = ends - np.bincount(s, minlength=letters)
    sa = np.full(n, -1, np.int64)
    heads = starts.copy()
    cuts = np.searchsorted(s[lms], np.arange(letters + 1))
    _bucket_place(sa, heads, s, np.array([n - 1]), False)
    present = np.flatnonzero(ends > starts)
    for c in present:
        done = starts[c]
        while done < heads[c]:
            j = sa[done : heads[c]] - 1
            done = int(heads[c])
            j = j[j >= 0]
            _bucket_place(sa, heads, s, j[~smaller[j]], False)
        _bucket_place(sa, heads, s, lms[cuts[c] : cuts[c + 1]] - 1, False)
    tails = ends.copy()
    for c in present[::-1]:
        done = ends[c]
        while done > tails[c]:
            j = sa[tails[c] : done][::-1] - 1
            done = int(tails[c])
            j = j[j >= 0]
            _bucket_place(sa, tails, s, j[smaller[j]], True)
        j = sa[starts[c] : heads[c]][::-1] - 1
        j = j[j >= 0]
        _bucket_place(sa, tails, s, j[smaller[j]], True)
    return sa


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names, by doubling the compared length while ties remain."""
    rank = names.astype(np.int64)
    n, k = len(rank), 1
    tied = np.arange(n)
    while True:
        counts = np.bincount(rank, minlength=n)
        tied = tied[counts[rank[tied]] > 1]
        if not len(tied):
            break
        nxt = np.where(tied + k < n, rank[np.minimum(tied + k, n - 1)] + 1, 0)
        both = rank[tied] * (n + 1) + nxt
        order = np.argsort(both)
        t, both = tied[order], both[order]
        g, x = both // (n + 1), both % (n + 1)
        fresh = np.concatenate(([True], g[1:] != g[:-1]))
        new = np.concatenate(([True], fresh[1:] | (x[1:] != x[:-1])))
        at = np.arange(len(t))
        start = np.maximum.accumulate(np.where(fresh, at, 0))
        step = np.maximum.accumulate(np.where(new, at, 0))
        rank[t] = g + (step - start)
        k *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def _equal_to_last(s: np.ndarray, starts: np.ndarray, sizes: np.ndarray, likely: np.ndarray) -> np.ndarray:
    """Whether each substring is letter for letter the one before it, where that is likely."""
    equal, at = np.zeros(len(starts), bool), np.flatnonzero(likely & (starts + sizes <= len(s)))
    at = at[starts[at - 1] + sizes[at] <= len(s)]
    for part in np.array_split(at, max(1, int(sizes[at].sum()) // (8 * CHUNK))):
        if len(part):
            ends = np.cumsum(sizes[part])
            first = ends - sizes[part]
            step = np.arange(ends[-1]) - np.repeat(first, sizes[part])
            same = s[np.repeat(starts[part], sizes[part]) + step] == s[np.repeat(starts[part - 1], sizes[part]) + step]
            equal[part] = np.logical_and.reduceat(same, first)
    return equal


def suffix_array(s: np.ndarray, letters: int) -> np.ndarray:
    """The suffix array of ``s``, whose end is smaller than any letter, by induced sorting."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    step = np.sign(s[1:].astype(np.int32) - s[:-1].astype(np.int32))
    at = np.where(step != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.zeros(n, bool)
    smaller[:-1] = np.where(nearest < n, step[np.minimum(nearest, n - 2)] > 0, False)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) > 1:
        rough = induce(s, smaller, lms[np.argsort(s[lms], kind="stable")], letters)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        rough = rough[is_lms[rough]]
        size = np.zeros(n, np.int64)
        size[lms] = np.diff(np.append(lms, n)) + 1
        power = np.full(n + 1, _BASE)
        total = np.concatenate(([np.uint64(0)], np.cumsum((s.astype(np.uint64) + np.uint64(1)) * np.cumprod(power)[:n])))
        power[:] = _INVERSE
        content = (total[np.minimum(rough + size[rough], n)] - total[rough]) * np.cumprod(power, out=power)[rough]
        del total, power
        new = np.concatenate(([True], (content[1:] != content[:-1]) | (size[rough][1:] != size[rough][:-1])))
        new |= ~_equal_to_last(s, rough, size[rough], ~new)
        # the first of its equals gives a name its rank
        name = np.maximum.accumulate(np.where(new, np.arange(len(rough)), 0))
        of = np.empty(n, np.int64)
        of[rough] = name
        lms = lms[_sorted_names(of[lms])]
    return induce(s, smaller, lms, letters)


def _confirmed(b: np.ndarray, place: np.ndarray, before: np.ndarray, likely: np.ndarray) -> np.ndarray:
    """Which ``likely`` windows equal their forerunner's byte by byte.

    Permuted common prefixes shrink by one at most from a place to the next, so where the place before
    has reached the window with the same distance, only the last byte is compared.
    """
    goes_on = np.zeros(len(place), bool)
    goes_on[1:] = likely[1:] & likely[:-1] & (place[1:] == place[:-1] + 1) & (before[1:] == before[:-1] + 1)
    equal = np.zeros(len(place), bool)
    at = np.flatnonzero(likely & goes_on)
    equal[at] = b[place[at] + WINDOW - 1] == b[before[at] + WINDOW - 1]
    windows = np.lib.stride_tricks.sliding_window_view(b, WINDOW)
    first = np.flatnonzero(likely & ~goes_on)
    for a in range(0, len(first), CHUNK):
        at = first[a : a + CHUNK]
        equal[at] = (windows[place[at]] == windows[before[at]]).all(1)
    # a run is confirmed as far as its first inequality
    broken = np.cumsum(~equal & likely)
    start = np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(place))))
    clean = broken - np.where(start > 0, broken[np.maximum(start - 1, 0)], 0) == 0
    return equal & clean


def earliest(strings: list[bytes], owner: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """For each string the windows that also start earlier, by (owner, start) of the string plus the offset.

    Strings are distinct and at least a window long.
    """
    joined = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    sizes = np.array([len(x) for x in strings], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    s = joined.astype(np.int16) + 1
    s[begin + sizes] = 0
    sa = suffix_array(s, 257)
    per = sizes - WINDOW + 1
    which = np.repeat(np.arange(len(strings)), per)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(per) - per, per)
    place = begin[which] + offset
    number = np.full(len(s), -1, np.int64)  # of the windows, in text order
    number[place] = np.arange(len(place))
    # permuted common prefixes, as far as whether they reach the window: of each suffix with its forerunner
    phi = np.full(len(s), -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    (content,) = Rolling()(joined, WINDOW)
    before = np.where((phi[place] >= 0) & (number[phi[place]] >= 0), phi[place], -1)
    reaches = (before >= 0) & (content[place] == content[np.maximum(before, 0)])
    reaches &= _confirmed(joined, place, before, reaches)
    in_order = number[sa]
    in_order = in_order[in_order >= 0]
    rank = np.empty(len(place), np.int64)
    at = (start[which] + offset, owner[which])
    order = np.lexsort(at)
    same = np.concatenate(([False], (at[0][order][1:] == at[0][order][:-1]) & (at[1][order][1:] == at[1][order][:-1])))
    rank[order] = np.cumsum(~same)
    heads = np.flatnonzero(~reaches[in_order])
    least = np.minimum.reduceat(rank[in_order], heads)
    late = np.empty(len(place), bool)
    late[in_order] = rank[in_order] > np.repeat(least, np.diff(np.append(heads, len(in_order))))
    return np.split(late, np.cumsum(per)[:-1])


# --- the messages of a block ---


class Order:
    """Ids and starts as ranks: integers by value, other ids as text, rows without an id last."""

    def __init__(self, unnamed: np.ndarray, ids: np.ndarray):
        self.rank = np.unique(ids, return_inverse=True)[1]
        self.rank[unnamed] = len(ids)


def _packed_ids(ids: list) -> tuple[np.ndarray, ...]:
    """Whether each is null, and the values: integers, or the lengths and bytes of texts."""
    unnamed = np.array([i is None for i in ids], bool)
    if any(isinstance(i, str) for i in ids):
        raw = [(i or "").encode() for i in ids]
        return unnamed, np.array([len(r) for r in raw], np.int64), np.frombuffer(b"".join(raw), np.uint8)
    return unnamed, np.array([i or 0 for i in ids], np.int64)


def _unpacked_ids(unnamed: np.ndarray, values: np.ndarray, raw: np.ndarray | None = None) -> np.ndarray:
    if raw is None:
        return values
    ends, raw = np.cumsum(values), raw.tobytes()
    return np.array([raw[e - n : e].decode() for e, n in zip(ends.tolist(), values.tolist(), strict=True)], object)


def cut_hot(raw: bytes, functions: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """First window and key of each stretch of windows whose least hashes agree under so many functions."""
    (grams,) = rolling(np.frombuffer(raw, np.uint8), GRAM)
    keys = np.zeros(len(raw) - WINDOW + 1, np.uint64)
    for k in range(functions):
        keys = mix(keys * _BASE + sliding(mix(grams + np.uint64(k + 1) * _INVERSE), True))
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return first, keys[first]


class Block:
    """The runs of a block's texts; the order of the texts doesn't matter."""

    def __init__(self, table: pa.Table, shards: int, told: pd.DataFrame | None = None):
        self.shards, self.rolling = shards, Rolling()
        ids, texts = table.column("doc_id").to_pylist(), [(t or "").encode("utf-8", "replace") for t in table.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0, texts[i]))
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        self.rank = np.cumsum([0, *(a != b for a, b in zip(self.ids, self.ids[1:]))])  # noqa: B905
        self.doc, self.start, self.count, self.key, places, close = runs(self.texts, self.rolling)
        self.keys, self.which = np.unique(self.key, return_inverse=True)
        place = np.searchsorted(self.keys, places)
        self.times = np.bincount(place, minlength=len(self.keys))
        self.loops = np.bincount(place[close], minlength=len(self.keys)) > 0
        if told is not None:
            self._share(answers(told)[1])

    def _share(self, places: np.ndarray) -> None:
        """Keep the runs whose key has other places; split those of frequent keys."""
        stays = np.flatnonzero(places[self.which] > 1)
        hot = places[self.which[stays]] > HOT
        plain, doc, start, count, key, loops = stays[~hot], [], [], [], [], []
        for i in stays[hot].tolist():
            d, p, n = int(self.doc[i]), int(self.start[i]), int(self.count[i])
            functions = min(MOST_CUTS, 1 + int(np.log2(places[self.which[i]] / HOT)))
            first, keys = cut_hot(self.texts[d][p : p + n + WINDOW - 1], functions, self.rolling)
            doc.append(np.full(len(first), d))
            start.append(p + first)
            count.append(np.diff(np.append(first, n)))
            key.append(mix(keys + self.key[i]))
            loops.append(np.ones(len(first), bool))  # a stretch may meet others of its own string
        self.doc, self.start, self.count, self.key, self.loops = (
            np.concatenate([x[plain], *more]) for x, more in ((self.doc, doc), (self.start, start), (self.count, count), (self.key, key), (self.loops[self.which], loops))
        )
        self.shard = (self.key % np.uint64(self.shards)).astype(np.int64)
        # the first run here with each string, and by shard those runs
        self.first, self.by_shard, seen = [], {}, {}
        for i, (d, p, n, shard) in enumerate(zip(self.doc.tolist(), self.start.tolist(), self.count.tolist(), self.shard.tolist(), strict=True)):
            f = seen.setdefault(self.texts[d][p : p + n + WINDOW - 1], i)
            self.first.append(f)
            if f == i:
                self.by_shard.setdefault(shard, []).append(i)

    def string_questions(self, g: int) -> pd.DataFrame:
        made = []
        for part in self.by_shard.values():
            raw = b"".join(self.texts[d][p : p + n + WINDOW - 1] for d, p, n in zip(self.doc[part], self.start[part], self.count[part], strict=True))
            made.append(pack(np.frombuffer(raw, np.uint8), self.count[part], self.start[part], self.key[part], self.loops[part], *_packed_ids([self.ids[d] for d in self.doc[part]])))
        return pd.DataFrame({"p": np.array(list(self.by_shard), np.int64), "g": np.int64(g), "message": made})

    def kept(self, told: pd.DataFrame) -> list[tuple]:
        """n_bytes, n_removed, n_spans and the hash of the rest, for each document."""
        late: dict[int, np.ndarray] = {}
        for shard, message in zip(told["p"], told["message"], strict=True):
            bits = np.unpackbits(unpack(message)[0]).astype(bool)
            at = 0
            for i in self.by_shard[shard]:
                n = int(self.count[i])
                late[i] = bits[at : at + n]
                at += n
        edges: dict[int, list[tuple[int, int]]] = {}
        for i, f in enumerate(self.first):
            d, p, n = int(self.doc[i]), int(self.start[i]), int(self.count[i])
            if f != i and (self.rank[d], p) > (self.rank[self.doc[f]], self.start[f]):
                edges.setdefault(d, []).append((p, p + n - 1))
            else:
                on = np.flatnonzero(np.diff(np.concatenate(([0], late[f].view(np.int8), [0]))))
                edges.setdefault(d, []).extend((p + int(a), p + int(b) - 1) for a, b in on.reshape(-1, 2))
        out = []
        for d, raw in enumerate(self.texts):
            spans: list[list[int]] = []
            for a, b in sorted(edges.get(d, ())):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b + WINDOW)
                else:
                    spans.append([a, b + WINDOW])
            digest, at = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            out.append((self.ids[d], len(raw), sum(b - a for a, b in spans), len(spans), digest.hexdigest()))
        return out


def answer_strings(messages: list[bytes]) -> list[bytes]:
    asked = [unpack(m) for m in messages]
    number: dict[bytes, int] = {}
    places: list[np.ndarray] = []
    for raw, count, *_ in asked:
        raw, ends = raw.tobytes(), np.cumsum(count + WINDOW - 1)
        places.append(np.fromiter((number.setdefault(raw[e - n : e], len(number)) for e, n in zip(ends.tolist(), (count + WINDOW - 1).tolist(), strict=True)), np.int64, len(count)))
    place, start = np.concatenate(places), np.concatenate([a[2] for a in asked])
    ids = [_unpacked_ids(*a[5:]) for a in asked]
    texts = any(x.dtype == object for x in ids)  # a block whose ids are all null packs them as integers
    owner = Order(np.concatenate([a[5] for a in asked]), np.concatenate([np.full(len(x), "", object) if texts and x.dtype != object else x for x in ids])).rank
    order = np.lexsort((start, owner))
    first = np.full(len(number), -1, np.int64)
    first[place[order][::-1]] = order[::-1]
    key = np.concatenate([a[3] for a in asked])[first]
    loops = np.bincount(place, weights=np.concatenate([a[4] for a in asked]), minlength=len(number)) > 0
    _, group, crowd = np.unique(key, return_inverse=True, return_counts=True)
    strings = list(number)
    late = [np.zeros(len(x) - WINDOW + 1, bool) for x in strings]
    compare = np.flatnonzero((crowd[group] > 1) | loops)
    if len(compare):
        for k, found in zip(compare.tolist(), earliest([strings[k] for k in compare.tolist()], owner[first[compare]], start[first[compare]]), strict=True):
            late[k] = found
    out, at = [], 0
    for p in places:
        bits = []
        for k in p.tolist():
            f = first[k]
            earlier = f != at and (owner[f], start[f]) < (owner[at], start[at])
            bits.append(np.ones(len(late[k]), bool) if earlier else late[k])
            at += 1
        out.append(pack(np.packbits(np.concatenate(bits))))
    return out


def deduplicated(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    ship(docs.sparkSession)
    id_type = dict(docs.dtypes)["doc_id"]
    blocks = block_count(docs, "text", block_bytes)
    shards = max(blocks, block_count(docs, "text", block_bytes // 3))
    whole = id_type in ("bigint", "int", "smallint", "tinyint")
    named = docs.select(F.col("doc_id").cast("bigint" if whole else "string").alias("doc_id"), "text")
    dealt = deal(named, F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    bits = shape(blocks)[1]

    def ask_keys(batch: pd.DataFrame) -> pd.DataFrame:
        block = Block(gathered(list(batch["rows"])), shards)
        return questions(int(batch["g"].iat[0]), block.keys, block.times, bits)

    def ask_strings(batch: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        return Block(gathered(list(batch["rows"])), shards, told).string_questions(int(batch["g"].iat[0]))

    def tell_strings(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.assign(message=answer_strings(list(batch["message"])))

    def finish(rows: pa.Table, told: pa.Table) -> pa.Table:
        told = told.to_pandas()
        block = Block(gathered(rows.column("rows").to_pylist()), shards, told[told["is_key"]])
        out = list(zip(*block.kept(told[~told["is_key"]]), strict=True))
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64() if whole else pa.string(), *[pa.int64()] * 3, pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    told_keys = tally(dealt.groupBy("g").applyInPandas(ask_keys, KIND), blocks, lambda keys, counts: np.zeros(1, np.int64))
    told_strings = dealt.groupBy("g").cogroup(told_keys.groupBy("g")).applyInPandas(ask_strings, KIND).groupBy("p").applyInPandas(tell_strings, KIND)
    told = told_keys.withColumn("is_key", F.lit(True)).unionByName(told_strings.withColumn("is_key", F.lit(False)))
    out = dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(finish, f"doc_id {'bigint' if whole else 'string'}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))


def oracle() -> str:
    """Windows are compared as hexadecimal text, two characters a byte."""
    return """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT k, doc_id, h, length(h) // 2 AS n FROM d),
w AS (SELECT k, doc_id, i, md5(substring(h, 2 * i - 1, 200)) AS g FROM (SELECT k, doc_id, h, unnest(range(1, n - 98)) AS i FROM n WHERE n >= 100)),
f AS (SELECT g, min(struct_pack(u := doc_id IS NULL, d := doc_id, i := i)) AS f FROM w GROUP BY g HAVING count(*) > 1),
late AS (SELECT k, i FROM w JOIN f USING (g) WHERE struct_pack(u := doc_id IS NULL, d := doc_id, i := i) > f),
s AS (SELECT k, i, i - lag(i) OVER (PARTITION BY k ORDER BY i) AS gap FROM late),
spans AS (SELECT k, min(i) AS a, max(i) + 99 AS b FROM (SELECT k, i, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS run FROM s) GROUP BY k, run),
gaps AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT k, sum(b - a + 1) AS gone, count(*) AS spans, max(b) AS last, string_agg(substring(h, (2 * before + 1)::BIGINT, (2 * (a - 1 - before))::BIGINT), '' ORDER BY a) AS rest FROM gaps JOIN n USING (k) GROUP BY k)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(rest, '') || substring(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM n LEFT JOIN kept USING (k)"""
