"""BPE encoding and decoding with forced-boundary splitting.

Two adjacent symbols that stand together inside no token of the vocabulary can never end up in one
token, whatever merges run.  Such pairs mark certain cuts: a word falls apart into fragments that
are encoded independently and concatenated, which gives the very ids of the undivided word.

A fragment of up to ``LONG`` symbols is merged by scanning its ranks, a longer one with a heap and a
linked list, in n log n steps.  A text with code points that Python's tables don't know (the library's
are newer) is normalised and split into words by the library; its words are merged here all the same.

The style is mapInPandas, free of shuffles; memory is one Arrow batch and a bounded word cache.

Defined results.  A null text counts as empty; an empty text has no ids.  Repeated rows are encoded
each on its own; further columns are left out.  Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import ship

WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words, and pieces between white space, kept by a worker; beyond it the cache starts anew.
CACHE_WORDS = 150_000
SHIFT, MASK, NONE = 24, (1 << 24) - 1, 1 << 60
LONG = 100


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Pieces(dict):
    """piece between white space -> its ids; hits cost one lookup."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        found = b"".join(map(self.bpe.encode_word, self.bpe.word.findall(piece)))
        if len(piece) < 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[piece] = found
        return found


class Bpe:
    """A BPE of words with end-of-word marks, read from a tokenizers file."""

    def __init__(self, definition: bytes):
        spec = json.loads(definition)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for token, i in (self.ids | self.special).items():
            self.tokens[i] = token
        merges = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        # a pair of ids is one number, and so is a merge: its rank, then the id it makes
        self.merge = {self.ids[a] << SHIFT | self.ids[b]: rank << SHIFT | self.ids[a + b] for rank, (a, b) in enumerate(merges)}
        self.together = {self.ids[a] << SHIFT | self.ids[b] for s in map(self.symbols, self.ids) for a, b in zip(s, s[1:], strict=False) if a in self.ids and b in self.ids}
        self.letters = [self.ids.get(c) for c in byte_letters()]
        self.last = [self.ids.get(c + self.end) for c in byte_letters()]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split)
        self.white = regex.compile(f"[{WHITE}]+")
        self.definition, self.library = definition, None
        self.assigned: set[str] = set()
        self.own = {letter: byte for byte, letter in enumerate(byte_letters())}
        self.marks = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.cache = Pieces(self)
        self.words: dict[str, bytes] = {}

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merged(self, part: list[int], pairs: list[int]) -> list[int]:
        """Merge the adjacent pair of lowest rank, the leftmost first, until none is left."""
        get = self.merge.get
        ranks = [get(pair, NONE) for pair in pairs]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            part[i] = new = best & MASK
            del part[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new << SHIFT | part[i + 1], NONE)
            if i:
                ranks[i - 1] = get(part[i - 1] << SHIFT | new, NONE)
        return part

    def merged_long(self, part: list[int]) -> list[int]:
        """The same merges, for long fragments: a heap of (rank, place) over a linked list."""
        get, n = self.merge.get, len(part)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m, i) for i, (a, b) in enumerate(zip(part, part[1:])) if (m := get(a << SHIFT | b)) is not None]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if part[i] < 0 or j < 0 or get(part[i] << SHIFT | part[j]) != m:
                continue  # an entry from before a merge nearby
            part[i], part[j] = m & MASK, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (m := get(part[i] << SHIFT | part[k])) is not None:
                    heapq.heappush(heap, (m, i))
            if (k := before[i]) >= 0 and (m := get(part[k] << SHIFT | part[i])) is not None:
                heapq.heappush(heap, (m, k))
        return [p for p in part if p >= 0]

    def encode_word(self, word: str) -> bytes:
        return self.encode_bytes(word.encode(), word)

    def encode_bytes(self, raw: bytes, word: object) -> bytes:
        found = self.words.get(word)
        if found is None:
            part = [self.letters[b] for b in raw]
            part[-1] = self.last[raw[-1]]
            if None in part:  # a vocabulary without that byte drops it
                part = [p for p in part if p is not None]
            pairs = [a << SHIFT | b for a, b in zip(part, part[1:])]  # noqa: B905
            cuts = [i + 1 for i, pair in enumerate(pairs) if pair not in self.together]
            if cuts:
                ids: list[int] = []
                for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
                    ids += self.merged(part[a:b], pairs[a : b - 1]) if b - a <= LONG else self.merged_long(part[a:b])
            else:
                ids = self.merged(part, pairs) if len(part) <= LONG else self.merged_long(part)
            found = array("I", ids).tobytes()
            if len(word) < 64:
                if len(self.words) >= CACHE_WORDS:
                    self.words.clear()
                self.words[word] = found
        return found

    def normalized(self, text: str) -> str:
        text = self.white.sub(" ", unicodedata.normalize("NFC", text))
        return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()

    def library_words(self, text: str) -> Iterator[bytes]:
        if self.library is None:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_buffer(self.definition)
            self.library = whole.normalizer, whole.pre_tokenizer
        normalizer, splitter = self.library
        for shown, _ in splitter.pre_tokenize_str(normalizer.normalize_str(text)):
            yield bytes(map(self.own.__getitem__, shown))

    def unknown(self, text: str) -> bool:
        """Whether a code point is unassigned in Python's tables."""
        new = set(text) - self.assigned
        if any(unicodedata.category(c) == "Cn" for c in new):
            return True
        self.assigned |= new
        return False

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if not text.isascii() and self.unknown(text):
            return b"".join(self.encode_bytes(raw, raw) for raw in self.library_words(text))
        return b"".join(map(self.cache.__getitem__, self.normalized(text).split(" ")))

    def encode(self, text: str) -> bytes:
        if self.marks is None or not self.marks.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [self.plain(text[at : m.start()]), array("I", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The file names no decoder, so tokens are joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, array("I", ids)))


_LOADED: dict[bytes, Bpe] = {}


def loaded(definition: bytes) -> Bpe:
    """A worker reads a definition once."""
    key = hashlib.sha256(definition).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(definition)
    return _LOADED[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and on request ids (array<int>) and decoded."""
    ship(docs.sparkSession)
    with open(path or default_path(), "rb") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(definition.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = bpe.encode(text or "")
                decoded = bpe.decode(ids)
                row = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append((*row, list(array("I", ids)), decoded) if with_ids else row)
            yield pd.DataFrame(rows, columns=names)

    id_type = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select("doc_id", "text").mapInPandas(run, schema)
