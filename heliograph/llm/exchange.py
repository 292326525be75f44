"""Counts that blocks of documents share, summed along a tree of key ranges, in packed arrays.

Documents lie in blocks.  A block packs its distinct keys (sorted 64-bit hashes) with its own counts
into one message for each of ``2**bits`` key ranges.  ``2**bits`` blocks and one range make a node,
which sums its messages and deals the sums among finer ranges, until a node sees its range from all
blocks.  The sums then go back the same way, each message answered in the order of its keys.

A block sends and a node receives at most ``2**MAX_BITS`` messages, and the tree grows a level
whenever the blocks grow by that factor, so messages are linear in the input (times its logarithm).
A frequent key is one entry a message and is summed up on its way, so it makes no task longer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS = 8
KIND = "p long, g long, message binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, which compress better, in one compressed message."""
    head = np.array([len(arrays), *(len(x) for x in arrays)], np.int64)
    kinds = "".join(f"{x.dtype.str:<4}" for x in arrays).encode()
    planes = (np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), kinds, *planes]))


def unpack(message: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(message)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    lengths = np.frombuffer(raw, np.int64, count, 8)
    at = 8 + 8 * count
    kinds = raw[at : at + 4 * count].decode()
    at += 4 * count
    out = []
    for k, n in enumerate(lengths.tolist()):
        kind = np.dtype(kinds[4 * k : 4 * k + 4].strip())
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def small(x: np.ndarray) -> np.ndarray:
    """Non-negative integers in the narrowest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


def shape(blocks: int) -> tuple[int, int]:
    """Levels of the tree, and bits of the key that each level deals by."""
    need = max(1, (blocks - 1).bit_length())
    levels = -(-need // MAX_BITS)
    return levels, -(-need // levels)


def questions(g: int, keys: np.ndarray, counts: np.ndarray, bits: int, level: int = 0, p: int = 0) -> pd.DataFrame:
    """The messages of node (or block) ``g`` under the path ``p``; ``keys`` are sorted."""
    paths = (p << bits) + np.arange(1 << bits)
    ends = np.searchsorted(keys >> np.uint64(64 - bits * (level + 1)), paths.astype(np.uint64), side="right")
    starts = np.append(0, ends[:-1])
    # steps between sorted keys take fewer bytes than keys
    made = [pack(np.diff(keys[a:b], prepend=np.uint64(0)), small(counts[a:b])) for a, b in zip(starts, ends, strict=True)]
    return pd.DataFrame({"p": paths, "g": g, "message": made})


def answers(told: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Totals, and the sums in the order of the keys, from the answers to one node's (or block's) messages."""
    got = [unpack(m) for m in told.sort_values("p")["message"]]
    return sum(t for t, _ in got), np.concatenate([c.astype(np.int64) for _, c in got])


def _merged(asked: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    got = [unpack(m) for m in asked["message"]]
    keys, where = np.unique(np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in got]), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, where, np.concatenate([c.astype(np.int64) for _, c in got]))
    return keys, sums, np.split(where, np.cumsum([len(k) for k, _ in got])[:-1])


def _reply(asked: pd.DataFrame, totals: np.ndarray, sums: np.ndarray, where: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"p": asked["p"], "g": asked["g"], "message": [pack(totals, small(sums[w])) for w in where]})


def tally(asked: DataFrame, blocks: int, totals: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """p, g, message: the answer to every message of ``asked`` (whose g are block numbers).

    ``totals`` maps keys and their sums to an array that adds up over key ranges.
    """
    levels, bits = shape(blocks)
    node = F.shiftright("g", bits).alias("node")

    def deeper(level: int):
        def run(asked: pd.DataFrame) -> pd.DataFrame:
            keys, sums, _ = _merged(asked)
            return questions(int(asked["g"].iat[0]) >> bits, keys, sums, bits, level, int(asked["p"].iat[0]))

        return run

    def top(asked: pd.DataFrame) -> pd.DataFrame:
        keys, sums, where = _merged(asked)
        return _reply(asked, totals(keys, sums), sums, where)

    def back(asked: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        return _reply(asked, *answers(told), _merged(asked)[2])

    stages = [asked]
    for level in range(1, levels):
        stages.append(stages[-1].groupBy("p", node).applyInPandas(deeper(level), KIND))
    told = stages.pop().groupBy("p", node).applyInPandas(top, KIND)
    while stages:
        told = stages.pop().groupBy("p", node).cogroup(told.groupBy(F.shiftright("p", bits).alias("p"), "g")).applyInPandas(back, KIND)
    return told


def deal(docs: DataFrame, block: Column) -> DataFrame:
    """block, rows: the documents of a batch that go to one block, as compressed Arrow.

    Blocks are functions of a row, so a batch that is computed anew after a loss sends the same rows.
    """

    def run(batches):
        for batch in batches:
            to = batch.column(0).to_numpy(zero_copy_only=False)
            rows = batch.select(range(1, batch.num_columns))
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order])) + 1
            blocks, made = [], []
            for part in np.split(order, cuts) if len(order) else []:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as writer:
                    writer.write_batch(rows.take(pa.array(part)))
                blocks.append(int(to[part[0]]))
                made.append(zstandard.ZstdCompressor(level=3).compress(sink.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(made, pa.binary())], ["g", "rows"])

    return docs.select(block.cast("long").alias("__block"), *docs.columns).mapInArrow(run, "g long, rows binary")


def gathered(rows: list[bytes]) -> pa.Table:
    """The documents of a block."""
    return pa.concat_tables(pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(r)).read_all() for r in rows)
