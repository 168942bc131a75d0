"""A count-min sketch for one question: may this 64-bit hash occur at least twice?

Its cells are counters that stop at two, in one or two rows with hash functions of their own. Their number follows
from the number of keys: ``PER_KEY`` cells for each, up to 2**``MOST_BITS`` in all. A partition sends the cells it
touched, delta-coded and cut into blocks; blocks are merged where they meet, and of the merged rows only whether a
cell counts two or more is kept, one bit each, and broadcast: at most 256 MB, whatever the input. Counts are never too low, so
no repeated hash is lost; colliding cells only let some unrepeated ones through. With n keys in m cells of one row an
unrepeated key passes with probability 1 - exp(-n / m), and a cell is set by unrepeated keys with probability
1 - exp(-n / m) (1 + n / m).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, partitions, staged

PER_KEY, LEAST_BITS, MOST_BITS, IN_BLOCK = 4, 20, 31, 19
FLUSH = 1_500_000
SCHEMA = "block int, once binary, twice binary"


def shape(keys: int) -> tuple[int, int]:
    """(rows, bits): rows of 2**bits cells for so many keys; one row where two would be fuller than it."""
    total = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, keys) * PER_KEY))))
    rows = 2 if 3 * keys <= 1 << total else 1
    return rows, total - rows + 1


def pass_rate(keys: int) -> float:
    """The share of unrepeated keys that pass."""
    rows, bits = shape(keys)
    return (1 - math.exp(-keys / 2**bits)) ** rows


class Repeats:
    """The bits of the merged sketch; a hash may be repeated if its bit is set in every row."""

    def __init__(self, rows: int, bits: int):
        self.bits, self.set = bits, np.zeros((rows, 1 << max(0, bits - 3)), np.uint8)

    def may(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        left = slice(None)
        for row, bits in enumerate(self.set):
            at = cells(hashes[left], row, self.bits)
            out[left] = (bits[at >> np.uint32(3)] << (at & np.uint32(7)).astype(np.uint8)) & 128 > 0
            left = np.flatnonzero(out)
        return out


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((mixed(hashes, 20 + row) if row else hashes) >> np.uint64(64 - bits)).astype(np.uint32)


def _coded(low: np.ndarray) -> bytes:
    gaps = np.diff(low, prepend=0)
    narrow = not len(gaps) or gaps.max() < 1 << 16
    return bytes([2 if narrow else 4]) + gaps.astype(np.uint16 if narrow else np.uint32).tobytes()


def _decoded(code: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(code, np.uint16 if code[0] == 2 else np.uint32, offset=1), dtype=np.int64)


def _partial(hashes: np.ndarray, rows: int, bits: int) -> pa.RecordBatch:
    at, once, twice = [], [], []
    for row in range(rows):
        found, n = np.unique(cells(hashes, row, bits), return_counts=True)
        block = (found >> np.uint32(IN_BLOCK)).astype(np.int32)
        edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
        for a, b in zip(edges, edges[1:], strict=False):
            low = (found[a:b] & np.uint32((1 << IN_BLOCK) - 1)).astype(np.int64)
            at.append((row << max(0, bits - IN_BLOCK)) + int(block[a]))
            once.append(_coded(low))
            twice.append(_coded(low[n[a:b] > 1]))
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["block", "once", "twice"])


def partial_sketches(hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], rows: int, bits: int):
    """For mapInArrow: the sketch of a partition, in pieces of at most ``FLUSH`` hashes and one batch row more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for h in hashes_of(batch):
                held.append(h)
                n += len(h)
                if n >= FLUSH:
                    yield _partial(np.concatenate(held), rows, bits)
                    held, n = [], 0
        if n:
            yield _partial(np.concatenate(held), rows, bits)

    return run


def _merge(bits: int):
    size = 1 << min(bits, IN_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; one block is held at a time."""
        block, once, twice = None, None, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for b, one, two in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if b != block:
                    if block is not None and twice.any():
                        yield closed()
                    block, once, twice = b, np.zeros(size, bool), np.zeros(size, bool)
                at = _decoded(one.as_py())
                twice[at[once[at]]] = True
                once[at] = True
                twice[_decoded(two.as_py())] = True
        if block is not None and twice.any():
            yield closed()

    return run


def repeated(docs: DataFrame, hashes_of, keys: int) -> Repeats:
    """What may be repeated of the hashes that ``hashes_of`` gives of each batch of ``docs``, about ``keys`` of them."""
    rows, bits = shape(keys)
    merged = (
        docs.mapInArrow(partial_sketches(hashes_of, rows, bits), SCHEMA)
        .repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block")
        .mapInArrow(_merge(bits), "block int, bits binary")
    )
    out = Repeats(rows, bits)
    flat, each = out.set.reshape(-1), 1 << (min(bits, IN_BLOCK) - 3)
    found = merged.collect() if rows << bits <= 1 << 28 else staged(merged, "sketch").coalesce(8).toLocalIterator()
    for row in found:  # at most 2 ** (MOST_BITS - 3) bytes in all
        flat[row.block * each : (row.block + 1) * each] = np.frombuffer(row.bits, np.uint8)
    return out


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
