"""Shared helpers of the training-data operators: tables, hashing in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..sources.storage import scratch, shared_dir, staged

__all__ = ["scratch", "shared_dir", "staged"]

BATCH_ROWS = 2000


def short_batches(spark: SparkSession) -> None:
    """At most ``BATCH_ROWS`` texts in an Arrow batch: what a Python worker holds of long texts at once follows from it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """``name`` with as many underscores before it as it takes to be no column's name."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- 64-bit hashing over byte arrays -------------------------------------------------

BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: np.uint64 = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    key = int(base)
    if key not in _POWERS or len(_POWERS[key][0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        inverse = np.uint64(pow(key, -1, 1 << 64))
        both = []
        for b in (base, inverse):
            row = np.full(size, b, np.uint64)
            row[0] = 1
            both.append(np.multiply.accumulate(row))
        _POWERS[key] = (both[0], both[1])
    up, down = _POWERS[key]
    return up[:n], down[:n]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words whose high bits depend on all bits."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(blank: bytes = b"") -> np.ndarray:
    """A random 64-bit value for each byte; zero for the blank ones."""
    values = mixed(np.arange(256, dtype=np.uint64), 7)
    values[list(blank)] = 0
    return values


def window_hashes(x: np.ndarray, k: int, base: np.uint64 = BASE) -> np.ndarray:
    """Polynomial hash of every ``k`` consecutive 64-bit values."""
    if len(x) < k:
        return np.empty(0, np.uint64)
    up, down = powers(len(x) + 1, base)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[:-1], out=total[1:])
    return (total[k:] - total[:-k]) * down[: len(x) - k + 1]


SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
CHUNK = 1 << 20
LONGEST_WORD = 1024  # bytes; longer words are told apart by a digest
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(family: int) -> tuple[np.ndarray, np.ndarray]:
    """Random 64-bit values of the bytes (0 for spaces) and odd factors of the places in a word, of their own for each family."""
    if family not in _TABLES:
        rng = np.random.default_rng([8191, family])
        values, places = rng.integers(0, 1 << 64, 256, np.uint64), rng.integers(0, 1 << 64, LONGEST_WORD + 1, np.uint64) | np.uint64(1)
        values[list(SPACES)] = 0
        _TABLES[family] = (values, places)
    return _TABLES[family]


def word_hashes(text: bytes, family: int = 0) -> np.ndarray:
    """One 64-bit hash for each word ``[^\\x20\\x09-\\x0D]+``, in order; long texts go in chunks cut at white space.

    Families are independent: each sums random values of the bytes, times random factors of their places.
    """
    if len(text) <= CHUNK:
        return _word_hashes(text, family)
    found, at = [], 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        while end < len(text) and text[end] not in SPACES:
            end += 1
        found.append(_word_hashes(text[at:end], family))
        at = end
    return np.concatenate(found)


def _word_hashes(text: bytes, family: int) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    word = ~_IS_SPACE[raw]
    starts = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
    if not len(starts):
        return np.empty(0, np.uint64)
    values, places = _tables(family)
    sizes = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, sizes)
    if sizes.max() > LONGEST_WORD:
        np.minimum(place, LONGEST_WORD, out=place)
    out = mixed(np.add.reduceat(values[raw[starts[0] :]] * places[place], starts - starts[0]))
    for i in np.flatnonzero(sizes > LONGEST_WORD):
        one = text[starts[i] : starts[i] + sizes[i]].strip(SPACES)
        if len(one) > LONGEST_WORD:
            out[i] = int.from_bytes(hashlib.blake2b(one, digest_size=8, salt=bytes([family])).digest(), "little")
    return out
