"""Removal of repeated word passages, exact, behind a count-min prefilter.

A window is ``width`` consecutive words (``[^\\x20\\x09-\\x0D]+``) of one document. The first pass sketches, for every
window, the half-window inside it with the smallest and the one with the largest hash, neighbouring windows mostly having
them in common: the merged sketch overestimates how often these occur, and they occur at least as often as the
window. The second pass sends on only windows that may be repeated, and of those of one partition that are equal only the
first, as the others are known to be later ones: a passage of a third of all documents is one row a partition.
Windows are told apart by two hashes of 64 bits that are made from independent hashes of the words.

First means the smaller doc_id, then the smaller start. Nulls and texts without words have no window and nothing
removed. Equal rows with one doc_id are one occurrence. A null doc_id stands before all others. Extra columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sketch
from .common import mixed, window_hashes, word_hashes

WIDTH = 20
SECOND_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
FLUSH = 3_000_000
NO_ID = -(1 << 63)
RESULT = "doc_id long, n_words long, n_removed long, kept binary"
CONTRACT = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for x in batch.column("text"):
        yield (x.as_py() or "").encode()


def rolling(x: np.ndarray, width: int, combine) -> np.ndarray:
    """``combine`` over every ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x, have = combine(x[:-step], x[step:]), have + step
    return x


def extremes(units: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``width`` units the smallest and the largest hash of its pieces of ``gram`` units."""
    if len(units) < width:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    pieces = mixed(window_hashes(units, gram))
    return rolling(pieces, width - gram + 1, np.minimum), rolling(pieces, width - gram + 1, np.maximum)


def extreme_pieces(units: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces, each place once, that are the smallest in some window, and those that are the largest."""
    pieces, n = mixed(window_hashes(units, gram)), width - gram + 1
    out = []
    for extreme, other, low in ((np.minimum, np.maximum, 0), (np.maximum, np.minimum, 2**64 - 1)):
        ends = np.full(n - 1, low, np.uint64)
        out.append(pieces[pieces == rolling(np.concatenate((ends, rolling(pieces, n, extreme), ends)), n, other)])
    return tuple(out)


def heads(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values start."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)


def spread(flags: np.ndarray, heads: np.ndarray, n: int) -> np.ndarray:
    """What holds for the runs that start at ``heads``, for each of the ``n`` values."""
    return np.repeat(flags, np.diff(np.append(heads, n)))


def keys(least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return least, mixed(most, 3)


def may_repeat(least: np.ndarray, most: np.ndarray, repeats: sketch.Repeats) -> np.ndarray:
    """For every window whether both its extremes may be repeated."""
    if not len(least):
        return np.empty(0, bool)
    a = heads(least)
    out = spread(repeats.may(least[a]), a, len(least))
    if out.any():
        b = heads(most)
        out &= spread(repeats.may(mixed(most[b], 3)), b, len(most))
    return out


def _windows(width: int):
    def of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for text in _texts(batch):
            words = word_hashes(text)
            if len(words) >= width:
                yield from keys(*extreme_pieces(words, width, width // 2))

    return of


def runs(doc: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """(doc, start, length) of the maximal runs of consecutive starts; sorted input."""
    if not len(doc):
        return [doc, start, start]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1))))
    return [doc[new], start[new], np.diff(np.append(new, len(doc)))]


def _rows(held: list[tuple]) -> pa.RecordBatch:
    """Local firsts as (h1, h2, doc, start, 1); of the rest the runs, with a length below zero."""
    doc = np.concatenate([np.full(len(s), d, np.int64) for d, s, _, _ in held])
    start, h1, h2 = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
    order = np.lexsort((start, doc, h1))
    doc, start, h1, h2 = doc[order], start[order].astype(np.int64), h1[order], h2[order]
    new = np.ones(len(doc), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    first = (doc == doc[head]) & (start == start[head])
    order = np.lexsort((start[~first], doc[~first]))
    late = runs(doc[~first][order], start[~first][order])
    dealt = mixed(late[0].astype(np.uint64) ^ mixed(late[1].astype(np.uint64)))
    columns = [
        np.concatenate((h1[first], dealt)).view(np.int64), np.concatenate((h2[first], np.zeros(len(dealt), np.uint64))).view(np.int64),
        np.concatenate((doc[first], late[0])), np.concatenate((start[first], late[1])), np.concatenate((np.ones(first.sum(), np.int64), -late[2])),
    ]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds, strict=True)], names=["h1", "h2", "id", "start", "n"])


def later_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, start, n): the windows start .. start + n - 1 of a document (id, text) also start earlier."""
    # about 2 * 2 / (width / 2 + 2) keys a word, and six bytes or more a word
    found = sketch.repeated(docs.select("text"), _windows(width), int(sketch.text_bytes(docs) * 4 / (width / 2 + 2) / 6))
    repeats = docs.sparkSession.sparkContext.broadcast(found)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), _texts(batch), strict=True):
                words = word_hashes(text)
                at = np.flatnonzero(may_repeat(*extremes(words, width, width // 2), repeats.value))
                if len(at):
                    h1, h2 = mixed(window_hashes(words, width)), window_hashes(word_hashes(text, 1), width, SECOND_BASE)
                    held.append((doc, at, h1[at], h2[at]))
                    n += len(at)
                    if n >= FLUSH:
                        yield from pa.Table.from_batches([_rows(held)]).to_batches(max_chunksize=100_000)
                        held, n = [], 0
        if held:
            yield from pa.Table.from_batches([_rows(held)]).to_batches(max_chunksize=100_000)

    rows = docs.select("id", "text").mapInArrow(emit, "h1 long, h2 long, id long, start int, n int")
    place = F.rank().over(Window.partitionBy("h1", "h2").orderBy("id", "start"))
    return rows.withColumn("place", place).where("n < 0 or place > 1").select("id", "start", F.abs("n").alias("n"))


def covered(n: int, starts, lengths, width: int) -> np.ndarray:
    """Of ``n`` units, those under a window; runs of windows are given by start and length."""
    edge = np.zeros(n + 1, np.int64)
    if starts is not None and len(starts):
        s, e = np.asarray(starts), np.asarray(starts) + np.asarray(lengths) - 1 + width
        np.add.at(edge, s, 1)
        np.add.at(edge, np.minimum(e, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _keep(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, starts, lengths in zip(batch.column(0).to_pylist(), _texts(batch), batch.column("starts"), batch.column("lengths"), strict=True):
                words = text.split()  # bytes part at exactly these six characters
                removed = 0
                if starts.is_valid:
                    gone = covered(len(words), starts.values.to_numpy(), lengths.values.to_numpy(), width)
                    removed = int(gone.sum())
                    kept = compress(words, (~gone).tolist())
                else:
                    kept = words
                rows.append((doc, len(words), removed, b" ".join(kept)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): words, removed words, the kept text and its digest."""
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"))
    late = later_windows(docs, width).groupBy("id").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("lengths"))
    return docs.join(late, "id", "left").select("doc_id", "text", "starts", "lengths").mapInArrow(_keep(width), RESULT).withColumn("kept_sha256", F.sha2("kept", 256)).withColumn("kept", F.col("kept").cast("string"))


def op10(spark, sf_dir):
    from .common import table

    return dedup(table(spark, sf_dir, "documents")).select(*CONTRACT)
