"""Exact removal of repeated byte strings with merged Burrows-Wheeler transforms.

Every string of ``WIDTH`` bytes of a document has a minimizer, the smallest hash of its ``GRAM``-byte pieces, and
neighbouring strings with one minimizer are sent on as one stretch; equal strings have equal minimizers, so all
their occurrences meet in one bucket. Documents equal to a smaller one lose all and go no further. A sketch keeps back
windows whose smallest or whose largest piece is unique, and equal stretches of one partition leave only that of the smallest document. In a bucket the distinct stretches are cut into
shards, each shard gets the transform of its rotations, and the transforms are merged by refining their interleave
two symbols at a time: the refinement that reaches ``WIDTH`` symbols gives the order of all suffixes and the intervals
with a common prefix of at least ``WIDTH``, without sorting the suffixes again. An interval's strings are removed
from all documents but the smallest; documents with a stretch equal to that of a smaller one lose all of it.

Where a minimizer has about ``HOT`` distinct stretches or more, its windows are dealt one by one by the hash of their bytes
instead, so that no bucket grows with the corpus; equal windows still meet, as they have one minimizer.

Removal is judged on the input; strings of one document do not remove each other. Null and empty texts, and those
shorter than ``WIDTH``, lose nothing. A null doc_id stands before all others; rows with one doc_id are one
document. Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch, substrings
from .common import CHUNK, byte_values, mixed, partitions, staged, window_hashes
from .substrings import NO_ID, covered, heads, keys, may_repeat, runs, spread

WIDTH, GRAM = 50, 24
LONGEST = 64  # windows in a stretch
SHARDS = 4
BATCH_BYTES = 1 << 16  # so that the arrays of a batch stay in a cache
FLUSH = 150_000
HOT, SAMPLE = 16_000, 16  # distinct stretches of a bucket that is split, and the share of documents that tells
_BYTES = byte_values()
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
CONTRACT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for x in batch.column("text"):
        yield (x.as_py() or "").encode()


def extremes(text: bytes, width: int = WIDTH, gram: int = GRAM) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(start, least, most): for every window of a text the smallest and largest hash of its pieces, chunk by chunk."""
    for at in range(0, max(0, len(text) - width + 1), CHUNK):
        part = text[at : at + CHUNK + width - 1]
        yield at, *substrings.extremes(_BYTES[np.frombuffer(part, np.uint8)], width, gram)


def _first_copies(ids: np.ndarray, firsts) -> np.ndarray:
    """False only for documents whose whole text a smaller document has."""
    return firsts.value.may(mixed(ids.view(np.uint64)))


def _pieces(firsts):
    def of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for first, text in zip(_first_copies(batch.column("id").to_numpy(), firsts), _texts(batch), strict=True):
            if first:
                for _, least, most in extremes(text):
                    yield from keys(least[heads(least)], most[heads(most)])

    return of


def _id_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Twice each, as the sketch keeps what occurs at least twice."""
    h = mixed(batch.column("id").to_numpy().view(np.uint64))
    yield h
    yield h


def stretches(text: bytes, repeats: sketch.Repeats, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, key) of the runs of windows with one minimizer, their key, that may be repeated; under a minimizer
    that is ``hot`` (sorted), every window is a run of its own, with the hash of its bytes as key."""
    found = []
    for at, least, most in extremes(text):
        may = may_repeat(least, most, repeats)
        if not may.any():
            continue
        new = np.concatenate(([True], (least[1:] != least[:-1]) | (may[1:] != may[:-1])))
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        new |= (np.arange(len(new)) - head) % LONGEST == 0
        split = spread(np.isin(least[a := heads(least)], hot), a, len(least)) if len(hot) else None
        if split is not None:
            new |= split
        s = np.flatnonzero(new)
        n = np.diff(np.append(s, len(new)))
        s, n = s[may[s]], n[may[s]]
        value = least[s]
        if split is not None and split.any():
            part = np.frombuffer(text[at : at + len(least) + WIDTH - 1], np.uint8)
            value = np.where(split[s], mixed(window_hashes(_BYTES[part], WIDTH), 5)[s], value)
        found.append((s + at, n, value.view(np.int64)))
    if len(found) == 1:
        return found[0]
    return tuple(np.concatenate([np.empty(0, np.int64), *(f[i] for f in found)]) for i in range(3))


#: A stretch (text) of a document with its starts; or without text, windows start .. start + n - 1 known to be removed.
STRETCH = "minimizer long, id long, text binary, starts array<int>, n int"
_NAMES = [c.split()[0] for c in STRETCH.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int32()]


def _stretch_rows(held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, bytes]]) -> pa.RecordBatch:
    """Stretches of documents (id, starts, windows, keys, text), of which equal ones are told apart by their bytes."""
    doc = np.concatenate([np.empty(0, np.int64), *(np.full(len(s), d, np.int64) for d, s, _, _, _ in held)])
    start, n, value = (np.concatenate([np.empty(0, np.int64), *(h[i] for h in held)]) for i in (1, 2, 3))
    pieces = [text[s:e] for _, begin, count, _, text in held for s, e in zip(begin.tolist(), (begin + count + (WIDTH - 1)).tolist(), strict=True)]
    found = pa.array(pieces, pa.binary()).dictionary_encode()
    code = found.indices.to_numpy().astype(np.int64)
    least = np.full(len(found.dictionary), np.iinfo(np.int64).max)
    np.minimum.at(least, code, doc)
    own = least[code] == doc
    kept = np.flatnonzero(own)
    kept = kept[np.argsort(code[kept], kind="stable")]
    first = heads(code[kept])
    gone = np.flatnonzero(~own)
    gone = gone[np.lexsort((start[gone], doc[gone]))]
    late, at, size = doc[gone], start[gone], n[gone]
    if len(gone):  # stretches that follow one another become one run
        new = np.flatnonzero(np.concatenate(([True], (late[1:] != late[:-1]) | (at[1:] != at[:-1] + size[:-1]))))
        late, at, size = late[new], at[new], np.add.reduceat(size, new)
    dealt = mixed((late ^ (at << 20)).view(np.uint64)).view(np.int64)
    columns = [
        pa.array(np.concatenate((value[kept[first]], dealt))), pa.array(np.concatenate((doc[kept[first]], late))),
        pa.concat_arrays([found.dictionary.take(pa.array(code[kept[first]])), pa.nulls(len(late), pa.binary())]),
        pa.ListArray.from_arrays(pa.array(np.concatenate((first, len(kept) + np.arange(len(late) + 1))).astype(np.int32)), pa.array(np.concatenate((start[kept], at)).astype(np.int32))),
        pa.array(np.concatenate((np.zeros(len(first), np.int64), size)).astype(np.int32)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _emit(bits, firsts, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, bytes]] = []
        waiting = 0
        for batch in batches:
            ids = batch.column("id").to_numpy()
            copies: list[tuple] = []
            for doc, first, text in zip(ids.tolist(), _first_copies(ids, firsts), _texts(batch), strict=True):
                if not first:
                    if len(text) >= WIDTH:
                        copies.append((doc, len(text) - WIDTH + 1))
                    continue
                s, n, value = stretches(text, bits.value, hot.value)
                if not len(s):
                    continue
                held.append((doc, s, n, value, text))
                waiting += len(s)
                if waiting >= FLUSH:
                    yield from pa.Table.from_batches([_stretch_rows(held)]).to_batches(max_chunksize=20_000)
                    held, waiting = [], 0
            rows = [[mixed(np.array([d], np.int64).view(np.uint64)).view(np.int64)[0] for d, _ in copies], [d for d, _ in copies], [None] * len(copies), [[0]] * len(copies), [n for _, n in copies]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, _KINDS, strict=True)], names=_NAMES)
        yield from pa.Table.from_batches([_stretch_rows(held)]).to_batches(max_chunksize=20_000)

    return run


def _sampled(bits, firsts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = [], []
            for first, text in zip(_first_copies(batch.column("id").to_numpy(), firsts), _texts(batch), strict=True):
                if first:
                    for s, n, value in zip(*(x.tolist() for x in stretches(text, bits.value, np.empty(0, np.uint64))), strict=True):
                        keys.append(value)
                        texts.append(text[s : s + n + WIDTH - 1])
            yield from pa.Table.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.binary())], names=["minimizer", "text"]).to_batches(max_chunksize=20_000)

    return run


def hot_minimizers(docs: DataFrame, bits, firsts) -> np.ndarray:
    """Sorted minimizers of about ``HOT`` distinct stretches or more, as a sample of the documents (id, text) tells. The
    sample decides only how windows are dealt: whatever is hot, all windows are compared."""
    some = docs.where(F.pmod(F.xxhash64("id", "text"), F.lit(SAMPLE)) == 0).select("id", "text").mapInArrow(_sampled(bits, firsts), "minimizer long, text binary")
    counts = some.select("minimizer", F.xxhash64("text").alias("h")).distinct().groupBy("minimizer").agg(F.count("*").alias("n"))
    return np.sort(np.array([r.minimizer for r in counts.where(F.col("n") * SAMPLE >= HOT).select("minimizer").collect()], np.int64).view(np.uint64))


# -- Burrows-Wheeler transforms ----------------------------------------------------


def rotations(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (byte + 1; 0 ends a text), the place after and before each within its rotation, and the text's number."""
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    symbols = np.zeros(int(ends[-1]), np.uint16)
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False
    symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    after = np.arange(1, len(symbols) + 1)
    after[ends - 1] = ends - sizes
    before = np.arange(-1, len(symbols) - 1)
    before[ends - sizes] = ends - 1
    return symbols, after, before, np.repeat(np.arange(len(texts)), sizes)


def transform(symbols: np.ndarray, after: np.ndarray, before: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, transform) of one shard: its rotations in order of at least ``depth`` symbols, and the symbol before each."""
    key, at, have = np.zeros(len(symbols), np.int64), np.arange(len(symbols)), 7
    for _ in range(have):
        key, at = key * 257 + symbols[at], after[at]
    _, rank = np.unique(key, return_inverse=True)
    while have < depth:
        _, rank = np.unique(rank * np.int64(len(symbols)) + rank[at], return_inverse=True)
        at, have = at[at], 2 * have
    order = np.argsort(rank, kind="stable")
    return order, symbols[before[order]]


def merge(shards: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, interval): all rotations, given by shard and place as one running number, in the order of their first
    ``depth`` symbols, and the number of the interval with a common prefix of that length.

    The interleave says which rotation of which shard comes next. It starts as one shard after the other; a round
    sorts it stably by the two symbols that precede, which makes it right for two symbols more, as every rotation gives way to the one
    that begins with those, and splits the intervals where the symbols or the interval before differ. Depths that are
    odd, and alphabets of more than 256 symbols, take rounds of one symbol.
    """
    values, bwt = np.unique(np.concatenate([b for _, b in shards]), return_inverse=True)
    bwt = bwt.astype(np.uint16)
    longer, at = np.empty(len(bwt), np.int32), 0
    for _, b in shards:
        own = bwt[at : at + len(b)]
        longer[at + np.argsort(own, kind="stable")] = np.arange(at, at + len(b), dtype=np.int32)
        at += len(b)
    steps = [(bwt, longer)] * depth
    if len(values) <= 256:
        two = (bwt[longer] * np.uint16(len(values)) + bwt, longer[longer])
        steps = [(bwt, longer)] * (depth % 2) + [two] * (depth // 2)
    firsts = {id(symbols): np.cumsum(np.bincount(symbols))[:-1] for symbols, _ in steps[:1] + steps[-1:]}  # where they begin, in every round
    split = np.zeros(len(bwt), bool)
    element = np.arange(len(bwt), dtype=np.int32)
    interval = np.zeros(len(bwt), np.int32)
    for symbols, next_ in steps:
        moved = np.argsort(symbols[element], kind="stable")
        element, interval = next_[element[moved]], interval[moved]
        np.not_equal(interval[1:], interval[:-1], out=split[1:])
        begins = firsts[id(symbols)]
        split[begins[(begins > 0) & (begins < len(split))]] = True
        np.cumsum(split, out=interval)
        if interval[-1] == len(bwt) - 1:
            break
    return element, interval


def repeated_windows(texts: list[bytes], ids: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(text number, offset) of the windows that also start in a text of a smaller id."""
    count = min(SHARDS, len(texts))
    shards, owner, offset, first = [], [], [], 0
    for part in np.array_split(np.arange(len(texts)), count):
        own = [texts[i] for i in part]
        symbols, after, before, number = rotations(own)
        order, bwt = transform(symbols, after, before, width)
        shards.append((order, bwt))
        begin = np.cumsum([0, *(len(t) + 1 for t in own)])[:-1]
        owner.append(number[order] + first)
        offset.append(order - begin[number[order]])
        first += len(own)
    owner, offset = np.concatenate(owner), np.concatenate(offset)
    order, interval = merge(shards, width)
    owner, offset = owner[order], offset[order]
    whole = offset + width <= np.array([len(t) for t in texts])[owner]
    owner, offset, interval = owner[whole], offset[whole], interval[whole]
    if not len(owner):
        return owner, offset
    doc = ids[owner]
    heads = np.flatnonzero(np.concatenate(([True], interval[1:] != interval[:-1])))
    least = np.repeat(np.minimum.reduceat(doc, heads), np.diff(np.append(heads, len(doc))))
    return owner[doc > least], offset[doc > least]


GONE = "id long, start int, n int"


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by minimizer; buckets are gathered until their distinct stretches make a batch."""
    gone: list[tuple[int, int, int]] = []
    waiting: list[tuple[bytes, int, list[int]]] = []
    size = 0
    bucket: dict[bytes, list[tuple[int, list[int]]]] = {}
    value = None

    def close() -> None:
        nonlocal size
        for text, owners in bucket.items():
            least = min(doc for doc, _ in owners)
            for doc, starts in owners:
                if doc != least:
                    gone.extend((doc, s, len(text) - WIDTH + 1) for s in starts)
            if len(bucket) > 1:
                waiting.append((text, least, [s for doc, starts in owners if doc == least for s in starts]))
                size += len(text) + 1
        bucket.clear()

    def settle() -> pa.RecordBatch:
        nonlocal size
        if waiting:
            owner, offset = repeated_windows([w[0] for w in waiting], np.array([w[1] for w in waiting], np.int64))
            order = np.lexsort((offset, owner))
            for o, s, n in zip(*(x.tolist() for x in runs(owner[order], offset[order])), strict=True):
                _, doc, starts = waiting[o]
                if len(starts) == 1:
                    gone.append((doc, starts[0] + s, n))
                else:
                    gone.extend([(doc, start + s, n) for start in starts])
        waiting.clear()
        size = 0
        columns = list(zip(*gone, strict=True)) or [()] * 3
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["id", "start", "n"])
        gone.clear()
        return out

    for batch in batches:
        minimizers, docs, sizes = (batch.column(c).to_numpy().tolist() for c in ("minimizer", "id", "n"))
        lists = batch.column("starts")
        # as arrays, since a Python list for each Arrow list costs more than all else here
        ends, places = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist(), lists.flatten().to_numpy().tolist()
        for v, doc, text, a, b, n in zip(minimizers, docs, batch.column("text").to_numpy(zero_copy_only=False), ends[:-1], ends[1:], sizes, strict=True):
            if text is None:
                gone.append((doc, places[a], n))
                continue
            if v != value:
                close()
                value = v
                if size >= BATCH_BYTES:
                    yield settle()
            bucket.setdefault(text, []).append((doc, places[a:b]))
        if len(gone) > 200_000:
            yield settle()
    close()
    yield settle()


def repeated(docs: DataFrame) -> DataFrame:
    """(id, start, n): the windows start .. start + n - 1 of a document (id, text) that start in a smaller one too."""
    spark = docs.sparkSession
    copies = staged(docs.groupBy(F.sha2(F.col("text").cast("binary"), 256)).agg(F.min("id").alias("id")).select("id"), "first-copies")
    firsts = spark.sparkContext.broadcast(sketch.repeated(copies, _id_hashes, 16 * copies.count()))
    # about 2 * 2 / (WIDTH - GRAM + 2) keys a byte
    bits = spark.sparkContext.broadcast(sketch.repeated(docs.select("id", "text"), _pieces(firsts), int(sketch.text_bytes(docs) * 4 / (WIDTH - GRAM + 2))))
    hot = spark.sparkContext.broadcast(hot_minimizers(docs, bits, firsts))
    rows = docs.select("id", "text").mapInArrow(_emit(bits, firsts, hot), STRETCH)
    return rows.repartition(partitions(spark), "minimizer").sortWithinPartitions("minimizer").mapInArrow(_buckets, GONE)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, starts, lengths in zip(batch.column(0).to_pylist(), _texts(batch), batch.column("starts"), batch.column("lengths"), strict=True):
            removed = spans = 0
            kept = text
            if starts.is_valid:
                out = covered(len(text), starts.values.to_numpy(), lengths.values.to_numpy(), WIDTH)
                removed, spans = int(out.sum()), int(out[0]) + int((out[1:] & ~out[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~out].tobytes()
            rows.append((doc, len(text), removed, spans, kept))
        kinds = [pa.int64()] * 4 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in RESULT.split(", ")])


def dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): bytes, removed bytes and spans, what is kept and its digest."""
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"))
    gone = repeated(docs).groupBy("id").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("lengths"))
    return docs.join(gone, "id", "left").select("doc_id", "text", "starts", "lengths").mapInArrow(_keep, RESULT).withColumn("kept_sha256", F.sha2("kept", 256))


def op4(spark, sf_dir):
    from .common import table

    return dedup(table(spark, sf_dir, "documents")).select(*CONTRACT)
