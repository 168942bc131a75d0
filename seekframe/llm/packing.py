"""Packing of token sequences by non-negative least squares.

Documents are tokenised whole. A full window of a document is a sequence of its own; what remains (shorter
than a window) is packed block by block, a block being a bounded run of one input partition: combinations of
two or three lengths that fill the window exactly are enumerated, their repeat counts are the non-negative
least-squares fit to the block's histogram of lengths, rounded down, and the residual pieces are laid end to end
and cut at window ends. The tail of a partition is cut at powers of two, so that nothing is padded.

Nothing is shuffled and nothing global is kept: a lost task packs its own partition again. Null and empty texts
are the end token alone. Repeated rows are packed as they come. Sequence ids are unique, not dense: the
partition number stands in the high bits.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

WINDOW = 2048
END = 1
BLOCK_TOKENS = 8_000_000
#: Words that a worker knows at most, and that it keeps for its next task; the pipeline's workers hold memory of other stages too.
CACHE_WORDS, KEPT_WORDS = 700_000, 250_000
STAGE_CACHE_WORDS = 100_000
MARKS, DOTTED = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "\u0130"
ODD_SPACE = re.compile("[\x1c-\x1f]")

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
CONTRACT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
OUT_BYTES = 16 << 20


def only_letters(word: str) -> bool:
    """Whether a word stays one group of letters when it is normalised and lowered."""
    return word.isalpha() and (word.isascii() or (DOTTED not in word and unicodedata.is_normalized("NFC", word)))


class WordTokenizer:
    """Ids of whole texts from ids of their words.

    The vocabulary's pre-tokenizer never joins what white space separates, and its normalizer works inside
    words, so the ids of a text are those of its words in a row. Words are tokenised once and kept.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}  # ids as little-endian 32-bit numbers
        ends = [i for token, i in self.model.get_vocab().items() if token.endswith("</w>")]
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        self.ends[ends] = True
        self.end = self.raw([END])
        self.marks: dict[str, bytes] = {}

    @staticmethod
    def raw(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def learn(self, new: set[str]) -> None:
        # A word of letters alone is one token group, so many can be encoded as one text and told apart by their
        # ends; the marks behind it are a group of their own. The small dotted I is no longer a letter alone.
        known = self.known
        cores = [w.rstrip(MARKS) for w in new]
        plain = list({c for c in cores if only_letters(c)}.difference(known))
        if plain:
            ids = self.model.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids
            ends = np.flatnonzero(self.ends[ids]).tolist()
            if len(ends) == len(plain):
                raw, at = self.raw(ids), 0
                for word, end in zip(plain, ends, strict=True):
                    known[word] = raw[at : 4 * end + 4]
                    at = 4 * end + 4
        rest = []
        for word, core in zip(new, cores, strict=True):
            if word in known:
                continue
            if core != word and core in known and only_letters(core):
                known[word] = known[core] + self.mark(word[len(core) :])
            else:
                rest.append(word)
        if rest:
            for word, e in zip(rest, self.model.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                known[word] = self.raw(e.ids)

    def mark(self, marks: str) -> bytes:
        if marks not in self.marks:
            self.marks[marks] = self.raw(self.model.encode(marks, add_special_tokens=False).ids)
        return self.marks[marks]

    def forget(self, keep: int) -> None:
        """Keeps the words that were learnt first, among which are those that come again most."""
        self.known = dict(islice(self.known.items(), keep))

    def ids(self, text: str) -> np.ndarray:
        if ODD_SPACE.search(text):  # str.split() parts at these, the vocabulary does not
            return np.array([*self.model.encode(text, add_special_tokens=False).ids, END], "<u4")
        if len(self.known) > self.most:
            self.forget(self.most // 3)
        words = text.split()
        if new := set(words).difference(self.known):
            self.learn(new)
        return np.frombuffer(b"".join([*map(self.known.__getitem__, words), self.end]), "<u4")


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int, top: int = 48) -> list[tuple[int, ...]]:
    """Two lengths that fill a window, and three of which two are among the ``top`` most frequent."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    found = [(int(a), window - int(a)) for a in lengths if 2 * a <= window and have[window - a]]
    often = np.sort(lengths[np.argsort(-counts, kind="stable")[:top]])
    for i, a in enumerate(often):
        for b in often[i:]:
            c = window - int(a) - int(b)
            if c >= 1 and have[c]:
                found.append(tuple(sorted((int(a), int(b), c))))
    return list(dict.fromkeys(found))


def repeat_counts(patterns: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Whole repeat counts from min |Ax - h|, x >= 0, by accelerated projected gradients; rounded down, then kept within the histogram."""
    if not patterns:
        return np.zeros(0, np.int64)
    width = max(map(len, patterns))
    index = np.array([p + (0,) * (width - len(p)) for p in patterns])
    weight = (index > 0).astype(float)
    h = histogram.astype(float)
    uses = np.bincount(index.ravel(), weight.ravel(), len(h))
    step = 1.0 / max(1.0, width * uses[1:].max())
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        rest = np.bincount(index.ravel(), (weight * y[:, None]).ravel(), len(h)) - h
        rest[0] = 0
        new = np.maximum(0.0, y - step * (weight * rest[index]).sum(1))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (last - 1) / t * (new - x)
        x = new
    left = histogram.copy()
    out = np.zeros(len(patterns), np.int64)
    for want in (np.floor(x + 1e-6).astype(np.int64), np.ceil(x).astype(np.int64)):
        for k in np.argsort(-x, kind="stable"):
            n = int(want[k] - out[k])
            if n > 0:
                need = np.bincount(patterns[k], minlength=len(left))
                at = np.flatnonzero(need)
                n = min(n, int((left[at] // need[at]).min()))
                if n > 0:
                    left[at] -= n * need[at]
                    out[k] += n
    return out


class _Packer:
    """Packs one partition; rows go out as columns."""

    def __init__(self, first_sequence: int, window: int):
        self.sequence, self.window = first_sequence, window
        self.rest: list[tuple[int, int, np.ndarray, int]] = []
        self.held = 0
        self.open: list[tuple[int, int, np.ndarray, int]] = []
        self.fill = 0
        self.rows: list[tuple] = []
        self.bytes = 0

    def put(self, doc, start, ids, tokens, sequence, offset) -> None:
        self.rows.append((doc, start, len(ids), tokens, sequence, offset, ids.tobytes()))
        self.bytes += 4 * len(ids)

    def add(self, doc, ids: np.ndarray) -> None:
        n = len(ids)
        for at in range(0, n - self.window + 1, self.window):
            self.put(doc, at, ids[at : at + self.window], n, self.sequence, 0)
            self.sequence += 1
        if n % self.window:
            self.rest.append((doc, n - n % self.window, ids[n - n % self.window :], n))
            self.held += n % self.window

    def pack(self) -> None:
        by_length = defaultdict(list)
        for piece in self.rest:
            by_length[len(piece[2])].append(piece)
        self.rest, self.held = [], 0
        histogram = np.zeros(self.window + 1, np.int64)
        for n, pieces in by_length.items():
            histogram[n] = len(pieces)
        lengths = np.flatnonzero(histogram)
        patterns = combinations(lengths, histogram[lengths], self.window)
        for pattern, times in zip(patterns, repeat_counts(patterns, histogram), strict=True):
            for _ in range(times):
                offset = 0
                for n in pattern:
                    doc, start, ids, tokens = by_length[n].pop()
                    self.put(doc, start, ids, tokens, self.sequence, offset)
                    offset += n
                self.sequence += 1
        for n in sorted(by_length, reverse=True):
            for piece in by_length[n]:
                self.lay(piece)

    def lay(self, piece) -> None:
        doc, start, ids, tokens = piece
        while len(ids):
            n = min(len(ids), self.window - self.fill)
            self.open.append((doc, start, ids[:n], tokens))
            start, ids, self.fill = start + n, ids[n:], self.fill + n
            if self.fill == self.window:
                self.close()

    def close(self) -> None:
        offset = 0
        for doc, start, ids, tokens in self.open:
            self.put(doc, start, ids, tokens, self.sequence, offset)
            offset += len(ids)
        self.open, self.fill, self.sequence = [], 0, self.sequence + 1

    def finish(self) -> None:
        """The tail: sequences at powers of two, the largest first."""
        self.pack()
        tail, whole = self.open, self.window
        self.open, left = [], self.fill
        self.fill = 0
        sizes = [1 << k for k in range(int(left).bit_length() - 1, -1, -1) if left >> k & 1]
        for size in sizes:
            self.window, self.fill = size, 0
            while self.fill < size:
                doc, start, ids, tokens = tail.pop(0)
                n = min(len(ids), size - self.fill)
                self.open.append((doc, start, ids[:n], tokens))
                self.fill += n
                if n < len(ids):
                    tail.insert(0, (doc, start + n, ids[n:], tokens))
            self.close()
        self.window = whole

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 7
        self.rows, self.bytes = [], 0
        kinds = [pa.int64()] * 6 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, block_tokens: int = BLOCK_TOKENS, cache_words: int = CACHE_WORDS, kept_words: int = KEPT_WORDS) -> DataFrame:
    """One row for each piece of a document (doc_id, text), with its token ids as little-endian 32-bit numbers; see the module's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(tokenizer_path)
        words.most = cache_words
        packer = _Packer(TaskContext.get().partitionId() << 40, window)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, words.ids(text.as_py() or ""))
                if packer.held >= block_tokens:
                    packer.pack()
                if packer.bytes > OUT_BYTES or len(packer.rows) > 50_000:
                    yield packer.take()
        packer.finish()
        yield packer.take()
        words.forget(kept_words)  # the worker may take up another task of this, or of another operator

    return docs.select("doc_id", "text").mapInArrow(run, PIECES).select(*(F.crc32("ids").alias(c) if c == "ids_crc32" else c for c in CONTRACT), "ids")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9(spark, sf_dir):
    from .common import table

    return pack(table(spark, sf_dir, "documents"), vocabulary_path()).select(*CONTRACT)


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return pack(docs, vocabulary_path(), cache_words=STAGE_CACHE_WORDS, kept_words=0)
