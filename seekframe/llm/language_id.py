"""Language identification with hyperdimensional profiles.

Every letter symbol has a random +-1 vector. A character trigram is bound from the permuted vectors of its
letters (element-wise product of rotated copies), a text is the bundle (sum) of its trigram vectors, and so is
a language. A document gets the language whose prototype has the largest cosine with it.

The cosine with a language that a text has nothing to do with is noise of about 1 / sqrt(``DIMENSIONS``).

Nulls, empty texts and texts without a letter get ``und`` with score 0. Ties go to the language first in
alphabetical order. Rows are judged one by one, so repeated rows get equal answers; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, staged, unused

SYMBOLS = 64
DIMENSIONS = 512
NOISE, ENOUGH, ATYPICAL = 4.0, 60, 0.005
SEED = 20240229
UNKNOWN = "und"

_CACHE: dict[str, np.ndarray] = {}


def _symbols() -> np.ndarray:
    """Code point -> symbol: 0 for what is no letter, 1 to 26 for a to z, the rest shared out over 27 to 63."""
    if "symbols" not in _CACHE:
        letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        codes = np.arange(0x110000)
        out = np.where(letters, 27 + codes % (SYMBOLS - 27), 0).astype(np.uint8)
        out[ord("a") : ord("z") + 1] = np.arange(1, 27)
        _CACHE["symbols"] = out
    return _CACHE["symbols"]


def _letter_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Bound vectors of the first two letters, by 64 * first + second, and of the third."""
    if "pairs" not in _CACHE:
        rng = np.random.default_rng(SEED)
        letters = rng.choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))
        first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
        _CACHE["pairs"] = (first[:, None, :] * second[None, :, :]).reshape(-1, DIMENSIONS)
        _CACHE["third"] = letters
    return _CACHE["pairs"], _CACHE["third"]


def trigrams(text: str) -> np.ndarray:
    """Trigram numbers of a whole text; a word is seen with one blank on either side."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.zeros(len(codes) + 2, np.int32)
    s[1:-1] = _symbols()[codes]
    grams = (s[:-2] << 12) | (s[1:-1] << 6) | s[2:]
    return grams[s[1:-1] > 0]


def bundle(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    pairs, third = _letter_vectors()
    out = np.zeros(DIMENSIONS, np.float64)
    for at in range(0, len(grams), 1 << 14):
        g, n = grams[at : at + (1 << 14)], counts[at : at + (1 << 14)]
        out += n.astype(np.float32) @ (pairs[g >> 6] * third[g & 63]).astype(np.float32)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            grams, n = np.unique(trigrams(text.as_py()), return_counts=True)
            if lang not in total:
                total[lang] = np.zeros(SYMBOLS**3, np.int64)
            total[lang][grams] += n
    for lang, n in total.items():
        grams = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int32()), pa.array(n[grams], pa.int64())], names=["lang", "gram", "n"])


def prototypes(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Unit vectors of the languages of ``labelled`` (text, lang); trigram counts cover every row.

    What reaches the driver is one count for each language and trigram symbol triple: at most 2**18 rows a
    language, whatever the number of documents.
    """
    rows = (
        labelled.select("text", "lang").where("text is not null and lang is not null")
        .mapInArrow(_count, "lang string, gram int, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .groupBy("lang").agg(F.collect_list("gram").alias("gram"), F.collect_list("n").alias("n"))
        .orderBy("lang").collect()
    )
    vectors = [bundle(np.array(r.gram), np.array(r.n, float)) for r in rows]
    unit = [v / max(np.linalg.norm(v), 1e-12) for v in vectors]
    return [r.lang for r in rows], np.array(unit).reshape(len(rows), DIMENSIONS)


def identify(docs: DataFrame, langs: list[str], vectors: np.ndarray, keep: list[str], names: tuple[str, str, str] = ("lang_pred", "score", "trigrams")) -> DataFrame:
    """``keep`` columns of ``docs`` with, under ``names``, the language, the cosine of its prototype and the number of trigrams."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, vectors))
    read = [*keep] if "text" in keep else [*keep, "text"]
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double").add(names[2], "long")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, unit = shared.value
        for batch in batches:
            pred, score, size = [], [], []
            for text in batch.column(read.index("text")):
                grams = trigrams(text.as_py() or "")
                size.append(len(grams))
                if not len(grams) or not known:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                grams, n = np.unique(grams, return_counts=True)
                v = bundle(grams, n)
                cosines = unit @ v / max(np.linalg.norm(v), 1e-12)
                best = int(np.argmax(cosines))
                pred.append(known[best])
                score.append(float(np.clip(cosines[best], 0.0, 1.0)))
            arrays = [batch.column(i) for i in range(len(keep))] + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])

    return docs.select(*read).mapInArrow(judge, schema)


def held_out(doc_id: str = "doc_id"):
    """True for the documents that are kept from training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    langs, vectors = prototypes(docs.where(~held_out()))
    out = identify(docs, langs, vectors, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(spark, docs: DataFrame, sf_dir: str, wanted: list[str] | None = None) -> DataFrame:
    """Pipeline stage: documents of the ``wanted`` languages (all, if None) stay.

    Texts without letters go, and so do texts of ``ENOUGH`` trigrams that score as noise does, below ``NOISE`` times its size and below nearly
    all (a part of ``ATYPICAL``) of the documents that have a language; shorter ones are too little evidence to reject them.
    Where no row has a language to learn from, every text with letters stays. Columns of any names are passed on as they are.
    """
    short_batches(spark)
    langs, vectors = prototypes(docs.where(~held_out()))
    columns = docs.columns
    names = tuple(unused(n, columns) for n in ("lang_pred", "score", "trigrams"))
    pred, score, size = map(F.col, names)
    judged, stays = staged(identify(docs, langs, vectors, columns, names), "language-judged"), size > 0
    if langs:
        typical = judged.where(F.col("lang").isNotNull() & (size >= ENOUGH)).agg(F.percentile_approx(score, ATYPICAL)).first()[0]
        stays &= (size < ENOUGH) | (score >= min(NOISE / DIMENSIONS**0.5, 1.0 if typical is None else typical))
        stays &= pred.isin(wanted) if wanted is not None else F.lit(True)
    return judged.where(stays).select(*columns)
