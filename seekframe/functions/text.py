"""Text analysis: words, normal forms and positions (inventory T1-T9)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_UNITS = 25
_SURROGATE = re.compile("[\ud800-\udfff]")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalise(word: str) -> str:
    """Compatibility decomposition, lower case, no marks, composed again."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", word).lower() if not unicodedata.category(c).startswith("M"))
    return unicodedata.normalize("NFKC", flat)


def truncate(word: str) -> str:
    """The first 25 UTF-16 units; a pair that would be cut goes whole."""
    return word.encode("utf-16-le", "surrogatepass")[: 2 * MAX_UNITS].decode("utf-16-le", "ignore")


def is_valid(text: str) -> bool:
    """Whether a text has no lone surrogate."""
    return not _SURROGATE.search(text)


class _Classes(dict):
    """A sign for the class of every character, found once each: d, a, w: digits, letters and the rest of letters and numbers; h: ideographs and kana; s: symbols; m: marks; . and ': what may join; blank: what parts words."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.category(c)[0]
        if kind in "LN":
            name = unicodedata.name(c, "")
            own = name.startswith(("CJK UNIFIED", "CJK COMPAT", "HIRAGANA", "KATAKANA"))
            out = "h" if own else "d" if c.isdigit() else "a" if c.isalpha() else "w"
        else:
            out = "s" if kind == "S" else "m" if kind == "M" else "." if c in ".," else "'" if c in "'’" else " "
        self[code] = out
        return out


_CLASSES = _Classes()
# over the classes of a text; a mark belongs to the character before
_WORD = re.compile(r"[daw](?:[dawm]++|(?<=d)\.(?=d)|(?<=a)'(?=[ah]))*+|h(?:[hm]++|(?<=h)'(?=[ah]))*+|s[sm]*+")
# the same over lower-case ASCII
_ASCII_WORD = re.compile(r"[a-z0-9](?:[a-z0-9]++|(?<=[0-9])[.,](?=[0-9])|(?<=[a-z])'(?=[a-z]))*+|[$+<=>^`|~]++")


@lru_cache(1 << 16)
def _terms_of(word: str) -> tuple[str, ...]:
    # a sign may decompose into a blank and a mark, a ligature into several words: blanks part words here too
    return tuple(t for t in map(truncate, normalise(word).split()) if t)


def terms(text: str | None) -> list[str]:
    """The normalised words of a text, in order.

    ``.`` and ``,`` join digits, an apostrophe joins letters, marks belong to the character before; every other
    mark of punctuation, blanks and controls part words, and so does a change between scripts.
    """
    if not text:
        return []
    if text.isascii():
        return [w[:MAX_UNITS] for w in _ASCII_WORD.findall(text.lower())]
    if not is_valid(text):
        return []
    out: list[str] = []
    text = text.replace("_", " ")
    for m in _WORD.finditer(text.translate(_CLASSES)):
        out += _terms_of(text[m.start() : m.end()])
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokenize(texts: pd.Series) -> pd.Series:
    """``terms`` as a vectorised column function."""
    return texts.map(terms)


@F.udtf(returnType="term string, pos int")
class Tokens:
    """``SELECT * FROM tokens(text)``: the words of a text with positions from 1."""

    def eval(self, text: str) -> Iterator[tuple[str, int]]:
        yield from ((t, i) for i, t in enumerate(terms(text), 1))


def portable_tokens(text: Column) -> Column:
    """Words of ASCII letters and digits, without Python; any engine with regular expressions gets the same."""
    found = F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), F.lit(1))
    return F.transform(found, lambda t: F.lower(F.left(t, F.lit(MAX_UNITS))))  # of words in ASCII, as no other sign is in them


def valid(raw: Column) -> Column:
    """Whether bytes are a text at all."""
    return F.is_valid_utf8(raw)


def placed(texts: Column, first: int = 1) -> Column:
    """``texts`` (an array of structs of field and words), one after the other: an array of (field, term, pos).

    A text of one word has no position; those of several take consecutive ones, and one is left out behind them.
    """
    kind = "array<struct<field: string, term: string, pos: int>>"

    def step(acc: Column, text: Column) -> Column:
        words, several = text["words"], F.size(text["words"]) > 1
        own = F.transform(words, lambda w, i: F.struct(text["field"].alias("field"), w.alias("term"), F.when(several, acc["next"] + i).cast("int").alias("pos")))
        return F.struct((acc["next"] + F.when(F.size(words) == 1, 0).otherwise(F.size(words) + 1)).alias("next"), F.concat(acc["out"], own).cast(kind).alias("out"))

    return F.aggregate(texts, F.struct(F.lit(first).alias("next"), F.array().cast(kind).alias("out")), step)["out"]


def positions(words: Column, first: int = 1) -> Column:
    """Consecutive positions from ``first``; a text of one word has none."""
    return F.when(F.size(words) > 1, F.sequence(F.lit(first), F.lit(first - 1) + F.size(words))).otherwise(F.array().cast("array<int>"))
