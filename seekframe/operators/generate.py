"""Index rows of files: words of names, attributes and contents, kinds, times (inventory T5-T10, W1).

Files are rows (doc_id, parent_id, name, mtime, ctime) and, where known, mime, size, is_dir, tags, rating, comment, text and data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import encode
from ..functions.text import placed, portable_tokens
from ..schema import FIRST_POSITION, POSTINGS
from ..sources.files import may_extract
from .index import Index, empty

Words = Callable[[Column], Column]
OPTIONAL = {"mime": "string", "size": "bigint", "is_dir": "boolean", "tags": "array<string>", "rating": "int", "comment": "string", "text": "string", "data": "string"}


def complete(files: DataFrame) -> DataFrame:
    """With a null column for each that is missing."""
    return files.withColumns({name: F.lit(None).cast(kind) for name, kind in OPTIONAL.items() if name not in files.columns})


def _rows(files: DataFrame, found: Column, origin: str) -> DataFrame:
    """Postings of arrays of (field, term, pos)."""
    words = files.select("doc_id", F.inline(found))
    out = words.groupBy("field", "term", "doc_id").agg(F.array_sort(F.collect_set("pos")).alias("positions"))
    return out.select("field", "term", "doc_id", F.lit(origin).alias("origin"), "positions")


def _text(field: str, words: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), words.alias("words"))


def _exact(field: str, terms: Column) -> Column:
    """Terms without positions."""
    return F.transform(terms, lambda t: F.struct(F.lit(field).alias("field"), t.alias("term"), F.lit(None).cast("int").alias("pos")))


def name_postings(files: DataFrame, words: Words = portable_tokens) -> DataFrame:
    return _rows(files, placed(F.array(_text("filename", words(F.col("name")))), FIRST_POSITION["filename"]), "filename")


def attribute_postings(files: DataFrame, words: Words = portable_tokens) -> DataFrame:
    """Tags as words, one after the other, and each as it is; a rating other than 0; the words of a comment behind those of the tags."""
    files = complete(files)
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    texts = F.concat(F.transform(tags, lambda t: _text("tags", words(t))), F.when(F.coalesce("comment", F.lit("")) != "", F.array(_text("usercomment", words(F.col("comment"))))).otherwise(F.array().cast("array<struct<field: string, words: array<string>>>")))
    rating = F.when(F.coalesce("rating", F.lit(0)) != 0, F.array(F.col("rating").cast("string"))).otherwise(F.array().cast("array<string>"))
    return _rows(files, F.concat(placed(texts, FIRST_POSITION["xattr"]), _exact("tag", tags), _exact("rating", rating)), "xattr")


def content_postings(files: DataFrame, words: Words = portable_tokens) -> DataFrame:
    """The words of a text, the media type and the kinds."""
    files = complete(files)
    mime, none = encode.effective_mime(F.col("mime"), F.coalesce("size", F.lit(1))), F.array().cast("array<string>")
    kinds = F.when(F.col("mime").isNull() & ~F.coalesce("is_dir", F.lit(False)), none).otherwise(encode.kinds(F.coalesce("mime", F.lit("")), F.coalesce("size", F.lit(1)), F.coalesce("is_dir", F.lit(False))))
    text = placed(F.array(_text("content", F.coalesce(words(F.col("text")), none))), FIRST_POSITION["text"])
    return _rows(files, F.concat(text, _exact("mimetype", F.array_compact(F.array(mime))), _exact("type", kinds)), "content")


def index_of(files: DataFrame, words: Words = portable_tokens) -> Index:
    """All tables for new files. Those with a text have it indexed; the other files that may be read wait in the queue."""
    files = complete(files)
    postings = name_postings(files, words).unionByName(attribute_postings(files, words)).unionByName(content_postings(files, words))
    waits = F.col("text").isNull() & ~F.coalesce("is_dir", F.lit(False)) & may_extract(F.coalesce("mime", F.lit("")), F.coalesce("size", F.lit(1))) & (F.coalesce("size", F.lit(1)) > 0)
    return empty(files.sparkSession).with_(
        postings=postings.select(*POSTINGS.names), files=files.select("doc_id", "parent_id", "name"), times=files.select("doc_id", "mtime", "ctime"),
        data=files.where("data is not null").select("doc_id", "data"), queue=files.where(waits).select("doc_id"),
    )
