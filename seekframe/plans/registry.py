"""The table of queries, and what they read: the given tables as catalogues to search in."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import index, tree
from ..sources import corpus
from .compile import Catalog
from .query import Query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def words(value: str) -> list[str]:
    """The portable words of a search value."""
    return [w[: text.MAX_UNITS] for w in re.findall("[a-z0-9]+", value.translate(str.maketrans(text.UPPER, text.LOWER)))]


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.tokens(corpus.documents(spark, sf_dir))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.terms(corpus.documents(spark, sf_dir))


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Contents, names, tags and properties of the documents as one postings table."""
    docs, tags = corpus.documents(spark, sf_dir), corpus.tags(spark, sf_dir)
    none = F.array().cast("array<int>").alias("positions")
    rows = index.postings(corpus.tokens(docs)).select("field", "term", "doc_id", "positions")
    raw = tags.select(F.lit("tag").alias("field"), F.col("tag").alias("term"), "doc_id", none)
    cut = tags.select("doc_id", F.explode(text.portable_tokens(F.col("tag"))).alias("term")).select(F.lit("tags").alias("field"), "term", "doc_id", none)
    typed = docs.select("doc_id", F.explode(F.create_map(F.lit("length"), F.col("n_chars").cast("string"), F.lit("language"), "lang", F.lit("type"), F.lit("document"))).alias("field", "term"))
    rows = rows.unionByName(raw).unionByName(cut).unionByName(typed.where("term is not null").select("field", "term", "doc_id", none))
    folders = tree.with_ancestors(docs.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("path"))).select((-F.abs(F.xxhash64("path"))).alias("doc_id"), "path")
    paths = docs.select("doc_id", "path").unionByName(folders)
    return Catalog(rows, docs.select("doc_id", "mtime", "ctime"), paths, {"length": "int", "language": "string"}, words, tokens=corpus.tokens(docs))


def search(spark: SparkSession, sf_dir: str, q: Query | str) -> DataFrame:
    q = q if isinstance(q, Query) else Query(q, order="id")
    found = q.ids(catalog(spark, sf_dir))
    return found if found is not None else spark.createDataFrame([], "doc_id long")


def parts(spark: SparkSession, sf_dir: str) -> Catalog:
    p = corpus.table(spark, sf_dir, "part")
    typed = p.select(F.col("p_partkey").alias("doc_id"), F.explode(F.create_map(F.lit("price"), F.col("p_retailprice").cast("string"), F.lit("size"), F.col("p_size").cast("string"))).alias("field", "term"))
    return Catalog(typed.withColumn("positions", F.array().cast("array<int>")), types={"price": "double", "size": "int"}, words=words)


def part_search(spark: SparkSession, sf_dir: str, q: str, strict: bool = False) -> DataFrame:
    c = parts(spark, sf_dir)
    c.strict = strict
    return Query(q).ids(c)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = corpus.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("doc_id"), "o_orderdate", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("mtime"))
