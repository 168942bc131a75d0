"""Index tables: build, dictionary and membership scans (inventory A1-A5, A13, SCAN1-SCAN15)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES


@dataclass(frozen=True)
class Index:
    """One DataFrame for each table of ``schema.TABLES``."""

    postings: DataFrame
    files: DataFrame
    times: DataFrame
    data: DataFrame
    queue: DataFrame
    failed: DataFrame

    def with_(self, **tables: DataFrame) -> Index:
        return replace(self, **tables)


def empty(spark: SparkSession) -> Index:
    return Index(**{name: spark.createDataFrame([], schema) for name, schema in TABLES.items()})


def postings(tokens: DataFrame, origin: str = "content") -> DataFrame:
    """Inverted rows of tokens (doc_id, field, term, pos): the positions of a term in a document, sorted."""
    return tokens.groupBy("field", "term", "doc_id").agg(F.array_sort(F.collect_set("pos")).alias("positions")).select("field", "term", "doc_id", F.lit(origin).alias("origin"), "positions")


def inverted_lists(tokens: DataFrame) -> DataFrame:
    """(field, term, segment, doc_ids): the list of a term in segments of at most 4096 ids, a range of ids each."""
    return tokens.groupBy("field", "term", F.shiftright("doc_id", 12).alias("segment")).agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))


def forward_lists(tokens: DataFrame) -> DataFrame:
    """(doc_id, field, terms): the distinct sorted terms of every document."""
    return tokens.groupBy("doc_id", "field").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def forward_by_origin(postings: DataFrame, doc_id: int) -> DataFrame:
    return postings.where(F.col("doc_id") == doc_id).groupBy("origin").agg(F.array_sort(F.collect_set("term")).alias("terms"))


# -- scans -------------------------------------------------------------------------


def equal(rows: DataFrame, field: str, term: str) -> DataFrame:
    return rows.where((F.col("field") == field) & (F.col("term") == term)).select("doc_id").distinct()


def starts_with(rows: DataFrame, field: str, prefix: str) -> DataFrame:
    """A range of terms; the prefix reaches the Parquet scan."""
    if not prefix:
        raise ValueError("an empty prefix would be every term")
    return rows.where((F.col("field") == field) & F.col("term").startswith(prefix)).select("doc_id").distinct()


def matches(rows: DataFrame, field: str, prefix: str, pattern: str) -> DataFrame:
    """Terms whose rest after ``prefix`` holds the pattern; the prefix is kept as its own condition, for the scan."""
    rest = F.substring("term", len(prefix) + 1, 1 << 20)
    return rows.where((F.col("field") == field) & F.col("term").startswith(prefix) & rest.rlike(pattern)).select("doc_id").distinct()


def compare(rows: DataFrame, field: str, kind: str, low=None, high=None) -> DataFrame:
    """Terms within inclusive bounds, read as ``bigint`` or ``double``, or as bytes for ``string``; other terms drop out."""
    value = F.col("term") if kind == "string" else F.col("term").try_cast(kind)
    rows = rows.where(F.col("field") == field)
    if low is not None:
        rows = rows.where(value >= F.lit(low))
    if high is not None:
        rows = rows.where(value <= F.lit(high))
    return rows.select("doc_id").distinct()


def modified_between(times: DataFrame, begin: int, end: int) -> DataFrame:
    return times.where(F.col("mtime").between(begin, end)).select("doc_id").distinct()


def dictionary(rows: DataFrame, prefix: str = "") -> DataFrame:
    rows = rows.where(F.col("term").startswith(prefix)) if prefix else rows
    return rows.select("field", "term").distinct()


def first_queued(queue: DataFrame, n: int) -> DataFrame:
    return queue.orderBy("doc_id").limit(n)


def membership(ids: DataFrame, index: Index) -> DataFrame:
    """For every id whether it is known, queued and failed."""
    out = ids.select("doc_id").distinct()
    for name, table in (("known", index.files), ("queued", index.queue), ("failed", index.failed)):
        out = out.join(table.select("doc_id", F.lit(True).alias(name)).distinct(), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def lookup(ids: DataFrame, table: DataFrame) -> DataFrame:
    """The rows of a table for given ids; ids that it lacks have nulls."""
    return ids.join(table, "doc_id", "left")


def properties(ids: DataFrame, data: DataFrame) -> DataFrame:
    """(doc_id, found, values): the properties of documents; no row, an empty text and an empty object all mean not found."""
    from ..functions.encode import property_values

    found = F.coalesce(~F.trim("data").isin("", "{}"), F.lit(False))
    return lookup(ids, data).select("doc_id", found.alias("found"), F.when(found, property_values(F.col("data"))).alias("values"))


def totals(index: Index) -> DataFrame:
    """Documents with content terms, all ids in postings, queue length, and failures, of which at most 100 are counted."""
    content = index.postings.where("origin = 'content'").agg(F.count_distinct("doc_id").alias("documents"))
    ids = index.postings.agg(F.count_distinct("doc_id").alias("ids"))
    queue = index.queue.agg(F.count("*").alias("queued"))
    failed = index.failed.limit(100).agg(F.count("*").alias("failed"))
    one = [x.withColumn("k", F.lit(1)) for x in (content, ids, queue, failed)]
    return one[0].join(one[1], "k").join(one[2], "k").join(one[3], "k").drop("k")


def shares(sizes: DataFrame, name: Column, size: Column) -> DataFrame:
    """(name, bytes, percent): the size of every table and its part of all; the total is joined, not windowed."""
    each = sizes.groupBy(name.alias("name")).agg(F.sum(size).alias("bytes"))
    total = each.agg(F.sum("bytes").alias("total")).withColumn("k", F.lit(1))
    return each.withColumn("k", F.lit(1)).join(F.broadcast(total), "k").select("name", "bytes", (100.0 * F.col("bytes") / F.col("total")).alias("percent"))
