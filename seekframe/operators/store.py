"""An index that is kept: tables in buckets of documents, of which a change rewrites only those it touches (inventory SINK1, SINK2, W5, W14).

Every table is partitioned by the bucket of its documents, postings within one in the order of (field, term), so that
row-group statistics skip what a scan does not need. A change is computed from the touched buckets alone, written to the shared folder,
and then takes their place with Spark's dynamic partition overwrite. Changes replace or remove by document, so one that was interrupted can be done again.

A bucket is not a task: adaptive execution cuts its rows into pieces of about ``spark.sql.adaptive.advisoryPartitionSizeInBytes``, each of which
is sorted and written as a file of its own, so what a task sorts does not grow with the index, however few the buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SCHEMA_VERSION, TABLES
from ..sources.storage import staged
from .index import Index

BUCKETS = 64


def bucket(doc_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def _write(table: str, rows: DataFrame, path: str, buckets: int, which: list[int]) -> None:
    """Replaces the buckets ``which``; a row without an id in each lets empty ones take the place of full ones too."""
    rows = rows.withColumn("bucket", bucket(F.col("doc_id"), buckets))
    ends = rows.sparkSession.createDataFrame([(b,) for b in which], "bucket int")
    rows = rows.unionByName(ends, allowMissingColumns=True).hint("rebalance", "bucket")
    order = ["bucket", "field", "term"] if table == "postings" else ["bucket", "mtime"] if table == "times" else ["bucket"]
    rows.sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/{table}")


def create(index: Index, path: str, buckets: int = BUCKETS) -> None:
    for table in TABLES:
        _write(table, getattr(index, table), path, buckets, list(range(buckets)))
    layout = index.postings.sparkSession.range(1).select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(buckets).alias("buckets"))
    layout.coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")


def _layout(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path}/layout").first()


def load(spark: SparkSession, path: str, which: list[int] | None = None) -> Index | None:
    """The index, or some buckets of it; None where the layout has another version, which means to build anew."""
    if _layout(spark, path).schema_version != SCHEMA_VERSION:
        return None

    def table(name: str) -> DataFrame:
        rows = spark.read.schema(T.StructType([*TABLES[name].fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{path}/{name}")
        rows = rows if which is None else rows.where(F.col("bucket").isin(which))
        return rows.where("doc_id is not null").drop("bucket")

    return Index(**{name: table(name) for name in TABLES})


def rewrite(spark: SparkSession, path: str, ids: DataFrame, update: Callable[[Index], Index]) -> None:
    """Replaces the buckets of the documents ``ids`` by what ``update`` makes of them; it must leave other documents as they are."""
    buckets = _layout(spark, path).buckets
    touched = sorted(r.bucket for r in ids.select(bucket(F.col("doc_id"), buckets).alias("bucket")).where("bucket is not null").distinct().collect())  # at most ``buckets``
    if not touched:
        return
    before = load(spark, path, touched)
    after = update(before)
    # all tables first, as each may depend on all others
    changed = {t: staged(getattr(after, t).select(*TABLES[t].names), f"store-{t}") for t in TABLES if getattr(after, t) is not getattr(before, t)}
    for table, rows in changed.items():
        _write(table, rows, path, buckets, touched)
