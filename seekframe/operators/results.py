"""Order, slices, names and administrative figures of results (inventory S1-S4, WN1, A6-A12, SINK3-SINK4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 5


def newest_first(ids: DataFrame, times: DataFrame, offset: int = 0, limit: int = -1) -> DataFrame:
    """(doc_id, mtime), newest first, ties by id; unknown times are 0. A limit makes it a top-k."""
    out = ids.join(times.select("doc_id", "mtime"), "doc_id", "left").withColumn("mtime", F.coalesce("mtime", F.lit(0).cast("long")))
    return sliced(out.orderBy(F.desc("mtime"), "doc_id"), offset, limit)


def by_id(ids: DataFrame, offset: int = 0, limit: int = -1) -> DataFrame:
    return sliced(ids.orderBy("doc_id") if offset or limit >= 0 else ids, offset, limit)


def sliced(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    rows = rows.offset(offset) if offset > 0 else rows
    return rows.limit(limit) if limit >= 0 else rows


def numbered_names(rows: DataFrame, *order: Column) -> DataFrame:
    """``shown``: the n-th repeat of a name gets `` (n)``."""
    n = F.row_number().over(Window.partitionBy("name").orderBy(*order)) - 1
    return rows.withColumn("shown", F.when(n > 0, F.concat("name", F.lit(" ("), n, F.lit(")"))).otherwise(F.col("name")))


def nth_named(rows: DataFrame, name: str, n: int, *order: Column) -> DataFrame:
    """The inverse: the row that stands as ``name (n)``, n from 0; the last one where there are fewer. A top-k of its ends."""
    named = rows.where(F.col("name") == name).withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy(*order)) - 1)
    return named.where(F.col("n") <= n).orderBy(F.desc("n")).limit(1).drop("n")


def per_device(ids: DataFrame) -> DataFrame:
    return ids.groupBy(F.col("doc_id").bitwiseAND(F.lit(0xFFFFFFFF)).alias("device")).agg(F.count("*").alias("n"))


def scan_summary(rows: DataFrame, ignored: Column, accessible: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(ignored).alias("ignored"), F.count_if(~ignored & accessible).alias("accessible"))


def active_days(times: DataFrame, today: Column) -> DataFrame:
    """(day): days with a document, none in the future; one aggregate answers what a probe for each day would."""
    day = F.to_date(F.timestamp_seconds("mtime"))
    return times.select(day.alias("day")).where(F.col("day") <= today).distinct()


def active_months(times: DataFrame, today: Column) -> DataFrame:
    return active_days(times, today).select(F.year("day").alias("year"), F.month("day").alias("month")).distinct()


def weighted_average(batches: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """``estimate``: the average of the last five values of a group, the i-th oldest weighted with the root of i."""
    last = F.collect_list(value).over(Window.partitionBy(group).orderBy(order).rowsBetween(-(ROUNDS - 1), 0))
    weights = F.transform("last", lambda _, i: F.sqrt((i + 1).cast("double")))
    total = F.aggregate(F.zip_with("last", weights, lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x)
    return batches.withColumn("last", last).withColumn("estimate", total / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)).drop("last")


def status(files: DataFrame, known: Column, queued: Column, failed: Column, included: Column, is_dir: Column, is_link: Column, basic_only: bool = False) -> DataFrame:
    """``state`` of every file: why it is or is not in the index."""
    waiting = F.when(known, "basic indexing done").otherwise("waiting for basic indexing")
    full = F.when(~known, "waiting for both").when(queued, "waiting for content").when(failed, "failed").otherwise("done")
    state = F.when(is_link, "not a file or folder").when(~included, "excluded by path").when(is_dir | F.lit(basic_only), waiting).otherwise(full)
    return files.withColumn("state", state)


def as_lines(rows: DataFrame, with_id: bool = True) -> DataFrame:
    """What a command line prints: the id in hexadecimal, then the path."""
    text = F.concat(F.lower(F.hex("doc_id")), F.lit(" "), "path") if with_id else F.col("path")
    return rows.select(text.alias("line"))


def as_json(path: Column, state: Column) -> Column:
    """One status line as JSON."""
    return F.to_json(F.struct(path.alias("file"), state.alias("state")))
