"""The given tables as files, documents, tags, properties and change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import portable_tokens

FIRST_TIME = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, name, mtime, ctime, text, lang, source, n_chars); ids from 1, as 0 stands for none."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc_"), d.doc_id, F.lit(".txt"))
    mtime = F.lit(FIRST_TIME) + d.doc_id * 3600
    return d.select(
        (d.doc_id + 1).alias("doc_id"), F.concat(F.lit("/"), d.lang, F.lit("/"), d.source, F.lit("/"), name).alias("path"), name.alias("name"),
        mtime.alias("mtime"), (mtime + d.doc_id % 5 * 60).alias("ctime"), "text", "lang", "source", "n_chars",
    )


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, field, term, pos) of contents and file names; positions from 1, portable words."""
    content = docs.select("doc_id", F.lit("content").alias("field"), F.posexplode(portable_tokens(F.col("text"))).alias("pos", "term"))
    names = docs.select("doc_id", F.lit("filename").alias("field"), F.posexplode(portable_tokens(F.col("name"))).alias("pos", "term"))
    return content.unionByName(names).select("doc_id", "field", "term", (F.col("pos") + 1).alias("pos"))


def terms(docs: DataFrame) -> DataFrame:
    """(doc_id, field, term): the different words of ``tokens`` in every content and file name; what a text repeats is no row."""
    each = [docs.select("doc_id", F.lit(field).alias("field"), F.explode(F.array_distinct(portable_tokens(F.col(column)))).alias("term")) for field, column in (("content", "text"), ("filename", "name"))]
    return each[0].unionByName(each[1])


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tag): two raw tags for every labelled document."""
    labels = table(spark, sf_dir, "labels")
    both = F.array(F.concat(F.lit("quality/"), F.col("quality")), F.concat(F.lit("toxic/"), F.col("toxic")))
    return labels.select((F.col("doc_id") + 1).alias("doc_id"), F.explode(both).alias("tag")).where("tag is not null")


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, parent_id, name): region, nation and customer as three levels of a tree."""
    region = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("parent_id"), F.col("r_name").alias("name"))
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("doc_id"), (F.col("n_regionkey") + 1).cast("long").alias("parent_id"), F.col("n_name").alias("name"))
    customer = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).alias("doc_id"), (F.col("c_nationkey") + 100).cast("long").alias("parent_id"), F.col("c_name").alias("name"))
    return region.unionByName(nation).unionByName(customer)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, path, ts, kind): change events, one path for every user."""
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in EVENT_KINDS.items() for x in pair]), F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("/user/"), F.col("user_id")).alias("path"), "ts", kind.alias("kind"))


EVENT_KINDS = {"signup": "created", "purchase": "modified", "click": "closed", "view": "attributes", "error": "deleted"}
