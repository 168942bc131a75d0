"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Of every ``SPAN - GRAM + 1`` consecutive
k-grams of a text the smallest hash is kept; two texts with a common span of ``SPAN`` words keep a common
fingerprint, so the join of fingerprints misses no such span. Documents with a common fingerprint are then
extended: their windows are joined with the items' windows and the words compared themselves. An item with fewer words
than a window is one window of its own length; it is found by a fingerprint that is its smallest word hash.

The fingerprints and windows of the benchmark are written to the shared folder first, so that the planner knows
their size: it broadcasts them only under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles beyond it.
A passage that a third of all documents share costs one row for each of its windows and documents. Nulls and texts without words have no window.
Every row is judged by its own text, also where rows repeat a doc_id or have none; an empty benchmark contaminates nothing. Columns other than ids and texts are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_batches, staged, unused
from .url_filter import LOWER, UPPER

SPAN = 10
GRAM = 4
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
NOT_WORD_OR_UPPER = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; lower() only where every character is ASCII, as it also changes other letters."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def n_words(text: Column) -> Column:
    """How many words a text has; no letter needs to be lowered for that."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_WORD_OR_UPPER), "")).cast("long")


def rolled(df: DataFrame, column: str, k: int, combine) -> DataFrame:
    """Replaces an array by ``combine`` over every ``k`` consecutive elements, built from halves.

    Each step is a projection of its own, so that none is computed twice.
    """
    have = 1
    while have < k:
        step = min(have, k - have)
        a = F.col(column)
        df = df.withColumn(column, F.zip_with(a, F.slice(a, F.lit(step + 1), F.greatest(F.size(a) - step, F.lit(0))), combine))
        have += step
    return df.withColumn(column, F.slice(column, F.lit(1), F.greatest(F.size(column) - (k - 1), F.lit(0))))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def grams_hashed(df: DataFrame, column: str, k: int) -> DataFrame:
    return rolled(df, column, k, lambda a, b: F.xxhash64(a, b))


def winnowed(df: DataFrame, column: str, span: int, gram: int) -> DataFrame:
    """Word hashes -> the smallest k-gram hash of every winnowing window."""
    return rolled(grams_hashed(df, column, gram), column, span - gram + 1, lambda a, b: F.least(a, b))


def row_key() -> Column:
    """What tells rows apart: the id and a hash of the text. Rows with one key are judged once, and alike."""
    return F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))


def item_windows(items: DataFrame, span: int = SPAN) -> DataFrame:
    """(item_id, window, n): the distinct windows of every item as arrays of words."""
    split = items.select("item_id", words(F.col("text")).alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (span - 1), F.lit(1)))
    split = split.select("item_id", F.explode(starts).alias("at"), "words")
    return split.select("item_id", F.slice("words", F.col("at"), F.lit(span)).alias("window")).distinct().withColumn("n", F.size("window"))


def hits(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(key, item_id, start, n): every occurrence of an item's window in a document (key, text); equal keys have equal texts."""
    spark = docs.sparkSession
    every = staged(item_windows(items, span), "decontam-windows")
    lengths = sorted(r.n for r in every.select("n").distinct().collect())  # at most ``span`` lengths
    hashed = every.withColumn("h", word_hashes(F.col("window")))
    full = winnowed(hashed.where(F.col("n") == span), "h", span, gram).select(F.element_at("h", 1).alias("f"))
    short = hashed.where(F.col("n") < span).select(F.array_min("h").alias("f"))
    marks = staged(full.unionByName(short).distinct(), "decontam-marks")
    keyed = docs.select("key", words(F.col("text")).alias("words")).select("key", word_hashes(F.col("words")).alias("h"))
    if any(n < span for n in lengths):
        keyed = winnowed(keyed.withColumn("w", F.col("h")), "w", span, gram).select("key", F.concat("w", "h").alias("h"))
    else:
        keyed = winnowed(keyed, "h", span, gram)
    found = keyed.select("key", F.explode(F.array_distinct("h")).alias("f")).join(marks, "f", "left_semi").select("key").distinct()
    texts = docs.join(staged(found, "decontam-candidates"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    candidates = staged(texts.select("key", words(F.col("text")).alias("words")), "decontam-words")
    parts = spark.createDataFrame([], "key struct<id: bigint, hash: bigint>, item_id long, start long, n int, window array<string>")
    for n in lengths:
        targets = grams_hashed(hashed.where(F.col("n") == n), "h", n).select("item_id", "window", F.element_at("h", 1).alias("h"))
        at = grams_hashed(candidates.select("key", word_hashes(F.col("words")).alias("h")), "h", n).select("key", F.posexplode("h").alias("start", "h"))
        parts = parts.unionByName(at.join(targets, "h").select("key", "item_id", F.col("start").cast("long").alias("start"), F.lit(n).alias("n"), "window"))
    likely = parts.groupBy("key").agg(F.collect_list(F.struct("item_id", "start", "n", "window")).alias("found"))
    same = F.filter("found", lambda x: F.slice("words", (x["start"] + 1).cast("int"), x["n"]) == x["window"])
    return candidates.join(likely, "key").select("key", F.explode(same).alias("x")).select("key", "x.item_id", "x.start", "x.n")


def mark(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(key, n_hit, n_items, items_sha256, places) for the documents (key, text) that hold a window of an item.

    ``places`` are the sorted (start, n) of the windows found.
    """
    found = hits(docs, items, span, gram)
    by_item = found.groupBy("key", "item_id").agg(F.collect_set(F.struct("start", "n")).alias("places"))
    by_doc = by_item.groupBy("key").agg(F.collect_list(F.col("item_id").cast("string")).alias("ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
    # words under the windows, left to right: what each adds beyond the end of those before it
    walked = F.aggregate(
        "places", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit")),
        lambda acc, p: F.struct(F.greatest(acc["end"], p["start"] + p["n"]).alias("end"), (acc["hit"] + F.greatest(F.lit(0).cast("long"), p["start"] + p["n"] - F.greatest(acc["end"], p["start"]))).alias("hit")),
    )
    return by_doc.select("key", walked["hit"].alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("ids"), ","), 256).alias("items_sha256"), "places")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``docs``."""
    keyed = docs.select("doc_id", row_key().alias("key"), "text")
    marked = staged(mark(keyed.select("key", "text"), items).drop("places"), "decontam-marked")
    none = F.sha2(F.lit("").cast("binary"), 256)
    sizes = keyed.select("doc_id", "key", n_words(F.col("text")).alias("n_words"))
    return sizes.join(marked, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0).cast("long")) > 0).alias("contaminated"),
    )


def op5(spark, sf_dir):
    from .common import table

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a benchmark passage stay."""
    short_batches(spark)
    from .common import table

    marked = mark(docs.select(row_key().alias("key"), "text"), table(spark, sf_dir, "benchmark"))
    own = unused("decontam_key", docs.columns)
    marked = staged(marked.select(F.col("key").alias(own)), "decontam-marked")
    return docs.withColumn(own, row_key()).join(marked, own, "left_anti").select(*docs.columns)
