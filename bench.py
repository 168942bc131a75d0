"""Times the headline queries, from the tables and from a kept index, and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekframe.operators import generate, store
from seekframe.plans import catalogue
from seekframe.plans.compile import Catalog
from seekframe.plans.query import Query
from seekframe.plans.registry import words
from seekframe.sources import corpus

HEADLINE = (
    "term_equal", "term_prefix", "contains_word", "and_3", "or_3", "nested_and_or", "phrase_2", "phrase_3", "phrase_and_term", "int_ge", "mtime_between", "include_folder_and_term",
    "sort_mtime_desc", "offset_limit", "inverted_lists", "forward_lists", "path_reconstruct", "diff_new_changed", "replace_terms", "timeline_days", "event_flag_merge", "rename_pairs",
)
#: The same searches on an index that was built before.
KEPT = {
    "term_equal": "content=the", "term_prefix": "content:thin", "contains_word": "content:thatin", "and_3": "content:the content:that content:with", "or_3": "content:einen OR content:pour OR content:para",
    "nested_and_or": "(content:einen OR content:pour) AND (content:des OR content:nicht)", "phrase_2": 'content="of the"', "phrase_3": 'content="in of the"', "phrase_and_term": 'content="of the" AND content:with',
}


def timed(frame) -> float:
    began = time.perf_counter()
    frame().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}

    def run(name: str, frame) -> None:
        runs = [timed(frame) for _ in range(3)]  # the first one warms up
        took[name] = round(statistics.median(runs[1:]), 3)

    for name in HEADLINE:
        run(name, lambda: catalogue.QUERIES[name](spark, sf))
    with tempfile.TemporaryDirectory(prefix="spark-bench-") as folder:
        began = time.perf_counter()
        store.create(generate.index_of(corpus.documents(spark, sf).withColumn("parent_id", F.lit(0).cast("bigint"))), f"{folder}/index", int(cpus))
        built = round(time.perf_counter() - began, 3)
        index = store.load(spark, f"{folder}/index")
        kept = Catalog(index.postings, index.times, words=words)

        def search(q: str) -> DataFrame:
            return Query(q, order="id").ids(kept)

        for name, q in KEPT.items():
            run(f"kept_{name}", lambda: search(q))
    tables = sum(took[n] for n in HEADLINE)
    out = {"metric": "headline queries from the tables, total", "value": round(tables, 3), "unit": "sec", "queries": took, "kept_total": round(sum(took.values()) - tables, 3), "kept_build": built, "sf": sf.rsplit("sf", 1)[-1]}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
