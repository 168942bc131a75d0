"""A kept index that follows change events (inventory SINK2, ST12-ST17, W1-W3, W10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import portable_tokens
from ..operators import generate, maintain, store, tree
from ..operators.index import Index
from ..sources.storage import staged
from . import changes


def known_files(index: Index) -> DataFrame:
    """(doc_id, path, mtime, ctime) of what is indexed."""
    return tree.paths(index.files).join(index.times, "doc_id", "left")


def gone_ids(index: Index, jobs: DataFrame) -> DataFrame:
    """Documents at the paths that jobs (path, job) remove, and below them."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    every = tree.paths(index.files).select("doc_id", F.explode(above).alias("path"))
    return every.join(jobs.where("job = 'remove'").select("path"), "path", "left_semi").select("doc_id").distinct()


def carry_out(index: Index, gone: DataFrame, plan: DataFrame, files: DataFrame, words=portable_tokens) -> Index:
    """Removes ``gone`` (doc_id), then does the plan (doc_id, facets) with the files as they are now."""
    return maintain.replace_each(maintain.remove(index, gone), generate.index_of(files, words), plan)


def first_load(index: Index, scanned: list[DataFrame], words=portable_tokens) -> Index:
    """First run: the files of one included folder after another; an id that is there already is passed over."""
    for files in scanned:
        index = maintain.add(index, generate.index_of(files.dropDuplicates(["doc_id"]), words))
    return index


def rescan(index: Index, files: DataFrame, words=portable_tokens) -> Index:
    """Takes over what a scan shows to be new or changed; names and places only where the path is another."""
    plan = staged(changes.update_plan(files.select("doc_id", "path", "mtime", "ctime"), known_files(index)).select("doc_id", "facets"), "rescan")
    return maintain.replace_each(index, generate.index_of(files.join(plan, "doc_id", "left_semi"), words), plan)


def apply(spark: SparkSession, path: str, jobs: DataFrame, found: DataFrame, words=portable_tokens) -> None:
    """Carries jobs (path, job) out on the index kept under ``path``. ``found`` are the files that are there now, as ``generate`` takes them, with
    their path; links and what the configuration excludes are left out of it. Only buckets of touched documents are rewritten."""
    index = store.load(spark, path)
    jobs = staged(jobs.select("path", "job"), "jobs")
    gone = staged(gone_ids(index, jobs), "gone")
    known = known_files(index).join(gone, "doc_id", "left_anti")
    plan = staged(changes.job_plan(jobs, found, known), "plan")
    files = staged(found.join(plan, "doc_id", "left_semi"), "found")
    store.rewrite(spark, path, gone.unionByName(plan.select("doc_id")), lambda part: carry_out(part, gone, plan, files, words))


def follow(spark: SparkSession, path: str, events: DataFrame, describe: Callable[[DataFrame], DataFrame], checkpoint: str, every: str = "2 seconds", words=portable_tokens):
    """Starts a stream that keeps the index under ``path`` up to date; ``describe`` gives the rows of the files that are there now at given paths (path)."""

    def batch(rows: DataFrame, number: int) -> None:
        jobs = staged(rows.select("path", "job"), "batch")
        if not jobs.isEmpty():
            apply(spark, path, jobs, describe(jobs.select("path").distinct()), words)

    return changes.maintain(events, batch, checkpoint, every)
