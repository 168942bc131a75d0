"""Folders as tables: scans, changes since the last scan, and text extraction (inventory SRC1-SRC5)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encode import pack_id
from ..operators.config import included
from ..operators.tree import with_ancestors

LARGE_TEXT = 10 * 1024 * 1024


def stat_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, path, name, size, mtime, ctime, is_dir) of files (path, size, mtime, is_dir, and where they are known device, inode and ctime): the id is made of device and inode, else of the path."""
    packed = pack_id(F.col("device"), F.col("inode")) if {"device", "inode"} <= set(rows.columns) else F.lit(None).cast("bigint")
    ctime = F.coalesce("ctime", "mtime") if "ctime" in rows.columns else F.col("mtime")
    return rows.select(F.coalesce(packed, F.xxhash64("path")).alias("doc_id"), "path", F.element_at(F.split("path", "/"), -1).alias("name"), "size", "mtime", ctime.alias("ctime"), "is_dir")


def listed(rows: DataFrame, folders: dict[str, bool], filters: Iterable[str] = (), hidden: bool = False, dirs_only: bool = False) -> DataFrame:
    """What a walk down the included folders meets of rows (path, is_dir, is_link): the folders themselves, no links, nothing hidden or excluded, nor what lies below such folders."""
    out = rows.where(~F.col("is_link") & included(F.col("path"), folders, filters, hidden))
    return out.where("is_dir") if dirs_only else out


def scan(spark: SparkSession, folder: str, filters: Iterable[str] = (), dirs_only: bool = False) -> DataFrame:
    """``stat_rows`` of a folder, the folders in it and their files, as ``listed``; contents are not read. Spark lists nothing hidden, no empty folders, no links and no change times."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.url_decode(F.regexp_replace("path", "^[a-z]+:/*", "/"))
    files = found.select(path.alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), F.lit(False).alias("is_dir"))
    root = "/" + "/".join(p for p in re.sub("^[a-z]+:/*", "/", folder).split("/") if p)
    above = with_ancestors(files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("path"))).where((F.col("path") == root) | F.col("path").startswith(root + "/"))
    folders = above.select("path", F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("mtime"), F.lit(True).alias("is_dir"))
    rows = stat_rows(files.unionByName(folders)).withColumn("is_link", F.lit(False))
    return listed(rows, {root: True}, filters, True, dirs_only).drop("is_link")


def changed(found: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``found`` (doc_id, mtime, ctime, is_dir) that are new or changed since ``known``; folders count only by ctime."""
    old = known.select("doc_id", F.col("mtime").alias("old_mtime"), F.col("ctime").alias("old_ctime"))
    new = F.col("old_mtime").isNull()
    both = found.join(old, "doc_id", "left").withColumn("mtime_changed", new | (F.col("mtime") != F.col("old_mtime"))).withColumn("ctime_changed", new | (F.col("ctime") != F.col("old_ctime")))
    return both.where(F.when(F.col("is_dir"), F.col("ctime_changed")).otherwise(F.col("mtime_changed") | F.col("ctime_changed"))).drop("old_mtime", "old_ctime")


def may_extract(mime: Column, size: Column) -> Column:
    """Large texts and mailboxes are not read."""
    return ~((mime.startswith("text/") | (mime == "application/mbox")) & (size >= LARGE_TEXT))


def extract(files: DataFrame) -> DataFrame:
    """(doc_id, text, status) of (doc_id, mime, content): plain text and HTML; a file that fails does not fail the batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, status = [], []
            for mime, content in zip(frame["mime"], frame["content"], strict=True):
                try:
                    text = bytes(content).decode()
                    if mime == "text/html":
                        text = re.sub(r"(?is)<script\b.*?</script>|<style\b.*?</style>|<[^>]*>", " ", text)
                    elif not (mime or "").startswith("text/"):
                        raise ValueError(mime)
                    texts.append(text)
                    status.append("succeeded")
                except (UnicodeDecodeError, ValueError, TypeError):
                    texts.append(None)
                    status.append("failed")
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": texts, "status": status})

    return files.select("doc_id", "mime", "content").mapInPandas(run, "doc_id long, text string, status string")
