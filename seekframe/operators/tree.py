"""Folder trees (inventory G1-G9). A tree is (doc_id, parent_id, name); the root 0 has no row.

Paths are built by pointer doubling: a join doubles how far every node has looked up, so the
deepest tree allowed takes nine joins. Deep trees are written to the shared folder between joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import staged

MAX_DEPTH = 512


def paths(tree: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(doc_id, path); a node whose ancestors break off, or that lies deeper than ``max_depth``, has an empty path."""
    out = tree.select("doc_id", F.col("parent_id").alias("above"), F.concat(F.lit("/"), "name").alias("path"))
    reach = 1
    while reach < max_depth:
        up = out.select(F.col("doc_id").alias("above"), F.col("above").alias("next"), F.col("path").alias("head"))
        out = out.join(up, "above", "left").select(
            "doc_id", F.when(F.col("above") == 0, F.lit(0)).otherwise(F.coalesce("next", F.lit(-1))).cast("long").alias("above"),
            F.when(F.col("head").isNull(), F.col("path")).otherwise(F.concat("head", "path")).alias("path"),
        )
        reach *= 2
        if reach >= 8 and reach < max_depth:  # else every doubling would double the plan too
            out = staged(out, "paths")
            if out.where("above > 0").isEmpty():
                break
    return out.select("doc_id", F.when(F.col("above") == 0, F.col("path")).otherwise("").alias("path"))


def under(path: Column, folder: str) -> Column:
    """The folder itself and all below it."""
    folder = "/" + "/".join(p for p in folder.split("/") if p)
    return F.lit(True) if folder == "/" else (path == folder) | path.startswith(folder + "/")


def descendants(paths: DataFrame, folder: str) -> DataFrame:
    return paths.where(under(F.col("path"), folder)).select("doc_id")


def descendants_of_known(paths: DataFrame, folder: str) -> DataFrame:
    """The subtree of a folder that has a row of its own; nothing of an unknown one. The root has none and is known."""
    folder = "/" + "/".join(p for p in folder.split("/") if p)
    below = paths.where(under(F.col("path"), folder))
    return (below if folder == "/" else below.where(paths.where(F.col("path") == folder).exists())).select("doc_id")


def children(tree: DataFrame, doc_id: int) -> DataFrame:
    return tree.where(F.col("parent_id") == doc_id).select("doc_id", "name")


def id_of(paths: DataFrame, path: str) -> DataFrame:
    """The node of a path; empty parts of it do not count."""
    return paths.where(F.col("path") == "/" + "/".join(p for p in path.split("/") if p)).select("doc_id")


def with_ancestors(files: DataFrame) -> DataFrame:
    """Every prefix of the paths (path) of ``files``, once."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    prefix = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return files.where("path <> ''").select(F.explode(prefix).alias("path")).distinct()


def add_paths(tree_paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path, parent): the folders and files that ``files`` needs and ``tree_paths`` lacks."""
    missing = with_ancestors(files).join(tree_paths.select("path"), "path", "left_anti")
    return missing.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("parent"))


def move(tree: DataFrame, doc_id: int, parent_id: int | None = None, name: str | None = None) -> DataFrame:
    """Another parent or name for one node; what is below it follows through its ids."""
    it = F.col("doc_id") == doc_id
    out = tree
    if parent_id is not None:
        out = out.withColumn("parent_id", F.when(it, F.lit(parent_id).cast("long")).otherwise(F.col("parent_id")))
    if name is not None:
        out = out.withColumn("name", F.when(it, F.lit(name)).otherwise(F.col("name")))
    return out


def remove_recursively(tree: DataFrame, paths: DataFrame, folder: str) -> DataFrame:
    return tree.join(descendants(paths, folder), "doc_id", "left_anti")


def remove_where(tree: DataFrame, paths: DataFrame, folder: str, delete: Column) -> DataFrame:
    """Removes below ``folder`` what ``delete`` (over path) names, from the top: a node that stays protects all below it, and a folder stays while anything in it does."""
    own = paths.where(under(F.col("path"), folder)).select("doc_id", "path", delete.alias("delete"))
    kept = own.where(~F.coalesce("delete", F.lit(False))).select("path")
    above = with_ancestors(own.select("path")).select("path")  # prefixes of all nodes
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    shielded = own.select("doc_id", F.explode(chain).alias("path")).join(kept, "path", "left_semi").select("doc_id").distinct()
    protecting = with_ancestors(kept).join(above, "path", "left_semi")
    holding = own.join(protecting, "path", "left_semi").select("doc_id")
    gone = own.select("doc_id").join(shielded, "doc_id", "left_anti").join(holding, "doc_id", "left_anti")
    return tree.join(gone, "doc_id", "left_anti")


def tag_children(tags: DataFrame, prefix: str = "") -> DataFrame:
    """(section): the next part of the tags under a prefix, which is compared without case; of spellings that differ by case the first in order."""
    depth = len([p for p in prefix.split("/") if p])
    start = prefix.strip("/").lower()
    below = tags.where(F.lower("tag").startswith(start + "/")) if start else tags
    part = F.try_element_at(F.split("tag", "/"), F.lit(depth + 1))
    return below.select(part.alias("section")).where("section <> ''").groupBy(F.lower("section").alias("low")).agg(F.min("section").alias("section")).select("section")
