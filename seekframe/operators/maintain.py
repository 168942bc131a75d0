"""Changes to an index and checks of it (inventory W1-W13, J3-J11, SINK1-SINK2). Tables are replaced, never edited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tree
from .index import Index

FACETS = {"terms": "content", "filename": "filename", "xattr": "xattr"}


def upsert(table: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def remove(index: Index, ids: DataFrame) -> Index:
    """The index without the documents ``ids`` (doc_id), in every table."""
    gone = ids.select("doc_id").distinct()
    return Index(**{name: frame.join(gone, "doc_id", "left_anti").select(*frame.columns) for name, frame in vars(index).items()})


def add(index: Index, new: Index) -> Index:
    """Documents of ``new`` that the index does not have; those it has stay as they are."""
    fresh = new.files.select("doc_id").join(index.files.select("doc_id"), "doc_id", "left_anti")
    return Index(**{name: getattr(index, name).unionByName(frame.join(fresh, "doc_id", "left_semi")) for name, frame in vars(new).items()})


def replace(index: Index, new: Index, facets: set[str]) -> Index:
    """Takes the named facets (terms, filename, xattr, times, data, url) of the documents of ``new``, and leaves the others."""
    ids = new.files.select("doc_id").distinct()
    out = index
    origins = [origin for facet, origin in FACETS.items() if facet in facets]
    if origins:
        of = F.col("origin").isin(origins)
        old = index.postings.join(ids.withColumn("hit", F.lit(True)), "doc_id", "left").where(F.col("hit").isNull() | ~of).drop("hit")
        out = out.with_(postings=new.postings.where(of).unionByName(old))
    for facet, table in (("times", "times"), ("data", "data"), ("url", "files")):
        if facet in facets:
            rows = getattr(new, table)
            kept = getattr(out, table).join(ids, "doc_id", "left_anti")
            out = out.with_(**{table: kept.unionByName(rows)})
    return out


def last_writes(operations: DataFrame, keys: tuple[str, ...] = ("term", "doc_id")) -> DataFrame:
    """Of operations (keys, op, seq, and what comes with them) the last of every term and document."""
    rest = [c for c in operations.columns if c not in (*keys, "seq")]
    return operations.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("last")).select(*keys, "last.*")


def commit(postings: DataFrame, operations: DataFrame) -> DataFrame:
    """Postings after add and remove operations in their order. Operations have the columns of the postings that they touch, ``op`` and ``seq``."""
    keys = [k for k in ("field", "term", "doc_id") if k in postings.columns]
    last = last_writes(operations, tuple(keys))
    return postings.join(last, keys, "left_anti").unionByName(last.where("op = 'add'").drop("op"), allowMissingColumns=True)


def replace_each(index: Index, new: Index, plan: DataFrame) -> Index:
    """Does a plan (doc_id, facets) with the rows of ``new``: adds what is new, replaces facet by facet, and queues."""
    of = lambda facet: plan.where(F.array_contains("facets", facet)).select("doc_id").distinct()
    part = lambda ids: Index(**{name: frame.join(ids, "doc_id", "left_semi") for name, frame in vars(new).items()})
    out = index
    for facet in (*FACETS, "times", "data", "url"):
        out = replace(out, part(of(facet)), {facet})
    out = add(out, part(of("add")))
    return mark(out, queue=of("queue"))


def mark(index: Index, queue: DataFrame | None = None, unqueue: DataFrame | None = None, failed: DataFrame | None = None, unfailed: DataFrame | None = None) -> Index:
    """Puts documents (doc_id) into the queue or among the failed ones, or takes them out; whoever is in already stays once."""
    out = index
    for table, come, go in (("queue", queue, unqueue), ("failed", failed, unfailed)):
        if come is not None:
            out = out.with_(**{table: getattr(out, table).unionByName(come.select("doc_id")).distinct()})
        if go is not None:
            out = out.with_(**{table: getattr(out, table).join(go, "doc_id", "left_anti")})
    return out


def index_now(index: Index, new: Index) -> Index:
    """Foreground indexing: documents that wait in the queue or have data are passed over, known ones replaced but for what was extracted, others added."""
    ids = new.files.select("doc_id").join(index.queue, "doc_id", "left_anti").join(index.data, "doc_id", "left_anti")
    known = ids.join(index.files, "doc_id", "left_semi").select("doc_id", F.array(*map(F.lit, ("filename", "xattr", "times", "url"))).alias("facets"))
    fresh = ids.join(index.files, "doc_id", "left_anti").select("doc_id", F.array(F.lit("add")).alias("facets"))
    return replace_each(index, new, known.unionByName(fresh))


def to_clear(index: Index, wanted: DataFrame) -> DataFrame:
    """``wanted`` (path, found_id: the id in the file system, or null) with ``doc_id``: that id, else the one the index has for the path; null where neither has it."""
    now = tree.paths(index.files).select("path", F.col("doc_id").alias("own"))
    return wanted.join(now, "path", "left").select("path", F.coalesce("found_id", "own").alias("doc_id"))


def clear(index: Index, wanted: DataFrame) -> Index:
    """The index without the files ``wanted`` (path, found_id)."""
    return remove(index, to_clear(index, wanted).where("doc_id is not null"))


def stale_report(paths: DataFrame, found: DataFrame, ignored_devices: list[int], links: DataFrame) -> DataFrame:
    """(doc_id, path, action) of documents that are no longer found: removed, or ignored on some devices and where they are links."""
    gone = paths.join(found.select("path"), "path", "left_anti").join(links.select("path", F.lit(True).alias("link")).distinct(), "path", "left")
    ignored = F.col("doc_id").bitwiseAND(F.lit(0xFFFFFFFF)).isin(ignored_devices or [-1]) | F.coalesce("link", F.lit(False))
    return gone.select("doc_id", "path", F.when(ignored, "ignored").otherwise("removed").alias("action"))


def remove_stale(index: Index, report: DataFrame, dry_run: bool = False) -> Index:
    """Does what a report says; a dry run leaves the index as it is."""
    return index if dry_run else remove(index, report.where("action = 'removed'"))


def settle_content(index: Index, results: DataFrame, new_postings: DataFrame, new_data: DataFrame) -> Index:
    """The end of content extraction: ``results`` (doc_id, path, state) against the current paths.

    Gone files are removed, skipped ones leave the queue, and what was extracted counts only where the document is still queued and still there under the same path.
    """
    gone = results.where(F.col("state").isin("missing", "remove")).select("doc_id")
    index = remove(index, gone)
    now = tree.paths(index.files)
    good = results.where("state = 'succeeded'").join(index.queue, "doc_id", "left_semi").join(now, ["doc_id", "path"], "left_semi").select("doc_id")
    postings = index.postings.join(good.withColumn("hit", F.lit(True)), "doc_id", "left").where("hit is null or origin <> 'content'").drop("hit")
    failed = results.where("state = 'failed'").select("doc_id").join(index.files.select("doc_id"), "doc_id", "left_semi")
    return index.with_(
        postings=postings.unionByName(new_postings.join(good, "doc_id", "left_semi")),
        data=index.data.join(good, "doc_id", "left_anti").unionByName(new_data.join(good, "doc_id", "left_semi")),
        queue=index.queue.join(results.select("doc_id"), "doc_id", "left_anti"),
        failed=index.failed.unionByName(failed).distinct(),
    )


def move(index: Index, moves: DataFrame, name_postings: DataFrame) -> tuple[Index, DataFrame]:
    """``moves`` (doc_id, target_id, parent_id, name): a document at the target goes first, then the moved ones get parent, name and ``name_postings``.

    The second value are the moves of unknown documents: new files to index.
    """
    known = moves.join(index.files.select("doc_id"), "doc_id", "left_semi")
    unknown = moves.join(index.files.select("doc_id"), "doc_id", "left_anti")
    index = remove(index, moves.where("target_id is not null").select(F.col("target_id").alias("doc_id")))
    files = upsert(index.files, known.select("doc_id", "parent_id", "name"))
    hit = known.select("doc_id", F.lit(True).alias("hit"))
    postings = index.postings.join(hit, "doc_id", "left").where("hit is null or origin <> 'filename'").drop("hit")
    return index.with_(files=files, postings=postings.unionByName(name_postings.join(known, "doc_id", "left_semi"))), unknown


def rename_tag(tags: Column, old: str, new: str | None) -> Column:
    """A tags array with a tag and all tags below it renamed, or dropped where ``new`` is None."""
    hit = lambda t: (t == old) | t.startswith(old + "/")
    if new is None:
        return F.filter(tags, lambda t: ~hit(t))
    return F.array_distinct(F.transform(tags, lambda t: F.when(hit(t), F.concat(F.lit(new), F.substring(t, len(old) + 1, 1 << 20))).otherwise(t)))


def add_tag(tags: Column, tag: str) -> Column:
    return F.array_union(F.coalesce(tags, F.array().cast("array<string>")), F.array(F.lit(tag)))


# -- checks ------------------------------------------------------------------------


def stale(paths: DataFrame, found: DataFrame, included: Column, scope: str = "excluded") -> DataFrame:
    """Indexed paths to drop: those the configuration excludes; with scope ``all`` also those that are no longer found."""
    out = paths.where(~included)
    if scope == "all":
        out = out.unionByName(paths.where(included).join(found.select("path"), "path", "left_anti"))
    return out


def only_left(left: DataFrame, right: DataFrame) -> DataFrame:
    """(term, doc_id) pairs of one direction of the index that the other lacks."""
    keys = ["term", "doc_id"]
    both = left.select(*keys, F.lit(True).alias("own")).unionByName(right.select(*keys, F.lit(False).alias("own")).dropna(subset=keys))
    return both.groupBy(*keys).agg(F.bool_and("own").alias("own")).where("own").select(*keys)  # one hash aggregation, no sorts for a join


def orphans(postings: DataFrame, paths: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(orphans, ids, percent): ids in postings without a path, or whose path is not found."""
    good = paths.where("path <> ''")
    if found is not None:
        good = good.join(found.select("path"), "path", "left_semi")
    ids = postings.select("doc_id").distinct().join(good.select("doc_id", F.lit(True).alias("ok")).distinct(), "doc_id", "left")
    return ids.agg(F.count_if(F.col("ok").isNull()).alias("orphans"), F.count("*").alias("ids")).withColumn("percent", F.when(F.col("ids") > 0, 100.0 * F.col("orphans") / F.col("ids")))


def id_differences(paths: DataFrame, found: DataFrame) -> DataFrame:
    """Paths whose id in the index and in the file system differ, or that only one has."""
    both = paths.select("path", F.col("doc_id").alias("index_id")).join(found.select("path", F.col("doc_id").alias("found_id")), "path", "full_outer")
    return both.where("not index_id <=> found_id")
