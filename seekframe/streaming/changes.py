"""Change events as streams (inventory ST1-ST17, J13). Every function takes a batch or a streaming DataFrame unless it says otherwise."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.config import included
from ..schema import EVENTS

# Fixed values, in seconds: shortest and longest delay, how long a path is tracked, deadline of a rename, age of a recent write.
SHORTEST, LONGEST, TRACKED = 5, 60, 120
RENAME_DEADLINE = 1
RECENT = 60_000
# The order in which waiting work is taken up.
PRIORITY = ("first run", "new", "modified", "attributes", "stale", "content", "unindexed")
FLAGS = ("created", "modified", "closed", "attributes", "deleted")


def event_stream(spark: SparkSession, folder: str, files_each: int = 100) -> DataFrame:
    """Streaming: change events (``schema.EVENTS``) from JSON files that arrive in a folder. After an overflow or a lost folder, ``after_overflow`` makes up for what was missed."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_each).json(folder)


def merged_flags(events: DataFrame, window: str = "10 milliseconds") -> DataFrame:
    """One row for a path and moment with the flags that occurred in it."""
    flags = [F.bool_or(F.col("kind") == k).alias(k) for k in FLAGS]
    return events.groupBy("path", F.window("ts", window).alias("w")).agg(*flags).select("path", F.col("w.start").alias("ts"), *FLAGS)


def without_deleted(events: DataFrame) -> DataFrame:
    """Batch: drops events of a path that is deleted later in the batch, itself or with a folder above it; deletions stay."""
    gone = events.where("kind = 'deleted'").groupBy("path").agg(F.max("ts").alias("gone"))
    paths = events.select("path").distinct()
    above = _above(paths).join(gone.withColumnRenamed("path", "prefix"), "prefix").groupBy("parent").agg(F.max("gone").alias("above_gone"))
    limits = paths.join(gone, "path", "left").withColumn("parent", _parent(F.col("path"))).join(above, "parent", "left").select("path", F.greatest("gone", "above_gone").alias("gone")).where("gone is not null")
    return events.join(limits, "path", "left").where("not coalesce(kind <> 'deleted' and ts <= gone, false)").select(*events.columns)


def _parent(path: Column) -> Column:
    """The folder of a path, null where none is above it."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))


def _above(paths: DataFrame) -> DataFrame:
    """(parent, prefix): every folder that holds one of ``paths``, once, with itself and all above it, so that what is above all paths is no row for each of them."""
    folders = paths.select(_parent(F.col("path")).alias("parent")).where("parent is not null").distinct()
    parts = F.split("parent", "/")
    above = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return folders.select("parent", F.explode(above).alias("prefix"))


def job(events: DataFrame) -> DataFrame:
    """``job``: what merged flags ask for."""
    only = F.col("attributes") & ~F.col("created") & ~F.col("modified") & ~F.col("closed")
    return events.withColumn("job", F.when(F.col("deleted"), "remove").when(only, "attributes").when(F.col("created"), "new").otherwise("modified"))


def recent_writes(events: DataFrame) -> DataFrame:
    """Closed files count only if written to lately; the limit is 60 000 seconds."""
    return events.where(F.col("ts_seconds") - F.col("mtime") <= RECENT)


def prioritised(work: DataFrame) -> DataFrame:
    """``rank`` by kind of work; order by it to take up work as a scheduler would."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("kind"))
    return work.withColumn("rank", F.when(rank > 0, rank).otherwise(len(PRIORITY) + 1).cast("int"))


class Debounce:
    """One path's state: when it was last seen, and when its held event is due (0: none)."""

    def __init__(self, seen: float = -1e18, due: float = 0.0):
        self.seen, self.due = seen, due

    def release(self, now: float) -> float | None:
        """The due time of a held event that has come."""
        if self.due and self.due <= now:
            due, self.due = self.due, 0.0
            return due
        return None

    def event(self, now: float) -> bool:
        """Whether the event goes out at once; else it is held, the longer the more follow."""
        fresh = now - self.seen > TRACKED and not self.due
        if not fresh:
            wait = 2 * (self.due - now) if self.due else SHORTEST
            self.due = now + min(LONGEST, max(SHORTEST, wait))
        self.seen = now
        return fresh


DEBOUNCED = "path string, at double, how string"


def debounce_replay(events: DataFrame) -> DataFrame:
    """Batch: (path, at, how) of the events (path, seconds) that go out, at once or when their delay ends.

    Paths are dealt out and sorted, and a task holds the state of one path at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, state, rows = None, Debounce(), []
        for frame in frames:
            for p, now in zip(frame["path"], frame["seconds"], strict=True):
                if p != path:
                    if state.due:
                        rows.append((path, state.due, "delayed"))
                    path, state = p, Debounce()
                if (due := state.release(now)) is not None:
                    rows.append((path, due, "delayed"))
                if state.event(now):
                    rows.append((path, now, "at once"))
            yield pd.DataFrame(rows, columns=["path", "at", "how"])
            rows = []
        if state.due:
            rows.append((path, state.due, "delayed"))
        yield pd.DataFrame(rows, columns=["path", "at", "how"])

    return events.select("path", "seconds").repartition("path").sortWithinPartitions("path", "seconds").mapInPandas(run, DEBOUNCED)


def debounce(events: DataFrame) -> DataFrame:
    """Streaming: as ``debounce_replay`` for events (path, ts), with processing-time timers."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Debounce(*state.get) if state.exists else Debounce()
        now = state.getCurrentProcessingTimeMs() / 1000
        rows = []
        if (due := own.release(now)) is not None:
            rows.append((key[0], due, "delayed"))
        if state.hasTimedOut and not own.due:
            state.remove()
        else:
            for frame in frames:
                rows += [(key[0], now, "at once") for _ in range(len(frame)) if own.event(now)]
            state.update((own.seen, own.due))
            state.setTimeoutDuration(int(1000 * max(0.01, (own.due - now) if own.due else TRACKED)))
        yield pd.DataFrame(rows, columns=["path", "at", "how"])

    return events.groupBy("path").applyInPandasWithState(run, DEBOUNCED, "seen double, due double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def renames(events: DataFrame) -> DataFrame:
    """(kind, path, target) of moves (path, ts, kind, cookie): both halves within a second are a rename, a lone arrival a creation, a lone departure a deletion.

    On a stream both sides carry a watermark and the outer join gives the lone halves once the deadline is past.
    """
    streaming = events.isStreaming
    out = events.where("kind = 'moved_from'").select("cookie", F.col("path").alias("source"), F.col("ts").alias("left_at"))
    into = events.where("kind = 'moved_to'").select(F.col("cookie").alias("to_cookie"), F.col("path").alias("target"), F.col("ts").alias("arrived_at"))
    if streaming:
        out, into = out.withWatermark("left_at", "2 seconds"), into.withWatermark("arrived_at", "2 seconds")
    near = (F.col("cookie") == F.col("to_cookie")) & (F.col("arrived_at") >= F.col("left_at")) & (F.col("arrived_at") <= F.col("left_at") + F.expr(f"INTERVAL {RENAME_DEADLINE} SECONDS"))
    both = out.join(into, near, "full_outer")
    kind = F.when(F.col("source").isNull(), "created").when(F.col("target").isNull(), "deleted").otherwise("renamed")
    return both.select(kind.alias("kind"), F.coalesce("source", "target").alias("path"), F.when(F.col("source").isNotNull(), F.col("target")).alias("target"))


def watched(events: DataFrame, paths: DataFrame) -> DataFrame:
    """Events of a given set of paths; stream against table."""
    return events.join(paths.select("path").distinct(), "path", "left_semi")


def update_plan(found: DataFrame, known: DataFrame) -> DataFrame:
    """``facets`` to replace for every file (doc_id, path, mtime, ctime): all of a new one, times for a later mtime, attributes, name and place for a later ctime; unchanged files drop out."""
    old = known.select("doc_id", F.col("path").alias("old_path"), F.col("mtime").alias("old_mtime"), F.col("ctime").alias("old_ctime"))
    rows = found.join(old, "doc_id", "left")
    new = F.col("old_mtime").isNull()
    touched, renamed = F.col("mtime") != F.col("old_mtime"), F.col("ctime") != F.col("old_ctime")
    moved = F.col("path") != F.col("old_path")
    facets = F.array_compact(F.array(F.when(touched | renamed, "times"), F.when(renamed, "xattr"), F.when(renamed & moved, "filename"), F.when(renamed & moved, "url"), F.when(touched, "queue")))
    return rows.withColumn("facets", F.when(new, F.array(F.lit("add"))).otherwise(facets)).where("size(facets) > 0").select("doc_id", "path", "mtime", "ctime", "facets")


def job_plan(jobs: DataFrame, found: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, facets) for jobs (path, job): ``found`` are the files that are there now (doc_id, path, mtime, ctime), ``known`` the indexed ones.

    A file that is not known is added whatever the job. Of a known one, ``new`` does nothing; ``modified`` takes times and queue for another mtime, and
    attributes, times, name and place for another ctime; ``attributes`` takes the latter four anyhow.
    """
    old = known.select("doc_id", F.col("mtime").alias("old_mtime"), F.col("ctime").alias("old_ctime"))
    rows = jobs.select("path", "job").join(found.select("doc_id", "path", "mtime", "ctime"), "path").join(old, "doc_id", "left")
    named = (F.col("job") == "attributes") | ((F.col("job") == "modified") & (F.col("ctime") != F.col("old_ctime")))
    touched = (F.col("job") == "modified") & (F.col("mtime") != F.col("old_mtime"))
    facets = F.array_compact(F.array(F.when(touched | named, "times"), F.when(named, "xattr"), F.when(named, "filename"), F.when(named, "url"), F.when(touched, "queue")))
    rows = rows.withColumn("facets", F.when(F.col("old_mtime").isNull(), F.array(F.lit("add"))).otherwise(facets)).where("job <> 'remove' and size(facets) > 0")
    return rows.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("facets")))).alias("facets"))


def after_overflow(found: DataFrame, known: DataFrame) -> DataFrame:
    """(path, job) that make up for lost events: what a scan shows to be new, changed or gone."""
    old = known.select("path", F.col("mtime").alias("old_mtime"), F.col("ctime").alias("old_ctime"))
    both = found.select("path", "mtime", "ctime").join(old, "path", "full_outer")
    changed = (F.col("mtime") != F.col("old_mtime")) | (F.col("ctime") != F.col("old_ctime"))
    job = F.when(F.col("old_mtime").isNull(), "new").when(F.col("mtime").isNull(), "remove").when(changed, "modified")
    return both.select("path", job.alias("job")).where("job is not null")


def still_included(pending: DataFrame, folders: dict[str, bool], filters=(), hidden: bool = False) -> DataFrame:
    """Waiting paths that a changed configuration still includes."""
    return pending.where(included(F.col("path"), folders, filters, hidden))


def parsed(lines: DataFrame) -> DataFrame:
    """Change events from lines of JSON (value), as a queue or a text stream delivers them; other lines give null events and drop out."""
    return lines.select(F.from_json("value", EVENTS).alias("e")).select("e.*").where("path is not null")


def pruned(pending: DataFrame, deleted: DataFrame) -> DataFrame:
    """Waiting paths without those that were deleted, themselves or with a folder above."""
    deleted = deleted.select("path")
    gone = _above(pending).join(deleted.withColumnRenamed("path", "prefix"), "prefix", "left_semi").select("parent").distinct()
    left = pending.withColumn("parent", _parent(F.col("path"))).join(gone, "parent", "left_anti")
    return left.select(*pending.columns).join(deleted, "path", "left_anti").select(*pending.columns)


def maintain(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str = "2 seconds"):
    """Starts a stream that hands every micro-batch of events, merged and classified, to ``apply``; the trigger bounds how long a commit waits."""

    def batch(rows: DataFrame, number: int) -> None:
        apply(job(merged_flags(rows)), number)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
