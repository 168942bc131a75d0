"""Registered queries over writes to an index and a kept one that follows changes, with their SQL.

The index holds the documents as files of folders that are named after their sources, with tags, ratings and comments; every query
gives the state of all its tables after a change.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import portable_tokens
from ..operators import generate, index, maintain, store, tree
from ..operators.index import Index
from ..sources import corpus
from ..sources.storage import shared_dir, staged
from ..streaming import changes, upkeep
from .registry import query

FOLDERS = 1_000_000_000


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and folders as rows of ``generate``, with ``k``, the original id of a document, and the path."""
    d = corpus.table(spark, sf_dir, "documents").join(corpus.table(spark, sf_dir, "labels"), "doc_id", "left").withColumnRenamed("doc_id", "k")
    number = F.substring("source", 4, 9).cast("bigint")
    mtime = F.lit(corpus.FIRST_TIME) + F.col("k") * 3600
    tags = F.when(F.col("quality").isNotNull(), F.array(F.concat(F.lit("quality/"), "quality"), F.concat(F.lit("toxic/"), "toxic")))
    files = d.select(
        "k", (F.col("k") + 1).alias("doc_id"), (FOLDERS + number).alias("parent_id"), F.concat(F.lit("doc_"), "k", F.lit(".txt")).alias("name"), mtime.alias("mtime"), (mtime + F.col("k") % 5 * 60).alias("ctime"),
        F.lit(False).alias("is_dir"), tags.alias("tags"), F.when(F.col("quality") == 1, (F.col("k") % 5 + 1).cast("int")).otherwise(0).alias("rating"),
        F.when(F.col("k") % 4 == 0, F.concat(F.lit("Seen in "), "source")).alias("comment"), F.concat(F.lit("/"), "source", F.lit("/doc_"), "k", F.lit(".txt")).alias("path"),
    )
    folders = d.select(F.lit(None).cast("bigint").alias("k"), (FOLDERS + number).alias("doc_id"), F.lit(0).cast("bigint").alias("parent_id"), F.col("source").alias("name"), F.lit(0).cast("bigint").alias("mtime"), F.lit(0).cast("bigint").alias("ctime"), F.lit(True).alias("is_dir"), F.concat(F.lit("/"), "source").alias("path")).distinct()
    return files.unionByName(folders, allowMissingColumns=True)


def states(i: Index) -> DataFrame:
    """(part, doc_id, value): all tables of an index as text."""
    found = i.postings.groupBy(F.col("origin").alias("part"), "doc_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat("field", F.lit(":"), "term"))), " ").alias("value"))
    of = lambda table, part, value: table.select(F.lit(part).alias("part"), "doc_id", value.alias("value"))
    none = F.lit("")
    return (
        found.unionByName(of(i.files, "files", F.concat_ws("/", "parent_id", "name"))).unionByName(of(i.times, "times", F.concat_ws("/", "mtime", "ctime")))
        .unionByName(of(i.data, "data", F.col("data"))).unionByName(of(i.queue, "queue", none)).unionByName(of(i.failed, "failed", none))
    )


_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def state(select: str = "", where: str = "true", files: str = "base", more: str = "") -> str:
    """SQL for the state of the files of ``base``, with ``select`` in place of some of their columns."""
    return f"""WITH base AS (SELECT doc_id AS k, doc_id + 1 AS doc_id, {FOLDERS} + CAST(substr(source, 4) AS BIGINT) AS parent_id, 'doc_' || doc_id || '.txt' AS name, {corpus.FIRST_TIME} + doc_id * 3600 AS mtime, {corpus.FIRST_TIME} + doc_id * 3600 + doc_id % 5 * 60 AS ctime,
        'doc_' || doc_id || '.txt' AS iname, quality AS q, toxic AS t, CASE WHEN quality = 1 THEN doc_id % 5 + 1 ELSE 0 END AS rating, CASE WHEN doc_id % 4 = 0 THEN 'Seen in ' || source END AS comment, true AS queued, false AS failed, NULL::VARCHAR AS data, NULL::VARCHAR AS content, source
        FROM documents LEFT JOIN labels USING (doc_id)
        UNION ALL SELECT DISTINCT NULL, {FOLDERS} + CAST(substr(source, 4) AS BIGINT), 0, source, 0, 0, source, NULL, NULL, 0, NULL, false, false, NULL, 'type:folder', source FROM documents){more},
    f AS (SELECT * {f'REPLACE ({select})' if select else ''} FROM {files} WHERE {where})
    SELECT 'files' AS part, doc_id, parent_id || '/' || name AS value FROM f UNION ALL SELECT 'times', doc_id, mtime || '/' || ctime FROM f
    UNION ALL SELECT 'filename', doc_id, array_to_string(list_sort(list_distinct(list_transform({_WORDS.format('iname')}, lambda x: 'filename:' || x))), ' ') FROM f
    UNION ALL SELECT 'xattr', doc_id, v FROM (SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN q IS NULL THEN [] ELSE ['tags:quality', 'tags:' || q, 'tag:quality/' || q, 'tags:toxic', 'tags:' || t, 'tag:toxic/' || t] END,
        CASE WHEN rating > 0 THEN ['rating:' || rating] ELSE [] END, CASE WHEN comment IS NULL THEN [] ELSE list_transform({_WORDS.format('comment')}, lambda x: 'usercomment:' || x) END))), ' ') AS v FROM f) WHERE v <> ''
    UNION ALL SELECT 'content', doc_id, content FROM f WHERE content IS NOT NULL UNION ALL SELECT 'data', doc_id, data FROM f WHERE data IS NOT NULL
    UNION ALL SELECT 'queue', doc_id, '' FROM f WHERE queued UNION ALL SELECT 'failed', doc_id, '' FROM f WHERE failed"""


def ids(files: DataFrame, where: str) -> DataFrame:
    return files.where(where).select("doc_id")


# -- rows of a file ------------------------------------------------------------------


@query(state())
def index_rows(spark, sf_dir):
    return states(generate.index_of(library(spark, sf_dir)))


@query(
    """WITH d AS (SELECT d.doc_id, d.doc_id + 1 AS id, source, quality AS q, toxic AS t FROM documents d LEFT JOIN labels USING (doc_id)), w AS (
    SELECT id, 'tags' AS field, 'quality' AS term, 1 AS pos FROM d WHERE q IS NOT NULL UNION ALL SELECT id, 'tags', q::VARCHAR, 2 FROM d WHERE q IS NOT NULL UNION ALL SELECT id, 'tags', 'toxic', 4 FROM d WHERE q IS NOT NULL
    UNION ALL SELECT id, 'tags', t::VARCHAR, 5 FROM d WHERE q IS NOT NULL UNION ALL SELECT id, 'tag', 'quality/' || q, NULL FROM d WHERE q IS NOT NULL UNION ALL SELECT id, 'tag', 'toxic/' || t, NULL FROM d WHERE q IS NOT NULL
    UNION ALL SELECT id, 'rating', (doc_id % 5 + 1)::VARCHAR, NULL FROM d WHERE q = 1
    UNION ALL SELECT id, 'usercomment', unnest(['seen', 'in', source]), unnest([0, 1, 2]) + CASE WHEN q IS NULL THEN 1 ELSE 7 END FROM d WHERE doc_id % 4 = 0)
    SELECT id AS doc_id, field, term, coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos), '') AS positions FROM w GROUP BY id, field, term"""
)
def attribute_terms(spark, sf_dir):
    """Tags as words and as they are, ratings, comments; the words of one text after the other, with a gap between."""
    rows = generate.attribute_postings(library(spark, sf_dir))
    return rows.select("doc_id", "field", "term", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


# -- writes --------------------------------------------------------------------------


@query(state("CASE WHEN k % 3 <> 0 THEN 'old_' || name ELSE name END AS name, CASE WHEN k % 3 <> 0 THEN 'old_' || iname ELSE iname END AS iname"))
def add_documents(spark, sf_dir):
    """Documents that are there already stay as they are."""
    files = library(spark, sf_dir)
    old = files.where("k % 3 <> 0").withColumn("name", F.concat(F.lit("old_"), "name"))
    return states(maintain.add(generate.index_of(old), generate.index_of(files)))


@query(state(where="k IS NULL OR k % 4 <> 0"))
def remove_documents(spark, sf_dir):
    files = library(spark, sf_dir)
    return states(maintain.remove(generate.index_of(files), ids(files, "k % 4 = 0")))


@query(state("CASE WHEN k % 3 = 0 THEN 1 - q ELSE q END AS q, CASE WHEN k % 3 = 0 THEN 'Read' ELSE comment END AS comment, CASE WHEN k % 5 = 0 THEN mtime + 7 ELSE mtime END AS mtime, CASE WHEN k % 7 = 0 THEN 'new_' || iname ELSE iname END AS iname, CASE WHEN k % 11 = 0 THEN 'new_' || name ELSE name END AS name"))
def replace_facets(spark, sf_dir):
    """Of every document other facets: attributes, times, words of the name, place."""
    files = library(spark, sf_dir)
    swapped = F.transform("tags", lambda t: F.when(t.startswith("quality/"), F.concat(F.lit("quality/"), (1 - F.substring(t, 9, 1).cast("int")).cast("string"))).otherwise(t))
    new = files.withColumns({"tags": swapped, "comment": F.lit("Read"), "mtime": F.col("mtime") + 7, "name": F.concat(F.lit("new_"), "name")})
    facet = lambda n, name: F.when(F.col("k") % n == 0, F.lit(name))
    plan = files.select("doc_id", F.array_compact(F.array(facet(3, "xattr"), facet(5, "times"), facet(7, "filename"), facet(11, "url"))).alias("facets"))
    return states(maintain.replace_each(generate.index_of(files), generate.index_of(new), plan))


@query(
    """SELECT field, term, doc_id, array_to_string(positions, ',') AS positions FROM (SELECT 'filename' AS field, unnest(['doc', doc_id::VARCHAR, 'txt']) AS term, doc_id + 1 AS doc_id, unnest([[1], [2], [3]]) AS positions FROM documents) WHERE NOT (term = 'txt' AND (doc_id - 1) % 3 = 0)
    UNION ALL SELECT 'filename', 'md', doc_id + 1, '3' FROM documents WHERE doc_id % 3 = 0"""
)
def commit_keeps_columns(spark, sf_dir):
    """Operations on terms leave fields and positions as they are; an add brings its own."""
    files = library(spark, sf_dir).where("k is not null")
    rows = generate.name_postings(files)
    hit = files.where("k % 3 = 0").select(F.lit("filename").alias("field"), "doc_id")
    out = hit.select("field", F.lit("txt").alias("term"), "doc_id", F.lit("filename").alias("origin"), F.array().cast("array<int>").alias("positions"), F.lit("remove").alias("op"), F.lit(1).alias("seq"))
    into = hit.select("field", F.lit("md").alias("term"), "doc_id", F.lit("filename").alias("origin"), F.array(F.lit(3)).alias("positions"), F.lit("add").alias("op"), F.lit(2).alias("seq"))
    return maintain.commit(rows, out.unionByName(into)).select("field", "term", "doc_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(f"SELECT doc_id + 1 AS doc_id, {corpus.FIRST_TIME} + doc_id * 3600 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS mtime FROM documents UNION ALL SELECT -1, 5")
def upsert_rows(spark, sf_dir):
    """One table, put by key: rows take the place of those with their id, others come in."""
    times = library(spark, sf_dir).where("k is not null").select("k", "doc_id", "mtime")
    put = times.where("k % 2 = 0").select("doc_id", (F.col("mtime") + 1).alias("mtime")).unionByName(spark.createDataFrame([(-1, 5)], "doc_id long, mtime long"))
    return maintain.upsert(times.drop("k"), put)


@query(state("CASE WHEN k % 3 = 0 THEN false ELSE queued END AS queued, coalesce(k % 5 = 0, false) AS failed"))
def queue_states(spark, sf_dir):
    """Into and out of the queue and the failed ones; whoever is in already stays once."""
    files = library(spark, sf_dir)
    i = maintain.mark(generate.index_of(files), queue=ids(files, "k % 2 = 0"), unqueue=ids(files, "k % 3 = 0"), failed=ids(files, "k % 5 = 0"))
    return states(maintain.mark(maintain.mark(i, failed=ids(files, "k % 7 = 1")), unfailed=ids(files, "k % 7 = 1 and k % 5 <> 0")))


@query(state(
    "CASE WHEN k % 6 = 4 THEN 'content:extracted' ELSE content END AS content, CASE WHEN k % 6 = 4 THEN '{\"n\":1}' ELSE data END AS data, coalesce(k % 6 = 5, false) AS failed, coalesce(k % 6 = 0, false) AS queued",
    where="k IS NULL OR k % 6 NOT IN (1, 2)",
))
def content_settled(spark, sf_dir):
    """Results of extraction by kind: still waiting, gone, to be removed, skipped, extracted, failed."""
    files = library(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, ("waiting", "missing", "remove", "skip", "succeeded", "failed"))), (F.col("k") % 6 + 1).cast("int"))
    results = files.where("k % 6 <> 0").select("doc_id", "path", kind.alias("state"))
    done = results.where("state = 'succeeded'").select("doc_id")
    found = done.select(F.lit("content").alias("field"), F.lit("extracted").alias("term"), "doc_id", F.lit("content").alias("origin"), F.array(F.lit(10000)).alias("positions"))
    return states(maintain.settle_content(generate.index_of(files), results, found, done.select("doc_id", F.lit('{"n":1}').alias("data"))))


@query(state(
    "CASE WHEN k % 2 = 0 AND k % 3 = 2 THEN 'now_' || name ELSE name END AS name, CASE WHEN k % 2 = 0 AND k % 3 = 2 THEN 'now_' || iname ELSE iname END AS iname, coalesce(k % 3 = 1 OR (k % 2 = 0 AND k % 9 = 8), false) AS queued, CASE WHEN k % 6 = 3 THEN '{}' END AS data",
    where="k IS NULL OR k % 9 <> 8 OR k % 2 = 0",
))
def foreground_index(spark, sf_dir):
    """Of the even files: those that wait or have data are passed over, known ones get names, attributes and times, unknown ones come in."""
    files = library(spark, sf_dir)
    i = generate.index_of(files.where("k is null or k % 9 <> 8")).with_(queue=ids(files, "k % 3 = 1 and k % 9 <> 8"), data=files.where("k % 6 = 3").select("doc_id", F.lit("{}").alias("data")))
    new = generate.index_of(files.where("k % 2 = 0 and k % 3 > 0").withColumn("name", F.concat(F.lit("now_"), "name")))
    return states(maintain.index_now(i, new))


@query(state(where="k IS NULL OR (k % 5 <> 0 AND k % 7 <> 0)"))
def clear_files(spark, sf_dir):
    """By the id a file has, or for files that are gone by the path in the index; unknown ones clear nothing."""
    files = library(spark, sf_dir)
    wanted = files.where("k % 5 = 0").select(F.concat(F.lit("/moved/"), "name").alias("path"), F.col("doc_id").alias("found_id"))
    wanted = wanted.unionByName(files.where("k % 7 = 0").select("path", F.lit(None).cast("bigint").alias("found_id")))
    wanted = wanted.unionByName(spark.createDataFrame([("/no/such/file", None)], "path string, found_id long"))
    return states(maintain.clear(generate.index_of(files), wanted))


@query(state(
    f"CASE WHEN k % 10 = 0 THEN {FOLDERS} + 1 ELSE parent_id END AS parent_id, CASE WHEN k % 10 = 0 THEN 'moved_' || k || '.md' ELSE name END AS name, CASE WHEN k % 10 = 0 THEN 'moved_' || k || '.md' ELSE iname END AS iname", where="k IS NULL OR k % 10 <> 5",
) + " UNION ALL SELECT 'unknown', -7, 'x.md'")
def move_files(spark, sf_dir):
    """Every tenth file gets another folder and name, over a file that was there, which goes; a file that is not known is a new one."""
    files = library(spark, sf_dir)
    name = F.concat(F.lit("moved_"), "k", F.lit(".md"))
    moves = files.where("k % 10 = 0").select("doc_id", (F.col("k") + 6).alias("target_id"), F.lit(FOLDERS + 1).cast("bigint").alias("parent_id"), name.alias("name"))
    moves = moves.unionByName(spark.createDataFrame([(-7, None, 0, "x.md")], "doc_id long, target_id long, parent_id long, name string"))
    i, unknown = maintain.move(generate.index_of(files), moves, generate.name_postings(moves))
    return states(i).unionByName(unknown.select(F.lit("unknown").alias("part"), "doc_id", F.col("name").alias("value")))


@query("SELECT (s_suppkey::BIGINT << 32) | s_nationkey AS doc_id, '/s/' || s_name AS path, CASE WHEN s_nationkey IN (1, 2) OR s_suppkey % 6 = 0 THEN 'ignored' ELSE 'removed' END AS action FROM supplier WHERE s_suppkey % 3 <> 1")
def stale_report(spark, sf_dir):
    """Files that are gone: ignored on two devices, and where they are links."""
    paths, found, links = _volumes(spark, sf_dir)
    return maintain.stale_report(paths, found, [1, 2], links)


@query("SELECT run, (s_suppkey::BIGINT << 32) | s_nationkey AS doc_id FROM supplier, (SELECT unnest([true, false]) AS dry) r, (SELECT 'dry' AS run, true AS d UNION ALL SELECT 'real', false) n WHERE n.d = r.dry AND (r.dry OR s_suppkey % 3 = 1 OR s_nationkey IN (1, 2) OR s_suppkey % 6 = 0)")
def stale_removal(spark, sf_dir):
    """What stays after a dry run and after a real one."""
    paths, found, links = _volumes(spark, sf_dir)
    i = index.empty(spark).with_(files=paths.select("doc_id", F.lit(0).cast("bigint").alias("parent_id"), F.col("path").alias("name")))
    report = maintain.stale_report(paths, found, [1, 2], links)
    after = [maintain.remove_stale(i, report, dry).files.select(F.lit(name).alias("run"), "doc_id") for name, dry in (("dry", True), ("real", False))]
    return after[0].unionByName(after[1])


def _volumes(spark, sf_dir):
    s = corpus.table(spark, sf_dir, "supplier").select("s_suppkey", F.expr("(cast(s_suppkey as bigint) << 32) | s_nationkey").alias("doc_id"), F.concat(F.lit("/s/"), "s_name").alias("path"))
    return s.select("doc_id", "path"), s.where("s_suppkey % 3 = 1"), s.where("s_suppkey % 6 = 0")


# -- a kept index that follows changes -------------------------------------------------


def kept(spark: SparkSession, i: Index, buckets: int = 8) -> str:
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    store.create(i, path, buckets)
    return path


def _worked(spark, sf_dir, first: DataFrame, jobs: DataFrame, found: DataFrame) -> DataFrame:
    path = kept(spark, generate.index_of(first).with_(queue=first.where("false").select("doc_id")))
    upkeep.apply(spark, path, jobs, found, portable_tokens)
    return states(store.load(spark, path))


def _job(kind: str, files: DataFrame) -> DataFrame:
    return files.select("path", F.lit(kind).alias("job"))


@query(state(
    "CASE WHEN k % 3 = 0 OR k % 10 = 9 THEN 'Changed' ELSE comment END AS comment, mtime + CASE WHEN k % 2 = 0 OR k % 10 = 9 THEN 9 ELSE 0 END AS mtime, ctime + CASE WHEN k % 3 = 0 OR k % 10 = 9 THEN 9 ELSE 0 END AS ctime, coalesce(k % 2 = 0 OR k % 10 = 9, false) AS queued"
))
def modified_files(spark, sf_dir):
    """Jobs for modified files: another mtime renews times and queues, another ctime renews attributes and name, unchanged files do nothing, unknown ones come in."""
    files = library(spark, sf_dir)
    now = files.where("k is not null").withColumns({"comment": F.lit("Changed"), "mtime": F.expr("mtime + if(k % 2 = 0 or k % 10 = 9, 9, 0)"), "ctime": F.expr("ctime + if(k % 3 = 0 or k % 10 = 9, 9, 0)")})
    return _worked(spark, sf_dir, files.where("k is null or k % 10 <> 9"), _job("modified", now), now)


@query(state("CASE WHEN k % 4 = 1 THEN 'Changed' ELSE comment END AS comment, mtime + CASE WHEN k % 4 = 1 THEN 9 ELSE 0 END AS mtime, coalesce(k % 4 = 1, false) AS queued"))
def new_files(spark, sf_dir):
    """Jobs for new files: what is there already stays as it is."""
    files = library(spark, sf_dir)
    now = files.where("k is not null").withColumns({"comment": F.lit("Changed"), "mtime": F.col("mtime") + 9})
    return _worked(spark, sf_dir, files.where("k is null or k % 4 <> 1"), _job("new", now), now)


@query(state("CASE WHEN k IS NOT NULL THEN 'Changed' ELSE comment END AS comment, coalesce(mtime + CASE WHEN k % 4 >= 0 THEN 9 ELSE 0 END, mtime) AS mtime, coalesce(k % 4 = 1, false) AS queued"))
def changed_attributes(spark, sf_dir):
    """Jobs for changed attributes: attributes, times and names, whatever the times say; nothing is queued but new files."""
    files = library(spark, sf_dir)
    now = files.where("k is not null").withColumns({"comment": F.lit("Changed"), "mtime": F.col("mtime") + 9})
    return _worked(spark, sf_dir, files.where("k is null or k % 4 <> 1"), _job("attributes", now), now)


@query(state("false AS queued", where="(k IS NULL AND source <> 'src3') OR (source <> 'src3' AND k % 6 <> 0)"))
def removed_paths(spark, sf_dir):
    """Jobs that remove files, and a folder with all that lies in it."""
    files = library(spark, sf_dir)
    jobs = _job("remove", files.where("k % 6 = 0")).unionByName(_job("remove", files.where("k is null and name = 'src3'")))
    return _worked(spark, sf_dir, files, jobs, files.limit(0))


@query(state("CASE WHEN k % 8 = 3 OR k % 5 = 0 THEN 'Changed' ELSE comment END AS comment, mtime + CASE WHEN k % 8 = 3 OR k % 7 = 0 THEN 9 ELSE 0 END AS mtime, ctime + CASE WHEN k % 8 = 3 OR k % 5 = 0 THEN 9 ELSE 0 END AS ctime, coalesce(k % 8 = 3 OR k % 7 = 0, false) AS queued"))
def rescanned(spark, sf_dir):
    """What a scan finds new or changed, taken over."""
    files = library(spark, sf_dir)
    now = files.where("k is not null").withColumns({"comment": F.lit("Changed"), "mtime": F.expr("mtime + if(k % 8 = 3 or k % 7 = 0, 9, 0)"), "ctime": F.expr("ctime + if(k % 8 = 3 or k % 5 = 0, 9, 0)")})
    i = generate.index_of(files.where("k is null or k % 8 <> 3"))
    return states(upkeep.rescan(i.with_(queue=i.queue.limit(0)), now))


@query(state(where="k IS NULL OR k % 5 <> 4"))
def first_run(spark, sf_dir):
    """The folders of a first run, one after the other, two of them with files in common, and one with rows that repeat."""
    files = library(spark, sf_dir)
    parts = [files.where("k is null"), files.where("k % 5 in (0, 1)"), files.where("k % 5 in (1, 2)").withColumn("mtime", F.when(F.col("k") % 5 == 1, 0).otherwise(F.col("mtime"))), files.where("k % 5 = 3").unionByName(files.where("k % 5 = 3"))]
    return states(upkeep.first_load(index.empty(spark), parts))


@query("SELECT '/user/' || user_id AS path, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def removal_jobs(spark, sf_dir):
    """Micro-batches of events as jobs, by the second; those that remove, by path."""
    e = corpus.table(spark, sf_dir, "events").where("event_type = 'error'").select(F.concat(F.lit("/user/"), "user_id").alias("path"), "ts", F.lit("deleted").alias("kind"))
    jobs = staged(changes.job(changes.merged_flags(e, "1 microsecond")), "jobs")
    return jobs.where("job = 'remove'").groupBy("path").agg(F.count("*").alias("n"))


@query("SELECT doc_id + 1 AS doc_id, '/' || source || '/doc_' || doc_id || '.txt' AS path FROM documents UNION ALL SELECT DISTINCT 1000000000 + CAST(substr(source, 4) AS BIGINT), '/' || source FROM documents")
def kept_paths(spark, sf_dir):
    """Paths of a kept index, from its tree."""
    i = generate.index_of(library(spark, sf_dir))
    return tree.paths(store.load(spark, kept(spark, i)).files, 8)


@query("SELECT count(*) + count(DISTINCT source) AS files FROM documents")
def built_anew(spark, sf_dir):
    """An index whose layout has another version isn't read but built again."""
    i = generate.index_of(library(spark, sf_dir))
    path = kept(spark, i)
    spark.range(1).select(F.lit(0).alias("schema_version"), F.lit(8).alias("buckets")).write.mode("overwrite").parquet(f"{path}/layout")
    if store.load(spark, path) is None:
        store.create(i, path, 8)
    return store.load(spark, path).files.agg(F.count("*").alias("files"))
