"""Registered queries over forms of queries, configuration, sources and events, with their SQL."""

from __future__ import annotations

import uuid
import warnings
from datetime import date

from pyspark.sql import functions as F

from ..functions import dates, encode, text
from ..operators import config, generate, index, match, results, store
from ..sources import corpus, files
from ..sources.storage import shared_dir
from ..streaming import changes
from . import catalogue_sql as sql
from .compile import Catalog
from .query import Query
from .registry import catalog, orders, parts, query, search, tokens, words
from .search import parse
from .term import Term, from_json, to_json
from .virtual import tag_folder, timeline

_NONE = "SELECT CAST(1 AS BIGINT) AS doc_id WHERE false"


def _the(prefix: str = "the") -> str:
    return sql.tok(f"SELECT DISTINCT doc_id FROM tok WHERE field = 'content' AND starts_with(term, '{prefix}')")


# -- scans ---------------------------------------------------------------------------


@query("SELECT doc_id + 1 AS doc_id FROM documents WHERE 1704067200 + doc_id * 3600 = 1704099600")
def mtime_point(spark, sf_dir):
    return index.modified_between(corpus.documents(spark, sf_dir), 1704099600, 1704099600)


@query("SELECT l.doc_id + 1 AS doc_id, 1704067200 + d.doc_id * 3600 AS mtime, '/' || lang || '/' || source || '/doc_' || d.doc_id || '.txt' AS path FROM (SELECT doc_id FROM labels UNION ALL SELECT -5) l LEFT JOIN documents d USING (doc_id)")
def lookup_by_id(spark, sf_dir):
    """Times and paths of given ids; one of them is unknown."""
    docs = corpus.documents(spark, sf_dir)
    ids = corpus.table(spark, sf_dir, "labels").select((F.col("doc_id") + 1).alias("doc_id")).unionByName(spark.range(1).select(F.lit(-4).cast("bigint").alias("doc_id")))
    return index.lookup(index.lookup(ids, docs.select("doc_id", "mtime")), docs.select("doc_id", "path"))


@query("SELECT doc_id + 1 AS doc_id, doc_id % 3 > 0 AS found, CASE WHEN doc_id % 3 > 0 THEN 2 END AS n, CASE WHEN doc_id % 3 > 0 THEN lang END AS lang FROM documents")
def properties_by_id(spark, sf_dir):
    """No row, an empty text and an empty object are not found."""
    d = corpus.documents(spark, sf_dir).withColumn("k", F.col("doc_id") - 1)
    full = F.to_json(F.struct("lang", F.array("source", "name").alias("names")))
    data = d.where("k % 9 <> 0").select("doc_id", F.when(F.col("k") % 3 > 0, full).when(F.col("k") % 2 == 0, "{}").otherwise("").alias("data"))
    values = index.properties(d, data)
    return values.select("doc_id", "found", F.when(F.col("found"), F.size("values")).alias("n"), F.element_at(F.col("values")["lang"], 1).alias("lang"))


@query(sql.tok("SELECT DISTINCT 'word' AS search, doc_id FROM tok WHERE field = 'content' AND term = 'the' UNION ALL SELECT DISTINCT 'prefix', doc_id FROM tok WHERE field = 'content' AND starts_with(term, 'thin') UNION ALL SELECT 'phrase', t.doc_id FROM tok t JOIN tok u ON t.doc_id = u.doc_id AND u.pos = t.pos + 1 AND t.field = 'content' AND u.field = 'content' WHERE t.term = 'of' AND u.term = 'the' GROUP BY t.doc_id"))
def saved_index(spark, sf_dir):
    """An index that is built, kept, and read again for three searches."""
    docs = corpus.documents(spark, sf_dir).withColumn("parent_id", F.lit(0).cast("bigint"))
    path = f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    store.create(generate.index_of(docs), path, 16)
    kept = store.load(spark, path)
    c = Catalog(kept.postings, kept.times, words=words)
    found = [Query(q, order="id").ids(c).select(F.lit(name).alias("search"), "doc_id") for name, q in (("word", "content=the"), ("prefix", "content:thin"), ("phrase", 'content="of the"'))]
    return found[0].unionByName(found[1]).unionByName(found[2])


# -- words and properties ------------------------------------------------------------


@query("SELECT doc_id, doc_id % 3 <> 0 AS valid FROM documents WHERE text IS NOT NULL")
def valid_text(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents").where("text is not null")
    raw = F.concat(F.col("text").cast("binary"), F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    return d.select("doc_id", text.valid(raw).alias("valid"))


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'application/x-zerosize' ELSE 'text/plain' END AS mime FROM documents")
def effective_mime(spark, sf_dir):
    size = F.when(F.col("doc_id") % 9 == 0, 0).otherwise(F.col("n_chars"))
    return corpus.table(spark, sf_dir, "documents").select("doc_id", encode.effective_mime(F.lit("text/plain"), size).alias("mime"))


@query(
    """SELECT p_partkey AS doc_id, 'size' AS field, p_size::VARCHAR AS term FROM part UNION ALL SELECT p_partkey, 'large', '' FROM part WHERE p_size > 25
    UNION ALL SELECT p_partkey, 'brand', t FROM part, unnest(regexp_extract_all(lower(p_brand), '[a-z0-9]+')) u(t) UNION ALL SELECT p_partkey, 'day', '2024-01-05' FROM part UNION ALL SELECT p_partkey, 'time', '2024-01-05T06:07:08' FROM part"""
)
def property_terms(spark, sf_dir):
    """Whole numbers, presence, words, dates and times."""
    p = corpus.table(spark, sf_dir, "part")
    moment = F.lit("2024-01-05 06:07:08").cast("timestamp_ntz")
    of = {"size": (F.col("p_size"), "int"), "large": (F.when(F.col("p_size") > 25, F.lit(True)), "boolean"), "brand": (F.col("p_brand"), "string"), "day": (moment, "date"), "time": (moment, "datetime")}
    each = F.array(*[F.struct(F.lit(field).alias("field"), F.coalesce(encode.property_term(value, kind), F.array().cast("array<string>")).alias("terms")) for field, (value, kind) in of.items()])
    return p.select(F.col("p_partkey").alias("doc_id"), F.inline(each)).select("doc_id", "field", F.explode("terms").alias("term"))


# -- leaves --------------------------------------------------------------------------


@query("SELECT c_custkey AS doc_id FROM customer")
def long_word(spark, sf_dir):
    """A word longer than a key is compared as far as a key goes, which all customers share."""
    c = corpus.table(spark, sf_dir, "customer")
    term = F.left(F.concat(F.lit("customername"), F.lpad(F.col("c_custkey").cast("string"), 20, "0")), F.lit(text.MAX_UNITS))
    rows = c.select(F.lit("content").alias("field"), term.alias("term"), F.col("c_custkey").alias("doc_id"), F.array().cast("array<int>").alias("positions"))
    return Query("content=customername" + "0" * 18 + "42").ids(Catalog(rows, words=lambda w: [w]))


@query("SELECT p_partkey AS doc_id FROM part WHERE p_size = 1")
def int_contains_is_equal(spark, sf_dir):
    return Query("size:1").ids(parts(spark, sf_dir))


@query("SELECT doc_id + 1 AS doc_id FROM documents WHERE 1704067200 + doc_id * 3600 BETWEEN 1704412800 + 18000 AND 1704412800 + 18000 + 86399")
def mtime_day_in_zone(spark, sf_dir):
    """The fifth of January, five hours west of Greenwich."""
    c = catalog(spark, sf_dir)
    c.zone = "Etc/GMT+5"
    return Query("modified=2024-01-05", order="id").ids(c)


@query(_NONE)
def modified_contains_is_empty(spark, sf_dir):
    return search(spark, sf_dir, "modified:2024-01-05")


@query(_the())
def negation_has_no_effect(spark, sf_dir):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)
        return search(spark, sf_dir, Query(term=~Term("content", "the"), order="id"))


@query(_NONE)
def unknown_folder(spark, sf_dir):
    return search(spark, sf_dir, Query("content:the", folder="/en/src", order="id"))


@query(sql.docs("SELECT doc_id FROM docs WHERE starts_with(path, '/fr/')"))
def folder_with_its_files(spark, sf_dir):
    return search(spark, sf_dir, Query(term=Term("includefolder", "//fr/", "equal"), order="id")).where("doc_id > 0")


# -- forms of queries ----------------------------------------------------------------


@query("SELECT p_partkey AS doc_id FROM part WHERE p_retailprice >= 950 AND p_size <= 20")
def term_json(spark, sf_dir):
    """A term that went through its JSON form; nested ANDs become one, in any order of their parts."""
    data = {"$and": [{"price": {"$gte": 950}}, {"$and": [{"size": {"$lte": 20}}]}]}
    term = from_json(to_json(from_json(data)))
    if term != Term("size", 20, "less_equal") & Term("price", 950, "greater_equal"):
        raise ValueError(term)
    return Query(term=term).ids(parts(spark, sf_dir))


@query("SELECT o_orderkey AS doc_id FROM orders WHERE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') <= '1995-03-01'")
def term_json_date(spark, sf_dir):
    """Text in the form of a date becomes one."""
    from .catalogue import dated

    return Query(term=from_json({"date": {"$lt": "1995-03-01"}})).ids(dated(spark, sf_dir))


@query(sql.tok("SELECT doc_id, path FROM docs WHERE doc_id IN (SELECT doc_id FROM tok WHERE field = 'content' AND starts_with(term, 'that')) AND make_timestamp(mtime * 1000000)::DATE = DATE '2024-01-03' ORDER BY doc_id LIMIT 9 OFFSET 2"))
def query_json(spark, sf_dir):
    q = Query("content:that", date=(2024, 1, 3), offset=2, limit=9, order="id").with_type("Document")
    return Query.from_json(q.to_json()).run(catalog(spark, sf_dir))


@query(_the("thinor"))
def query_url(spark, sf_dir):
    return search(spark, sf_dir, Query.from_url(Query("content:thinor", order="id").to_url("words & more")))


@query("SELECT doc_id + 1 AS doc_id FROM documents")
def preset_url(spark, sf_dir):
    return search(spark, sf_dir, Query.from_url("filesearch:/documents"))


@query("SELECT * FROM (VALUES ('a b', '([ contains ''a''] AND [ contains ''b''])'), ('x:1 OR (y>2 AND z)', '([x contains ''1''] OR ([y greater ''2''] AND [ contains ''z'']))'), ('tag=''q''', '[tag equal \"''q''\"]')) t(search, printed)")
def printed_terms(spark, sf_dir):
    return spark.createDataFrame([(s, repr(parse(s))) for s in ("a b", "x:1 OR (y>2 AND z)", "tag='q'")], "search string, printed string")


@query("SELECT o_orderkey AS doc_id FROM orders WHERE o_orderdate::DATE = DATE '1996-02-10'")
def timeline_day(spark, sf_dir):
    found = timeline("timeline://calendar//1996-02/1996-02-10/".replace("timeline:/", ""), date(1996, 2, 13))
    return _on(spark, sf_dir, found.day)


@query("SELECT o_orderkey AS doc_id FROM orders WHERE o_orderdate::DATE = DATE '1996-02-06'")
def timeline_relative(spark, sf_dir):
    """Today is the thirteenth of March: a month and a week back."""
    return _on(spark, sf_dir, timeline("/today?relMonths=-1&relDays=-7", date(1996, 3, 13)).day)


def _on(spark, sf_dir, day: date):
    o = orders(spark, sf_dir)
    empty = o.select(F.lit("").alias("field"), F.lit("").alias("term"), "doc_id").limit(0)
    return Query(date=(day.year, day.month, day.day), order="id").ids(Catalog(empty, o))


@query(sql.docs("SELECT doc_id, path FROM docs WHERE doc_id - 1 IN (SELECT doc_id FROM labels WHERE quality = 1) AND name = 'doc_42.txt'"))
def tag_file(spark, sf_dir):
    """The file that an entry of a tag's folder stands for; there is one of the name, so any number finds it."""
    return tag_folder("/quality/1/doc_42.txt (3)", {"quality/0", "quality/1"}).file(catalog(spark, sf_dir))


@query("SELECT o_custkey, o_orderkey AS doc_id FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n, count(*) OVER () AS c FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)) WHERE n = least(c, 3)")
def nth_named(spark, sf_dir):
    """The third of the rows with one name, or the last."""
    o = corpus.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("c"), "o_custkey").alias("name"))
    first = o.agg(F.min("o_custkey")).first()[0]
    return results.nth_named(o, f"c{first}", 2, F.col("doc_id")).select("o_custkey", "doc_id")


@query(sql.tok("SELECT path FROM docs WHERE doc_id IN (SELECT doc_id FROM tok WHERE field = 'content' AND starts_with(term, 'that')) ORDER BY doc_id LIMIT 30"))
def streamed_paths(spark, sf_dir):
    """Results one by one; the limit is the query's own."""
    return spark.createDataFrame([(p,) for p in Query("content:that", limit=30, order="id").stream(catalog(spark, sf_dir))], "path string")


# -- dates ---------------------------------------------------------------------------


@query("SELECT event_id, epoch(date_trunc('day', ts))::BIGINT AS first, epoch(date_trunc('day', ts))::BIGINT + 86399 AS last FROM events")
def day_bounds(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events")
    return e.select("event_id", dates.day_start(F.col("ts")).alias("first"), dates.day_end(F.col("ts")).alias("last"))


@query("SELECT o_orderkey AS doc_id, ((o_orderdate::DATE + INTERVAL 12 MONTH)::DATE - INTERVAL 1 MONTH)::DATE + 18 AS day FROM orders")
def relative_dates(spark, sf_dir):
    """A year on, a month back, two weeks and four days on."""
    return corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), dates.relative(F.to_date("o_orderdate"), 1, -1, 2, 4).alias("day"))


# -- configuration -------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('/a/b/c/', true), ('/a/b/', false), ('/a/', true), ('/d/e/', true)) t(folder, included)")
def folder_config(spark, sf_dir):
    """Entries that say what the folder above them says already are dropped, and excludes with nothing above."""
    entries = {"/a": True, "/a/x": True, "/a/b": False, "/a/b/c/": True, "/a/b/y": False, "/d": False, "/d/e": True}
    return spark.createDataFrame(config.normalised_folders(entries), "folder string, included boolean")


@query("SELECT * FROM (VALUES ('/a', true), ('/a/b', false), ('/a/c', true), ('/d', true), ('/d/x', false), ('/z', false)) t(folder, searchable)")
def searchable_folders(spark, sf_dir):
    entries = {"/a": True, "/a/b": False, "/d/e": True}
    return spark.createDataFrame([(f, config.can_be_searched(f, entries)) for f in ("/a", "/a/b", "/a/c", "/d", "/d/x", "/z")], "folder string, searchable boolean")


@query("SELECT s_suppkey AS doc_id FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey = 3 OR (n_regionkey <> 1 AND n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0))")
def usable_volumes(spark, sf_dir):
    """No removable, network or inaccessible volumes, unless they are included by name."""
    s = corpus.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_nationkey").alias("device"))
    n = corpus.table(spark, sf_dir, "nation")
    mounts = n.select(
        F.col("n_nationkey").alias("device"), (F.col("n_regionkey") == 1).alias("removable"), (F.col("n_nationkey") % 5 == 0).alias("network"), F.lit(False).alias("optical"),
        (F.col("n_nationkey") % 7 != 0).alias("accessible"), F.concat(F.lit("/mnt/"), F.col("n_nationkey").cast("string")).alias("mount_path"),
    )
    return config.usable(s, mounts, ["/mnt/3"]).select("doc_id")


@query("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(list_filter(list(l_linenumber), lambda x: x <> 2), [5]))), ',') AS lines FROM lineitem GROUP BY l_orderkey")
def sorted_set(spark, sf_dir):
    """The sorted lines of an order, with the fifth put in and the second taken out."""
    lines = corpus.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("lines"))
    return lines.select("l_orderkey", F.array_join(match.removed(match.inserted(F.col("lines"), F.lit(5)), F.lit(2)), ",").alias("lines"))


# -- sources -------------------------------------------------------------------------


@query(sql.docs("SELECT path FROM (SELECT path, doc_id - 1 AS k FROM docs UNION ALL SELECT DISTINCT '/' || lang || '/' || source, 1 FROM docs UNION ALL SELECT DISTINCT '/' || lang, 1 FROM docs) WHERE k % 6 <> 0 AND NOT regexp_matches(path, '7[.]txt$') AND (path = '/en' OR path = '/fr' OR starts_with(path, '/fr/') OR (starts_with(path, '/en/') AND NOT (path = '/en/src1' OR starts_with(path, '/en/src1/'))))"))
def listed_files(spark, sf_dir):
    """Two folders without one below them, without links and excluded names."""
    d = corpus.documents(spark, sf_dir)
    above = d.select(F.explode(F.array(F.concat(F.lit("/"), "lang"), F.concat(F.lit("/"), "lang", F.lit("/"), "source"))).alias("path")).distinct()
    rows = d.select("path", F.lit(False).alias("is_dir"), ((F.col("doc_id") - 1) % 6 == 0).alias("is_link")).unionByName(above.select("path", F.lit(True).alias("is_dir"), F.lit(False).alias("is_link")))
    return files.listed(rows, {"/en": True, "/fr": True, "/en/src1": False}, ["*7.txt"]).select("path")


@query("SELECT '/' || lang || '/' || source AS path FROM documents WHERE lang IN ('en', 'de') GROUP BY 1 UNION ALL SELECT '/' || lang FROM documents WHERE lang IN ('en', 'de') GROUP BY 1")
def listed_folders(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).where("path is not null")
    above = d.select(F.explode(F.array(F.concat(F.lit("/"), "lang"), F.concat(F.lit("/"), "lang", F.lit("/"), "source"))).alias("path")).distinct()
    rows = d.select("path", F.lit(False).alias("is_dir")).unionByName(above.select("path", F.lit(True).alias("is_dir"))).withColumn("is_link", F.lit(False))
    return files.listed(rows, {"/en": True, "/de": True}, dirs_only=True).select("path")


@query("SELECT (s_suppkey::BIGINT << 32) | s_nationkey AS doc_id, '/s/' || s_name AS path, s_name AS name, 7 AS size, 100 + s_suppkey AS mtime, 100 + s_suppkey + CASE WHEN s_suppkey % 2 = 0 THEN 5 ELSE 0 END AS ctime, false AS is_dir FROM supplier")
def stat_rows(spark, sf_dir):
    """Ids of device and inode; where no change time is known, the other time stands for it."""
    s = corpus.table(spark, sf_dir, "supplier")
    mtime = F.col("s_suppkey") + 100
    return files.stat_rows(s.select(
        F.concat(F.lit("/s/"), "s_name").alias("path"), F.lit(7).alias("size"), mtime.alias("mtime"), F.when(F.col("s_suppkey") % 2 == 0, mtime + 5).alias("ctime"),
        F.lit(False).alias("is_dir"), F.col("s_nationkey").alias("device"), F.col("s_suppkey").alias("inode"),
    ))


@query(
    """SELECT page_id AS doc_id, CASE WHEN page_id % 10 = 3 OR html IS NULL THEN NULL ELSE md5(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<[^>]*>', ' ', 'g')) END AS digest,
    CASE WHEN page_id % 10 = 3 OR html IS NULL THEN 'failed' ELSE 'succeeded' END AS status FROM pages"""
)
def extracted_text(spark, sf_dir):
    """Text of HTML; a kind of file that can't be read fails by itself, not its batch."""
    p = corpus.table(spark, sf_dir, "pages")
    mime = F.when(F.col("page_id") % 10 == 3, "application/pdf").otherwise("text/html")
    out = files.extract(p.select(F.col("page_id").alias("doc_id"), mime.alias("mime"), F.col("html").cast("binary").alias("content")))
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "status")


# -- events --------------------------------------------------------------------------


@query("SELECT '/user/' || user_id AS path, ts, event_type AS kind, event_id AS cookie, false AS is_dir FROM events")
def event_lines(spark, sf_dir):
    """Events from lines of JSON; other lines drop out."""
    e = corpus.table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.concat(F.lit("/user/"), "user_id").alias("path"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.col("event_type").alias("kind"), F.col("event_id").alias("cookie"), F.lit(False).alias("is_dir")))
    return changes.parsed(e.select(F.explode(F.array(line, F.lit("no json"))).alias("value")))


@query(
    """SELECT path, ts, CASE WHEN deleted THEN 'remove' WHEN attributes AND NOT (created OR modified OR closed) THEN 'attributes' WHEN created THEN 'new' ELSE 'modified' END AS job FROM (SELECT '/user/' || user_id AS path, date_trunc('hour', ts) AS ts,
    bool_or(event_type = 'signup') AS created, bool_or(event_type = 'purchase') AS modified, bool_or(event_type = 'click') AS closed, bool_or(event_type = 'view') AS attributes, bool_or(event_type = 'error') AS deleted FROM events GROUP BY 1, 2)"""
)
def event_jobs(spark, sf_dir):
    return changes.job(changes.merged_flags(corpus.events(spark, sf_dir), "1 hour")).select("path", "ts", "job")


@query("SELECT '/user/' || user_id || '/' || event_id AS path FROM events WHERE user_id % 10 <> 3 AND event_id % 4 <> 1")
def pruned_paths(spark, sf_dir):
    """Waiting paths without those that were deleted, by name or with their folder."""
    e = corpus.table(spark, sf_dir, "events")
    path = F.concat(F.lit("/user/"), "user_id", F.lit("/"), "event_id").alias("path")
    folder = F.concat(F.lit("/user/"), "user_id").alias("path")
    gone = e.where("user_id % 10 = 3").select(folder).distinct().unionByName(e.where("event_id % 4 = 1").select(path))
    return changes.pruned(e.select(path), gone)


@query(sql.docs("SELECT path FROM docs WHERE NOT starts_with(path, '/es/') AND NOT regexp_matches(path, '3[.]txt$')"))
def still_included(spark, sf_dir):
    """Waiting paths after a change of the configuration."""
    return changes.still_included(corpus.documents(spark, sf_dir).where("path is not null").select("path"), {"/": True, "/es": False}, ["*3.txt"])


@query(sql.docs("SELECT path, CASE WHEN doc_id % 11 = 0 THEN 'new' WHEN doc_id % 13 = 0 THEN 'remove' ELSE 'modified' END AS job FROM docs WHERE doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0"))
def after_overflow(spark, sf_dir):
    """What makes up for lost events: a scan against what is known."""
    d = corpus.documents(spark, sf_dir).where("path is not null")
    known = d.where("doc_id % 11 <> 0").select("path", F.expr("if(doc_id % 7 = 0, mtime - 1, mtime)").alias("mtime"), F.expr("if(doc_id % 5 = 0, ctime - 1, ctime)").alias("ctime"))
    return changes.after_overflow(d.where("doc_id % 13 <> 0 or doc_id % 11 = 0"), known)
