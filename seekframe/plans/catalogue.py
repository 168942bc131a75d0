"""All registered queries over the given tables, with the SQL that an independent engine answers them by."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode, text
from ..operators import config, index, maintain, match, results, tree
from ..sources import corpus, files
from ..streaming import changes
from . import catalogue_sql as sql
from .compile import Catalog
from .query import Query
from .registry import ORACLES, QUERIES, catalog, orders, part_search, query, search, terms, tokens
from .term import Term

__all__ = ["ORACLES", "QUERIES", "flagship"]

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query("the AND that", limit=10).run(catalog(spark, sf_dir))


# -- scans and leaves ----------------------------------------------------------------


@query(sql.tok("SELECT DISTINCT doc_id FROM tok WHERE field = 'content' AND term = 'the'"))
def term_equal(spark, sf_dir):
    return index.equal(tokens(spark, sf_dir), "content", "the")


@query(sql.tok("SELECT DISTINCT doc_id FROM tok WHERE field = 'content' AND starts_with(term, 'thin')"))
def term_prefix(spark, sf_dir):
    return index.starts_with(tokens(spark, sf_dir), "content", "thin")


@query(sql.tok("SELECT DISTINCT doc_id FROM tok WHERE field = 'content' AND starts_with(term, 'th') AND regexp_matches(substr(term, 3), 'n.*s')"))
def term_regex_in_prefix(spark, sf_dir):
    return index.matches(tokens(spark, sf_dir), "content", "th", "n.*s")


@query(sql.tok("SELECT DISTINCT field, term FROM tok WHERE starts_with(term, 'on')"))
def term_dictionary(spark, sf_dir):
    return index.dictionary(tokens(spark, sf_dir), "on")


@query(sql.tok("SELECT DISTINCT doc_id FROM tok WHERE field = 'content' AND term = 'of'"))
def contains_short_word(spark, sf_dir):
    return search(spark, sf_dir, "content:of")


@query(sql.tok("SELECT DISTINCT doc_id FROM tok WHERE field = 'content' AND starts_with(term, 'thatin')"))
def contains_word(spark, sf_dir):
    return search(spark, sf_dir, "content:thatin")


@query(sql.tok("SELECT DISTINCT doc_id FROM tok WHERE field = 'filename' AND starts_with(term, '42')"))
def contains_short_name(spark, sf_dir):
    return search(spark, sf_dir, "filename:42")


@query("SELECT doc_id + 1 AS doc_id FROM documents WHERE n_chars >= 5000")
def int_ge(spark, sf_dir):
    return search(spark, sf_dir, "length>=5000")


@query("SELECT doc_id + 1 AS doc_id FROM documents WHERE n_chars > 5000")
def int_gt_strict(spark, sf_dir):
    return search(spark, sf_dir, "length>5000")


@query("SELECT doc_id + 1 AS doc_id FROM documents WHERE n_chars < 500")
def int_lt(spark, sf_dir):
    return search(spark, sf_dir, "length<500")


@query("SELECT p_partkey AS doc_id FROM part WHERE p_retailprice >= 950")
def double_ge(spark, sf_dir):
    return part_search(spark, sf_dir, "price>=950")


@query("SELECT p_partkey AS doc_id FROM part WHERE p_retailprice >= 950")
def double_gt_is_inclusive(spark, sf_dir):
    return part_search(spark, sf_dir, "price>950")


@query("SELECT p_partkey AS doc_id FROM part WHERE p_retailprice > 950")
def double_gt_strict_option(spark, sf_dir):
    return part_search(spark, sf_dir, "price>950", strict=True)


@query("SELECT p_partkey AS doc_id FROM part WHERE p_size BETWEEN 10 AND 20")
def typed_range(spark, sf_dir):
    return part_search(spark, sf_dir, "size>=10 AND size<=20")


def dated(spark: SparkSession, sf_dir: str) -> Catalog:
    o = orders(spark, sf_dir)
    rows = o.select(F.lit("date").alias("field"), F.explode(encode.property_term(F.col("o_orderdate"), "datetime")).alias("term"), "doc_id", F.array().cast("array<int>").alias("positions"))
    return Catalog(rows, types={"date": "datetime"})


@query("SELECT o_orderkey AS doc_id FROM orders WHERE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') <= '1995-06-30T00:00:00'")
def iso_date_le(spark, sf_dir):
    return Query(term=Term("date", "1995-06-30T00:00:00", "less_equal")).ids(dated(spark, sf_dir))


@query("SELECT o_orderkey AS doc_id FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-03-31'")
def iso_date_range(spark, sf_dir):
    """Bounds are inclusive, as in every comparison of times that is not strict."""
    low, high = (Term("date", datetime(1996, 3, day), c) for day, c in ((1, "greater"), (31, "less")))
    return Query(term=low & high).ids(dated(spark, sf_dir))


@query("SELECT doc_id + 1 AS doc_id FROM documents WHERE 1704067200 + doc_id * 3600 BETWEEN 1704100000 AND 1704500000")
def mtime_between(spark, sf_dir):
    return index.modified_between(corpus.documents(spark, sf_dir), 1704100000, 1704500000)


@query("SELECT doc_id + 1 AS doc_id FROM documents WHERE make_timestamp((1704067200 + doc_id * 3600) * 1000000)::DATE = DATE '2024-01-05'")
def mtime_day(spark, sf_dir):
    return search(spark, sf_dir, "modified=2024-01-05")


@query("SELECT doc_id + 1 AS doc_id FROM documents WHERE 1704067200 + doc_id * 3600 > 1705276800")
def mtime_after(spark, sf_dir):
    return search(spark, sf_dir, "modified>2024-01-15")


@query("SELECT o_orderkey AS doc_id FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) = 2")
def mtime_month_filter(spark, sf_dir):
    o = orders(spark, sf_dir)
    return Query(date=(1996, 2, 0), order="id").ids(Catalog(o.select(F.lit("").alias("field"), F.lit("").alias("term"), "doc_id"), o))


@query("SELECT o_orderkey AS doc_id FROM orders WHERE year(o_orderdate) = 1997")
def mtime_year_filter(spark, sf_dir):
    o = orders(spark, sf_dir)
    return Query(date=(1997, 0, 0), order="id").ids(Catalog(o.select(F.lit("").alias("field"), F.lit("").alias("term"), "doc_id"), o))


@query(sql.tok("SELECT DISTINCT doc_id FROM tok WHERE field = 'content' AND starts_with(term, 'thinor')"))
def type_filter(spark, sf_dir):
    return search(spark, sf_dir, Query("content:thinor", order="id").with_type("Document"))


@query("SELECT doc_id + 1 AS doc_id FROM labels WHERE quality = 1")
def tag_exact(spark, sf_dir):
    return search(spark, sf_dir, "tag=quality/1")


@query("SELECT doc_id + 1 AS doc_id FROM labels WHERE toxic IS NOT NULL")
def tag_tokens(spark, sf_dir):
    return search(spark, sf_dir, "tag:toxic")


@query("SELECT doc_id + 1 AS doc_id FROM documents WHERE lang = 'fr'")
def string_property(spark, sf_dir):
    return search(spark, sf_dir, "language=fr")


@query("SELECT CAST(1 AS BIGINT) AS doc_id WHERE false")
def string_comparison_is_empty(spark, sf_dir):
    return search(spark, sf_dir, "language>fr")


# -- combinations --------------------------------------------------------------------


def _has(word: str, field: str = "content", prefix: bool = True) -> str:
    test = f"starts_with(term, '{word}')" if prefix else f"term = '{word}'"
    return f"SELECT doc_id FROM tok WHERE field = '{field}' AND {test}"


@query(sql.tok(f"{_has('the')} INTERSECT {_has('that')}"))
def and_2(spark, sf_dir):
    return search(spark, sf_dir, "content:the AND content:that")


@query(sql.tok(f"{_has('the')} INTERSECT {_has('that')} INTERSECT {_has('with')}"))
def and_3(spark, sf_dir):
    return search(spark, sf_dir, "content:the content:that content:with")


@query(sql.tok(f"{_has('einen')} UNION {_has('pour')}"))
def or_2(spark, sf_dir):
    return search(spark, sf_dir, "content:einen OR content:pour")


@query(sql.tok(f"{_has('einen')} UNION {_has('pour')} UNION {_has('para')}"))
def or_3(spark, sf_dir):
    return search(spark, sf_dir, "content:einen OR content:pour OR content:para")


@query(sql.tok(f"({_has('einen')} UNION {_has('pour')}) INTERSECT ({_has('des')} UNION {_has('nicht')})"))
def nested_and_or(spark, sf_dir):
    return search(spark, sf_dir, "(content:einen OR content:pour) AND (content:des OR content:nicht)")


@query(sql.tok(f"{_has('txt')} UNION {_has('txt', 'filename')}"))
def bare_word_content_or_filename(spark, sf_dir):
    return search(spark, sf_dir, "txt")


@query(sql.phrase(["of", "the"]))
def phrase_2(spark, sf_dir):
    return search(spark, sf_dir, 'content="of the"')


@query(sql.phrase(["in", "of", "the"]))
def phrase_3(spark, sf_dir):
    return search(spark, sf_dir, 'content="in of the"')


@query(sql.phrase(["of", "the"], f"doc_id IN ({_has('with')})"))
def phrase_and_term(spark, sf_dir):
    return search(spark, sf_dir, 'content="of the" AND content:with')


@query("SELECT CAST(1 AS BIGINT) AS doc_id WHERE false")
def empty_child_and(spark, sf_dir):
    return search(spark, sf_dir, "content:the AND unknown:x")


@query(sql.tok(_has("the").replace("SELECT", "SELECT DISTINCT")))
def empty_child_or(spark, sf_dir):
    return search(spark, sf_dir, "content:the OR unknown:x")


@query(sql.tok(f"SELECT DISTINCT doc_id FROM docs WHERE starts_with(path, '/en/src1/') INTERSECT {_has('that')}"))
def include_folder_and_term(spark, sf_dir):
    return search(spark, sf_dir, Query("content:that", folder="/en/src1", order="id"))


@query("SELECT c.conv_id AS doc_id FROM (SELECT conv_id, lower(text) AS t FROM conversations WHERE text IS NOT NULL) c WHERE regexp_matches(c.t, '(^|[^a-z0-9])of[^a-z0-9]+the([^a-z0-9]|$)') GROUP BY c.conv_id")
def conversation_phrase(spark, sf_dir):
    """A document of several chunks of text: a gap between their positions keeps phrases from crossing chunks."""
    turns = corpus.table(spark, sf_dir, "conversations").where("text is not null")
    chunks = turns.select(F.col("conv_id").alias("doc_id"), F.posexplode(text.portable_tokens("text")).alias("pos", "term"), (F.col("turn") * (1 << 32)).alias("base"))
    return match.phrase(chunks.select("doc_id", F.lit("content").alias("field"), "term", (F.col("base") + F.col("pos")).alias("pos")), "content", ["of", "the"])


@query("SELECT page_id AS doc_id FROM pages WHERE regexp_matches(regexp_extract(url, '://[^/]*/([^?#]*)', 1), '(^|/)en(/|$)')")
def page_path_word(spark, sf_dir):
    pages = corpus.table(spark, sf_dir, "pages")
    path = F.regexp_extract("url", "://[^/]*/([^?#]*)", 1)
    rows = pages.select(F.col("page_id").alias("doc_id"), F.lit("filename").alias("field"), F.explode(F.split(path, "/")).alias("term"))
    return index.equal(rows, "filename", "en")


# -- trees ---------------------------------------------------------------------------


@query(sql.TREE + "SELECT doc_id, path FROM walk")
def path_reconstruct(spark, sf_dir):
    return tree.paths(corpus.folders(spark, sf_dir), 8)


@query(sql.TREE + "SELECT doc_id FROM walk WHERE path = '/EUROPE/NATION_3'")
def path_to_id(spark, sf_dir):
    return tree.id_of(tree.paths(corpus.folders(spark, sf_dir), 8), "//EUROPE//NATION_3/")


@query("SELECT CAST(n_nationkey + 100 AS BIGINT) AS doc_id, n_name AS name FROM nation WHERE n_regionkey = 3")
def children_of(spark, sf_dir):
    return tree.children(corpus.folders(spark, sf_dir), 4)


@query(sql.TREE + "SELECT doc_id FROM walk WHERE path = '/ASIA' OR starts_with(path, '/ASIA/')")
def descendants_of(spark, sf_dir):
    return tree.descendants(tree.paths(corpus.folders(spark, sf_dir), 8), "/ASIA")


@query(sql.TREE + "SELECT doc_id FROM walk WHERE NOT (path = '/ASIA' OR starts_with(path, '/ASIA/'))")
def remove_recursive(spark, sf_dir):
    t = corpus.folders(spark, sf_dir)
    return tree.remove_recursively(t, tree.paths(t, 8), "/ASIA").select("doc_id")


@query(
    sql.TREE
    + """, own AS (SELECT doc_id, path, NOT regexp_matches(path, '7$') AS del FROM walk WHERE path = '/ASIA' OR starts_with(path, '/ASIA/')),
    kept AS (SELECT path FROM own WHERE NOT del)
    SELECT doc_id FROM walk w WHERE doc_id NOT IN (SELECT doc_id FROM own o WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE o.path = k.path OR starts_with(k.path, o.path || '/') OR starts_with(o.path, k.path || '/')))"""
)
def conditional_remove(spark, sf_dir):
    t = corpus.folders(spark, sf_dir)
    return tree.remove_where(t, tree.paths(t, 8), "/ASIA", ~F.col("path").rlike("7$")).select("doc_id")


@query(sql.TREE + "SELECT doc_id, CASE WHEN path = '/EUROPE/NATION_3' OR starts_with(path, '/EUROPE/NATION_3/') THEN '/ASIA/GAUL' || substr(path, 17) ELSE path END AS path FROM walk")
def move_subtree(spark, sf_dir):
    t = corpus.folders(spark, sf_dir)
    return tree.paths(tree.move(t, 103, 3, "GAUL"), 8)


@query(sql.docs("SELECT DISTINCT path FROM (SELECT '/' || lang AS path FROM docs UNION ALL SELECT '/' || lang || '/' || source FROM docs UNION ALL SELECT path FROM docs) WHERE path IS NOT NULL"))
def ancestors_created(spark, sf_dir):
    return tree.with_ancestors(corpus.documents(spark, sf_dir).where("path is not null"))


# -- results -------------------------------------------------------------------------


@query(sql.tok(f"SELECT doc_id, mtime FROM docs WHERE doc_id IN ({_has('that')}) ORDER BY mtime DESC, doc_id LIMIT 20"))
def sort_mtime_desc(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return results.newest_first(Query("content:that").ids(c), c.times, limit=20)


@query(sql.tok(f"SELECT doc_id, path FROM docs WHERE doc_id IN ({_has('that')}) ORDER BY mtime DESC, doc_id LIMIT 15 OFFSET 10"))
def offset_limit(spark, sf_dir):
    return Query("content:that", offset=10, limit=15).run(catalog(spark, sf_dir))


@query(sql.tok(f"SELECT doc_id, path FROM docs WHERE doc_id IN ({_has('that')}) ORDER BY doc_id LIMIT 12"))
def sort_none_limit(spark, sf_dir):
    return Query("content:that", limit=12).with_order("none").run(catalog(spark, sf_dir))


@query("SELECT lower(hex(doc_id + 1)) || ' /' || lang || '/' || source || '/doc_' || doc_id || '.txt' AS line FROM documents")
def hex_id(spark, sf_dir):
    return results.as_lines(corpus.documents(spark, sf_dir))


@query("SELECT o_orderkey AS doc_id, CASE WHEN n > 0 THEN name || ' (' || n || ')' ELSE name END AS shown FROM (SELECT o_orderkey, 'c' || o_custkey AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)")
def dup_name_suffix(spark, sf_dir):
    o = corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("c"), "o_custkey").alias("name"))
    return results.numbered_names(o, F.col("doc_id")).select("doc_id", "shown")


# -- index ---------------------------------------------------------------------------


@query(sql.tok("SELECT field, term, count(DISTINCT doc_id) AS n, min(doc_id) AS first, max(doc_id) AS last FROM tok GROUP BY field, term"))
def inverted_lists(spark, sf_dir):
    lists = index.inverted_lists(terms(spark, sf_dir))
    ends = lists.select("field", "term", F.size("doc_ids").cast("long").alias("n"), F.element_at("doc_ids", 1).alias("first"), F.element_at("doc_ids", -1).alias("last"))
    return ends.groupBy("field", "term").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


@query(sql.tok("SELECT doc_id, field, array_to_string(list_sort(list(DISTINCT term)), ' ') AS terms FROM tok GROUP BY doc_id, field"))
def forward_lists(spark, sf_dir):
    return index.forward_lists(tokens(spark, sf_dir)).select("doc_id", "field", F.array_join("terms", " ").alias("terms"))


@query(sql.tok("SELECT doc_id, field, array_to_string(list_sort(list(pos)), ',') AS positions FROM tok WHERE term = 'that' GROUP BY doc_id, field"))
def positions_per_term(spark, sf_dir):
    rows = index.postings(tokens(spark, sf_dir)).where("term = 'that'")
    return rows.select("doc_id", "field", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(sql.tok("SELECT field, count(*) AS n, count(DISTINCT term) AS terms FROM tok GROUP BY field"))
def token_count(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy("field").agg(F.count("*").alias("n"), F.count_distinct("term").alias("terms"))


@query(sql.tok("SELECT doc_id, term, pos FROM tok WHERE field = 'content'"))
def portable_tokens(spark, sf_dir):
    return tokens(spark, sf_dir).where("field = 'content'").select("doc_id", "term", F.col("pos").cast("long").alias("pos"))


@query(sql.docs(
    """SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, left(nfc_normalize(lower(strip_accents(t))), 25) AS term
    FROM docs, unnest(regexp_extract_all(replace(text, '_', ' '), '\\p{S}+|([0-9]([.,][0-9])*|\\p{L}([''’]\\p{L})*)+')) WITH ORDINALITY AS u(t, i)"""
))
def unicode_tokens(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(text.tokenize("text")).alias("pos", "term")).withColumn("pos", F.col("pos").cast("long"))


@query(sql.docs("SELECT doc_id, CAST(CASE WHEN n > 1 THEN 10000 END AS BIGINT) AS first, CAST(CASE WHEN n > 1 THEN 10000 + n - 1 END AS BIGINT) AS last FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS n FROM docs)"))
def position_bases(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir).select("doc_id", text.positions(text.portable_tokens(F.col("text")), 10000).alias("p"))
    return docs.select("doc_id", F.try_element_at("p", F.lit(1)).cast("long").alias("first"), F.try_element_at("p", F.lit(-1)).cast("long").alias("last"))


# -- maintenance ---------------------------------------------------------------------


@query(sql.docs("SELECT doc_id, doc_id % 7 = 0 AS mtime_changed, doc_id % 5 = 0 OR doc_id % 7 = 0 AS ctime_changed FROM docs WHERE doc_id % 11 <> 0 AND (doc_id % 7 = 0 OR doc_id % 5 = 0) UNION ALL SELECT doc_id, true, true FROM docs WHERE doc_id % 11 = 0"))
def diff_new_changed(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir).select("doc_id", "mtime", "ctime", F.lit(False).alias("is_dir"))
    known = docs.where("doc_id % 11 <> 0").select("doc_id", F.expr("if(doc_id % 7 = 0, mtime - 10, mtime)").alias("mtime"), F.expr("if(doc_id % 5 = 0 or doc_id % 7 = 0, ctime - 10, ctime)").alias("ctime"))
    return files.changed(docs, known).select("doc_id", "mtime_changed", "ctime_changed")


@query(sql.docs("SELECT doc_id, path FROM docs WHERE starts_with(path, '/en/src1/') OR doc_id % 9 = 0"))
def stale_entries(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir).select("doc_id", "path").where("path is not null")
    inside = config.included(F.col("path"), {"/": True, "/en/src1": False}, hidden=True)
    return maintain.stale(docs, docs.where("doc_id % 9 <> 0"), inside, "all").distinct()


@query(sql.tok("SELECT DISTINCT term, doc_id FROM tok WHERE field = 'content' AND term = 'that' AND doc_id % 4 = 0"))
def check_forward_minus_inverted(spark, sf_dir):
    t = terms(spark, sf_dir).where("field = 'content'")
    return maintain.only_left(t, t.where("not (term = 'that' and doc_id % 4 = 0)"))


@query(sql.tok("SELECT DISTINCT term, doc_id FROM tok WHERE field = 'content' AND doc_id % 50 = 3"))
def check_inverted_minus_forward(spark, sf_dir):
    t = terms(spark, sf_dir).where("field = 'content'")
    return maintain.only_left(t, t.where("doc_id % 50 <> 3"))


@query(sql.tok("SELECT count(DISTINCT doc_id) FILTER (WHERE doc_id % 6 = 0) AS orphans, count(DISTINCT doc_id) AS ids, 100.0::DOUBLE * count(DISTINCT doc_id) FILTER (WHERE doc_id % 6 = 0) / count(DISTINCT doc_id) AS percent FROM tok"))
def orphan_ids_pct(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir)
    return maintain.orphans(tokens(spark, sf_dir), docs.where("doc_id % 6 <> 0 and path is not null").select("doc_id", "path"))


@query(sql.tok("SELECT DISTINCT CASE WHEN doc_id % 3 = 0 AND term = 'that' THEN 'replaced' ELSE term END AS term, doc_id FROM tok WHERE field = 'content'"))
def replace_terms(spark, sf_dir):
    """Remove, then add: of the operations on a term and document the last one counts."""
    t = terms(spark, sf_dir).where("field = 'content'").select("term", "doc_id").distinct()
    hit = t.where("doc_id % 3 = 0 and term = 'that'")
    out = hit.select("term", "doc_id", F.lit("remove").alias("op"), F.lit(1).alias("seq"))
    into = hit.select(F.lit("replaced").alias("term"), "doc_id", F.lit("add").alias("op"), F.lit(2).alias("seq"))
    return maintain.commit(t, out.unionByName(into)).distinct()


@query(sql.tok("SELECT DISTINCT term, doc_id FROM tok WHERE field = 'content' AND doc_id % 10 <> 1"))
def add_then_remove(spark, sf_dir):
    """Documents that are added and removed leave the index as it was."""
    t = terms(spark, sf_dir).where("field = 'content'").select("term", "doc_id").distinct()
    base, extra = t.where("doc_id % 10 <> 1"), t.where("doc_id % 10 = 1")
    ops = extra.select("term", "doc_id", F.lit("add").alias("op"), F.lit(1).alias("seq")).unionByName(extra.select("term", "doc_id", F.lit("remove").alias("op"), F.lit(2).alias("seq")))
    return maintain.commit(base, ops)


@query("SELECT doc_id + 1 AS doc_id, CASE WHEN lang = 'es' THEN 'excluded by path' WHEN doc_id % 13 = 0 THEN 'waiting for both' WHEN doc_id % 7 = 0 THEN 'waiting for content' WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'done' END AS state FROM documents WHERE lang IS NOT NULL")
def status_per_file(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).where("lang is not null").withColumn("k", F.col("doc_id") - 1)
    inside = config.included(F.col("path"), {"/": True, "/es": False})
    return results.status(d, F.col("k") % 13 != 0, F.col("k") % 7 == 0, F.col("k") % 5 == 0, inside, F.lit(False), F.lit(False)).select("doc_id", "state")


@query("SELECT doc_id + 1 AS doc_id, array_to_string(CASE WHEN doc_id % 11 = 0 THEN ['add'] ELSE list_filter([CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 'times' END, CASE WHEN doc_id % 5 = 0 THEN 'xattr' END, CASE WHEN doc_id % 7 = 0 THEN 'queue' END], lambda x: x IS NOT NULL) END, ',') AS facets FROM documents WHERE doc_id % 11 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0")
def update_plan(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).withColumn("k", F.col("doc_id") - 1)
    known = d.where("k % 11 <> 0").select("doc_id", "path", F.expr("if(k % 7 = 0, mtime - 1, mtime)").alias("mtime"), F.expr("if(k % 5 = 0, ctime - 1, ctime)").alias("ctime"))
    return changes.update_plan(d.select("doc_id", "path", "mtime", "ctime"), known).select("doc_id", F.array_join("facets", ",").alias("facets"))


# -- configuration -------------------------------------------------------------------


@query("SELECT c_custkey AS doc_id FROM customer WHERE c_name <> 'Customer#000000007' AND NOT regexp_matches(c_name, '(13|99)$') AND NOT regexp_matches(c_name, '^Customer#.*5.1$')")
def exclude_name_filters(spark, sf_dir):
    c = corpus.table(spark, sf_dir, "customer")
    return c.where(~config.excluded_name(F.col("c_name"), ["Customer#000000007", "*13", "*99", "Customer#*5?1"])).select(F.col("c_custkey").alias("doc_id"))


@query(sql.docs("SELECT doc_id, CASE WHEN starts_with(path, '/en/src1/') THEN true WHEN starts_with(path, '/en/') THEN false ELSE true END AS included FROM docs WHERE path IS NOT NULL"))
def folder_longest_prefix(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).where("path is not null")
    return d.select("doc_id", config.included(F.col("path"), {"/": True, "/en": False, "/en/src1": True}).alias("included"))


def mime():
    return F.element_at(F.array(*map(F.lit, sql.MIME_TYPES)), (F.col("k") % len(sql.MIME_TYPES) + 1).cast("int"))


@query(f"SELECT doc_id + 1 AS doc_id FROM documents WHERE {sql.MIME} NOT IN ('image/png', 'application/zip')")
def mime_exclude(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).withColumn("k", F.col("doc_id") - 1)
    return d.where(config.mime_included(mime(), ["image/png", "application/zip"])).select("doc_id")


@query("SELECT s_suppkey AS doc_id FROM supplier WHERE s_suppkey % 4 <> 0")
def hidden_filter(spark, sf_dir):
    s = corpus.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.concat(F.expr("if(s_suppkey % 4 = 0, '/data/.', '/data/')"), "s_name").alias("path"))
    return s.where(config.included(F.col("path"), {"/data": True})).select("doc_id")


@query("SELECT doc_id + 1 AS doc_id FROM documents WHERE n_chars * 500 < 10485760")
def large_text_skip(spark, sf_dir):
    return corpus.documents(spark, sf_dir).where(files.may_extract(F.lit("text/plain"), F.col("n_chars") * 500)).select("doc_id")


@query(f"SELECT doc_id + 1 AS doc_id, {sql.KINDS} AS kinds FROM documents")
def mime_to_types(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).withColumn("k", F.col("doc_id") - 1)
    return d.select("doc_id", F.array_join(encode.kinds(mime()), ",").alias("kinds"))


# -- figures -------------------------------------------------------------------------


@query(sql.tok("SELECT count(DISTINCT doc_id) AS documents FROM tok WHERE field = 'content'"))
def docs_total(spark, sf_dir):
    return tokens(spark, sf_dir).where("field = 'content'").agg(F.count_distinct("doc_id").alias("documents"))


@query("SELECT count(*) AS queued FROM documents WHERE doc_id % 7 = 0")
def queue_size(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").where("doc_id % 7 = 0").agg(F.count("*").alias("queued"))


@query("SELECT least(count(*), 100) AS failed FROM documents WHERE doc_id % 5 = 0")
def failed_capped(spark, sf_dir):
    """A status line counts no further than a hundred failures; that limit is the feature."""
    return corpus.table(spark, sf_dir, "documents").where("doc_id % 5 = 0").limit(100).agg(F.count("*").alias("failed"))


@query("SELECT doc_id + 1 AS doc_id FROM documents WHERE doc_id % 7 = 0 ORDER BY doc_id LIMIT 40")
def queue_fetch(spark, sf_dir):
    return index.first_queued(corpus.documents(spark, sf_dir).where("(doc_id - 1) % 7 = 0").select("doc_id"), 40)


@query("SELECT CAST(s_nationkey AS BIGINT) AS device, count(*) AS n FROM supplier GROUP BY s_nationkey")
def items_per_device(spark, sf_dir):
    s = corpus.table(spark, sf_dir, "supplier")
    return results.per_device(s.select(encode.pack_id(F.col("s_nationkey"), F.col("s_suppkey")).alias("doc_id")))


@query("SELECT DISTINCT tag FROM (SELECT 'quality/' || quality AS tag FROM labels UNION ALL SELECT 'toxic/' || toxic FROM labels) WHERE tag IS NOT NULL")
def distinct_tags(spark, sf_dir):
    return corpus.tags(spark, sf_dir).select("tag").distinct()


@query("SELECT DISTINCT CAST(quality AS VARCHAR) AS section FROM labels WHERE quality IS NOT NULL")
def tag_children(spark, sf_dir):
    return tree.tag_children(corpus.tags(spark, sf_dir), "Quality")


@query("SELECT doc_id + 1 AS doc_id FROM labels WHERE quality = 1 AND starts_with(doc_id::VARCHAR, '42')")
def tag_and_filename(spark, sf_dir):
    return search(spark, sf_dir, "tag=quality/1 AND filename:42")


@query("SELECT doc_id + 1 AS doc_id, to_json({'file': '/' || lang || '/' || source || '/doc_' || doc_id || '.txt', 'state': CASE WHEN lang = 'es' THEN 'excluded by path' ELSE 'done' END})::VARCHAR AS json FROM documents WHERE lang IS NOT NULL")
def status_json(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).where("lang is not null")
    yes, no = F.lit(True), F.lit(False)
    states = results.status(d, yes, no, no, config.included(F.col("path"), {"/": True, "/es": False}), no, no)
    return states.select("doc_id", results.as_json(F.col("path"), F.col("state")).alias("json"))


@query(sql.tok("SELECT origin, array_to_string(list_sort(list(DISTINCT term)), ' ') AS terms FROM (SELECT CASE field WHEN 'content' THEN 'content' ELSE 'filename' END AS origin, term FROM tok WHERE doc_id = 12) GROUP BY origin"))
def forward_terms_by_origin(spark, sf_dir):
    t = tokens(spark, sf_dir)
    rows = index.postings(t.where("field = 'content'")).unionByName(index.postings(t.where("field = 'filename'"), "filename"))
    return index.forward_by_origin(rows, 12).select("origin", F.array_join("terms", " ").alias("terms"))


@query("SELECT doc_id + 1 AS doc_id, doc_id % 3 <> 0 AS known, doc_id % 7 = 0 AS queued, doc_id % 5 = 0 AS failed FROM documents")
def membership(spark, sf_dir):
    ids = corpus.documents(spark, sf_dir).select("doc_id").withColumn("k", F.col("doc_id") - 1)
    empty = index.empty(spark)
    state = empty.with_(files=ids.where("k % 3 <> 0"), queue=ids.where("k % 7 = 0"), failed=ids.where("k % 5 = 0"))
    return index.membership(ids, state)


@query("SELECT coalesce(a.path, b.path) AS path, a.doc_id AS index_id, b.doc_id AS found_id FROM (SELECT '/s/' || s_name AS path, CAST(s_suppkey AS BIGINT) AS doc_id FROM supplier WHERE s_suppkey % 5 <> 0) a FULL JOIN (SELECT '/s/' || s_name AS path, CAST(s_suppkey + CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS doc_id FROM supplier WHERE s_suppkey % 7 <> 0) b ON a.path = b.path WHERE a.doc_id IS DISTINCT FROM b.doc_id")
def id_differences(spark, sf_dir):
    s = corpus.table(spark, sf_dir, "supplier").select(F.concat(F.lit("/s/"), "s_name").alias("path"), F.col("s_suppkey").alias("doc_id"))
    found = s.where("doc_id % 7 <> 0").select("path", F.expr("doc_id + if(doc_id % 4 = 0, 1, 0)").cast("long").alias("doc_id"))
    return maintain.id_differences(s.where("doc_id % 5 <> 0").select("path", F.col("doc_id").cast("long").alias("doc_id")), found)


@query("SELECT doc_id + 1 AS doc_id, CASE WHEN toxic IS NULL THEN '' ELSE 'harm/' || toxic END || '|' || CASE WHEN quality IS NULL THEN '' ELSE 'quality/' || quality END AS tags FROM labels")
def tag_rename(spark, sf_dir):
    tags = corpus.tags(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("tag").alias("tags")).select("doc_id", F.array_sort(maintain.rename_tag(F.col("tags"), "toxic", "harm")).alias("tags"))
    of = lambda p: F.coalesce(F.try_element_at(F.filter("tags", lambda t: t.startswith(p)), F.lit(1)), F.lit(""))
    return tags.select("doc_id", F.concat(of("harm/"), F.lit("|"), of("quality/")).alias("tags"))


@query("SELECT DISTINCT make_timestamp((1704067200 + doc_id * 3600) * 1000000)::DATE AS day FROM documents WHERE make_timestamp((1704067200 + doc_id * 3600) * 1000000)::DATE <= DATE '2024-02-01'")
def timeline_days(spark, sf_dir):
    return results.active_days(corpus.documents(spark, sf_dir), F.lit("2024-02-01").cast("date"))


@query("SELECT DISTINCT year(o_orderdate) AS year, month(o_orderdate) AS month FROM orders WHERE o_orderdate::DATE <= DATE '1998-08-02'")
def timeline_months(spark, sf_dir):
    rows = results.active_months(orders(spark, sf_dir), F.lit("1998-08-02").cast("date"))
    return rows.select(F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"))


@query(
    """WITH v AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS q, list(CAST(l_quantity AS DOUBLE)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l FROM lineitem)
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(list_sum(list_transform(l, lambda x, i: x * sqrt(i))) / list_sum(list_transform(l, lambda x, i: sqrt(i))), 4) AS estimate FROM v"""
)
def eta_weighted_avg(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.struct("l_linenumber", "l_partkey", "l_quantity").alias("at"), F.col("l_quantity").cast("double").alias("q"))
    return results.weighted_average(rows, "l_orderkey", "at", "q").select("l_orderkey", "l_linenumber", F.round("estimate", 4).alias("estimate"))


@query("SELECT lang AS name, sum(n_chars)::BIGINT AS bytes, 100.0::DOUBLE * sum(n_chars) / (SELECT sum(n_chars) FROM documents) AS percent FROM documents GROUP BY lang")
def size_share(spark, sf_dir):
    return index.shares(corpus.table(spark, sf_dir, "documents"), F.col("lang"), F.col("n_chars"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE n_chars < 400) AS ignored, count(*) FILTER (WHERE n_chars >= 400 AND doc_id % 2 = 0) AS accessible FROM documents")
def scan_summary(spark, sf_dir):
    return results.scan_summary(corpus.table(spark, sf_dir, "documents"), F.col("n_chars") < 400, F.col("doc_id") % 2 == 0)


@query("SELECT s_suppkey AS doc_id FROM supplier WHERE s_nationkey IN (1, 2, 3) AND s_nationkey <> 2 AND regexp_matches(s_name, '1')")
def sanitizer_filters(spark, sf_dir):
    s = corpus.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_nationkey").alias("device"), F.col("s_name").alias("path"), F.lit(True).alias("available"))
    mounts = corpus.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("device"))
    return config.sanitize(s, mounts, [1, 2, 3, -2], "1", ["unavailable", "unmounted"]).select("doc_id")


# -- properties ----------------------------------------------------------------------


@query("SELECT l_orderkey, '{\"lines\":' || CASE WHEN count(*) = 1 THEN max(l_linenumber)::VARCHAR ELSE '[' || string_agg(l_linenumber, ',' ORDER BY l_linenumber, l_partkey) || ']' END || '}' AS json FROM lineitem GROUP BY l_orderkey")
def property_json(spark, sf_dir):
    """Numbers; an order of one line has a plain value, others an array."""
    rows = corpus.table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_orderkey").agg(encode.property_json(F.lit("lines"), F.col("l_linenumber"), F.struct("l_linenumber", "l_partkey")).alias("json"))


@query("SELECT doc_id, '{\"lang\":' || to_json(lang)::VARCHAR || ',\"source\":' || to_json(source)::VARCHAR || '}' AS json FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def property_json_texts(spark, sf_dir):
    """Two names with a text each, quoted."""
    d = corpus.table(spark, sf_dir, "documents").where("lang is not null and source is not null")
    rows = d.select("doc_id", F.explode(F.create_map(F.lit("source"), "source", F.lit("lang"), "lang")).alias("k", "v"))
    return rows.groupBy("doc_id").agg(encode.property_json(F.col("k"), F.col("v"), F.lit(0)).alias("json"))


@query("SELECT event_id, k AS name, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL)")
def property_values(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "events").where("props is not null")
    values = rows.select("event_id", F.explode(encode.property_values(F.col("props"))).alias("name", "values"))
    return values.select("event_id", "name", F.explode("values").alias("value"))


@query("SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 = 0 THEN 'property' WHEN p_partkey % 3 = 1 THEN 'plain' ELSE 'malformed' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS number FROM part")
def property_term_parse(spark, sf_dir):
    p = corpus.table(spark, sf_dir, "part")
    term = F.expr("case when p_partkey % 3 = 0 then concat('X', p_size, '-', lower(p_brand)) when p_partkey % 3 = 1 then lower(p_brand) else concat('Xq', p_size) end")
    c = encode.term_class(term)
    return p.select(F.col("p_partkey").alias("doc_id"), c["kind"].alias("kind"), c["number"].alias("number"))


@query("SELECT s_suppkey AS inode, CAST(s_nationkey AS BIGINT) AS device, (s_suppkey::BIGINT << 32) | s_nationkey AS doc_id FROM supplier")
def id_pack(spark, sf_dir):
    s = corpus.table(spark, sf_dir, "supplier").select(encode.pack_id(F.col("s_nationkey"), F.col("s_suppkey")).alias("doc_id"))
    return s.select(encode.inode_of(F.col("doc_id")).alias("inode"), encode.device_of(F.col("doc_id")).alias("device"), "doc_id")


# -- change events -------------------------------------------------------------------


@query("""WITH RECURSIVE ev AS (SELECT '/user/' || user_id AS path, epoch_us(ts)::DOUBLE / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT path, n, s, 0.0::DOUBLE AS due, NULL::DOUBLE AS released, true AS fresh FROM ev WHERE n = 1
    UNION ALL SELECT path, n, s, CASE WHEN fresh THEN d ELSE s + least(60, greatest(5, CASE WHEN d > 0 THEN 2 * (d - s) ELSE 5 END)) END, released, fresh
        FROM (SELECT *, s - seen > 120 AND d = 0 AS fresh FROM (SELECT e.path, e.n, e.s, r.s AS seen, CASE WHEN r.due > 0 AND r.due <= e.s THEN 0 ELSE r.due END AS d, CASE WHEN r.due > 0 AND r.due <= e.s THEN r.due END AS released FROM r JOIN ev e ON e.path = r.path AND e.n = r.n + 1) x) y)
    SELECT path, released AS at, 'delayed' AS how FROM r WHERE released IS NOT NULL UNION ALL SELECT path, s, 'at once' FROM r WHERE fresh
    UNION ALL SELECT path, due, 'delayed' FROM r JOIN (SELECT path, max(n) AS n FROM ev GROUP BY path) l USING (path, n) WHERE due > 0""")
def debounce_replay(spark, sf_dir):
    e = corpus.events(spark, sf_dir)
    return changes.debounce_replay(e.select("path", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").__truediv__(1e6).alias("seconds")))


@query("SELECT 'renamed' AS kind, '/user/' || a.user_id AS path, '/new/' || a.event_id AS target FROM events a WHERE a.event_type = 'view' AND a.event_id % 3 = 0 UNION ALL SELECT 'deleted', '/user/' || user_id, NULL FROM events WHERE event_type = 'view' AND event_id % 3 = 1 UNION ALL SELECT 'created', '/new/' || event_id, NULL FROM events WHERE event_type = 'view' AND event_id % 3 = 2")
def rename_pairs(spark, sf_dir):
    e = corpus.events(spark, sf_dir).where("kind = 'attributes'")
    gone = e.where("seq % 3 < 2").select("path", "ts", F.lit("moved_from").alias("kind"), F.col("seq").alias("cookie"))
    come = e.where("seq % 3 <> 1").select(F.concat(F.lit("/new/"), "seq").alias("path"), (F.col("ts") + F.expr("interval 400 milliseconds")).alias("ts"), F.lit("moved_to").alias("kind"), F.col("seq").alias("cookie"))
    return changes.renames(gone.unionByName(come))


@query("SELECT '/user/' || user_id AS path, date_trunc('hour', ts) AS ts, bool_or(event_type = 'signup') AS created, bool_or(event_type = 'purchase') AS modified, bool_or(event_type = 'click') AS closed, bool_or(event_type = 'view') AS attributes, bool_or(event_type = 'error') AS deleted FROM events GROUP BY 1, 2")
def event_flag_merge(spark, sf_dir):
    return changes.merged_flags(corpus.events(spark, sf_dir), "1 hour")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND (event_id % 100) * 1000 <= 60000")
def recency_guard(spark, sf_dir):
    e = corpus.events(spark, sf_dir).where("kind = 'closed'").select("seq", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts_seconds"))
    return changes.recent_writes(e.withColumn("mtime", F.col("ts_seconds") - F.col("seq") % 100 * 1000)).select(F.col("seq").alias("event_id"))


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 WHEN 'view' THEN 4 ELSE 8 END AS rank FROM events")
def scheduler_priority(spark, sf_dir):
    e = corpus.events(spark, sf_dir).select(F.col("seq").alias("event_id"), F.when(F.col("kind") == "created", "new").otherwise(F.col("kind")).alias("kind"))
    return changes.prioritised(e).select("event_id", "rank")


@query("SELECT path, ts, kind FROM (SELECT '/user/' || user_id AS path, ts, CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'modified' WHEN 'click' THEN 'closed' WHEN 'view' THEN 'attributes' WHEN 'error' THEN 'deleted' END AS kind, max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id) AS gone FROM events) WHERE kind = 'deleted' OR gone IS NULL OR ts > gone")
def delete_short_circuit(spark, sf_dir):
    return changes.without_deleted(corpus.events(spark, sf_dir).select("path", "ts", "kind"))


@query("SELECT event_id FROM events WHERE user_id % 10 = 3")
def watched_paths(spark, sf_dir):
    e = corpus.events(spark, sf_dir)
    mine = corpus.table(spark, sf_dir, "events").where("user_id % 10 = 3").select(F.concat(F.lit("/user/"), "user_id").alias("path"))
    return changes.watched(e, mine).select(F.col("seq").alias("event_id"))


from . import catalogue_forms, catalogue_upkeep  # noqa: E402, F401  these register the other queries
