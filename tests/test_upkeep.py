"""Rows of files, and an index that is kept and follows changes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from seekframe.functions import encode, text
from seekframe.operators import generate, index, maintain, results, store
from seekframe.plans.catalogue_upkeep import states
from seekframe.plans.compile import Catalog
from seekframe.plans.query import Query
from seekframe.plans.virtual import TagFolder
from seekframe.streaming import changes, upkeep

FILES = "doc_id long, parent_id long, name string, path string, mtime long, ctime long, is_dir boolean, tags array<string>, rating int, comment string"


def rows(spark, *files):
    return spark.createDataFrame([(d, p, n, path, m, c, False, t, r, x) for d, p, n, path, m, c, t, r, x in files], FILES)


@pytest.fixture(scope="module")
def files(spark):
    folder = spark.createDataFrame([(100, 0, "home", "/home", 1, 1, True, None, None, None)], FILES)
    return folder.unionByName(rows(spark, *[(d, 100, f"file {d}.txt", f"/home/file {d}.txt", 10 + d, 20 + d, ["red/dark", "x"] if d % 2 else None, d % 6, "Well done" if d == 3 else None) for d in range(1, 21)])).cache()


def state(i):
    return sorted(map(str, states(i).collect()))


def test_rows_of_a_file(spark):
    found = generate.index_of(rows(spark, (1, 0, "My_file.tar.gz", "/My_file.tar.gz", 1, 2, ["red/dark blue", "x", "red"], 4, "A red one"), (2, 0, "one", "/one", 1, 2, [], 0, "")))
    got = {(r.doc_id, r.field, r.term): (r.origin, r.positions) for r in found.postings.collect()}
    assert got == {
        (1, "filename", "my"): ("filename", [1]), (1, "filename", "file"): ("filename", [2]), (1, "filename", "tar"): ("filename", [3]), (1, "filename", "gz"): ("filename", [4]),
        (1, "tags", "red"): ("xattr", [1]), (1, "tags", "dark"): ("xattr", [2]), (1, "tags", "blue"): ("xattr", [3]), (1, "tags", "x"): ("xattr", []),
        (1, "tag", "red/dark blue"): ("xattr", []), (1, "tag", "x"): ("xattr", []), (1, "tag", "red"): ("xattr", []), (1, "rating", "4"): ("xattr", []),
        (1, "usercomment", "a"): ("xattr", [5]), (1, "usercomment", "red"): ("xattr", [6]), (1, "usercomment", "one"): ("xattr", [7]), (2, "filename", "one"): ("filename", []),
    }
    assert sorted(r.doc_id for r in found.queue.collect()) == [1, 2]
    full = generate.index_of(spark.createDataFrame([(5, 0, "a.txt", 1, 2, "text/plain", 3, "x y x"), (6, 0, "b", 1, 2, "text/plain", 0, None), (7, 0, "c", 1, 2, "text/plain", 20 << 20, None)], "doc_id long, parent_id long, name string, mtime long, ctime long, mime string, size long, text string"))
    got = {(r.doc_id, r.field, r.term): r.positions for r in full.postings.where("origin = 'content'").collect()}
    assert got == {
        (5, "content", "x"): [10000, 10002], (5, "content", "y"): [10001], (5, "mimetype", "text/plain"): [], (5, "type", "document"): [], (5, "type", "text"): [], (6, "mimetype", "application/x-zerosize"): [],
        (7, "mimetype", "text/plain"): [], (7, "type", "document"): [], (7, "type", "text"): [],
    }
    assert full.queue.collect() == []


def test_placed_words(spark):
    one = spark.range(1).select(text.placed(F.array(*[F.struct(F.lit(f).alias("field"), F.array(*map(F.lit, w)).cast("array<string>").alias("words")) for f, w in (("a", "xy"), ("b", "z"), ("a", ""), ("c", "uvw"))]), 7).alias("p")).first().p
    assert [tuple(r) for r in one] == [("a", "x", 7), ("a", "y", 8), ("b", "z", None), ("c", "u", 11), ("c", "v", 12), ("c", "w", 13)]


def test_property_json(spark):
    df = spark.createDataFrame([(1, "a", "x\"y", 1), (1, "b", "2", 2), (1, "b", "1", 3), (2, "a", None, 1)], "id long, k string, v string, o int")
    got = {r.id: json.loads(r.j) for r in df.groupBy("id").agg(encode.property_json(F.col("k"), F.col("v"), F.col("o")).alias("j")).collect()}
    assert got == {1: {"a": 'x"y', "b": ["2", "1"]}, 2: {"a": None}}
    numbers = df.groupBy("id").agg(encode.property_json(F.lit("n"), F.col("o").cast("double"), F.col("o")).alias("j")).collect()
    assert {r.id: r.j for r in numbers} == {1: '{"n":[1.0,2.0,3.0]}', 2: '{"n":1.0}'}


def test_store(spark, tmp_path, files):
    path, i = str(tmp_path / "i"), generate.index_of(files)
    store.create(i, path, 8)
    assert state(store.load(spark, path)) == state(i)
    before = {f: os.stat(f).st_mtime_ns for d, _, names in os.walk(path) for f in (os.path.join(d, n) for n in names) if f.endswith(".parquet")}
    gone = files.where("doc_id in (3, 4)").select("doc_id")
    touched = {f"bucket={r.b}" for r in gone.select(store.bucket(F.col("doc_id"), 8).alias("b")).collect()}
    store.rewrite(spark, path, gone, lambda part: maintain.remove(part, gone))
    assert state(store.load(spark, path)) == state(maintain.remove(i, gone))
    assert all((f in before and os.path.exists(f)) == (not any(b in f for b in touched)) for f in before if "bucket" in f)
    everything = files.select("doc_id")
    store.rewrite(spark, path, everything, lambda part: maintain.remove(part, everything))
    assert state(store.load(spark, path)) == []
    store.rewrite(spark, path, everything, lambda part: maintain.add(part, i))
    assert state(store.load(spark, path)) == state(i)
    spark.range(1).select(F.lit(99).alias("schema_version"), F.lit(8).alias("buckets")).write.mode("overwrite").parquet(f"{path}/layout")
    assert store.load(spark, path) is None


def test_large_buckets_are_written_in_pieces(spark, tmp_path):
    """However few the buckets, no task gets a whole one; each piece is in the order of (field, term)."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    i = index.empty(spark).with_(postings=spark.range(40_000).repartition(16).select(F.lit("content").alias("field"), F.sha2(F.col("id").cast("string"), 256).alias("term"), "id", F.lit("content").alias("origin"), F.array(F.lit(1)).alias("positions")).withColumnRenamed("id", "doc_id"))
    before = spark.conf.get(size)
    spark.conf.set(size, "200k")
    try:
        store.create(i, str(tmp_path / "i"), 2)
    finally:
        spark.conf.set(size, before)
    for bucket in ("bucket=0", "bucket=1"):
        pieces = sorted((tmp_path / "i" / "postings" / bucket).glob("*.parquet"))
        assert len(pieces) > 3
        terms = [[r.term for r in spark.read.parquet(str(p)).collect() if r.term is not None] for p in pieces]
        assert all(t == sorted(t) and len(t) < 10_000 for t in terms)
    kept = store.load(spark, str(tmp_path / "i")).postings
    assert kept.count() == 40_000 and kept.exceptAll(i.postings).isEmpty()


def test_prefixes_reach_the_kept_postings(spark, tmp_path, files):
    store.create(generate.index_of(files), str(tmp_path / "i"), 2)
    plan = index.starts_with(store.load(spark, str(tmp_path / "i")).postings, "filename", "fi")._jdf.queryExecution().toString()
    assert "StringStartsWith(" in plan.split("PushedFilters")[-1] and "EqualTo(field,filename)" in plan


def test_jobs_twice(spark, tmp_path, files):
    """Carrying the same jobs out again changes nothing; an unknown path and a removed folder are no trouble."""
    path = str(tmp_path / "i")
    store.create(generate.index_of(files), path, 4)
    now = rows(spark, (1, 100, "file 1.txt", "/home/file 1.txt", 99, 21, None, 0, None), (50, 100, "new", "/home/new", 5, 6, ["n"], 5, None))
    jobs = spark.createDataFrame([("/home/file 1.txt", "modified"), ("/home/new", "new"), ("/home/file 2.txt", "remove"), ("/nowhere", "remove"), ("/home/none", "modified")], "path string, job string")
    upkeep.apply(spark, path, jobs, now)
    once = state(store.load(spark, path))
    kept = store.load(spark, path)
    assert {r.doc_id for r in kept.files.collect()} == {100, 50, *range(1, 21)} - {2} and kept.times.where("doc_id = 1").first().mtime == 99
    upkeep.apply(spark, path, jobs, now)
    assert state(store.load(spark, path)) == once
    upkeep.apply(spark, path, spark.createDataFrame([("/home", "remove")], "path string, job string"), now.limit(0))
    assert state(store.load(spark, path)) == []


def test_stream_keeps_the_index(spark, tmp_path, files):
    """Events arrive as JSON files; each batch of jobs goes into the kept index, which is searched in between."""
    path, inbox = str(tmp_path / "i"), tmp_path / "in"
    inbox.mkdir()
    store.create(generate.index_of(files), path, 4)
    there = {"/home/late.txt": (60, 100, "late.txt", "/home/late.txt", 7, 8, ["fresh"], 0, None), "/home/file 5.txt": (5, 100, "file 5.txt", "/home/file 5.txt", 15, 400, ["fresh"], 0, None)}
    describe = lambda paths: rows(spark, *there.values()).join(paths, "path", "left_semi")
    stream = upkeep.follow(spark, path, changes.event_stream(spark, str(inbox)), describe, str(tmp_path / "c"), "1 second")

    def send(n, *events):
        (tmp_path / "part").write_text("".join(json.dumps({"path": p, "ts": "2024-01-01T00:00:00", "kind": k}) + "\n" for p, k in events))
        os.rename(tmp_path / "part", inbox / f"{n}.json")
        stream.processAllAvailable()

    def search(q):
        i = store.load(spark, path)
        return {r.doc_id for r in Query(q, order="id").ids(Catalog(i.postings, i.times)).collect()}

    try:
        assert search("tag=fresh") == set() and search("filename:late") == set()
        send(1, ("/home/late.txt", "created"), ("/home/late.txt", "closed"))
        assert search("tag=fresh") == {60} and search('filename="late txt"') == {60}
        send(2, ("/home/file 5.txt", "attributes"), ("/home/file 6.txt", "deleted"))
        assert search("tag=fresh") == {5, 60} and 6 not in search("filename:file")
    finally:
        stream.stop()


def test_foreground(spark, files):
    i = generate.index_of(files.where("doc_id <> 7")).with_(queue=spark.createDataFrame([(1,)], "doc_id long"), data=spark.createDataFrame([(2, "{}")], "doc_id long, data string"))
    new = generate.index_of(rows(spark, *[(d, 100, f"now {d}", f"/home/now {d}", 0, 0, None, 0, None) for d in (1, 2, 3, 7)]))
    after = maintain.index_now(i, new)
    assert {r.doc_id for r in after.files.where("name like 'now%'").collect()} == {3, 7} and {r.doc_id for r in after.queue.collect()} == {1, 7}
    wanted = spark.createDataFrame([("/a", 3), ("/home/file 4.txt", None), ("/b", None)], "path string, found_id long")
    assert {r.path: r.doc_id for r in maintain.to_clear(i, wanted).collect()} == {"/a": 3, "/home/file 4.txt": 4, "/b": None}
    assert {r.doc_id for r in maintain.clear(i, wanted).files.collect()} == {100, *range(1, 21)} - {3, 4, 7}


def test_first_load_and_rescan(spark, files):
    part = files.where("doc_id <= 5")
    one = upkeep.first_load(index.empty(spark), [part, part.unionByName(part), files])
    assert state(one) == state(generate.index_of(files))
    moved = files.where("doc_id = 3").withColumns({"path": F.lit("/home/other.md"), "name": F.lit("other.md"), "ctime": F.lit(999).cast("long")})
    after = upkeep.rescan(one, moved.unionByName(files.where("doc_id = 4")))
    assert after.files.where("doc_id = 3").first().name == "other.md" and {r.term for r in after.postings.where("doc_id = 3 and origin = 'filename'").collect()} == {"other", "md"}
    assert [x for x in state(after) if "doc_id=3," not in x] == [x for x in state(one) if "doc_id=3," not in x]


def test_nth_of_a_name(spark):
    named = spark.createDataFrame([(4, "b"), (1, "a"), (3, "a"), (2, "a")], "doc_id long, name string")
    pick = lambda name, n: [r.doc_id for r in results.nth_named(named, name, n, F.col("doc_id")).collect()]
    assert pick("a", 0) == [1] and pick("a", 2) == [3] and pick("a", 9) == [3] and pick("c", 0) == []
    postings = spark.createDataFrame([("tag", "t", d, []) for d in (1, 2, 3)] + [("filename", "a", d, []) for d in (1, 2, 3)], "field string, term string, doc_id long, positions array<int>")
    paths = spark.createDataFrame([(d, f"/{d}/a") for d in (1, 2, 3)], "doc_id long, path string")
    assert [r.path for r in TagFolder("t", "a", 1).file(Catalog(postings, paths=paths)).collect()] == ["/2/a"]


def test_stale_with_devices(spark):
    paths = spark.createDataFrame([((i << 32) | (i % 3), f"/{i}") for i in range(1, 8)], "doc_id long, path string")
    report = maintain.stale_report(paths, paths.where("path in ('/1', '/2')"), [0], paths.where("path = '/4'"))
    assert {r.path: r.action for r in report.collect()} == {"/3": "ignored", "/4": "ignored", "/5": "removed", "/6": "ignored", "/7": "removed"}
