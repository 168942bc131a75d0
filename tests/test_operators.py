import time
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seekframe.functions import dates, encode
from seekframe.operators import config, index, maintain, match, results, tree
from seekframe.plans import virtual
from seekframe.sources import corpus, files
from seekframe.streaming import changes


def ids(df):
    return sorted(r.doc_id for r in df.collect())


@pytest.fixture(scope="module")
def rows(spark):
    data = {"f:fir": [1, 3, 5], "f:fire": [1, 8, 9], "f:fore": [2, 3, 5], "R:1": [1, 3, 5, 7], "R:2": [1, 8], "R:3": [2, 3, 5], "R:10": [10, 12], "R:x": [99]}
    return spark.createDataFrame([(k[0], k[2:], d) for k, v in data.items() for d in v], "field string, term string, doc_id long").cache()


def test_scans(rows):
    assert ids(index.equal(rows, "f", "fir")) == [1, 3, 5]
    assert ids(index.starts_with(rows, "f", "fi")) == [1, 3, 5, 8, 9]
    assert ids(index.matches(rows, "f", "f", ".re")) == [1, 2, 3, 5, 8, 9]
    assert ids(index.compare(rows, "R", "bigint", low=2)) == [1, 2, 3, 5, 8, 10, 12]
    assert ids(index.compare(rows, "R", "bigint", high=2)) == [1, 3, 5, 7, 8]
    assert [r.term for r in index.dictionary(rows, "f").orderBy("term").collect()] == ["fir", "fire", "fore"]
    with pytest.raises(ValueError):
        index.starts_with(rows, "f", "")


def test_times(spark):
    times = spark.createDataFrame([(1, 5), (2, 6), (3, 6), (4, 7), (5, 8), (6, 9)], "doc_id long, mtime long")
    assert ids(index.modified_between(times, 6, 8)) == [2, 3, 4, 5]
    assert ids(index.modified_between(times, 4, 4)) == [] == ids(index.modified_between(times, 10, 20))


def test_sets(spark):
    a, b, c = (spark.createDataFrame([(x,) for x in v], "doc_id long") for v in ([1, 3, 5, 7], [3, 4, 5, 7, 9, 11], [1, 3, 7]))
    assert ids(match.all_of([a, b, c])) == [3, 7] and match.all_of([a, None]) is None
    assert ids(match.any_of([a, None, b, c])) == [1, 3, 4, 5, 7, 9, 11]


def test_phrase(spark):
    t = spark.createDataFrame([(2, "x", "one", p) for p in (5, 9)] + [(2, "x", "two", p) for p in (6, 7)] + [(4, "x", "one", 3), (4, "x", "two", 9), (7, "x", "two", 2), (8, "x", "one", 1), (8, "x", "one", 2)], "doc_id long, field string, term string, pos int")
    assert ids(match.phrase(t, "x", ["one", "two"])) == [2]
    assert ids(match.phrase(t, "x", ["one", "one"])) == [8]


@pytest.fixture(scope="module")
def folders(spark):
    return spark.createDataFrame([(1, 0, "home"), (2, 1, "a"), (3, 2, "x"), (4, 1, "b"), (5, 99, "lost")], "doc_id long, parent_id long, name string").cache()


def test_tree(spark, folders):
    p = tree.paths(folders)
    assert {r.doc_id: r.path for r in p.collect()} == {1: "/home", 2: "/home/a", 3: "/home/a/x", 4: "/home/b", 5: ""}
    assert ids(tree.descendants(p, "/home/a")) == [2, 3] and ids(tree.id_of(p, "home//b/")) == [4] and ids(tree.children(folders, 1)) == [2, 4]
    assert {r.path for r in tree.paths(tree.move(folders, 2, 4, "z")).collect()} == {"/home", "/home/b", "/home/b/z", "/home/b/z/x", ""}
    assert ids(tree.remove_recursively(folders, p, "/home/a")) == [1, 4, 5]
    assert ids(tree.remove_where(folders, p, "/home/a", F.col("path") == "/home/a")) == [1, 2, 3, 4, 5]
    assert ids(tree.remove_where(folders, p, "/home/a", F.lit(True))) == [1, 4, 5]
    assert ids(tree.remove_where(folders, p, "/home", ~F.col("path").endswith("/x"))) == [1, 2, 3, 5]
    new = tree.add_paths(p, spark.createDataFrame([("/home/a/new/f",)], "path string"))
    assert {r.path for r in new.collect()} == {"/home/a/new", "/home/a/new/f"}


def test_deep_tree(spark):
    chain = spark.createDataFrame([(i, i - 1, "d") for i in range(1, 300)], "doc_id long, parent_id long, name string")
    assert tree.paths(chain).where("doc_id = 299").first().path == "/d" * 299


def test_tags(spark):
    tags = spark.createDataFrame([("a/b",), ("A/c/d",), ("x",)], "tag string")
    assert {r.section for r in tree.tag_children(tags).collect()} == {"A", "x"}
    assert {r.section for r in tree.tag_children(tags, "a").collect()} == {"b", "c"}
    one = spark.range(1).select(F.array(F.lit("a"), F.lit("a/b"), F.lit("ab")).alias("t"))
    assert one.select(maintain.rename_tag(F.col("t"), "a", "z").alias("t")).first().t == ["z", "z/b", "ab"]
    assert one.select(maintain.rename_tag(F.col("t"), "a", None).alias("t")).first().t == ["ab"]


def make(spark, docs, word):
    e = index.empty(spark)
    return e.with_(
        postings=spark.createDataFrame([("content", word, d, "content", [1]) for d in docs], e.postings.schema), files=spark.createDataFrame([(d, 0, f"f{d}") for d in docs], e.files.schema),
        times=spark.createDataFrame([(d, 1, 2) for d in docs], e.times.schema), data=spark.createDataFrame([(d, "{}") for d in docs], e.data.schema), queue=spark.createDataFrame([(d,) for d in docs], e.queue.schema),
    )


def state(i):
    return {n: sorted(str(sorted(r.asDict().items())) for r in f.collect()) for n, f in vars(i).items()}


def test_lifecycle(spark):
    one, two = make(spark, [1], "power"), make(spark, [2], "night")
    both = maintain.add(one, two)
    assert ids(both.files) == [1, 2] and state(maintain.remove(both, two.files)) == state(one)
    assert state(maintain.add(one, make(spark, [1], "other"))) == state(one)
    other = make(spark, [1], "other")
    assert state(maintain.replace(one, other, {"terms"}))["postings"] == state(other)["postings"]
    assert state(maintain.replace(one, other, {"times"})) == state(one)
    moves = spark.createDataFrame([(1, 2, 0, "moved"), (9, None, 0, "new")], "doc_id long, target_id long, parent_id long, name string")
    moved, unknown = maintain.move(both, moves, one.postings.limit(0))
    assert [(r.doc_id, r.name) for r in moved.files.collect()] == [(1, "moved")] and ids(unknown) == [9]
    assert index.totals(both).first().asDict() == {"documents": 2, "ids": 2, "queued": 2, "failed": 0}
    done = spark.createDataFrame([(1, "/f1", "succeeded"), (2, "/f2", "failed")], "doc_id long, path string, state string")
    settled = maintain.settle_content(both, done, make(spark, [1], "text").postings, make(spark, [1], "x").data)
    assert ids(settled.queue) == [] and ids(settled.failed) == [2] and {r.term for r in settled.postings.collect()} == {"text", "night"}


def test_commit_keeps_order(spark):
    base = spark.createDataFrame([("a", 1)], "term string, doc_id long")
    ops = spark.createDataFrame([("a", 1, "remove", 1), ("a", 1, "add", 2), ("b", 1, "add", 3), ("b", 1, "remove", 4)], "term string, doc_id long, op string, seq int")
    assert [tuple(r) for r in maintain.commit(base, ops).collect()] == [("a", 1)]


def test_config(spark):
    paths = ["/home", "/home/d1", "/home/d1/build/x", "/home/d1/fooXar", "/home/d2/a", "/home/d2/keep/b", "/home/.h/c", "/other"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.ok for r in df.select("path", config.included(F.col("path"), {"/home": True, "/home/d2": False, "/home/d2/keep": True}, ["build", "foo?ar"]).alias("ok")).collect()}
    assert [p for p in paths if got[p]] == ["/home", "/home/d1", "/home/d2/keep/b"]
    assert config.normalised_folders({"/a": True, "/a/b": True, "/c": False, "/a/x": False}) == [("/a/x/", False), ("/a/", True)]
    assert config.can_be_searched("/", {"/a": True}) and not config.can_be_searched("/b", {"/a": True})


def test_encode(spark):
    row = spark.range(1).select(
        encode.kinds(F.lit("application/vnd.ms-excel")).alias("a"), encode.kinds(F.lit("text/plain"), F.lit(0)).alias("b"), encode.kinds(F.lit("x"), is_dir=F.lit(True)).alias("c"),
        encode.hex_id(encode.pack_id(F.lit(7), F.lit(5))).alias("d"), encode.term_class(F.lit("X12-ab")).alias("e"), encode.term_class(F.lit("Xab")).alias("f"), encode.property_values(F.lit('{"1":["a","b"],"2":3.5}')).alias("g"),
    ).first()
    assert row.a == ["document", "spreadsheet"] and row.b == [] and row.c == ["folder"] and row.d == "500000007"
    assert tuple(row.e) == ("property", 12, "ab") and row.f.kind == "malformed" and row.g == {"1": ["a", "b"], "2": ["3.5"]}


def test_dates():
    assert dates.period(2024) == (date(2024, 1, 1), date(2024, 12, 31)) and dates.period(2024, 2) == (date(2024, 2, 1), date(2024, 2, 29))
    assert dates.period(2024, 13, 1) == dates.period(2024) and dates.period(2023, 2, 30) == dates.period(2023, 2)
    assert virtual.timeline("timeline:/today?relDays=-1", date(2024, 3, 1)) == virtual.Timeline("day", date(2024, 2, 29), "")
    assert virtual.timeline("timeline:/calendar//2024-03/", date(2024, 1, 1)) == virtual.Timeline("month", date(2024, 3, 1))
    assert virtual.timeline("timeline:/2024-13", date(2024, 1, 1)).kind == "none" and virtual.timeline("timeline:/calendar/", date(2024, 1, 1)).kind == "calendar"
    assert virtual.timeline("timeline:/2024-03-05/a.txt", date(2024, 1, 1)) == virtual.Timeline("day", date(2024, 3, 5), "a.txt")
    assert virtual.shifted(date(2024, 1, 31), {"relMonths": "1"}) == date(2024, 2, 29)
    assert virtual.tag_folder("tags:/a/b", {"A/b/c"}) == virtual.TagFolder("a/b") and virtual.tag_folder("tags:/a/x.txt (2)", {"a"}) == virtual.TagFolder("a", "x.txt", 2)


def test_results(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "doc_id long, name string")
    assert [r.shown for r in results.numbered_names(rows, F.col("doc_id")).orderBy("doc_id").collect()] == ["a", "a (1)", "b", "a (2)"]


def test_extraction(spark):
    rows = spark.createDataFrame([(1, "text/plain", bytearray(b"abc")), (2, "text/html", bytearray(b"<p>hi <b>you</b><script>x</script></p>")), (3, "text/plain", bytearray(b"\xff")), (4, "image/png", bytearray(b""))], "doc_id long, mime string, content binary")
    got = {r.doc_id: (r.text.split() if r.text else None, r.status) for r in files.extract(rows).collect()}
    assert got == {1: (["abc"], "succeeded"), 2: (["hi", "you"], "succeeded"), 3: (None, "failed"), 4: (None, "failed")}


def test_scan(spark, tmp_path):
    for folder, name in (("d", "a b.txt"), ("d", "x.bak"), ("d/e", "f"), (".h", "g"), ("d/build", "o")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text("hello")
    at = lambda rows: {(r.path.removeprefix(str(tmp_path)), r.is_dir, r.size) for r in rows.collect()}
    assert at(files.scan(spark, str(tmp_path), ["*.bak", "build"])) == {("", True, 0), ("/d", True, 0), ("/d/e", True, 0), ("/d/a b.txt", False, 5), ("/d/e/f", False, 5)}
    assert at(files.scan(spark, str(tmp_path), ["d"])) == {("", True, 0)}
    assert at(files.scan(spark, str(tmp_path), dirs_only=True)) == {("", True, 0), ("/d", True, 0), ("/d/e", True, 0), ("/d/build", True, 0)}
    rows = files.scan(spark, str(tmp_path)).collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.ctime == r.mtime for r in rows)


def test_debounce(spark):
    ev = spark.createDataFrame([("p", s) for s in (0.0, 1.0, 2.0, 3.0)] + [("q", 0.0), ("q", 200.0)], "path string, seconds double")
    got = sorted(map(tuple, changes.debounce_replay(ev).collect()))
    # held until 6, then twice what remains: 2 + 8 = 10, then 3 + 14 = 17
    assert got == [("p", 0.0, "at once"), ("p", 17.0, "delayed"), ("q", 0.0, "at once"), ("q", 200.0, "at once")]


def test_rename_stream_and_flags(spark, tmp_path):
    rows = pd.DataFrame({"path": ["/a", "/b", "/c", "/d"], "ts": pd.to_datetime(["2024-01-01 00:00:00.0", "2024-01-01 00:00:00.5", "2024-01-01 00:00:01.0", "2024-01-01 00:00:30.0"]), "kind": ["moved_from", "moved_to", "moved_from", "moved_to"], "cookie": [1, 1, 2, 3]})
    df = spark.createDataFrame(rows)
    assert {(r.kind, r.path, r.target) for r in changes.renames(df).collect()} == {("renamed", "/a", "/b"), ("deleted", "/c", None), ("created", "/d", None)}
    df.write.parquet(str(tmp_path / "in"))
    stream = changes.renames(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("ren").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert ("renamed", "/a", "/b") in {tuple(r) for r in spark.table("ren").collect()}


def test_maintain_stream(spark, tmp_path):
    df = spark.createDataFrame(pd.DataFrame({"path": ["/a", "/a", "/b"], "ts": pd.to_datetime(["2024-01-01"] * 3), "kind": ["created", "closed", "attributes"]}))
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    q = changes.maintain(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), lambda rows, n: seen.extend((r.path, r.job) for r in rows.collect()), str(tmp_path / "c"), "1 second")
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [("/a", "new"), ("/b", "attributes")]


def test_debounce_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"path": "/a", "kind": "created"}\n{"path": "/a", "kind": "closed"}\n{"path": "/b", "kind": "created"}\n')
    stream = changes.debounce(changes.event_stream(spark, str(tmp_path / "in")).select("path", "ts"))
    q = stream.writeStream.format("memory").queryName("deb").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    until = time.time() + 90
    while time.time() < until and spark.table("deb").count() < 3:
        time.sleep(1)
    q.stop()
    assert sorted((r.path, r.how) for r in spark.table("deb").collect()) == [("/a", "at once"), ("/a", "delayed"), ("/b", "at once")]


def test_deleted_folders_at_any_depth(spark):
    """Paths and deletions at all depths, odd ones too, against every prefix of every path; no row for each path of the folders above it."""
    names = ["/a", "/a/b", "/a/b/c", "/a/b/c/d", "/ab", "/ab/c", "a/b/c", "a/b", "a", "/", "//x", "", None]
    above = lambda p: {"/".join(p.split("/")[:n]) for n in range(2, max(2, len(p.split("/"))) + 1)} if p is not None else set()
    rows = spark.createDataFrame([(p,) for p in names * 2], "path string")
    for gone in (["/a/b"], ["/a"], ["a/b"], ["a"], ["/"], ["/ab", "/a/b/c", None], [""], []):
        got = changes.pruned(rows, spark.createDataFrame([(p,) for p in gone], "path string"))
        assert sorted(map(str, (r.path for r in got.collect()))) == sorted(str(p) for p in names * 2 if not above(p) & {g for g in gone if g is not None})
    events = [(p, t, k) for p in names for t, k in ((1, "modified"), (3, "modified"), (None, "modified"), (2, None))] + [("/a/b", 2, "deleted"), ("/a", 1, "deleted"), ("a", 9, "deleted"), (None, 9, "deleted")]
    last = {"/a/b": 2, "/a": 1, "a": 9}
    want = [e for e in events if not (e[0] is not None and e[1] is not None and e[2] == "modified" and any(e[1] <= last.get(x, 0) for x in above(e[0])))]
    got = changes.without_deleted(spark.createDataFrame(events, "path string, ts int, kind string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    many = spark.range(5000).selectExpr("concat('/user/', id % 5, '/', id) AS path")
    assert changes._above(many).count() == 10


def test_one_direction_lacks(spark):
    """Repeated rows, and nulls, which equal nothing; both directions meet in one aggregation, without sorts."""
    make = lambda rows: spark.createDataFrame(rows, "term string, doc_id long")
    found = maintain.only_left(make([("a", 1), ("a", 1), ("b", 1), (None, 1), ("c", None)]), make([("b", 1), ("b", 1), (None, 1), ("c", None), ("d", 2)]))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [("a", 1), (None, 1), ("c", None)]))
    assert "Join" not in found._jdf.queryExecution().toString()


def test_terms_are_the_different_tokens(spark):
    """Equal to tokens without repetitions, one row each; signs that become ASCII only in lower case are no letters."""
    texts = [(1, "The the THE \u212aelvin \u0130x K" + "A" * 30 + " k" + "a" * 24), (2, None), (3, ""), (4, "a A b")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("name", F.lit("Doc_1.doc"))
    rows = [tuple(r) for r in corpus.terms(docs).collect()]
    assert set(rows) == {tuple(r) for r in corpus.tokens(docs).select("doc_id", "field", "term").collect()}
    assert len(rows) == len(set(rows)) and {r[2] for r in rows if r[:2] == (1, "content")} == {"the", "elvin", "x", "k" + "a" * 24}


def test_inverted_lists_in_segments(spark):
    rows = spark.range(0, 20_000, 2).selectExpr("id AS doc_id", "'text' AS field", "'a' AS term")
    lists = index.inverted_lists(rows.union(rows)).collect()
    assert max(len(r.doc_ids) for r in lists) <= 4096 and sorted(d for r in lists for d in r.doc_ids) == list(range(0, 20_000, 2))
