import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seekframe.functions.text import terms
from seekframe.operators import match
from seekframe.plans.compile import Catalog
from seekframe.plans.query import Query, title_of
from seekframe.plans.search import parse, pieces
from seekframe.plans.term import EMPTY, Term, combine, from_json, to_json


def t(prop, value, comparator="contains"):
    return Term(prop, value, comparator)


A, S, W = t("artist", "Coldplay"), t("type", "song"), t("", "stars")


@pytest.mark.parametrize(
    "text,expected",
    [
        ("artist:Coldplay", A),
        ("artist:Coldplay AND type:song", A & S),
        ("artist:Coldplay OR type:song", A | S),
        ("artist:Coldplay AND type:song OR stars", (A & S) | W),
        ("artist:Coldplay OR type:song AND stars", (A | S) & W),
        ("artist:Coldplay AND type:song AND stars", combine("and", A, S, W)),
        ("artist:Coldplay OR type:song OR stars", combine("or", A, S, W)),
        ("artist:Coldplay type:song stars", combine("and", A, S, W)),
        ("(artist:Coldplay OR type:song) stars", (A | S) & W),
        ("((stars", W),
        ("stars ))))", W),
        ("stars (", W),
        ('foo "', t("", "foo")),
        ("foo>", t("foo", "")),
        ("> 4", EMPTY),
        ("rating>4", t("rating", "4", "greater")),
        ("rating>=4", t("rating", "4", "greater_equal")),
        ("rating<4", t("rating", "4", "less")),
        ("rating<=4", t("rating", "4", "less_equal")),
        ("rating=4", t("rating", "4", "equal")),
        ('""', t("", "")),
        ('"foo""bar"', t("", "foo") & t("", "bar")),
        ('artist:"foo" OR artist:"bar"', t("artist", "foo") | t("artist", "bar")),
        ('artist:"" AND filename:""', t("artist", "") & t("filename", "")),
        ('one "two and three" four', combine("and", t("", "one"), t("", "two and three"), t("", "four"))),
        ("foo@bar.com", t("", "foo@bar.com")),
        ('a "AND" b', t("", "a") & t("", "b")),
    ],
)
def test_parse(text, expected):
    assert parse(text) == expected


def test_pieces():
    assert pieces('a:"b c" (d>=e)') == ["a", ":", "b c", "(", "d", ">=", "e", ")"]
    assert pieces('x"y z"w') == ["xy z", "w"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab ():="<>ANDOR', max_size=40))
def test_parse_never_fails(text):
    assert isinstance(parse(text), Term)


def test_json_and_url():
    term = (A & t("rating", 4, "greater")) | t("title", "x", "equal")
    assert from_json(to_json(term)) == term
    q = Query("a & b/ü%20", limit=3, offset=2, date=(2024, 5, 0), order="id").with_type("Audio/Video")
    assert Query.from_json(q.to_json()) == q
    assert Query.from_url(q.to_url("My title")) == q and title_of(q.to_url("My title")) == "My title"
    assert Query.from_url("filesearch:/documents") == Query(types=("Document",))
    assert Query.from_url("filesearch:/?query=a%20b").search == "a b"
    with pytest.warns(UserWarning):
        assert (~A).negated


# A corpus of nine files, and what searches find in it.
CONTENT = {
    1: "A small grey heron waded past the noisy mill", 7: "A small grey heron waded past the empty mill", 8: "One small grey heron slept beside an empty barge",
    2: "Winter came early and the river froze", 3: "Can't tell who painted this. Maybe neighbours did it", 4: "Only the ferry runs 17 days. noisy", 9: "Plain words with a lone dot . End here",
}
NAMES = {1: "note1.txt", 7: "note7_quiet", 8: "note8_barge", 2: "note2", 3: "note3", 4: "note4", 9: "note - for later.txt", 5: "tagged1", 6: "tagged2"}
TAGS = {5: ["Red", "Green", "Blue", "Late", "A1"], 6: ["Red", "Green-Blue", "Late", "A2"]}
SEARCHES = [
    ("noisy", {1, 4}), ("content:noisy", {1, 4}), ("content:mill", {1, 7}), ("filename:mill", set()), ("filename:bar", {8}), ("content:day", {4}), ("content=day", set()), ("content=days", {4}),
    ("content=can't", {3}), ("content=neighbours", {3}), ('content="past the"', {1, 7}), ('content="past the noisy mill"', {1}), ('content="past the mill"', set()),
    ("small AND noisy AND mill", {1}), ("small noisy mill", {1}), ('"small grey" mill', {1, 7}), ('"small grey" empty the mill', {7}), ('"small grey" content="the mill"', set()),
    ('"small grey" content:"\'the mill\'"', set()), ('"small grey" "the noisy mill"', {1}), ("content=days OR filename:bar", {4, 8}), ("painted who", {3}), ("past OR froze", {1, 2, 7}),
    ("tag:a1", {5}), ("tag:a2", {6}), ("tag:red", {5, 6}), ("tag:green", {5, 6}), ("tag:green AND tag:blue", {5, 6}), ("tag:green-blue", {6}), ("filename:later", {9}),
    ("note for later.txt", {9}), ("content:dot", {9}), ("note - for later.txt", set()), ("dot . End", set()), ('"dot . End"', {9}), ("rating>=3", {1, 2}), ("rating>3", {2}), ("rating=3", {1}),
    ("tag=Green-Blue", {6}), ("tag=green-blue", set()), ("unknown:x", set()), ("content>x", set()), ("modified:1970-01-01", set()), ("modified=1970-01-01", set(range(1, 10))), ("includefolder:relative", set()),
    ("(noisy OR froze) AND the", {1, 2, 4}),
]


@pytest.fixture(scope="module")
def nine(spark):
    rows = []

    def index(doc, field, text):
        words = terms(text)
        for w in dict.fromkeys(words):
            rows.append((field, w, doc, [i + 1 for i, x in enumerate(words) if x == w] if len(words) > 1 else []))

    for doc, text in CONTENT.items():
        index(doc, "content", text)
    for doc, name in NAMES.items():
        index(doc, "filename", name)
    for doc, tags in TAGS.items():
        for tag in tags:
            index(doc, "tags", tag)
            rows.append(("tag", tag, doc, []))
    rows += [("rating", "3", 1, []), ("rating", "5", 2, [])]
    postings = spark.createDataFrame(rows, "field string, term string, doc_id long, positions array<int>").cache()
    times = spark.createDataFrame([(d, 3 if d in TAGS else 1, 4) for d in NAMES], "doc_id long, mtime long, ctime long").cache()
    paths = spark.createDataFrame([(d, f"/home/{'b' if d > 5 else 'a'}/{n}") for d, n in NAMES.items()] + [(100, "/home"), (101, "/home/a"), (102, "/home/b")], "doc_id long, path string").cache()
    return Catalog(postings, times, paths)


@pytest.mark.parametrize("text,expected", SEARCHES)
def test_search(nine, text, expected):
    found = Query(text).ids(nine)
    assert (set() if found is None else {r.doc_id for r in found.collect()}) == expected


def test_order_and_slice(nine):
    rows = Query(limit=3, term=t("filename", "note") | t("tag", "red")).run(nine).collect()
    assert [r.doc_id for r in rows] == [5, 6, 1]
    assert [r.doc_id for r in Query("the", offset=1, limit=2, order="id").run(nine).collect()] == [2, 4]
    assert Query("the", offset=9).run(nine).collect() == [] and Query("the", limit=0).run(nine).collect() == []
    assert {r.doc_id for r in Query("grey", folder="/home/b").run(nine).collect()} == {7, 8}
    assert Query("grey", folder="/home/c").run(nine).collect() == [] and Query("grey", folder="/").run(nine).count() == 3
    assert list(Query("froze").stream(nine)) == ["/home/a/note2"]


def test_algebra(nine):
    ids = lambda q: {r.doc_id for r in (Query(q).ids(nine) or nine.postings.limit(0)).select("doc_id").collect()}
    for a, b in (("the", "mill"), ("small", "empty"), ("only", "content=noisy")):
        assert ids(f"{a} AND {b}") == ids(a) & ids(b) and ids(f"{a} OR {b}") == ids(a) | ids(b)
    assert ids('content="the noisy mill"') <= ids("content=the AND content=noisy AND content=mill")


def test_one_pass_for_words(nine):
    plan = Query("content:the AND (content:mill OR content:froze)").ids(nine)._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_long_words(nine, spark):
    word = "x" * 30
    rows = spark.createDataFrame([("content", word[:25], 1, [])], "field string, term string, doc_id long, positions array<int>")
    assert Query(f"content={word}").ids(Catalog(rows)).count() == 1


@pytest.mark.parametrize("n", [1, 2, 62, 63, 64, 65, 124, 125, 200])
def test_phrases_of_many_words(spark, n):
    """As many words as one likes, with a word that stands twice."""
    words = [f"w{i}" for i in range(n - 1)] + ["w0"]
    rows = [("content", w, 1, [i + 5]) for i, w in enumerate(words[:-1])] + [("content", "w0", 1, [n + 4])] + [("content", w, 2, [2 * i]) for i, w in enumerate(dict.fromkeys(words))]
    c = Catalog(spark.createDataFrame(rows, "field string, term string, doc_id long, positions array<int>"))
    assert {r.doc_id for r in Query(term=t("content", " ".join(words), "equal")).ids(c).collect()} == ({1, 2} if n == 1 else {1})


def test_phrase_moves_rows_once(spark):
    """From tokens, a phrase is one shuffle."""
    tokens = spark.createDataFrame([(1, "content", "a", 1), (1, "content", "b", 2)], "doc_id long, field string, term string, pos int")
    found = match.phrase(tokens, "content", ["a", "b"])
    found.collect()
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") in (1, 2)  # the final plan and the initial one
    assert found._jdf.queryExecution().sparkPlan().toString().count("RepartitionByExpression") <= 1


def test_days_are_those_of_the_zone(spark):
    times = spark.createDataFrame([(1, 1704412800 - 1), (2, 1704412800), (3, 1704430800 - 1), (4, 1704430800), (5, 1704517200 - 1), (6, 1704517200)], "doc_id long, mtime long")
    postings = spark.createDataFrame([], "field string, term string, doc_id long, positions array<int>")
    found = lambda **kw: {r.doc_id for r in Query("modified=2024-01-05").ids(Catalog(postings, times, **kw)).collect()}
    assert found() == {2, 3, 4} and found(zone="America/New_York") == {4, 5}
    assert {r.doc_id for r in Query(date=(2024, 1, 5)).ids(Catalog(postings, times, zone="America/New_York")).collect()} == {4, 5}
