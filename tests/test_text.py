import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seekframe.functions.text import is_valid, normalise, terms, tokenize, truncate

# Inputs and the sorted words they have.
WORDS = [
    ("The quick (\"brown\") 'fox' can't jump 32.3 feet, right? No-Wrong;xx.txt", ["32.3", "brown", "can't", "feet", "fox", "jump", "no", "quick", "right", "the", "txt", "wrong", "xx"]),
    ("你", ["你"]),
    ("hello world!你好世界貴方元気켐ㅇㄹ？☺", ["hello", "world", "☺", "你好世界貴方元気", "켐ᄋᄅ"]),
    ("_plant", ["plant"]),
    ("Hello_Howdy", ["hello", "howdy"]),
    ("Como está Kûg", ["como", "esta", "kug"]),
    ("jo@fields.example", ["example", "fields", "jo"]),
    ("Teddy Bear 🧸", ["bear", "teddy", "🧸"]),
    ("maﬀab", ["maffab"]),
    ("𝐻𝑒𝑑𝑔𝑒", ["hedge"]),
    ("1230", ["1230"]),
    ("1230.0", ["1230.0"]),
    ("1230e0", ["1230e0"]),
    ("1.23e4", ["1.23e4"]),
    ("1,234", ["1,234"]),
    ("twelve,thirtyfour", ["thirtyfour", "twelve"]),
    ("word1\u0001word2", ["word1", "word2"]),
    ("file.png", ["file", "png"]),
    ("foo_bar.png", ["bar", "foo", "png"]),
    ("/foo/bar", ["bar", "foo"]),
    ("'one two", ["one", "two"]),
    ("one'two three", ["one'two", "three"]),
    ("one' two", ["one", "two"]),
    (" \ud83e  ", []),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize("text,expected", WORDS)
def test_words(text, expected):
    assert sorted(set(terms(text))) == sorted(expected)


def test_limits():
    assert truncate("a" * 40) == "a" * 25
    assert truncate("a" * 24 + "😀") == "a" * 24
    assert not is_valid("a\ud800") and is_valid("😀")
    assert normalise("ÀÉ") == "ae"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_terms_are_normal_and_short(text):
    for t in terms(text):
        assert t and len(t.encode("utf-16-le")) <= 50 and " " not in t


def test_characters_and_words_are_looked_up_once(monkeypatch):
    """A text of few characters asks Unicode's tables for each of them once, however long it is."""
    asked = []
    name = unicodedata.name
    monkeypatch.setattr("unicodedata.name", lambda *a: asked.append(a[0]) or name(*a))
    assert terms("Ǣǣ ǣ1,5 中文ア l'Ǣǣ " * 500) == ["ææ", "æ1,5", "中文ア", "l'ææ"] * 500 and len(asked) <= 20


def test_column_form(spark):
    rows = spark.createDataFrame([("Hello_Howdy",), (None,), ("",)], "t string").select(tokenize("t").alias("w")).collect()
    assert [r.w for r in rows] == [["hello", "howdy"], [], []]
