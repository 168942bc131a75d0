"""Terms to DataFrames of document ids (inventory Q3-Q18).

Word, prefix and typed leaves are conditions on a posting; a tree of such leaves alone is one filtered pass
over the postings with one aggregation by document. Phrases, times and folders are sets of their own, joined by semi
joins and unions. What can have no result is dropped before Spark sees it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import period
from ..functions.text import terms
from ..operators import match, tree
from ..schema import FIELD_TYPES, PREFIX_BYTES, PROPERTY_PREFIX_BYTES
from .term import Term

KEY_BYTES = 25
LAST_SECOND = 2**32 - 1


@dataclass
class Catalog:
    """Where leaves are looked up. ``postings`` is (field, term, doc_id, positions); ``paths`` is (doc_id, path), folders included.

    ``tokens`` (doc_id, field, term, pos), where there are any, spare phrases the way through postings. Days are those of ``zone``, by default the session's.
    """

    postings: DataFrame
    times: DataFrame | None = None
    paths: DataFrame | None = None
    types: dict[str, str] = field(default_factory=dict)
    words: Callable[[str], list[str]] = terms
    strict: bool = False
    tokens: DataFrame | None = None
    zone: str | None = None

    @property
    def time_zone(self) -> ZoneInfo:
        return ZoneInfo(self.zone or self.postings.sparkSession.conf.get("spark.sql.session.timeZone"))


@dataclass
class Leaf:
    """A condition on a posting, or else a set of documents."""

    condition: Column | None = None
    rows: DataFrame | None = None


def prefix_bytes(name: str) -> int:
    return PREFIX_BYTES.get(name, PROPERTY_PREFIX_BYTES)


def _word(name: str, word: str, whole: bool) -> Column:
    """A word or the words that begin with it; keys hold 25 bytes, so longer ones can only be compared that far."""
    room = KEY_BYTES - prefix_bytes(name)
    raw = word.encode()
    here = F.col("field") == name
    if len(raw) > room:
        return here & F.encode("term", "UTF-8").startswith(F.lit(raw[:room]))
    return here & ((F.col("term") == word) if whole else F.col("term").startswith(word))


def _text(catalog: Catalog, name: str, value: str, whole: bool) -> Leaf | None:
    words = catalog.words(str(value))
    if not words:
        return None
    if len(words) > 1:
        cut = [w[:KEY_BYTES] for w in words]
        return Leaf(rows=match.phrase(catalog.tokens if catalog.tokens is not None else match.exploded(catalog.postings.where(F.col("term").isin(cut))), name, cut))
    return Leaf(_word(name, words[0], whole or prefix_bytes(name) + len(words[0].encode()) < 3))


def _bounds(comparator: str, value: float, strict: bool) -> tuple[float | None, float | None]:
    step = 1 if strict else 0
    return {"greater": (value + step, None), "greater_equal": (value, None), "less": (None, value - step), "less_equal": (None, value)}[comparator]


def _number(value, kind: type):
    try:
        return kind(value)
    except (TypeError, ValueError):
        return kind(0)


def _typed(catalog: Catalog, name: str, kind: str, comparator: str, value) -> Leaf | None:
    here = F.col("field") == name
    if kind == "string":
        return None
    if kind == "datetime":
        text = value.isoformat() if isinstance(value, date | datetime) else str(value)
        term, ok = F.col("term"), {"greater": ">", "greater_equal": ">=", "less": "<", "less_equal": "<="}[comparator]
        compare = {">": term > text, ">=": term >= text, "<": term < text, "<=": term <= text}
        return Leaf(here & compare[ok if catalog.strict else ok[0] + "="])
    number = _number(value, int if kind == "int" else float)
    low, high = _bounds(comparator, number, kind == "int")
    typed = F.col("term").try_cast("bigint" if kind == "int" else "double")
    if catalog.strict and kind == "double" and comparator in ("greater", "less"):
        return Leaf(here & (typed > number if comparator == "greater" else typed < number))
    return Leaf(here & (typed >= low if low is not None else typed <= high))


def _times(catalog: Catalog, begin: int, end: int) -> Leaf | None:
    if catalog.times is None or end < begin:
        return None
    return Leaf(rows=catalog.times.where(F.col("mtime").between(begin, end)).select("doc_id"))


def _seconds(value, zone: ZoneInfo) -> int:
    if isinstance(value, date) and not isinstance(value, datetime):
        value = datetime.combine(value, time())
    return int((value if value.tzinfo else value.replace(tzinfo=zone)).timestamp())


def _modified(catalog: Catalog, comparator: str, value) -> Leaf | None:
    """A string is a local day or time; ``:`` has no meaning here and finds nothing, unless strict, where it is equality."""
    if isinstance(value, date | datetime):
        return None if not catalog.strict else _modified(catalog, comparator, value.isoformat())
    if comparator == "contains":
        if not catalog.strict:
            return None
        comparator = "equal"
    try:
        when = datetime.fromisoformat(str(value))
    except ValueError:
        return None
    zone = catalog.time_zone
    at = _seconds(when, zone)
    first, last = _seconds(when.date(), zone), _seconds(when.date() + timedelta(1), zone) - 1
    ranges = {"equal": (first, last), "less_equal": (0, at), "less": (0, at - 1), "greater_equal": (at, LAST_SECOND), "greater": (at + 1, LAST_SECOND)}
    return _times(catalog, *ranges[comparator])


def leaf(catalog: Catalog, term: Term) -> list[Leaf | None]:
    """What a leaf can be met by; several for a bare word."""
    name, value = term.property.lower(), term.value
    whole = term.comparator == "equal"
    if name in ("type", "kind"):
        return [Leaf((F.col("field") == "type") & (F.col("term") == str(value).lower()))] if value else [None]
    if name == "includefolder":
        if catalog.paths is None or not str(value).startswith("/"):
            return [None]
        return [Leaf(rows=tree.descendants_of_known(catalog.paths, str(value)))]
    if name in ("modified", "mtime"):
        return [_modified(catalog, term.comparator, value)]
    if name == "$date":
        first, last = period(*value)
        zone = catalog.time_zone
        return [_times(catalog, _seconds(first, zone), _seconds(last + timedelta(1), zone) - 1)]
    if name == "tag":
        if whole:
            return [Leaf((F.col("field") == "tag") & (F.col("term") == str(value)))]
        return [_text(catalog, "tags", str(value), True)] if term.comparator == "contains" else [None]
    if not name:
        return [_text(catalog, n, str(value), whole) for n in ("content", "filename")]
    kind = catalog.types.get(name) or FIELD_TYPES.get(name)
    if kind is None:
        return [None]
    if term.comparator in ("equal", "contains"):
        if catalog.strict and kind == "datetime" and whole:
            return [Leaf((F.col("field") == name) & (F.col("term") == str(value)))]
        return [_text(catalog, name, str(value), whole or kind == "int")]
    return [_typed(catalog, name, kind, term.comparator, value)]


def compile(catalog: Catalog, term: Term) -> DataFrame | None:  # noqa: A001
    """Distinct (doc_id), or None where nothing can be found."""
    leaves: dict[str, Column] = {}

    def one_pass(t: Term) -> Column | None | bool:
        """The condition over a document's flags; None: no result; False: the tree needs sets too."""
        if t.children:
            parts = [one_pass(c) for c in t.children]
            if any(p is False for p in parts):
                return False
            if t.operation == "and" and any(p is None for p in parts):
                return None
            out = None
            for p in parts:
                if p is not None:
                    out = p if out is None else (out & p if t.operation == "and" else out | p)
            return out
        out = None
        for found in leaf(catalog, t):
            if found is None:
                continue
            if found.condition is None:
                return False
            name = f"leaf{len(leaves)}"
            leaves[name] = found.condition
            out = F.col(name) if out is None else out | F.col(name)
        return out

    keep = None if term.is_empty else one_pass(term)
    if keep is None:
        return None
    if keep is not False:
        return match.by_conditions(catalog.postings, leaves, keep)

    def sets(t: Term) -> DataFrame | None:
        if t.children:
            parts = [sets(c) for c in t.children]
            return match.all_of(parts) if t.operation == "and" else match.any_of(parts)
        found = [x for x in leaf(catalog, t) if x is not None]
        return match.any_of([x.rows if x.rows is not None else catalog.postings.where(x.condition).select("doc_id").distinct() for x in found])

    return sets(term)
