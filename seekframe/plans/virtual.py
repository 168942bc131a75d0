"""Virtual folders: times and tags as paths (inventory F4, F5, F10, J12)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date
from typing import NamedTuple
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import results
from .compile import Catalog
from .query import Query
from .term import Term

MODIFIERS = ("relYears", "relMonths", "relWeeks", "relDays")


class Timeline(NamedTuple):
    """kind: root, calendar, month (its days), day (its files), or none."""

    kind: str
    day: date | None = None
    name: str = ""


def canonical(path: str) -> str:
    """One slash in front, single ones between, none at the end."""
    return "/" + "/".join(p for p in path.split("/") if p)


def shifted(day: date, modifiers: dict[str, str]) -> date:
    """Years, months, weeks and days added in that order; a day past the month's end is its last."""

    def months(d: date, n: int) -> date:
        year, month = divmod(d.year * 12 + d.month - 1 + n, 12)
        last = (date(year + (month + 1) // 12, (month + 1) % 12 + 1, 1) - date.resolution).day
        return date(year, month + 1, min(d.day, last))

    n = {k: int(v) for k, v in modifiers.items() if k in MODIFIERS and re.fullmatch(r"-?\d+", v)}
    day = months(months(day, 12 * n.get("relYears", 0)), n.get("relMonths", 0))
    return date.fromordinal(day.toordinal() + 7 * n.get("relWeeks", 0) + n.get("relDays", 0))


def timeline(url: str, today: date) -> Timeline:
    """``/``, ``/calendar``, ``/today``, ``/yesterday``, ``/2024-03``, ``/2024-03-05[/file]`` with date modifiers."""
    parts = urlsplit(url)
    path = canonical(parts.path)
    if path == "/":
        return Timeline("root")
    if path == "/calendar":
        return Timeline("calendar")
    name = path.rpartition("/")[2]
    for word, back in (("today", 0), ("yesterday", 1)):
        if path.startswith(f"/{word}"):
            return Timeline("day", date.fromordinal(shifted(today, dict(parse_qsl(parts.query))).toordinal() - back), name if path.count("/") > 1 else "")
    if m := re.fullmatch(r"(?:/calendar)?/(\d{4})-(\d{1,2})", path):
        return Timeline("month", date(int(m[1]), int(m[2]), 1)) if 1 <= int(m[2]) <= 12 else Timeline("none")
    if m := re.fullmatch(r"(?:/calendar)?(?:/\d{4}-\d{1,2})?/(\d{4})-(\d{1,2})-(\d{1,2})(?:/([^/]+))?", path):
        try:
            return Timeline("day", date(*map(int, m.groups()[:3])), m[4] or "")
        except ValueError:
            return Timeline("none")
    return Timeline("none")


@dataclass(frozen=True)
class TagFolder:
    """A tag with the tags below it, or the n-th file of a name in it."""

    tag: str
    file_name: str = ""
    repeat: int = 0

    def query(self) -> Query:
        """Documents with the tag, and the name if there is one."""
        term = Term("tag", self.tag, "equal")
        return Query(term=term & Term("filename", self.file_name, "equal") if self.file_name else term, order="id")


    def file(self, catalog: Catalog) -> DataFrame:
        """(doc_id, path) of the file that the folder's entry stands for: the n-th of its name, or the last if there are fewer."""
        found = self.query().run(catalog).withColumn("name", F.lit(self.file_name))
        return results.nth_named(found, self.file_name, self.repeat, F.col("doc_id")).select("doc_id", "path")


def tag_folder(url: str, tags: set[str]) -> TagFolder:
    """``/a/b`` is the tag ``a/b`` if that is or leads to a tag, else the file ``b`` of tag ``a``; ``b (2)`` is the second repeat."""
    path = canonical(urlsplit(url).path).strip("/")
    low = {t.lower() for t in tags}
    if not path or any(t == path.lower() or t.startswith(path.lower() + "/") for t in low):
        return TagFolder(path)
    tag, _, name = path.rpartition("/")
    m = re.fullmatch(r"(.*) \((\d+)\)", name)
    return TagFolder(tag, m[1], int(m[2])) if m else TagFolder(tag, name)
