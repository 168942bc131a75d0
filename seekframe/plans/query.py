"""A query: search string or term, filters, order and slice; its JSON and URL forms (inventory Q29, S1-S4, F8, F9)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace
from urllib.parse import parse_qsl, quote, urlencode, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import results
from .compile import Catalog, compile
from .search import parse
from .term import EMPTY, Term, combine, from_json, to_json

SCHEME = "filesearch"
# Folders that stand for a kind of file.
PRESETS = {"documents": "Document", "images": "Image", "audio": "Audio", "videos": "Video"}
ORDERS = {"auto": "newest", "time": "newest", "none": "id"}


@dataclass(frozen=True)
class Query:
    search: str = ""
    term: Term = EMPTY
    types: tuple[str, ...] = ()
    folder: str | None = None
    date: tuple[int, int, int] = (0, 0, 0)
    order: str = "newest"
    offset: int = 0
    limit: int = -1

    def with_type(self, names: str) -> Query:
        """One or several types, parted by slashes; all of them must hold."""
        return replace(self, types=self.types + tuple(n for n in names.split("/") if n))

    def with_search(self, text: str) -> Query:
        return replace(self, search=text, term=EMPTY)

    def with_order(self, name: str) -> Query:
        return replace(self, order=ORDERS[name])

    def condition(self) -> Term:
        """Search string (before a term), types, folder and date, all together."""
        parts = [parse(self.search) if self.search else self.term, *(Term("type", t, "equal") for t in self.types)]
        if self.folder:
            parts.append(Term("includefolder", self.folder, "equal"))
        if any(self.date):
            parts.append(Term("$date", self.date, "equal"))
        return combine("and", *parts)

    def ids(self, catalog: Catalog) -> DataFrame | None:
        return compile(catalog, self.condition())

    def run(self, catalog: Catalog) -> DataFrame:
        """(doc_id, path) in order; paths are looked up only for what order and slice leave."""
        found = self.ids(catalog)
        if found is None:
            found = catalog.postings.select("doc_id").limit(0)
        if self.order == "newest" and catalog.times is not None:
            rows = results.newest_first(found, catalog.times, self.offset, self.limit)
        else:
            rows = results.by_id(found, self.offset, self.limit)
        if catalog.paths is None:
            return rows.select("doc_id", F.lit(None).cast("string").alias("path"))
        joined = rows.join(catalog.paths, "doc_id", "left")
        order = [F.desc("mtime"), F.col("doc_id")] if "mtime" in rows.columns else [F.col("doc_id")]
        return joined.orderBy(*order).select("doc_id", "path")

    def stream(self, catalog: Catalog) -> Iterator[str]:
        """Paths one by one, a partition at a time."""
        yield from (row.path for row in self.run(catalog).toLocalIterator())

    # -- serial forms --------------------------------------------------------------

    def to_json(self) -> str:
        out: dict = {}
        if self.types:
            out["type"] = list(self.types)
        if self.limit >= 0:
            out["limit"] = self.limit
        if self.offset:
            out["offset"] = self.offset
        if self.search:
            out["searchString"] = self.search
        elif not self.term.is_empty:
            out["term"] = to_json(self.term)
        for key, value in zip(("yearFilter", "monthFilter", "dayFilter"), self.date, strict=True):
            if value > 0:
                out[key] = value
        if self.order != "newest":
            out["sortingOption"] = self.order
        if self.folder:
            out["includeFolder"] = self.folder
        return json.dumps(out, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Query:
        data = json.loads(text)
        types = data.get("type", [])
        return Query(
            data.get("searchString", ""), from_json(data.get("term", {})), tuple([types] if isinstance(types, str) else types), data.get("includeFolder"),
            (data.get("yearFilter", 0), data.get("monthFilter", 0), data.get("dayFilter", 0)), data.get("sortingOption", "newest"), data.get("offset", 0), data.get("limit", -1),
        )

    def to_url(self, title: str = "") -> str:
        values = {"json": self.to_json()} | ({"title": title} if title else {})
        return f"{SCHEME}:/?{urlencode(values, quote_via=quote)}"

    @staticmethod
    def from_url(url: str) -> Query:
        """``json=``, else ``query=``, else a folder that stands for a type."""
        parts = urlsplit(url)
        values = dict(parse_qsl(parts.query, keep_blank_values=True))
        if "json" in values:
            return Query.from_json(values["json"])
        if "query" in values:
            return Query(values["query"])
        kind = PRESETS.get(parts.path.strip("/"))
        return Query(types=(kind,)) if kind else Query()


def title_of(url: str) -> str:
    return dict(parse_qsl(urlsplit(url).query)).get("title", "")
