"""Sets of documents: all of, any of, phrases (inventory J1, J2, U1-U3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BITS = 62


def all_of(sets: list[DataFrame | None]) -> DataFrame | None:
    """Documents in every set; none at all if a set is missing."""
    if not sets or any(s is None for s in sets):
        return None
    return reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), sets)


def any_of(sets: list[DataFrame | None]) -> DataFrame | None:
    """Documents in some set; missing sets are passed over."""
    there = [s for s in sets if s is not None]
    return reduce(lambda a, b: a.unionByName(b), there).distinct() if there else None


def by_conditions(rows: DataFrame, leaves: dict[str, Column], keep: Column) -> DataFrame:
    """One pass over postings for a whole AND/OR tree: ``leaves`` are flags of a posting, ``keep`` combines a document's flags.

    Only postings that meet a leaf are shuffled, and partial aggregation leaves one row a document and task.
    """
    some = reduce(lambda a, b: a | b, leaves.values())
    flags = rows.where(some).groupBy("doc_id").agg(*[F.bool_or(c).alias(name) for name, c in leaves.items()])
    return flags.where(keep).select("doc_id")


def phrase(tokens: DataFrame, field: str, words: list[str]) -> DataFrame:
    """Documents with the words at consecutive positions; ``tokens`` is (doc_id, field, term, pos).

    Tokens move back by their place in the phrase, so a hit is one (document, position) with all places. Places are bits, 62 to a number.
    Only the phrase's own words are shuffled, once: hits and documents stay where their document is.
    """
    if len(words) == 1:
        return tokens.where((F.col("field") == field) & (F.col("term") == words[0])).select("doc_id").distinct()
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    of = F.element_at(F.create_map(*[x for w, own in places.items() for x in (F.lit(w), F.array(*map(F.lit, own)))]), F.col("term"))
    placed = tokens.where((F.col("field") == field) & F.col("term").isin(list(places))).select("doc_id", "pos", F.explode(of).alias("place")).repartition("doc_id")
    full = range(0, len(words), BITS)
    bits = [F.bit_or(F.when(F.floor(F.col("place") / BITS) == n // BITS, F.expr(f"shiftleft(1L, place % {BITS})"))).alias(f"bits{n}") for n in full]
    hits = placed.groupBy("doc_id", (F.col("pos") - F.col("place")).alias("at")).agg(*bits)
    found = reduce(lambda a, b: a & b, [F.col(f"bits{n}") == (1 << min(BITS, len(words) - n)) - 1 for n in full])
    return hits.where(found).select("doc_id").distinct()


def exploded(postings: DataFrame) -> DataFrame:
    """Postings with positions as tokens."""
    return postings.select("doc_id", "field", "term", F.explode("positions").alias("pos"))


def inserted(ids: Column, doc_id: Column) -> Column:
    return F.array_sort(F.array_union(ids, F.array(doc_id)))


def removed(ids: Column, doc_id: Column) -> Column:
    return F.array_remove(ids, doc_id)
