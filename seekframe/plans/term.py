"""Conditions of a search as values: leaves and AND/OR nodes, their JSON form and equality (inventory Q19, Q20, F6, F7, F11, F12)."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, replace
from datetime import date, datetime
from typing import Any

# Keys of the JSON form.
COMPARATORS = {"contains": "$ct", "greater": "$gt", "greater_equal": "$gte", "less": "$lt", "less_equal": "$lte"}
OPERATIONS = {"and": "$and", "or": "$or"}


@dataclass(frozen=True, eq=False, repr=False)
class Term:
    """A leaf has a property, comparator and value; a node has an operation and at least two children."""

    @property
    def is_empty(self) -> bool:
        return not self.property and self.value is None and not self.children

    property: str = ""
    value: Any = None
    comparator: str = "contains"
    operation: str | None = None
    children: tuple[Term, ...] = ()
    negated: bool = False

    def __invert__(self) -> Term:
        warnings.warn("a negation is kept but has no effect on results", stacklevel=2)
        return replace(self, negated=not self.negated)

    def __and__(self, other: Term) -> Term:
        return combine("and", self, other)

    def __or__(self, other: Term) -> Term:
        return combine("or", self, other)

    def __eq__(self, other: object) -> bool:
        """Children count in any order; properties without case."""
        return isinstance(other, Term) and self._key() == other._key()

    def __hash__(self) -> int:
        return hash(self._key())

    def _key(self):
        return (self.property.lower(), repr(self.value), self.comparator if not self.children else "", self.operation, tuple(sorted(map(repr, (c._key() for c in self.children)))), self.negated)

    def __repr__(self) -> str:
        if self.children:
            return "(" + f" {self.operation.upper()} ".join(map(repr, self.children)) + ")"
        return f"{'!' * self.negated}[{self.property} {self.comparator} {self.value!r}]"


EMPTY = Term()


def combine(operation: str, *terms: Term) -> Term:
    """One node; empty terms fall away, nodes of the same operation become part of it, a single term stays itself."""
    parts: list[Term] = []
    for t in terms:
        if not t.is_empty:
            parts += t.children if t.operation == operation and not t.negated else (t,)
    if len(parts) < 2:
        return parts[0] if parts else EMPTY
    return Term(comparator="auto", operation=operation, children=tuple(parts))


def to_json(term: Term) -> dict:
    if term.children:
        return {OPERATIONS[term.operation]: [to_json(c) for c in term.children]}
    value = term.value.isoformat() if isinstance(term.value, date | datetime) else term.value
    return {term.property: value if term.comparator == "equal" else {COMPARATORS[term.comparator]: value}}


def from_json(data: dict) -> Term:
    """A map of several properties is their AND."""
    found = []
    for key, value in data.items():
        operation = next((o for o, k in OPERATIONS.items() if k == key), None)
        if operation:
            found.append(combine(operation, *map(from_json, value)))
        elif isinstance(value, dict):
            sign, value = next(iter(value.items()))
            found.append(Term(key, moment(value), next(c for c, k in COMPARATORS.items() if k == sign)))
        else:
            found.append(Term(key, moment(value), "equal"))
    return combine("and", *found)


def moment(value: Any) -> Any:
    """A string in the form of a date or time as such; everything else as it is."""
    if isinstance(value, str) and re.fullmatch(r"\d{4}-\d\d-\d\d(T\d\d:\d\d(:\d\d)?)?", value):
        try:
            return datetime.fromisoformat(value) if "T" in value else date.fromisoformat(value)
        except ValueError:
            return value
    return value
