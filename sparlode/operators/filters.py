"""Filters on documents: equality at a path, and conjunctions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.json import INDEXED_PATHS, MISSING, canonical, get_path, json_path


@dataclass(frozen=True)
class Eq:
    """Whole-value equality that minds JSON types. A missing path never matches; JSON null matches None."""

    path: str
    value: Any


@dataclass(frozen=True)
class And:
    filters: tuple

    def __init__(self, *filters):
        object.__setattr__(self, "filters", tuple(filters))


@dataclass
class Plan:
    """native: what Catalyst sees; residual: what needs the document parsed. None: nothing of that kind."""

    native: Column | None
    residual: Column | None

    @property
    def fully_indexed(self) -> bool:
        return self.native is not None and self.residual is None

    @property
    def condition(self) -> Column:
        """The native part comes first, so that only rows that pass it are parsed."""
        parts = [c for c in (self.native, self.residual) if c is not None]
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _conjuncts(f) -> list[Eq]:
    return [f] if isinstance(f, Eq) else [e for x in f.filters for e in _conjuncts(x)]


def plan(f: Eq | And | None, document: str = "document", payload: str = "payload") -> Plan:
    native, residual = None, None
    for e in _conjuncts(f) if f is not None else []:
        if e.path in INDEXED_PATHS:
            c = F.col(payload)[e.path] == F.lit(canonical(e.value))
            native = c if native is None else native & c
        else:
            c = json_path(F.col(document), e.path) == F.lit(canonical(e.value))
            residual = c if residual is None else residual & c
    return Plan(native, residual)


def matches(f: Eq | And | None, document: Any) -> bool:
    """The same for one parsed document."""
    return all((v := get_path(document, e.path)) is not MISSING and canonical(v) == canonical(e.value) for e in (_conjuncts(f) if f is not None else []))
