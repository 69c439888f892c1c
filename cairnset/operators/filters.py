"""Row filters: one conjunction [(column, operator, value), ...], a list of them (any may hold), a Column, or SQL."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "=": lambda c, v: c == v,
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    ">": lambda c, v: c > v,
    "<=": lambda c, v: c <= v,
    ">=": lambda c, v: c >= v,
}


def _one(column: str, operator: str, value: Any) -> Column:
    c = F.col(column)
    if operator in _COMPARE:
        return _COMPARE[operator](c, value)
    if operator not in ("in", "not in"):
        raise ValueError(f"unknown operator {operator!r}: {', '.join(_COMPARE)}, in, not in")
    if isinstance(value, str) or not hasattr(value, "__iter__"):
        raise ValueError(f"{operator} takes a collection of values")
    # null is a value like others here, unlike in SQL
    known = [v for v in value if v is not None]
    null = any(v is None for v in value)
    if operator == "in":
        return c.isin(known) | c.isNull() if null else c.isin(known)
    return ~c.isin(known) & c.isNotNull() if null else ~c.isin(known) | c.isNull()


def _all(terms: list[Column], join) -> Column:
    if not terms:
        raise ValueError("an empty filter")
    return reduce(join, terms)


def compile_filter(filters: Any) -> Column:
    if isinstance(filters, Column):
        return filters
    if isinstance(filters, str):
        return F.expr(filters)
    filters = list(filters)
    if filters and isinstance(filters[0], tuple):
        filters = [filters]
    return _all([_all([_one(*term) for term in terms], lambda a, b: a & b) for terms in filters], lambda a, b: a | b)
