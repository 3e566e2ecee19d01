"""Predicates over memories, as boolean columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def live(deleted: Column, superseded: Column, duplicate_of: Column, searchable: Column) -> Column:
    """Records that recall may return; an unknown ``searchable`` counts as true."""
    return deleted.isNull() & superseded.isNull() & duplicate_of.isNull() & ~searchable.eqNullSafe(F.lit(False))


def build(filters: dict) -> Column:
    """All of ``{"column": value}`` and ``{"column__op": value}``.

    Ops: eq, in, not_in, null, min, max, ilike, all_of, any_of.  A list means in.
    """
    escape = lambda x: x.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    ops = {
        "eq": lambda c, v: c.isin(v) if isinstance(v, list) else c == v,
        "in": lambda c, v: c.isin(v),
        "not_in": lambda c, v: ~c.isin(v),
        "null": lambda c, v: c.isNull() if v else c.isNotNull(),
        "min": lambda c, v: c >= v,
        "max": lambda c, v: c <= v,
        "ilike": lambda c, v: c.ilike(f"%{escape(v)}%"),
        "all_of": lambda c, v: F.size(F.array_except(F.array(*map(F.lit, v)), c)) == 0,
        "any_of": lambda c, v: F.arrays_overlap(c, F.array(*map(F.lit, v))),
    }
    parts = [ops[op or "eq"](F.col(name), v) for (name, _, op), v in ((k.partition("__"), v) for k, v in filters.items())]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def effective_time(observed: Column, created: Column) -> Column:
    return F.coalesce(observed, created)


def glob(path: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """``*`` within a segment, ``**`` across them, ``?`` for one character."""

    def matches(pattern: str) -> Column:
        out = "".join({"*": "[^/]*", "?": "[^/]", "\0": ".*"}.get(c, "\\" + c if not c.isalnum() else c) for c in pattern.replace("**", "\0"))
        return path.rlike(f"^{out}$")

    some = lambda patterns: reduce(lambda a, b: a | b, map(matches, patterns), F.lit(False))
    return (some(include) if include else F.lit(True)) & ~some(exclude)
