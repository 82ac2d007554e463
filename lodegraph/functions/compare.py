"""Predicates on typed columns, with the engine's rules for nulls and literals.

None stands for a predicate that nothing satisfies whatever the row holds.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
_OPS = {"lt": "__lt__", "le": "__le__", "gt": "__gt__", "ge": "__ge__", "eq": "__eq__"}


def literal(value, kind: str):
    """The literal a column of this kind is compared with; None if it has none."""
    if kind in NUMERIC or kind.startswith("decimal"):
        try:
            if isinstance(value, int) and not isinstance(value, bool):
                return value
            number = float(value)
        except (TypeError, ValueError):
            return None
        return None if number != number else number
    if kind in ("timestamp", "date", "timestamp_ntz"):
        return value if isinstance(value, (str, date, datetime)) else None
    return str(value)


def predicate(column: Column, kind: str, op: str, value) -> Column | None:
    """A comparison, two-valued: rows without a value satisfy ne only."""
    if op in ("contains", "contains_any"):
        needles = [value] if op == "contains" else list(value)
        text = F.lower(column.cast("string"))
        out = F.lit(False)
        for n in needles:
            out = out | F.contains(text, F.lit(str(n).lower()))
        return F.coalesce(out, F.lit(False))
    if op == "in":
        known = [v for v in (literal(x, kind) for x in value if x is not None) if v is not None]
        return F.coalesce(column.isin(known), F.lit(False)) if known else None
    if value is None and op in ("eq", "ne"):
        if kind in NUMERIC:
            return None if op == "eq" else F.lit(True)
        return column.isNull() if op == "eq" else column.isNotNull()
    known = literal(value, kind)
    if known is None:
        return F.lit(True) if op == "ne" else None
    if op == "ne":
        return ~F.coalesce(_same(column, kind, known), F.lit(False))
    if op == "eq":
        return F.coalesce(_same(column, kind, known), F.lit(False))
    out = getattr(column, _OPS[op])(F.lit(known))
    if kind in ("float", "double"):
        out = out & ~F.isnan(column)  # Spark sorts NaN above all numbers
    return F.coalesce(out, F.lit(False))


def _same(column: Column, kind: str, known) -> Column:
    out = column == F.lit(known)
    return out & ~F.isnan(column) if kind in ("float", "double") else out
