"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def or_null(c: Column | str) -> Column:
    """Null for an empty string."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def first_filled(*cs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[or_null(c) for c in cs])


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lookup(c: Column, table: dict) -> Column:
    """The table's value of c, or null; c is computed once."""
    if not table:
        return F.lit(None)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)
