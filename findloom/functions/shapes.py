"""JSON shapes: which values a declared schema takes, checked over VARIANT at every depth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of leaves. An integer has no fraction and no exponent, and fits 64 bits.
TEXT, INTEGER, ANY = "STRING", "BIGINT", ""


@dataclass(frozen=True)
class MapOf:
    """An object with any keys."""

    value: object


def fits(v: Column, shape) -> Column:
    """Whether a VARIANT has a shape: TEXT, INTEGER, ANY, {key: shape}, [shape] or MapOf(shape). Missing and null values fit everywhere, keys
    that aren't named don't matter, and true is never an integer, 1.0 neither."""
    if shape == ANY:
        return F.lit(True)
    none = v.isNull() | F.is_variant_null(v)
    if isinstance(shape, str):
        return none | (F.schema_of_variant(v) == shape)
    if isinstance(shape, list):
        items = F.try_variant_get(v, "$", "array<variant>")
        return none | (items.isNotNull() & F.coalesce(F.forall(items, lambda x: fits(x, shape[0])), F.lit(False)))
    if isinstance(shape, MapOf):
        items = F.try_variant_get(v, "$", "map<string,variant>")
        return none | (items.isNotNull() & F.coalesce(F.forall(F.map_values(items), lambda x: fits(x, shape.value)), F.lit(False)))
    out = F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    for key, inner in shape.items():
        if inner != ANY:
            out = out & fits(F.try_variant_get(v, f"$['{key}']", "variant"), inner)
    return none | out
