"""Boundary coercion of drifting JSON values: a changed type never fails a job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from forgeclock.functions.text import strip


def text(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "string")


def number(v: Column, path: str = "$") -> Column:
    """DOUBLE from number, boolean or numeric text; blank text is 0, non-finite is null."""
    n = F.try_variant_get(v, path, "double")
    blank = strip(F.try_variant_get(v, path, "string")) == ""
    usable = ~F.isnan(n) & (F.abs(n) != F.lit(float("inf")))
    return F.when(n.isNull(), F.when(blank, F.lit(0.0))).when(usable, n)


def integer(v: Column, path: str = "$") -> Column:
    """BIGINT, cut toward zero."""
    return number(v, path).try_cast("bigint")


def truth(v: Column, path: str = "$") -> Column:
    """Truthiness: any non-empty text is true, zero and empty text are false."""
    item = F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(item)
    as_text = F.try_variant_get(v, path, "string")
    as_number = F.try_variant_get(v, path, "double")
    return (
        F.when(item.isNull() | (kind == "VOID"), F.lit(None).cast("boolean"))
        .when(kind == "BOOLEAN", F.try_variant_get(v, path, "boolean"))
        .when(kind == "STRING", as_text != "")
        .when(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")), F.lit(True))
        .otherwise((as_number != 0) & ~F.isnan(as_number))
    )


def items(v: Column, path: str = "$") -> Column:
    """Array elements as VARIANT; null when the value is no array."""
    return F.try_variant_get(v, path, "array<variant>")


def entries(v: Column, path: str = "$") -> Column:
    """Object fields as an array of (key, value); null when the value is no object."""
    return F.map_entries(F.try_variant_get(v, path, "map<string,variant>"))


def longs(v: Column, path: str = "$") -> Column:
    """Array of unit numbers; null when the value is no array."""
    return F.transform(items(v, path), lambda x: integer(x))


# Shape of one event; fields whose type drifts stay VARIANT until coerced.
EVENT = (
    "struct<reason:string,index:variant,elapsed:variant,section:string,package_id:string,"
    "target:struct<name:string>,mode:string,dependencies:variant,unblocked:variant>"
)


def event_columns(e: Column) -> list[Column]:
    """Typed columns of an event cast to ``EVENT``."""
    return [
        e["reason"].alias("reason"),
        integer(e["index"]).alias("index"),
        number(e["elapsed"]).alias("elapsed"),
        e["section"].alias("section"),
        e["package_id"].alias("package_id"),
        e["target"]["name"].alias("target_name"),
        e["mode"].alias("mode"),
        longs(e["dependencies"]).alias("dependencies"),
        longs(e["unblocked"]).alias("unblocked"),
    ]
