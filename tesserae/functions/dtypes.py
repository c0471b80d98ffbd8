"""Restoring types, and typed access to nested values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOW, HIGH = -(2**31), 2**31 - 1


def integers_restored(table: DataFrame) -> DataFrame:
    """Double columns whose values are all whole and within 32 bits as integers, found in one aggregate.

    Columns without a value stay as they are, as do those with a NaN. This changes real double columns of whole
    numbers too, so it is done only where it is asked for.
    """
    doubles = [f.name for f in table.schema.fields if isinstance(f.dataType, T.DoubleType)]
    if not doubles:
        return table
    whole = [F.coalesce(F.bool_and((F.col(f"`{c}`") == F.floor(f"`{c}`")) & F.col(f"`{c}`").between(LOW, HIGH)), F.lit(False)).alias(f"c{i}") for i, c in enumerate(doubles)]
    found = table.agg(*whole).first()
    return table.withColumns({c: F.col(f"`{c}`").cast("int") for i, c in enumerate(doubles) if found[i]})


def nested(column: str, path: str, kind: str = "string") -> Column:
    """A value of a JSON column by path; null where the JSON or the type does not fit."""
    return F.try_variant_get(F.try_parse_json(F.col(column)), path, kind)
