"""Names of columns and values: cleaning, repeats, lengths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that names should not have; longest name in bytes.
SPECIAL = "/ ,;:\\|?*<>\"'`()[]{}@#$%^&=+~"
LONGEST = 256
_CLASS = "[" + re.escape(SPECIAL) + "]"


def sanitised(name: str) -> str:
    """Special characters as _, runs of _ as one, no _ at the end, X before a digit; nothing left is ``unnamed``."""
    out = re.sub("_+", "_", re.sub(_CLASS, "_", name))
    out = out[:-1] if out.endswith("_") else out
    return "X" + out if out[:1].isascii() and out[:1].isdigit() else out or "unnamed"


def sanitised_column(c: Column) -> Column:
    """The same for values."""
    out = F.regexp_replace(F.regexp_replace(c, "[" + re.sub(r"([\[\]\\^$&|~{}()*+?.-])", r"\\\1", SPECIAL) + "]", "_"), "_+", "_")
    out = F.regexp_replace(out, "_$", "")
    return F.when(out == "", "unnamed").when(out.rlike("^[0-9]"), F.concat(F.lit("X"), out)).otherwise(out)


def truncated(name: str, most: int = LONGEST) -> str:
    """At most so many bytes in UTF-8; a character is never cut."""
    return name.encode()[:most].decode(errors="ignore")


def without_repeats(names: list[str]) -> list[str]:
    """The nth of equal names (n from 2) gets _dupn."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_dup{seen[n]}")
    return out


def truncated_column(c: Column, most: int = LONGEST) -> Column:
    """``truncated`` for values: cut bytes, without the bytes of a character that would be cut."""
    data = F.encode(c, "UTF-8")
    # a byte of the form 10xxxxxx goes on with a character: the cut moves back to the first byte before it that doesn't
    goes_on = lambda k: (F.conv(F.hex(F.substring(data, k, 1)), 16, 10).cast("int") >= 128) & (F.conv(F.hex(F.substring(data, k, 1)), 16, 10).cast("int") < 192)
    end = F.lit(most)
    for back in (3, 2, 1):
        inside = goes_on(most + 1)
        for k in range(back - 1):
            inside = inside & goes_on(most - k)
        end = F.when(inside & ~goes_on(most + 1 - back), F.lit(most - back)).otherwise(end)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.decode(F.substr(data, F.lit(1), end), "UTF-8"))


def without_repeats_column(t: DataFrame, name: str, order: str) -> DataFrame:
    """``without_repeats`` for the values of a column, in the order of another."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return t.withColumn("_n", n).withColumn(name, F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_dup"), F.col("_n")))).drop("_n")
