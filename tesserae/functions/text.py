"""Human-readable numbers, sizes and durations, as column expressions and for plain values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")


def size(n: float) -> str:
    at = 0
    while n >= 1024 and at + 1 < len(UNITS):
        n, at = n / 1024, at + 1
    return f"{n:.2f} {UNITS[at]}" if at else f"{int(n)} B"


def size_column(c: Column) -> Column:
    out = F.concat(c.cast("long").cast("string"), F.lit(" B"))
    for i in range(1, len(UNITS)):
        out = F.when(c >= 1024**i, F.format_string(f"%.2f {UNITS[i]}", F.bround(c / float(1024**i), 2))).otherwise(out)
    return out


def duration(seconds: float) -> str:
    if seconds < 60:
        return f"{seconds:.1f}s"
    m, s = divmod(int(seconds), 60)
    return f"{m}m {s}s" if m < 60 else f"{m // 60}h {m % 60}m"


def number(n: int) -> str:
    return f"{n:,}"


def number_column(c: Column) -> Column:
    return F.format_number(c, 0)
