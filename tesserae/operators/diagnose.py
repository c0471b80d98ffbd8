"""Diagnostics of annotation tables, cleaning, and the audit log of what was changed."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tesserae.functions import names
from tesserae.model import CELL, GENE, INDEX, Dataset

#: Points that an issue of each severity costs, of 100.
COST = {"info": 1, "warning": 5, "error": 20}
ISSUES = "component string, column string, kind string, severity string, fix string"
VERSION = "0.1"


@dataclass(frozen=True)
class Issue:
    component: str
    column: str
    kind: str
    severity: str
    fix: str


def issues_of(columns: list[str], component: str) -> list[Issue]:
    out, seen = [], {}
    for c in columns:
        if any(x in names.SPECIAL for x in c):
            out.append(Issue(component, c, "special_characters", "info", names.sanitised(c)))
        if c[:1].isascii() and c[:1].isdigit():
            out.append(Issue(component, c, "numeric_start", "info", "X" + c))
        if len(c.encode()) > names.LONGEST:
            out.append(Issue(component, c, "long_name", "warning", names.truncated(c)))
        seen[c] = seen.get(c, 0) + 1
    out += [Issue(component, c, "duplicate", "warning", f"{c}_dup2") for c, n in seen.items() if n > 1]
    return out


def issues(ds: Dataset) -> list[Issue]:
    return [i for t, n, k in ((ds.obs, "obs", CELL), (ds.var, "var", GENE)) for i in issues_of([c for c in t.columns if c not in (k, INDEX)], n)]


def frame(found: list[Issue], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i.component, i.column, i.kind, i.severity, i.fix) for i in found], ISSUES)


def score(found: list[Issue]) -> int:
    return max(0, 100 - sum(COST[i.severity] for i in found))


def convertible(found: list[Issue]) -> bool:
    return all(i.severity != "error" for i in found)


def clean_names(columns: list[str]) -> list[str]:
    return names.without_repeats([names.truncated(names.sanitised(c)) for c in columns])


def clean(ds: Dataset) -> Dataset:
    """Clean names of obs and var by position, so repeated names are no obstacle; every change goes to the log."""
    log, parts = list(ds.log), {}
    for part, index in (("obs", CELL), ("var", GENE)):
        table = getattr(ds, part)
        fixed = (index, INDEX)
        new = iter(clean_names([c for c in table.columns if c not in fixed]))
        to = [c if c in fixed else next(new) for c in table.columns]
        log += [{"action": "renamed", "component": part, "from": a, "to": b} for a, b in zip(table.columns, to, strict=True) if a != b]
        parts[part] = table.toDF(*to)
    return ds.with_(log=tuple(log), **parts)


def preview(ds: Dataset) -> list[dict]:
    """What ``clean`` would change."""
    return list(clean(ds).log[len(ds.log) :])


def audit(ds: Dataset, now: datetime | None = None) -> str:
    """The log as JSON."""
    return json.dumps({"timestamp": (now or datetime.now(timezone.utc)).isoformat(), "tool_version": VERSION, "modifications": list(ds.log)})


def read_audit(text: str) -> list[dict]:
    return json.loads(text)["modifications"]
