"""Where queries are registered, and the common table expressions of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Common table expressions of the SQL: x, a changed copy y, extents and split layers.
CTE = {
    "x": "x AS (SELECT l_orderkey AS cell_idx, l_partkey AS gene_idx, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)",
    "y": "y AS (SELECT cell_idx, gene_idx, CASE WHEN (cell_idx + gene_idx) % 7 = 0 THEN value + 0.5 ELSE value END AS value FROM x WHERE (cell_idx * 31 + gene_idx) % 11 <> 0)",
    "d": "d AS (SELECT (SELECT count(*) FROM orders) AS n, (SELECT count(*) FROM part) AS m, (SELECT min(o_orderkey) FROM orders) AS c0, (SELECT min(p_partkey) FROM part) AS g0)",
    "l": "l AS (SELECT 'counts.' || l_returnflag AS layer, l_orderkey AS cell_idx, l_partkey AS gene_idx, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3)",
    "z": "z AS (SELECT cell_idx, gene_idx, CASE WHEN t > 0 THEN ln(value * 10000 / t + 1) ELSE value END AS value FROM (SELECT *, sum(value) OVER (PARTITION BY cell_idx) AS t FROM x))",
    "p": "p AS (SELECT coalesce(x.value, 0) AS a, coalesce(y.value, 0) AS b, x.value IS NOT NULL AS in_a, y.value IS NOT NULL AS in_b FROM x FULL OUTER JOIN y ON x.cell_idx = y.cell_idx AND x.gene_idx = y.gene_idx)",
}
CTE["x0"] = "x0 AS (SELECT cell_idx - c0 AS cell_idx, gene_idx - g0 AS gene_idx, value FROM x, d)"
R = 6


def query(sql: str = "", *ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = ("WITH " + ", ".join(CTE[c] for c in ctes) + " " if ctes else "") + sql
        return f

    return add


def again(name: str, of: str) -> None:
    """Another operator of the blueprint that this engine does by the same plan."""
    QUERIES[name] = QUERIES[of]
    if of in ORACLES:
        ORACLES[name] = ORACLES[of]


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, R) for c in columns})
