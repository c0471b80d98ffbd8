"""A dataset as a folder of Parquet tables, one for each part, with a small JSON header.

Parts are read lazily: a part that is not used is not opened, and column selection and index ranges reach the scan.
Category lists and their order are kept in the schema's field metadata; nulls stay nulls.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.model import CELL, GENE, Dataset, Dims

PARTS = ("x", "obs", "var", "layers", "obsm", "varm", "obsp", "varp", "spatial")
#: Presets of what to read.
PRESETS = {"metadata_only": ("obs", "var"), "lazy": PARTS, "full": PARTS}
#: What each part is ordered by, so that ranges of it are runs of row groups.
ORDER = {"x": (CELL, GENE), "layers": (CELL, GENE), "obs": (CELL,), "var": (GENE,), "obsm": (CELL,), "varm": (GENE,), "obsp": ("i", "j"), "varp": ("i", "j"), "spatial": (CELL,)}


def write(ds: Dataset, path: str, codec: str = "zstd", ordered: bool = True) -> None:
    """Write every part; layers, embeddings and pairwise tables in a folder for each member."""
    spark, member = ds.x.sparkSession, {"layers": "layer", "obsm": "name", "varm": "name", "obsp": "name", "varp": "name"}
    for name, table in ds.parts().items():
        out = table.repartitionByRange(*ORDER[name]).sortWithinPartitions(*ORDER[name]) if ordered else table
        writer = out.write.option("compression", codec)
        (writer.partitionBy(member[name]) if name in member else writer).parquet(f"{path}/{name}")
    head = {"dims": ds.dims.__dict__, "layer_dims": ds.layer_dims, "parts": list(ds.parts()), "uns": ds.uns, "log": list(ds.log)}
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.text(f"{path}/head")


def header(spark: SparkSession, path: str) -> dict:
    """Extents, parts and uns; no table is opened."""
    return json.loads(spark.read.text(f"{path}/head").first()[0])


def read(spark: SparkSession, path: str, parts: tuple[str, ...] | str = PARTS) -> Dataset:
    """The dataset, or the parts of it that are named (or those of a preset). What is left out is an empty table or None."""
    head, wanted = header(spark, path), PRESETS[parts] if isinstance(parts, str) else parts
    got = {p: spark.read.parquet(f"{path}/{p}") for p in head["parts"] if p in wanted}
    empty = {"x": "cell_idx long, gene_idx long, value double", "obs": "cell_idx long", "var": "gene_idx long"}
    for p, schema in empty.items():
        got.setdefault(p, spark.createDataFrame([], schema))
    return Dataset(dims=Dims(**head["dims"]), layer_dims={k: tuple(v) for k, v in head["layer_dims"].items()}, uns=head["uns"], log=tuple(head["log"]), **got)


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """part, rows, columns of every part; rows come from Parquet footers."""
    out = None
    for p in header(spark, path)["parts"]:
        t = spark.read.parquet(f"{path}/{p}")
        row = t.agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("rows"), F.lit(len(t.columns)).alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out


def with_categories(table: DataFrame, column: str, categories: list[str], ordered: bool = False) -> DataFrame:
    """Note a column's category list, unused ones among them, in its field metadata."""
    return table.withColumn(column, F.col(column).alias(column, metadata={"categories": categories, "ordered": ordered}))


def codes(table: DataFrame, column: str, na: str | None = None) -> DataFrame:
    """``<column>_code``: place of the value in its category list, null (or that of an extra category ``na``) where it is missing."""
    known = table.schema[column].metadata["categories"]
    code = F.array_position(F.array(*map(F.lit, known)), F.col(column)) - 1
    missing = F.lit(len(known)) if na is not None else F.lit(None)
    return table.withColumn(f"{column}_code", F.when(F.col(column).isNull(), missing).otherwise(code).cast("int"))


def decoded(table: DataFrame, code: str, categories: list[str], na: str | None = None) -> DataFrame:
    """Values of category codes; -1 is null, or ``na`` if that is given."""
    value = F.try_element_at(F.array(*map(F.lit, categories)), F.when(F.col(code) >= 0, F.col(code).cast("int") + 1))
    return table.withColumn(code, value if na is None else F.coalesce(value, F.lit(na)))


def masked(table: DataFrame, value: str, mask: str) -> DataFrame:
    """Null where the mask is set; the mask goes."""
    return table.withColumn(value, F.when(~F.col(mask), F.col(value))).drop(mask)
