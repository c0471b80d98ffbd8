"""Positional subsetting of rows and columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae import folders
from tesserae.model import CELL, GENE, Dataset

#: Ranges that indices are numbered by, at most.
RANGES = 256


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, in the session's checkpoint folder."""
    folders.top(df.sparkSession)
    return df.checkpoint()


def ordered_blocks(df: DataFrame, order: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows in order, block by block: sorted by ranges on executors, then taken a partition at a time, packed."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block"])

    for row in df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(packed, "block binary").toLocalIterator(prefetchPartitions=True):
        yield pa.ipc.open_stream(row["block"]).read_all()


def _range(index: Column, bounds: list[int], first: int = 0) -> Column:
    """How many bounds are at or below the index, by halves."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(index < bounds[mid], _range(index, bounds[:mid], first)).otherwise(_range(index, bounds[mid + 1 :], first + mid + 1))


def renumbered(kept: DataFrame, index: str) -> DataFrame:
    """index, new: kept indices in ascending order, numbered from 0.

    Numbered in two steps, range by range, so that no task holds all of them: counts of the ranges are summed
    up first (a row for each range), and each row adds its place within its range. Ranges hold about as many
    indices each, however these are spread (bounds are approximate quantiles).
    """
    spark = kept.sparkSession
    n = min(RANGES, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = kept.agg(F.percentile_approx(index, [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0]
    ranged = kept.select(index).distinct().withColumn("_range", _range(F.col(index), sorted(set(found or [])) if n > 1 else []))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(index)) - 1
    return ranged.withColumn("_place", place).join(counts.select("_range", before.alias("_before")), "_range").select(index, (F.col("_before") + F.col("_place")).cast("long").alias("new"))


def rows(x: DataFrame, kept: DataFrame, index: str = CELL) -> DataFrame:
    """Entries of the kept indices, under their new numbers."""
    return x.join(renumbered(kept, index), index).withColumn(index, F.col("new")).drop("new").select(x.columns)


def columns_between(x: DataFrame, first: int, last: int) -> DataFrame:
    """Entries of genes in [first, last), numbered from 0. The bounds reach the scan."""
    return x.where((F.col(GENE) >= first) & (F.col(GENE) < last)).withColumn(GENE, F.col(GENE) - first)


def rows_between(table: DataFrame, first: int, last: int, index: str = CELL, renumber: bool = False) -> DataFrame:
    """Rows of [first, last) of a matrix or an annotation table."""
    out = table.where((F.col(index) >= first) & (F.col(index) < last))
    return out.withColumn(index, F.col(index) - first) if renumber else out


def is_contiguous(kept: DataFrame, index: str) -> DataFrame:
    """Whether the indices are consecutive; none at all are."""
    run = F.max(index) - F.min(index) + 1 == F.count_distinct(index)
    return kept.agg(F.coalesce(run, F.lit(True)).alias("contiguous"))


def blocks(x: DataFrame, cells: int, genes: int) -> DataFrame:
    """x with the place of each entry's block, in row-major order."""
    return x.select(F.floor(F.col(CELL) / cells).cast("long").alias("cell_block"), F.floor(F.col(GENE) / genes).cast("long").alias("gene_block"), *x.columns)


def keep_genes(ds: Dataset, kept: DataFrame) -> Dataset:
    """Everything by gene, for the kept genes under new numbers. Layers of another width than X stay as they are."""
    new = cut(renumbered(kept, GENE))
    to = lambda t, c: t.join(new.withColumnRenamed(GENE, c), c).withColumn(c, F.col("new")).drop("new").select(t.columns)
    layers, layer_dims = ds.layers, dict(ds.layer_dims)
    if layers is not None:
        same = [k for k, d in layer_dims.items() if d[1] == ds.dims.n_genes]
        layers = to(layers.where(F.col("layer").isin(same)), GENE).unionByName(layers.where(~F.col("layer").isin(same)))
        layer_dims |= {k: (layer_dims[k][0], new.count()) for k in same}
    varp = None if ds.varp is None else to(to(ds.varp, "i"), "j")
    dims = type(ds.dims)(**{**ds.dims.__dict__, "n_genes": new.count(), "first_gene": 0})
    return ds.with_(x=to(ds.x, GENE), var=to(ds.var, GENE), varm=None if ds.varm is None else to(ds.varm, GENE), varp=varp, layers=layers, layer_dims=layer_dims, dims=dims)


def keep_cells(ds: Dataset, kept: DataFrame) -> Dataset:
    """Everything by cell, for the kept cells under new numbers."""
    new = cut(renumbered(kept, CELL))
    to = lambda t, c: None if t is None else t.join(new.withColumnRenamed(CELL, c), c).withColumn(c, F.col("new")).drop("new").select(t.columns)
    n = new.count()
    dims = type(ds.dims)(**{**ds.dims.__dict__, "n_cells": n, "first_cell": 0})
    obsp = None if ds.obsp is None else to(to(ds.obsp, "i"), "j")
    same = {k: (n, d[1]) for k, d in ds.layer_dims.items() if d[0] == ds.dims.n_cells}
    layers = ds.layers
    if layers is not None:
        layers = to(layers.where(F.col("layer").isin(list(same))), CELL).unionByName(layers.where(~F.col("layer").isin(list(same))))
    return ds.with_(x=to(ds.x, CELL), obs=to(ds.obs, CELL), obsm=to(ds.obsm, CELL), spatial=to(ds.spatial, CELL), obsp=obsp, layers=layers, layer_dims=ds.layer_dims | same, dims=dims)


def sorted_columns(table: DataFrame, index: str) -> DataFrame:
    """The index, then the other columns in alphabetical order."""
    return table.select(index, *sorted(c for c in table.columns if c != index))
