"""Normalisation, variances, variable genes, gene identifiers."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.model import CELL, GENE, INDEX, VALUE, Dataset, Dims
from tesserae.operators import select

#: Fixed value: total of a cell after scaling.
SCALE = 10_000


def _log1p(v: Column) -> Column:
    """ln(v + 1); -inf at -1 and NaN below, as the function itself has it."""
    shifted = v + 1
    return F.when(shifted > 0, F.log(shifted)).when(shifted == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))


def log1p(x: DataFrame) -> DataFrame:
    """Every entry as ln(value + 1); zeros stay implicit."""
    return x.withColumn(VALUE, _log1p(F.col(VALUE)))


def normalised(x: DataFrame, keys: tuple[str, ...] = (CELL,)) -> DataFrame:
    """ln(1 + value * 10000 / total of the cell) where the total is above 0, other cells as they are.

    A window keeps it to one exchange by cell. A value of -1 after scaling gives -inf and a smaller one NaN.
    """
    total = F.sum(VALUE).over(Window.partitionBy(*keys))
    log = _log1p(F.col(VALUE) * SCALE / F.col("_total"))
    return x.withColumn("_total", total).withColumn(VALUE, F.when(F.col("_total") > 0, log).otherwise(F.col(VALUE))).drop("_total")


def normalise(ds: Dataset, layers: bool = False) -> Dataset:
    """X normalised, and every layer too if asked for."""
    of_layers = normalised(ds.layers, ("layer", CELL)) if layers and ds.layers is not None else ds.layers
    return ds.with_(x=normalised(ds.x), layers=of_layers)


def gene_variances(x: DataFrame, genes: DataFrame, dims: Dims) -> DataFrame:
    """gene_idx, mean, variance of every gene: population variance over all cells, implicit zeros included.

    One partial aggregate by gene, combined before the shuffle: entries, their mean and population variance (kept by central
    moments, so large means lose no digits). The zeros are put in as a second group of the same gene, by the
    rule for the variance of two groups. A gene in every cell is no hot key.
    """
    n = float(dims.n_cells)
    own = x.groupBy(GENE).agg(F.count(F.lit(1)).alias("k"), F.avg(VALUE).alias("m"), F.var_pop(VALUE).alias("v"))
    share = F.col("k") / n
    mean, variance = F.col("m") * share, F.col("v") * share + F.col("m") * F.col("m") * share * (1 - share)
    return genes.select(GENE).join(own, GENE, "left").select(GENE, F.coalesce(mean, F.lit(0.0)).alias("mean"), F.coalesce(variance, F.lit(0.0)).alias("variance"))


def top_genes(variances: DataFrame, n: int) -> DataFrame:
    """The n genes of the highest variance; of equal ones, those of lower index."""
    return variances.orderBy(F.desc("variance"), GENE).limit(n)


def select_top_genes(ds: Dataset, n: int) -> Dataset:
    """Keep the n most variable genes in everything that is by gene. n of the genes there are or more: no change."""
    if n <= 0:
        raise ValueError("the number of genes must be positive")
    if n >= ds.dims.n_genes:
        warnings.warn(f"{n} genes wanted, {ds.dims.n_genes} are there", stacklevel=2)
        return ds
    return select.keep_genes(ds, top_genes(gene_variances(ds.x, ds.var, ds.dims), n).select(GENE))


def use_gene_ids(ds: Dataset, column: str) -> Dataset:
    """``_index`` of var is that column as a string, null as ''. It is replaced in place, or comes first."""
    if column not in ds.var.columns:
        raise KeyError(f"var has no column {column!r}; it has {ds.var.columns}")
    ids = F.coalesce(F.col(column).cast("string"), F.lit(""))
    if INDEX in ds.var.columns:
        return ds.with_(var=ds.var.withColumn(INDEX, ids))
    return ds.with_(var=ds.var.select(GENE, ids.alias(INDEX), *[c for c in ds.var.columns if c != GENE]))
