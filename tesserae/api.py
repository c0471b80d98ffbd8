"""Functions by format, for use from Python: read_*, write_*, inspect, validate."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tesserae.model import Dataset
from tesserae.operators import compare, transform
from tesserae.sources import bundle, h5ad, loom, rds, registry


def _changed(ds: Dataset, normalize: bool, top_genes: int | None, gene_id_column: str | None) -> Dataset:
    ds = transform.normalise(ds, layers=True) if normalize else ds
    ds = transform.select_top_genes(ds, top_genes) if top_genes else ds
    return transform.use_gene_ids(ds, gene_id_column) if gene_id_column else ds


def read_h5ad(spark: SparkSession, path: str, normalize: bool = False, top_genes: int | None = None, gene_id_column: str | None = None) -> Dataset:
    """An H5AD file; normalised first, then reduced to its most variable genes, then under other gene names, as far as asked for."""
    return _changed(h5ad.read(spark, path), normalize, top_genes, gene_id_column)


def read_rds(spark: SparkSession, path: str, normalize: bool = False, top_genes: int | None = None, gene_id_column: str | None = None, keep_layers: bool = False) -> Dataset:
    """A Seurat or SingleCellExperiment object."""
    return _changed(rds.read(spark, path, keep_layers), normalize, top_genes, gene_id_column)


def read_loom(spark: SparkSession, path: str, normalize: bool = False, top_genes: int | None = None, gene_id_column: str | None = None) -> Dataset:
    return _changed(loom.read(spark, path), normalize, top_genes, gene_id_column)


def read_bundle(spark: SparkSession, path: str) -> Dataset:
    return bundle.read(spark, path)


write_h5ad, write_loom, write_bundle = h5ad.write, loom.write, bundle.write


def write_rds(ds: Dataset, path: str, kind: str = "seurat") -> None:
    rds.write(ds, path, kind)


def simplify_seurat(spark: SparkSession, source: str, target: str) -> Dataset:
    """Read a Seurat object and write it again with what this engine keeps of one."""
    ds = rds.read(spark, source)
    rds.write(ds, target, "seurat")
    return ds


def formats() -> dict[str, str]:
    known = registry.default()
    return {n: known.get(n).description for n in known.list()}


def inspect(spark: SparkSession, path: str) -> dict:
    """Format, extents and parts, from headers where the format has some."""
    found = registry.default().detect(path)
    if found is None:
        raise ValueError(f"the format of {path} is not known")
    if found.name == "h5ad":
        return {"format": "h5ad", "parts": h5ad.inspect(path)}
    ds = found.read(spark, path)
    return {"format": found.name, "cells": ds.dims.n_cells, "genes": ds.dims.n_genes, "parts": {k: {"columns": t.columns} for k, t in ds.parts().items()}}


def validate(spark: SparkSession, original: str, converted: str, tolerance: float = 1e-7) -> compare.Report:
    """The comparison of two files, of one format or of two."""
    known = registry.default()
    one, other = (known.detect(p) for p in (original, converted))
    if one is None or other is None:
        raise ValueError(f"the format of {original if one is None else converted} is not known")
    a, b = one.read(spark, original), other.read(spark, converted)
    return compare.compare(a, b, tolerance) if one.name == other.name else compare.cross_format(a, b, tolerance)
