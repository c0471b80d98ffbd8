"""The dataset: an annotated matrix of cells by genes as long tables.

All parts are aligned by index, as rows of a matrix are, but carry the index as a column. Zeros are
implicit: a cell or gene without an entry exists because ``dims`` says how many there are, so every mean
over cells divides by ``dims.n_cells`` and not by a number of rows. Explicit zeros are kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL, GENE, VALUE, INDEX = "cell_idx", "gene_idx", "value", "_index"
X_SCHEMA = "cell_idx bigint, gene_idx bigint, value double"


@dataclass(frozen=True)
class Dims:
    """Extent of the matrix and where it came from. Indices run from ``first_cell`` and ``first_gene``."""

    n_cells: int
    n_genes: int
    source_format: str = "parquet"
    source_version: str | None = None
    active_assay: str | None = None
    first_cell: int = 0
    first_gene: int = 0

    @property
    def size(self) -> int:
        return self.n_cells * self.n_genes


@dataclass(frozen=True)
class Dataset:
    """x: cell_idx, gene_idx, value. obs, var: index, _index and annotation. layers: layer + x's columns, extents in layer_dims.

    obsm: name, cell_idx, vec. varm: name, gene_idx, vec. obsp, varp: name, i, j, value. spatial: cell_idx, coords. uns: nested dict.
    """

    x: DataFrame
    obs: DataFrame
    var: DataFrame
    dims: Dims
    layers: DataFrame | None = None
    layer_dims: dict[str, tuple[int, int]] = field(default_factory=dict)
    obsm: DataFrame | None = None
    varm: DataFrame | None = None
    obsp: DataFrame | None = None
    varp: DataFrame | None = None
    spatial: DataFrame | None = None
    uns: dict = field(default_factory=dict)
    log: tuple[dict, ...] = ()

    def with_(self, **parts) -> Dataset:
        return replace(self, **parts)

    def pipe(self, f: Callable[..., Dataset], *args, **kwargs) -> Dataset:
        return f(self, *args, **kwargs)

    def parts(self) -> dict[str, DataFrame]:
        """The tables that are there, by name."""
        names = ("x", "obs", "var", "layers", "obsm", "varm", "obsp", "varp", "spatial")
        return {n: t for n in names if (t := getattr(self, n)) is not None}


def matrix(df: DataFrame, cell: str, gene: str, value: str) -> DataFrame:
    """Long matrix of a table with one row for each entry."""
    return df.select(F.col(cell).cast("long").alias(CELL), F.col(gene).cast("long").alias(GENE), F.col(value).cast("double").alias(VALUE))
