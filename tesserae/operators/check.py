"""Structural checks and schema validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.model import CELL, GENE, Dataset, Dims

#: Columns that the cellxgene schema, version 5, requires.
CELLXGENE_V5_OBS = (
    "assay_ontology_term_id", "cell_type_ontology_term_id", "development_stage_ontology_term_id", "disease_ontology_term_id", "donor_id", "is_primary_data",
    "organism_ontology_term_id", "self_reported_ethnicity_ontology_term_id", "sex_ontology_term_id", "suspension_type", "tissue_ontology_term_id", "tissue_type",
)
CELLXGENE_V5_VAR = ("feature_is_filtered",)
SCHEMAS = {"cellxgene-v5": (CELLXGENE_V5_OBS, CELLXGENE_V5_VAR)}


def sparse_errors(x: DataFrame, dims: Dims) -> DataFrame:
    """cell_out_of_bounds, gene_out_of_bounds, null_entries, duplicates, passed."""
    out = lambda c, first, n: F.count_if((F.col(c) < first) | (F.col(c) >= first + n))
    nulls = F.col(CELL).isNull() | F.col(GENE).isNull() | F.col("value").isNull()
    by_key = x.groupBy(CELL, GENE).agg(F.count(F.lit(1)).alias("n"), F.count_if(nulls).alias("nulls"))
    sums = by_key.agg(
        F.coalesce(F.sum(F.when((F.col(CELL) < dims.first_cell) | (F.col(CELL) >= dims.first_cell + dims.n_cells), F.col("n"))), F.lit(0)).alias("cell_out_of_bounds"),
        F.coalesce(F.sum(F.when((F.col(GENE) < dims.first_gene) | (F.col(GENE) >= dims.first_gene + dims.n_genes), F.col("n"))), F.lit(0)).alias("gene_out_of_bounds"),
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("null_entries"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    )
    return sums.withColumn("passed", F.col("cell_out_of_bounds") + F.col("gene_out_of_bounds") + F.col("null_entries") + F.col("duplicates") == 0)


def require_sparse(x: DataFrame, dims: Dims) -> DataFrame:
    """x, or an error that says what is wrong with it."""
    found = sparse_errors(x, dims).first()
    if not found.passed:
        raise ValueError(", ".join(f"{k}: {v}" for k, v in found.asDict().items() if k != "passed" and v))
    return x


def extents(ds: Dataset) -> list[tuple[DataFrame, str, list[str], bool]]:
    """(table, name, index columns with their axis, whether every index must have a row) of what must agree with X."""
    out = [(ds.obs, "obs", [CELL], True), (ds.var, "var", [GENE], True), (ds.x, "x", [CELL, GENE], False)]
    out += [(t, n, k, False) for t, n, k in ((ds.obsm, "obsm", [CELL]), (ds.varm, "varm", [GENE]), (ds.obsp, "obsp", ["i", "j"]), (ds.varp, "varp", ["i", "j"]), (ds.spatial, "spatial", [CELL])) if t is not None]
    return out


def dimensions(ds: Dataset) -> DataFrame:
    """component, rows, lowest, highest, expected, passed: indices within the extents, and as many annotation rows as indices. One aggregate a part."""
    parts = []
    for table, name, keys, whole in extents(ds):
        genes = name in ("var", "varm", "varp")
        for k in keys:
            by_gene = genes or k == GENE
            first, n = (ds.dims.first_gene, ds.dims.n_genes) if by_gene else (ds.dims.first_cell, ds.dims.n_cells)
            row = table.agg(F.lit(f"{name}.{k}").alias("component"), F.count(F.lit(1)).alias("rows"), F.min(k).alias("lowest"), F.max(k).alias("highest"), F.count_distinct(k).alias("_k") if whole else F.lit(None).cast("long").alias("_k"))
            inside = F.coalesce((F.col("lowest") >= first) & (F.col("highest") < first + n), F.lit(True))
            every = (F.col("rows") == n) & (F.col("_k") == n) if whole else F.lit(True)
            parts.append(row.select("component", "rows", "lowest", "highest", F.lit(n).cast("long").alias("expected"), (inside & every).alias("passed")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def required(ds: Dataset, kind: str = "anndata") -> list[str]:
    """What is empty and must not be. kind: anndata or seurat (which also wants an assay name)."""
    found = []
    if not ds.dims.n_cells or not ds.dims.n_genes:
        found.append("expression matrix is empty")
    if ds.obs.isEmpty():
        found.append("obs has no rows")
    if ds.var.isEmpty():
        found.append("var has no rows")
    if kind == "seurat" and not ds.dims.active_assay:
        found.append("no active assay")
    return found


@dataclass(frozen=True)
class SchemaResult:
    version: str
    missing_obs: tuple[str, ...]
    missing_var: tuple[str, ...]
    message: str = ""

    @property
    def passed(self) -> bool:
        return not (self.missing_obs or self.missing_var or self.message)


def schema(ds: Dataset, version: str = "cellxgene-v5") -> SchemaResult:
    """Required columns that are missing. An unknown version is a failed result and no error."""
    if version not in SCHEMAS:
        return SchemaResult(version, (), (), f"unknown schema version {version!r}; known: {', '.join(SCHEMAS)}")
    obs, var = SCHEMAS[version]
    return SchemaResult(version, tuple(c for c in obs if c not in ds.obs.columns), tuple(c for c in var if c not in ds.var.columns))


#: Types that the file formats hold without loss.
HDF5_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)
R_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)


def types(table: DataFrame) -> list[tuple[str, str, bool, bool]]:
    """(column, type, fits HDF5, fits R) of each column."""
    return [(f.name, f.dataType.simpleString(), isinstance(f.dataType, HDF5_TYPES), isinstance(f.dataType, R_TYPES)) for f in table.schema.fields]
