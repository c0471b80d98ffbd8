"""Counts, sparsity and memory estimates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.model import VALUE, Dims

#: Bytes of a value and of an index or pointer.
VALUE_BYTES, INDEX_BYTES = 8, 8
#: Factors of peak memory and of the safety margin; shares of free memory at which advice changes.
PEAK, MARGIN, ADVICE = 2.0, 1.2, ((0.5, "fits"), (0.8, "use chunks"), (1.0, "use disk"), (float("inf"), "too large"))


def nnz(x: DataFrame) -> DataFrame:
    """Stored entries, explicit zeros among them."""
    return x.agg(F.count(F.lit(1)).alias("nnz"))


def sparsity(stored: Column, dims: Dims, empty: float = 1.0) -> Column:
    """1 - stored / size, or ``empty`` where there is no element."""
    return F.lit(empty) if not dims.size else F.lit(1.0) - stored / F.lit(float(dims.size))


def matrix_sparsity(x: DataFrame, dims: Dims, dense: bool = False) -> DataFrame:
    """Three conventions: ``sparsity`` (1.0 if empty), ``percent`` (0.0 if empty or dense) and ``by_value`` (dense matrices count what isn't zero)."""
    n = F.count(F.lit(1))
    there = F.count_if(F.col(VALUE) != 0) if dense else n
    percent = F.lit(0.0) if dense or not dims.size else 100 * sparsity(n, dims)
    return x.agg(sparsity(n, dims).alias("sparsity"), percent.alias("percent"), sparsity(there, dims).alias("by_value"))


@dataclass(frozen=True)
class MemoryEstimate:
    """Bytes of a compressed layout: values and indices for each entry, pointers for each major row."""

    values: int
    indices: int
    pointers: int

    @property
    def total(self) -> int:
        return self.values + self.indices + self.pointers

    @property
    def peak(self) -> int:
        return int(self.total * PEAK)

    @property
    def recommended(self) -> int:
        return int(self.total * PEAK * MARGIN)


def estimate_memory(n_major: int, nnz: int) -> MemoryEstimate:
    """For CSR the major axis is cells, for CSC genes."""
    return MemoryEstimate(nnz * VALUE_BYTES, nnz * INDEX_BYTES, (n_major + 1) * INDEX_BYTES)


def advise(estimate: MemoryEstimate, free: int) -> str:
    share = estimate.recommended / free if free else float("inf")
    return next(text for limit, text in ADVICE if share <= limit)


def memory(x: DataFrame, dims: Dims) -> DataFrame:
    """csr_bytes, csc_bytes and their peaks, from one count."""
    n = F.count(F.lit(1))
    size = lambda major: n * (VALUE_BYTES + INDEX_BYTES) + F.lit((major + 1) * INDEX_BYTES)
    csr, csc = size(dims.n_cells), size(dims.n_genes)
    return x.agg(csr.alias("csr_bytes"), csc.alias("csc_bytes"), (csr * int(PEAK)).alias("csr_peak_bytes"), (csc * int(PEAK)).alias("csc_peak_bytes"))


def contingency(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of label pairs; null labels count as empty ones."""
    return labels.groupBy(F.coalesce(F.col(a).cast("string"), F.lit("")).alias("a"), F.coalesce(F.col(b).cast("string"), F.lit("")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
