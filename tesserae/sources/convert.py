"""From one file to another, part by part: nothing is held as a whole but what a format's writer holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from tesserae.model import Dataset
from tesserae.sources import registry

#: Called with rows written and rows in all.
Progress = Callable[[int, int], None]


def convert(spark: SparkSession, source: str, target: str, progress: Progress | None = None, known: registry.Registry | None = None, change: Callable[[Dataset], Dataset] | None = None) -> Dataset:
    """Read ``source``, apply ``change``, write ``target``; formats are found by extension, then by content. Returns the dataset that was written.

    Rows go in order, in chunks; ``progress`` hears of each chunk of X if the target's writer takes rows one chunk after the other (H5AD), and of the end otherwise.
    """
    known = known or registry.default()
    found = [known.detect(p) for p in (source, target)]
    if None in found or not found[0].read or not found[1].write:
        raise ValueError(f"no way from {source} to {target}; known are {', '.join(known.list())}")
    ds = found[0].read(spark, source)
    ds = change(ds) if change else ds
    if found[1].name == "h5ad":
        found[1].write(ds, target, progress)
    else:
        found[1].write(ds, target)
        if progress:
            progress(ds.dims.n_cells, ds.dims.n_cells)
    return ds
