"""Split layers: merging, padding, splitting by extent."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.model import CELL, GENE, Dims
from tesserae.operators import layout


def split_name(name: str) -> tuple[str, str | None]:
    """Prefix before the last dot, and what follows it; a name without one has no suffix."""
    prefix, dot, suffix = name.rpartition(".")
    return (prefix, suffix) if dot and prefix and suffix else (name, None)


def groups(dims: dict[str, tuple[int, int]]) -> dict[str, list[str]]:
    """Layers to merge: prefix to its members (two or more) in the order of their suffixes as strings."""
    found: dict[str, list[tuple[str, str]]] = {}
    for name in dims:
        prefix, suffix = split_name(name)
        if suffix is not None:
            found.setdefault(prefix, []).append((suffix, name))
    return {p: [n for _, n in sorted(m)] for p, m in found.items() if len(m) > 1}


def offsets(members: list[str], dims: dict[str, tuple[int, int]], axis: int = 0) -> dict[str, int]:
    """Where each member begins. Members must be equal along the other axis."""
    other = {dims[m][1 - axis] for m in members}
    if len(other) > 1:
        raise ValueError(f"{members} differ along the other axis: {sorted(other)}")
    out, at = {}, 0
    for m in members:
        out[m], at = at, at + dims[m][axis]
    return out


def _moved(layers: DataFrame, by: dict[str, int], index: str) -> DataFrame:
    if not by:
        return layers
    moves = F.create_map(*[F.lit(v) for pair in by.items() for v in pair])
    return layers.withColumn(index, F.col(index) + F.coalesce(F.try_element_at(moves, F.col("layer")), F.lit(0)))


def merge(layers: DataFrame, dims: dict[str, tuple[int, int]]) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """Members of a group one below the other under the group's prefix; others keep their names. No shuffle: indices are moved."""
    moves, names, out = {}, {}, {}
    for prefix, members in groups(dims).items():
        moves |= offsets(members, dims)
        names |= dict.fromkeys(members, prefix)
        out[prefix] = (sum(dims[m][0] for m in members), dims[members[0]][1])
    moved = _moved(layers, moves, CELL)
    if names:
        to = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
        moved = moved.withColumn("layer", F.coalesce(F.try_element_at(to, F.col("layer")), F.col("layer")))
    return moved, out | {k: v for k, v in dims.items() if k not in names}


def pad(layers: DataFrame, dims: dict[str, tuple[int, int]]) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """Members of a group keep their names, each at its place in the whole: as tall as all of them. Zeros are implicit."""
    moves, out = {}, dict(dims)
    for members in groups(dims).values():
        moves |= offsets(members, dims)
        total = sum(dims[m][0] for m in members)
        out |= {m: (total, dims[m][1]) for m in members}
    return _moved(layers, moves, CELL), out


def stack(parts: list[tuple[DataFrame, int, int]], axis: int = 0) -> DataFrame:
    """Matrices (x, n_cells, n_genes) one after another along an axis; unequal extents along the other are an error."""
    dims = {str(i): (c, g) for i, (_, c, g) in enumerate(parts)}
    at = offsets(list(dims), dims, axis)
    index = (CELL, GENE)[axis]
    return reduce(DataFrame.unionByName, [x.withColumn(index, F.col(index) + at[str(i)]) for i, (x, _, _) in enumerate(parts)])


def split_by_extent(layers: DataFrame, dims: dict[str, tuple[int, int]], shape: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Layers of that shape, and the others as rows of a dense matrix (name X_<layer>, cell_idx, vec). A row's entries fit one task."""
    same = [k for k, d in dims.items() if d == shape]
    other = layers.where(~F.col("layer").isin(same))
    width = F.create_map(*[F.lit(v) for k, d in dims.items() for v in (k, d[1])]) if dims else F.create_map()
    row = other.groupBy("layer", CELL).agg(F.map_from_entries(F.collect_list(F.struct(GENE, "value"))).alias("m"))
    vec = F.transform(F.sequence(F.lit(0).cast("long"), F.try_element_at(width, F.col("layer")).cast("long") - 1), lambda g: F.coalesce(F.try_element_at(F.col("m"), g), F.lit(0.0)))
    return layers.where(F.col("layer").isin(same)), row.select(F.concat(F.lit("X_"), "layer").alias("name"), CELL, vec.alias("vec"))


def over_split(layers: DataFrame, dims: dict[str, tuple[int, int]], shape: tuple[int, int], f: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """name, and what f makes of blocks of cells and their dense rows, of the layers that ``split_by_extent`` keeps dense; rows do not leave their worker."""
    found = []
    for k, (n, width) in dims.items():
        if (n, width) != shape:
            cells = layers.sparkSession.range(n).select(F.col("id").alias(CELL))
            made = layout.over_dense(layers.where(F.col("layer") == k).select(CELL, GENE, "value"), cells, Dims(n, width), f, schema)
            found.append(made.select(F.lit(f"X_{k}").alias("name"), "*"))
    return reduce(DataFrame.unionByName, found) if found else layers.sparkSession.createDataFrame([], f"name string, {schema}")


def main_layer(names: list[str], order: tuple[str, ...] = ("counts", "data")) -> str:
    """counts, else data, else the first in alphabetical order."""
    if not names:
        raise ValueError("no layer")
    return next((n for n in order if n in names), min(names))
