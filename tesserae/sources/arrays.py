"""Parts of HDF5 files as tables: what H5AD and Loom files have in common.

A part is described by a small dict (``what``: sparse, dense, table, compound, vectors or edges). ``batches`` reads a range of its rows, and only
the chunks of the file that the range meets, in blocks of bounded size. The data sources below make a Spark partition of each range.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tesserae.sources import hdf5

#: Rows of a partition, where an option names no other number; entries and values of a block.
ROWS, BLOCK = 50_000, 1 << 18
#: Spark types of numbers, by numpy kind and size.
NUMBERS = {"i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int", "u4": "bigint", "u8": "bigint", "f2": "float", "f4": "float", "f8": "double", "b1": "boolean"}
ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def text(value) -> str:
    return value.decode() if isinstance(value, bytes) else str(value)


def column_type(kind: hdf5.Kind) -> str:
    if kind.vlen is str or kind.dtype.kind == "S":
        return "string"
    if kind.boolean:
        return "boolean"
    return NUMBERS.get(kind.dtype.kind + str(kind.dtype.itemsize), "string")


def as_arrow(values: np.ndarray, to: str, missing: np.ndarray | None = None) -> pa.Array:
    """A column; ``missing`` marks nulls."""
    if to == "string":
        return pa.array([None if v is None else str(v) for v in values.tolist()], pa.string(), mask=missing)
    kind = ARROW[to]
    return pa.array(np.ascontiguousarray(values.astype(values.dtype.newbyteorder("="))), mask=missing).cast(kind, safe=False)


def matrix_of(node, path: str, swap: bool = False) -> dict:
    """The description of a sparse group or a 2-D dataset, with its shape. ``swap``: rows of the file are genes."""
    if isinstance(node, hdf5.Group):
        kind = node.attrs.get("encoding-type", node.attrs.get("h5sparse_format", "csr"))
        shape = node.attrs.get("shape", node.attrs.get("h5sparse_shape"))
        if shape is None:
            raise ValueError(f"{path}: a sparse matrix without a shape")
        by_column = text(kind).startswith("csc")
        return {"what": "sparse", "path": path, "by_column": by_column, "shape": [int(x) for x in shape], "rows": int(shape[1 if by_column else 0]), "swap": swap, "stored": len(node["data"])}
    if len(node.shape or ()) != 2:
        raise ValueError(f"{path}: a matrix of {len(node.shape or ())} dimensions")
    return {"what": "dense", "path": path, "shape": list(node.shape), "rows": node.shape[0], "swap": swap, "values": node.stored_values()}


def entries(file: hdf5.File, d: dict, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, column and value of the entries in rows [lo, hi) of the file's layout, block by block; of dense data, those that aren't 0."""
    flip = d.get("by_column", False) != d.get("swap", False)
    if d["what"] == "sparse":
        group = file[d["path"]]
        pointers = group["indptr"].read(lo, hi + 1).astype(np.int64)
        first, last = int(pointers[0]), int(pointers[-1])
        for at in range(first, last, BLOCK):
            to = min(last, at + BLOCK)
            row = lo + np.searchsorted(pointers, np.arange(at, to), "right") - 1
            column, value = group["indices"].read(at, to).astype(np.int64), group["data"].read(at, to).astype(np.float64)
            yield (column, row, value) if flip else (row, column, value)
        return
    node = file[d["path"]]
    if node.tiled:
        yield from _joined((column, row, value) if flip else (row, column, value) for row, column, value in node.nonzero(lo, hi))
        return
    step = max(1, BLOCK // max(1, d["shape"][1]))
    for at in range(lo, hi, step):
        block = node.read(at, min(hi, at + step)).astype(np.float64)
        row, column = np.nonzero(block)
        value = block[row, column]
        yield (column, row + at, value) if flip else (row + at, column, value)


def _joined(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks put together until they are of some size."""
    held, n = [], 0
    for block in found:
        held.append(block)
        n += len(block[-1])
        if n >= BLOCK:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def batches(file: hdf5.File, d: dict, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
    """Rows [lo, hi) of a part."""
    if d["what"] in ("sparse", "dense"):
        extra = [] if d.get("name") is None else [d["name"]]
        for i, j, v in entries(file, d, lo, hi):
            yield pa.RecordBatch.from_arrays([*(pa.array([n] * len(v), pa.string()) for n in extra), pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(v)], names=[*(d["key"] for _ in extra), *d["columns"]])
        return
    step = max(1, BLOCK // max(1, d.get("width", 1)))
    for at in range(lo, hi, step):
        to = min(hi, at + step)
        place = pa.array(np.arange(at, to), pa.int64())
        if d["what"] == "vectors":
            values = file[d["path"]].read(at, to) if not d.get("field") else _field(file, d, at, to)
            values = values.reshape(to - at, -1).astype(np.float64)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(to - at + 1) * values.shape[1], pa.int32()), pa.array(values.reshape(-1)))
            arrays = [pa.array([d["name"]] * (to - at), pa.string()), place, vec] if d.get("name") is not None else [place, vec]
            yield pa.RecordBatch.from_arrays(arrays, names=d["columns"])
        elif d["what"] == "edges":
            group = file[d["path"]]
            a, b = (group[k].read(at, to).astype(np.int64) for k in "ab")
            w = group["w"].read(at, to).astype(np.float64) if "w" in group else np.ones(to - at)
            keep = (a >= 0) & (a < d["extent"]) & (b >= 0) & (b < d["extent"])
            yield pa.RecordBatch.from_arrays([pa.array([d["name"]] * int(keep.sum()), pa.string()), pa.array(a[keep]), pa.array(b[keep]), pa.array(w[keep])], names=d["columns"])
        else:
            yield pa.RecordBatch.from_arrays([place, *(_column(file, d, c, at, to) for c in d["fields"])], names=[d["index"], *(c["as"] for c in d["fields"])])


def _field(file: hdf5.File, d: dict, lo: int, hi: int) -> np.ndarray:
    node = file[d["path"]]
    return file.field(node.kind, node.raw(lo, hi), d["field"])


def _column(file: hdf5.File, d: dict, c: dict, lo: int, hi: int) -> pa.Array:
    how, path = c["how"], c.get("path")
    if how == "place":
        return pa.array([str(i) for i in range(lo, hi)], pa.string())
    if how == "field":
        values = _field(file, {"path": d["path"], "field": c["field"]}, lo, hi)
        return _decoded(values, file[c["categories"]].read(), c["type"]) if c.get("categories") else as_arrow(values, c["type"])
    if how == "codes":
        return _decoded(file[path].read(lo, hi), _categories(file, c).read(), c["type"])
    if how == "masked":
        return as_arrow(file[f"{path}/values"].read(lo, hi), c["type"], file[f"{path}/mask"].read(lo, hi).astype(bool))
    return as_arrow(file[path].read(lo, hi), c["type"])


def _categories(file: hdf5.File, c: dict):
    return file.at(c["at"]) if "at" in c else file[c["categories"]]


def _decoded(codes: np.ndarray, categories: np.ndarray, to: str) -> pa.Array:
    """Values of category codes; a code without a category is null."""
    codes = codes.astype(np.int64)
    missing = (codes < 0) | (codes >= len(categories))
    if not len(categories):
        return pa.nulls(len(codes), ARROW[to])
    return as_arrow(categories, to).take(pa.array(np.where(missing, 0, codes), mask=missing))


class Rows(InputPartition):
    def __init__(self, lo: int, hi: int):
        super().__init__((lo, hi))
        self.lo, self.hi = lo, hi


class PartReader(DataSourceReader):
    """Partitions are ranges of rows."""

    def __init__(self, path: str, part: dict, rows: int):
        self.path, self.part, self.rows = path, part, rows

    def partitions(self) -> list[Rows]:
        n = self.part["rows"]
        return [Rows(lo, min(n, lo + self.rows)) for lo in range(0, n, self.rows)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.lo < partition.hi:
            with hdf5.File(self.path) as file:
                yield from batches(file, self.part, partition.lo, partition.hi)


class PartSource(DataSource):
    """Options: path, component (what ``parts`` names), rows (of a partition)."""

    def parts(self, file: hdf5.File) -> dict[str, tuple[str, dict]]:
        """Schema and description of each component of the file."""
        raise NotImplementedError

    def _part(self) -> tuple[str, dict]:
        if "part" in self.options:
            return tuple(json.loads(self.options["part"]))
        component = self.options.get("component", "x")
        with hdf5.File(self.options["path"]) as file:
            found = self.parts(file)
        if component not in found:
            raise ValueError(f"no component {component!r}; there are {', '.join(found)}")
        return found[component]

    def schema(self) -> str:
        return self._part()[0]

    def reader(self, schema: StructType) -> DataSourceReader:
        return PartReader(self.options["path"], self._part()[1], int(self.options.get("rows", ROWS)))


def load(spark, source: type[PartSource], path: str, part: tuple[str, dict], rows: int):
    """A part as a lazy DataFrame; the file was looked into once."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("part", json.dumps(part)).option("rows", rows).load(path)
