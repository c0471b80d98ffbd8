"""Datasets in RDS files: Seurat (V3, V4, V5) and SingleCellExperiment objects.

Files are opened by the task that goes through them, once, on an executor, a window at a time; those in other stores than a folder come through Spark's binary source. R matrices are genes by cells; as long
tables only the names of the two indices change.
"""

from __future__ import annotations

import gzip
import io
import pickle
import shutil
import warnings
from collections.abc import Callable, Iterator
from typing import Any
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import folders
from tesserae.model import CELL, GENE, INDEX, VALUE, Dataset, Dims
from tesserae.operators import layers as split
from tesserae.sources import pieces
from tesserae.sources import rdata as r
from tesserae.sources.hdf5 import opener

TABLES = {
    "layers": "layer string, cell_idx long, gene_idx long, value double",
    "obsm": "name string, cell_idx long, vec array<double>",
    "varm": "name string, gene_idx long, vec array<double>",
    "obsp": "name string, i long, j long, value double",
    "spatial": "cell_idx long, coords array<double>",
}
#: Arrow types by Spark type.
ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
#: R vectors by kind as Spark types.
COLUMN = {"integer": "int", "double": "double", "logical": "boolean", "character": "string"}


def kind_of(x: Any) -> str:
    """seurat or sce, by class."""
    classes = getattr(x, "classes", [])
    if "Seurat" in classes or (isinstance(x, r.Vector) and x["assays"] is not None):
        return "seurat"
    if "SingleCellExperiment" in classes or "SummarizedExperiment" in classes:
        return "sce"
    raise ValueError(f"an object of class {', '.join(classes) or type(x).__name__} is no dataset")


def slot(x: Any, name: str) -> Any:
    """A slot of an S4 object or a member of a list."""
    if isinstance(x, r.S4):
        return x.attrs.get(name)
    return x[name] if isinstance(x, r.Vector) and x.kind == "list" else None


def members(x: Any) -> dict[str, Any]:
    """Named members of a list, or of an S4 list's data."""
    if isinstance(x, r.S4):
        inner = x.attrs.get("listData") or x.attrs.get("data") or x.attrs.get(".Data")
        if isinstance(inner, r.Vector) and inner.names is None and isinstance(x.attrs.get("names"), r.Vector):
            return dict(zip(x.attrs["names"].values, inner.values, strict=False))
        return members(inner)
    if isinstance(x, r.Environment):
        return members(x.content.get("data"))
    return dict(zip(x.names, x.values, strict=False)) if isinstance(x, r.Vector) and x.kind == "list" and x.names else {}


def version(seurat: Any) -> str:
    """V3, V4 or V5, by the class of the assays and the slot for images."""
    if any("Assay5" in a.classes for a in members(slot(seurat, "assays")).values()):
        return "V5"
    return "V4" if isinstance(seurat, r.S4) and "images" in seurat.attrs else "V3"


def extents(x: Any) -> tuple[int, int] | None:
    """Rows and columns of a dgCMatrix or a dense matrix; None for anything else."""
    if isinstance(x, r.S4) and {"i", "p", "x", "Dim"} <= x.attrs.keys():
        return tuple(int(v) for v in x.attrs["Dim"].values)
    if isinstance(x, r.Vector) and x.kind in ("double", "integer") and "dim" in x.attrs:
        n, m = (int(v) for v in x.attrs["dim"].values)
        return n, m
    return None


def _part(values: Any, lo: int, hi: int) -> np.ndarray:
    """A range of a vector's numbers, which are in memory or in files."""
    return np.asarray(values.read(lo, hi) if isinstance(values, pieces.Source) else values[lo:hi])


def _slices(x: Any, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, value) of columns [lo, hi) of a dgCMatrix, or what is not 0 of a dense matrix, a block of entries at a time."""
    if isinstance(x, r.S4):
        p = _part(x.attrs["p"].values, lo, hi + 1)
        for a in range(int(p[0]), int(p[-1]), BLOCK):
            b = min(int(p[-1]), a + BLOCK)
            yield _part(x.attrs["i"].values, a, b).astype(np.int64), lo + np.searchsorted(p, np.arange(a, b), "right") - 1, _part(x.attrs["x"].values, a, b)
        return
    n = extents(x)[0]
    step = max(1, 8 * BLOCK // max(1, n))
    for a in range(lo, hi, step):
        b = min(hi, a + step)
        block = _part(x.values, a * n, b * n).astype(float).reshape(b - a, n)
        j, i = np.nonzero(block)
        yield i, a + j, block[j, i]


def row_names(x: Any, axis: int) -> r.Vector | None:
    names = x.attrs.get("Dimnames" if isinstance(x, r.S4) else "dimnames") if x is not None else None
    return names.values[axis] if isinstance(names, r.Vector) else None


def frame(x: Any, n: int) -> dict[str, tuple[str, r.Vector]]:
    """Spark type and vector of the columns of a data frame that have n values."""
    if isinstance(x, r.S4):  # DFrame
        names, cols = x.attrs.get("rownames"), members(x.attrs.get("listData"))
    else:
        names, cols = (x.attrs.get("row.names"), members(x)) if isinstance(x, r.Vector) else (None, {})
    out = {}
    if isinstance(names, r.Vector) and names.kind == "character":
        if len(names) != n:
            raise ValueError(f"a table of {n} rows has {len(names)} names")
        out[INDEX] = "string", names
    for name, v in cols.items():
        if isinstance(v, r.Vector) and v.kind in COLUMN and len(v) == n:
            out[name] = "string" if "factor" in v.classes else COLUMN[v.kind], v
    return out


def _column(v: r.Vector, lo: int, hi: int) -> pa.Array:
    """A range of a data frame's column; factors as their labels, NA as null."""
    if v.kind == "character":
        return v.values.arrow(lo, hi) if isinstance(v.values, pieces.Texts) else pa.array(v.values.read(lo, hi) if isinstance(v.values, pieces.Source) else v.values[lo:hi], pa.string())
    values = _part(v.values, lo, hi)
    if v.kind == "double":
        return pa.array(values, pa.float64(), from_pandas=True)
    missing = values == r.NA_INT
    if "factor" in v.classes:
        return pa.array(list(v.attrs["levels"].values), pa.string()).take(pa.array(np.where(missing, 1, values) - 1, mask=missing))
    return pa.array(values != 0, mask=missing) if v.kind == "logical" else pa.array(values, pa.int32(), mask=missing)


class Parts:
    """The components of an object as tables. Its long vectors are in files, and tasks read ranges of them."""

    def __init__(self, spark: SparkSession, x: Any):
        self.spark, self.x, self.kind = spark, x, kind_of(x)
        if self.kind == "seurat":
            assays = members(slot(x, "assays"))
            active = slot(x, "active.assay") or slot(x, "active_assay")
            self.assay = active.values[0] if isinstance(active, r.Vector) and active.values[0] in assays else next(iter(assays))
            one = assays[self.assay]
            self.version = version(x)
            found = members(slot(one, "layers")) if slot(one, "layers") is not None else {k: v for k in ("counts", "data", "scale.data") if (v := slot(one, k)) is not None}
            self.features = slot(one, "features")
        else:
            self.assay, self.version, one = "assays", "SCE", None
            assays = x.attrs.get("assays")
            found = members(assays.attrs["data"] if isinstance(assays, r.S4) and "data" in assays.attrs else assays)
            self.features = None
        # dense scaled data is no layer, but a dense matrix is one if it is all there is
        usable = {k: v for k, v in found.items() if extents(v) is not None}
        self.layers = {k: v for k, v in usable.items() if isinstance(v, r.S4)} or usable
        if not self.layers:
            raise ValueError("no matrix in the active assay")
        self.dims = {k: tuple(reversed(extents(v))) for k, v in self.layers.items()}  # cells, genes

    def _ranges(self, n: int, fields: list[tuple[str, str]], make: Callable[[int, int], Iterator[list]]) -> DataFrame:
        """A table of what ``make`` gives for ranges of n."""
        kinds = pa.schema([(c, ARROW[kind]) for c, kind in fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in batch.column(0).to_pylist():
                    for columns in make(lo, min(n, lo + BLOCK)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, np.ndarray) else c for c, k in zip(columns, kinds.types, strict=True)], schema=kinds)

        return pieces.ranges(self.spark, n, BLOCK).mapInArrow(run, ", ".join("`{}` {}".format(c.replace("`", "``"), kind) for c, kind in fields))

    def _union(self, table: str, found: Iterator[tuple[str | None, int, Callable]]) -> DataFrame | None:
        """One table of members by name, with as many rows (or columns of a matrix) each; None if there is none."""
        fields, out = [tuple(f.split(" ")) for f in TABLES[table].split(", ")], None
        for name, n, make in found:
            t = self._ranges(n, [f for f in fields if f[0] not in ("name", "layer")], make)
            t = t if name is None else t.select(F.lit(name).alias(fields[0][0]), "*")
            out = t if out is None else out.unionByName(t)
        return out

    def matrix(self) -> DataFrame:
        def make(v: Any) -> Callable:
            return lambda lo, hi: ([cell, gene, value] for gene, cell, value in _slices(v, lo, hi))

        return self._union("layers", ((k, extents(v)[1], make(v)) for k, v in self.layers.items()))

    def _table(self, index: str, n: int, columns: dict[str, tuple[str, r.Vector]], label: str) -> DataFrame:
        """Columns of n rows; without names, rows have numbers from 1 on."""
        if INDEX not in columns:
            columns = {INDEX: ("string", None)} | columns
        fields = [(index, "long"), *((c, kind) for c, (kind, _) in columns.items())]
        numbered = lambda lo, hi: pa.array([f"{label}_{i + 1}" for i in range(lo, hi)], pa.string())
        return self._ranges(n, fields, lambda lo, hi: iter([[np.arange(lo, hi), *(numbered(lo, hi) if v is None else _column(v, lo, hi) for _, v in columns.values())]]))

    def obs(self) -> DataFrame:
        n = sum(self.dims[k][0] for k in max(split.groups(self.dims).values(), key=len, default=[next(iter(self.dims))]))
        columns = frame(slot(self.x, "meta.data") if self.kind == "seurat" else self.x.attrs.get("colData"), n)
        names = row_names(next(iter(self.layers.values())), 1)
        if INDEX not in columns and names is not None and n and len(names) == n:
            columns = {INDEX: ("string", names)} | columns
        return self._table(CELL, n, columns, "Cell")

    def var(self) -> DataFrame:
        n, names = self.dims[next(iter(self.layers))][1], row_names(next(iter(self.layers.values())), 0)
        if names is None and isinstance(self.features, r.S4):  # a LogMap: a logical matrix by feature and layer
            names = row_names(r.Vector("logical", [], {"dimnames": self.features.attrs.get("dimnames")}), 0)
        return self._table(GENE, n, {INDEX: ("string", names)} if names is not None and n and len(names) == n else {}, "Gene")

    def embeddings(self, which: str) -> DataFrame | None:
        if self.kind == "seurat":
            slots = {"obsm": "cell.embeddings", "varm": "feature.loadings"}
            found = {k: slot(v, slots[which]) for k, v in members(slot(self.x, "reductions")).items()}
        else:
            inner = self.x.attrs.get("int_colData")
            found = members(members(inner).get("reducedDims")) if which == "obsm" and inner is not None else {}
        usable = {k: (v, tuple(int(d) for d in v.attrs["dim"].values)) for k, v in found.items() if isinstance(v, r.Vector) and "dim" in v.attrs and len(v)}

        def make(v: r.Vector, n: int, k: int) -> Callable:
            return lambda lo, hi: iter([[np.arange(lo, hi), _vectors([_part(v.values, c * n + lo, c * n + hi) for c in range(k)])]])

        return self._union(which, ((name, n, make(v, n, k)) for name, (v, (n, k)) in usable.items()))

    def graphs(self) -> DataFrame | None:
        found = members(slot(self.x, "graphs")) if self.kind == "seurat" else {}
        usable = {k: v for k, v in found.items() if extents(v) is not None and len(v.attrs["x"].values if isinstance(v, r.S4) else v.values)}

        def make(v: Any) -> Callable:
            return lambda lo, hi: ([i, j, value] for i, j, value in _slices(v, lo, hi))

        return self._union("obsp", ((k, extents(v)[1], make(v)) for k, v in usable.items()))

    def spatial(self) -> DataFrame | None:
        for image in members(slot(self.x, "images")).values() if self.kind == "seurat" else ():
            c = slot(image, "coordinates")
            cols = [v for v in c.values if isinstance(v, r.Vector) and v.kind in ("double", "integer")][-2:] if isinstance(c, r.Vector) else []
            if len(cols) == 2:
                if len(cols[0]) != len(cols[1]):
                    raise ValueError("coordinates of unlike lengths")
                return self._union("spatial", iter([(None, len(cols[0]), lambda lo, hi, cols=cols: iter([[np.arange(lo, hi), _vectors([_part(v.values, lo, hi) for v in cols])]]))])) if len(cols[0]) else None
        return None


#: Rows or entries of a block.
BLOCK = 1 << 15


def _vectors(columns: list[np.ndarray]) -> pa.Array:
    """Rows of a block of columns."""
    rows = np.column_stack(columns).astype("f8")
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1)))


def _sources(x: Any) -> dict[int, tuple[pieces.Source, str]]:
    """Vectors of an object whose values are in files, with their kinds."""
    out: dict[int, tuple[pieces.Source, str]] = {}
    if isinstance(x, r.Vector) and isinstance(x.values, pieces.Source):
        out[id(x.values)] = x.values, x.kind
    inner = x.values if isinstance(x, r.Vector) and x.kind == "list" else []
    for v in [*inner, *(x.attrs.values() if isinstance(x, (r.Vector, r.S4)) else ())]:
        out |= _sources(v)
    return out


def _kept(x: Any, keep: pieces.Kept, known: dict[int, Any]) -> Any:
    """The object, long vectors in files."""
    if isinstance(x, r.S4):
        return r.S4({k: _kept(v, keep, known) for k, v in x.attrs.items()})
    if not isinstance(x, r.Vector):
        return x
    values, n = x.values, len(x.values)
    if n >= r.LONG and not isinstance(values, pieces.Source) and (x.kind in r.DTYPES or x.kind == "character"):
        if id(values) not in known:
            cut = (values[at : at + BLOCK] for at in range(0, n, BLOCK))
            text = lambda block: [None if v is None else v.encode("utf-8", "surrogateescape") for v in block]
            packed = lambda block: (b"".join(v for v in block if v), [-1 if v is None else len(v) for v in block])
            # values go along, as the id of what is gone may be used again
            known[id(values)] = values, keep.strings((packed(text(block)) for block in cut), n) if x.kind == "character" else keep.numbers((r.encoded(block, x.kind) for block in cut), x.kind, n)
        values = known[id(values)][1]
    elif x.kind in ("list", "expression"):
        values = [_kept(v, keep, known) for v in values]
    return r.Vector(x.kind, values, {k: _kept(v, keep, known) for k, v in x.attrs.items()})


def read(spark: SparkSession, path: str, keep_layers: bool = False) -> Dataset:
    """The dataset of an RDS file. Split layers are merged under their prefix, or padded in place with ``keep_layers``.

    The file is gone through once, by one task, as it is one stream. That task holds a window of it and puts long vectors into files of the
    shared folder; from there on each part is a table of its own, of which many tasks read ranges.
    """
    at, folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), folders.new(spark)

    def parsed(f: Any) -> pa.RecordBatch:
        keep = pieces.Kept(folder)
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_kept(r.load(f, keep), keep, {}))], pa.binary())], names=["object"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in (1 for batch in batches for _ in range(batch.num_rows)):
            with opener(path) as f:
                yield parsed(f)

    def content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (parsed(io.BytesIO(data.as_py())) for batch in batches for data in batch.column(0))

    scheme = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme()
    if scheme == "file" and not set(path) & set("*?[]{}"):  # opened by the task: the JVM holds no copy of the content
        found = spark.range(1, numPartitions=1).mapInArrow(opened, "object binary")
    else:
        found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(content, "object binary")
    return _dataset(spark, pickle.loads(found.first()[0]), keep_layers)


def from_object(spark: SparkSession, x: Any, keep_layers: bool = False) -> Dataset:
    """The dataset of an R object as ``rdata`` has it. Vectors in files (``to_object``) are read where they are, long ones in memory are put into files first."""
    return _dataset(spark, _kept(x, pieces.Kept(folders.new(spark)), {}), keep_layers)


def _dataset(spark: SparkSession, x: Any, keep_layers: bool) -> Dataset:
    p = Parts(spark, x)
    matrices, layer_dims = (split.pad if keep_layers else split.merge)(p.matrix(), p.dims)
    order = ("counts", "logcounts") if p.kind == "sce" else ("counts", "data")
    main = split.main_layer(sorted(layer_dims), order)
    rest = {k: v for k, v in layer_dims.items() if k != main}
    dims = Dims(*layer_dims[main], source_format="rds", source_version=p.version, active_assay=p.assay)
    return Dataset(matrices.where(F.col("layer") == main).drop("layer"), p.obs(), p.var(), dims, matrices.where(F.col("layer") != main) if rest else None, rest, p.embeddings("obsm"), p.embeddings("varm"), p.graphs(), spatial=p.spatial())


def detect(path: str) -> bool:
    """Whether the file is R serialization, compressed by gzip or not."""
    try:
        with opener(path) as f:
            data = f.read(2)
            f.seek(0)
            data = gzip.GzipFile(fileobj=f).read(2) if data == b"\x1f\x8b" else data
    except (OSError, EOFError):
        return False
    return data in (b"X\n", b"A\n", b"B\n")


def dgc(x: pd.DataFrame, cells: list[str], genes: list[str]) -> r.S4:
    """A dgCMatrix (genes by cells) of entries."""
    x = x.sort_values([CELL, GENE])
    p = np.concatenate([[0], np.cumsum(np.bincount(x[CELL], minlength=len(cells)))])
    attrs = {"i": r.ints(x[GENE]), "p": r.ints(p), "Dim": r.ints([len(genes), len(cells)]), "Dimnames": r.Vector("list", [r.strings(*genes), r.strings(*cells)]), "x": r.doubles(x[VALUE]), "factors": r.Vector("list", [])}
    return r.S4(attrs | {"class": r.strings("dgCMatrix", package=r.strings("Matrix"))})


def dgc_of(x: DataFrame, cells: r.Vector, genes: r.Vector, folder: str, first: tuple[int, int] = (0, 0), columns: tuple[str, str] = (CELL, GENE)) -> r.S4:
    """The same of a table: sorted by executors, its vectors are files in a shared folder."""
    cell, gene = columns
    t = pieces.spill(x.select(F.col(cell).cast("long"), F.col(gene).cast("long"), F.col(VALUE).cast("double")), (cell, gene), folder)
    if len(t) and (t.least(cell) < first[0] or t.most(cell) >= first[0] + len(cells) or t.least(gene) < first[1] or t.most(gene) >= first[1] + len(genes)):
        raise ValueError(f"entries beyond {len(cells)} x {len(genes)}")
    if len(t) >= 2**31:
        raise ValueError(f"{len(t)} entries are more than a dgCMatrix has pointers for; write a bundle")
    vectors = {"i": r.Vector("integer", pieces.Column(t, gene, "<i4", first[1])), "p": r.Vector("integer", pieces.Pointers(t, cell, len(cells), first[0], "<i4")), "x": r.Vector("double", pieces.Column(t, VALUE, "<f8"))}
    attrs = {"i": vectors["i"], "p": vectors["p"], "Dim": r.ints([len(genes), len(cells)]), "Dimnames": r.Vector("list", [genes, cells]), "x": vectors["x"], "factors": r.Vector("list", [])}
    return r.S4(attrs | {"class": r.strings("dgCMatrix", package=r.strings("Matrix"))})


def entries(spark: SparkSession, m: r.S4) -> DataFrame:
    """cell_idx, gene_idx, value of a dgCMatrix (genes by cells) whose vectors are in files: ranges of its columns, by a task each."""
    n = int(m.attrs["Dim"].values[1])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in batch.column(0).to_pylist():
                for gene, cell, value in _slices(m, lo, min(n, lo + BLOCK)):
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype("i8")), pa.array(gene), pa.array(value, pa.float64())], names=[CELL, GENE, VALUE])

    return pieces.ranges(spark, n, BLOCK).mapInArrow(make, f"{CELL} long, {GENE} long, {VALUE} double")


def names_of(t: DataFrame, index: str, folder: str, label: str) -> r.Vector:
    """Names of rows in order, in files."""
    name = F.col(INDEX).cast("string") if INDEX in t.columns else F.concat(F.lit(f"{label}_"), (F.col(index) + 1).cast("string"))
    return r.Vector("character", pieces.Strings(pieces.spill(t.select(index, F.coalesce(name, F.lit("None")).alias("_label")), (index,), folder), "_label"))


def frame_of(t: DataFrame, index: str, rows: r.Vector, folder: str) -> r.Vector:
    """A data frame of a table's columns, in files; null is NA. Whole numbers beyond 32 bits become doubles."""
    kinds = {c: k for c, k in t.dtypes if c not in (index, INDEX)}
    whole = [c for c, k in kinds.items() if k in ("tinyint", "smallint", "int", "bigint")]
    found = t.agg(*[f(F.col(f"`{c}`")).alias(f"{n}{k}") for k, c in enumerate(whole) for n, f in (("lo", F.min), ("hi", F.max))]).first() if whole else None
    fits = {c: found[f"lo{k}"] is None or (found[f"lo{k}"] > -(2**31) and found[f"hi{k}"] < 2**31) for k, c in enumerate(whole)}
    columns, made = [], {}
    for k, (c, kind) in enumerate(kinds.items()):
        v = F.col(f"`{c}`")
        if kind in ("float", "double") or (kind in ("tinyint", "smallint", "int", "bigint") and not fits[c]):
            columns.append(F.coalesce(v.cast("double"), F.lit(float("nan"))).alias(f"c{k}"))
            made[c] = "double"
        elif kind == "boolean" or c in fits:
            columns.append(F.coalesce(v.cast("int"), F.lit(r.NA_INT)).alias(f"c{k}"))
            made[c] = "logical" if kind == "boolean" else "integer"
        else:
            columns += [F.coalesce(v.cast("string"), F.lit("")).alias(f"c{k}"), v.isNull().alias(f"m{k}")]
            made[c] = "character"
    of = pieces.spill(t.select(F.col(index).alias("_at"), *columns), ("_at",), folder)
    source = lambda k, kind: pieces.Strings(of, f"c{k}", f"m{k}") if kind == "character" else pieces.Column(of, f"c{k}", "<f8" if kind == "double" else "<i4")
    out = r.named({c: r.Vector(kind, source(k, kind)) for k, (c, kind) in enumerate(made.items())})
    out.attrs |= {"row.names": rows, "class": r.strings("data.frame")}
    return out


def shared(spark: SparkSession) -> str:
    """A new folder for the vectors of objects, which driver and executors open as files."""
    out = pieces.local(folders.new(spark))
    if "://" in out:
        raise ValueError(f"{out}: objects are made in a folder that driver and executors can open")
    return out


def to_object(ds: Dataset, kind: str = "seurat", most: int = 2**32) -> r.S4:
    """A Seurat object (Assay5) or a SingleCellExperiment, as ``rdata`` has it. Its vectors are files in a shared folder, made by executors.

    More than ``most`` entries (of X, layers, pairwise matrices and vectors) are an
    error. A Seurat object has loadings (varm) of reductions it has, and one image's coordinates; what the kind has no
    place for is named in a warning: layers of another extent than X, varp, and in a SingleCellExperiment obsp, varm and coordinates.
    """
    tables = [t for t in (ds.layers, ds.obsp, ds.varp) if t is not None]
    vectors = [t.select(F.sum(F.size("vec"))) for t in (ds.obsm, ds.varm) if t is not None]
    n = ds.x.count() + sum(t.count() for t in tables) + sum(int(t.first()[0] or 0) for t in vectors)
    left_out = [f"layer {k}" for k, v in ds.layer_dims.items() if tuple(v) != (ds.dims.n_cells, ds.dims.n_genes)] + (["varp"] if ds.varp is not None else [])
    if kind != "seurat":
        left_out += [name for name in ("obsp", "varm", "spatial") if getattr(ds, name) is not None]
    if n > most:
        raise ValueError(f"{n} entries are more than one file may have ({most}); write a bundle")
    folder, full = shared(ds.x.sparkSession), (ds.dims.n_cells, ds.dims.n_genes)
    cells, genes = names_of(ds.obs, CELL, folder, "Cell"), names_of(ds.var, GENE, folder, "Gene")
    if (len(cells), len(genes)) != full:
        raise ValueError(f"obs and var have {len(cells)} and {len(genes)} rows, X has shape {list(full)}")
    first = ds.dims.first_cell, ds.dims.first_gene
    matrices = {"counts": dgc_of(ds.x, cells, genes, folder, first)}
    if ds.layers is not None:
        matrices |= {k: dgc_of(ds.layers.where(F.col("layer") == k), cells, genes, folder, first) for k in sorted(ds.layer_dims) if tuple(ds.layer_dims[k]) == full and k != "counts"}
    meta = frame_of(ds.obs, CELL, cells, folder)

    def by_name(t: DataFrame | None, index: str) -> dict[str, pieces.Table]:
        found = [] if t is None else sorted(x[0] for x in t.select("name").distinct().collect())
        out = {k: pieces.spill(t.where(F.col("name") == k).select(index, F.col("vec").cast("array<double>")), (index,), folder) for k in found}
        for k, m in out.items():
            if m.least("vec") != m.most("vec"):
                raise ValueError(f"{k}: vectors of unlike lengths")
        return out

    vectors, loadings = by_name(ds.obsm, CELL), by_name(ds.varm, GENE) if kind == "seurat" else {}
    left_out += [f"varm {k}" for k in loadings if k not in vectors]
    if left_out:
        warnings.warn(f"a {kind} object has no place for {', '.join(left_out)}", stacklevel=2)
    width = lambda m: int(m.most("vec") or 0)
    dense = lambda m, rows, label: r.Vector("double", pieces.ByColumn(m, "vec", tuple(range(width(m)))), {"dim": r.ints([len(m), width(m)]), "dimnames": r.Vector("list", [rows, r.strings(*[f"{label}_{i + 1}" for i in range(width(m))])])})
    of = lambda name, package="SeuratObject": r.strings(name, package=r.strings(package))
    if kind == "seurat":
        features = r.S4({".Data": r.Vector("logical", np.ones(len(genes), np.int32)), "dim": r.ints([len(genes), 1]), "dimnames": r.Vector("list", [genes, r.strings("counts")]), "class": of("LogMap")})
        assay = r.S4({"layers": r.named(matrices), "features": features, "default": r.ints([1]), "key": r.strings("rna_"), "class": of("Assay5")})
        reductions = {k: r.S4({"cell.embeddings": dense(m, cells, k), **({"feature.loadings": dense(loadings[k], genes, k)} if k in loadings else {}), "assay.used": r.strings("RNA"), "key": r.strings(f"{k}_"), "class": of("DimReduc")}) for k, m in vectors.items()}
        name = ds.dims.active_assay or "RNA"
        graphs = {} if ds.obsp is None else {k: dgc_of(ds.obsp.where(F.col("name") == k), cells, cells, folder, columns=("j", "i")) for k in sorted(x[0] for x in ds.obsp.select("name").distinct().collect())}
        images = r.Vector("list", [])
        if ds.spatial is not None:
            where = pieces.spill(ds.spatial.select(CELL, F.col("coords").cast("array<double>").alias("vec")), (CELL,), folder)
            places = r.named({c: r.Vector("double", pieces.ByColumn(where, "vec", (k,))) for k, c in enumerate(("row", "col"))})
            places.attrs |= {"row.names": cells, "class": r.strings("data.frame")}
            images = r.named({"image": r.S4({"coordinates": places, "class": of("SlideSeq", "Seurat")})})
        out = r.S4({"assays": r.named({name: assay}), "meta.data": meta, "active.assay": r.strings(name), "graphs": r.named(graphs), "reductions": r.named(reductions), "images": images, "project.name": r.strings("dataset"), "version": r.Vector("list", [r.ints([5, 0, 0])]), "class": of("Seurat")})
    else:
        table_of = lambda v, n: r.S4({"rownames": n, "nrows": r.ints([len(n)]), "listData": v, "class": of("DFrame", "S4Vectors")})
        plain = r.Vector("list", meta.values, {"names": meta.attrs["names"]})
        reduced = table_of(r.named({k: dense(m, cells, k) for k, m in vectors.items()}), cells)
        assays = r.S4({"data": r.S4({"listData": r.named(matrices), "class": of("SimpleList", "S4Vectors")}), "class": of("SimpleAssays", "SummarizedExperiment")})
        out = r.S4({"int_colData": table_of(r.named({"reducedDims": reduced}), cells), "assays": assays, "colData": table_of(plain, cells), "NAMES": genes, "class": of("SingleCellExperiment", "SingleCellExperiment")})
    return out


def write(ds: Dataset, path: str, kind: str = "seurat", most: int = 2**32) -> None:
    """One RDS file of ``to_object``."""
    save(ds.x.sparkSession, to_object(ds, kind, most), path)


def save(spark: SparkSession, x: Any, path: str) -> None:
    """An object as one RDS file. Executors encode and deflate the vectors that are in files, as gzip members of their own; the driver puts them together."""
    folder, step = shared(spark), pieces.PIECE
    sources = _sources(x)
    work = [(i, lo, min(len(s), lo + step)) for i, (s, _) in sources.items() for lo in range(0, len(s), step)]

    def make(item: tuple) -> str:
        i, lo, hi = item
        source, kind = by_place[place[i]]
        name = f"{folder}/{uuid4().hex}"
        with gzip.GzipFile(name, "wb", 6, mtime=0) as f:
            for a in range(lo, hi, BLOCK):
                f.write(r.encoded(source.read(a, min(hi, a + BLOCK)), kind))
        return name

    place, by_place = {i: k for k, i in enumerate(sources)}, list(sources.values())
    parts: dict[int, list[bytes | str]] = {i: [] for i in sources}
    for (i, _, _), name in zip(work, pieces.run(spark, work, make), strict=True):
        parts[i].append(name)
    with open(pieces.local(path), "wb") as out:
        for part in r.pieces(x, parts):
            if isinstance(part, bytes):
                out.write(gzip.compress(part, 6, mtime=0))
            else:
                with open(part, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 22)
    pieces.gone(folder)
