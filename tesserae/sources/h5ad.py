"""H5AD files (annotated matrices in HDF5): a data source ``format("h5ad")``, reading by component, and a writer that streams.

Reading opens the file's headers once, on the driver; every component is a lazy DataFrame whose partitions are ranges of rows, read on
executors. The path is one that all machines reach (a mounted folder, or a store that pyarrow knows). Known are sparse and dense matrices,
tables with plain, categorical (old and new) and nullable columns, and the compound tables of files before 0.7.

Writing sorts rows by ranges on executors, which deflate the chunks of the arrays, too (``pieces``); the driver writes the headers and copies the executors' files
into the one file, so executors reach the target's folder as well.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.model import CELL, GENE, INDEX, VALUE, Dataset, Dims
from tesserae.sources import arrays, hdf5, pieces
from tesserae.sources.bundle import PARTS, PRESETS, with_categories

#: Encodings of the format.
ENCODINGS = {"anndata": "0.1.0", "dataframe": "0.2.0", "csr_matrix": "0.1.0", "array": "0.2.0", "string-array": "0.2.0", "categorical": "0.2.0", "nullable-integer": "0.1.0", "nullable-boolean": "0.1.0", "nullable-string-array": "0.1.0", "dict": "0.1.0", "numeric-scalar": "0.2.0"}
MEMBERS = {"layers": ("layer", (CELL, GENE, VALUE)), "obsp": ("name", ("i", "j", VALUE)), "varp": ("name", ("i", "j", VALUE))}


def encoding(kind: str, **more) -> dict:
    return {"encoding-type": kind, "encoding-version": ENCODINGS[kind], **more}


def _table(file: hdf5.File, path: str, index: str) -> tuple[str, dict, dict[str, tuple[list[str], bool]]]:
    """Schema, description and category lists of obs or var."""
    node = file[path]
    fields, categories = [], {}
    if isinstance(node, hdf5.Dataset):  # a compound of old files
        names = list(node.kind.fields)
        own = "index" if "index" in names else names[0]
        for name in [own, *(n for n in names if n != own)]:
            c = {"how": "field", "field": name, "as": INDEX if name == own else name, "type": arrays.column_type(node.kind.fields[name])}
            listed = f"uns/{name}_categories"
            if name != own and listed in file:
                c |= {"categories": listed, "type": arrays.column_type(file[listed].kind)}
                categories[name] = ([str(x) for x in file[listed].read().tolist()], False)
            fields.append(c)
        rows = len(node)
    else:
        own = arrays.text(node.attrs.get("_index", "_index"))
        order = [arrays.text(x) for x in np.asarray(node.attrs.get("column-order", [])).reshape(-1).tolist()]
        names = [n for n in order if n in node] + [n for n in node.keys() if n not in order and n not in (own, "__categories")]
        rows = len(node[own]) if own in node else max((_length(node[n]) for n in names), default=0)
        fields.append({"how": "plain", "path": f"{path}/{own}", "as": INDEX, "type": "string"} if own in node else {"how": "place", "as": INDEX, "type": "string"})
        for name in names:
            member, c = node[name], {"as": name, "path": f"{path}/{name}"}
            if isinstance(member, hdf5.Group) and "codes" in member:
                c |= {"how": "codes", "path": f"{path}/{name}/codes", "categories": f"{path}/{name}/categories", "type": arrays.column_type(member["categories"].kind)}
                categories[name] = ([str(x) for x in member["categories"].read().tolist()], bool(member.attrs.get("ordered", False)))
            elif isinstance(member, hdf5.Group) and "values" in member:
                c |= {"how": "masked", "type": arrays.column_type(member["values"].kind)}
            elif isinstance(member, hdf5.Group):
                continue  # of a kind that tables don't have
            elif "categories" in member.attrs:  # codes that point to their list
                listed = file.at(int(member.attrs["categories"]))
                c |= {"how": "codes", "at": listed.at, "type": arrays.column_type(listed.kind)}
                categories[name] = ([str(x) for x in listed.read().tolist()], bool(np.asarray(listed.attrs.get("ordered", False)).reshape(-1)[0]))
            else:
                if len(member.shape or ()) != 1:
                    continue
                c |= {"how": "plain", "type": arrays.column_type(member.kind)}
            fields.append(c)
    schema = ", ".join([f"`{index}` bigint", *(f"`{c['as']}` {c['type']}" for c in fields)])
    return schema, {"what": "table", "path": path, "fields": fields, "rows": rows, "index": index, "width": len(fields) + 1}, categories


def _length(node) -> int:
    return len(node) if isinstance(node, hdf5.Dataset) else len(node["codes"] if "codes" in node else node["values"]) if "codes" in node or "values" in node else 0


def _vectors(file: hdf5.File, group: str, index: str) -> dict[str, tuple[str, dict]]:
    out, node, schema = {}, file[group], f"name string, {index} bigint, vec array<double>"
    columns = ["name", index, "vec"]
    if isinstance(node, hdf5.Dataset):  # a compound of old files
        for name, kind in node.kind.fields.items():
            out[f"{group}/{name}"] = schema, {"what": "vectors", "path": group, "field": name, "name": name, "rows": len(node), "columns": columns, "width": int(np.prod(kind.dtype.shape, dtype=np.int64)), "shape": [len(node), int(np.prod(kind.dtype.shape, dtype=np.int64))]}
        return out
    for name in node.keys():
        member = node[name]
        if isinstance(member, hdf5.Dataset) and len(member.shape or ()) == 2:
            out[f"{group}/{name}"] = schema, {"what": "vectors", "path": f"{group}/{name}", "name": name, "rows": len(member), "columns": columns, "width": member.shape[1], "shape": list(member.shape)}
    return out


def parts(file: hdf5.File) -> tuple[dict[str, tuple[str, dict]], dict[str, dict], list[dict]]:
    """Schema and description of every component, category lists of obs and var, and what was left out.

    Layers that haven't X's shape and pairwise matrices that aren't square are errors; members of varm that
    don't fit are left out.
    """
    out: dict[str, tuple[str, dict]] = {}
    categories: dict[str, dict] = {}
    log: list[dict] = []
    for name, index in (("obs", CELL), ("var", GENE)):
        if name in file:
            schema, d, categories[name] = _table(file, name, index)
            out[name] = schema, d
    n, m = (out[k][1]["rows"] if k in out else None for k in ("obs", "var"))
    if "X" in file and not (isinstance(file["X"], hdf5.Dataset) and file["X"].shape is None):
        d = arrays.matrix_of(file["X"], "X")
        if [n, m] != d["shape"] and None not in (n, m):
            raise ValueError(f"X has shape {d['shape']}, obs and var have {n} and {m} rows")
        out["x"] = f"{CELL} bigint, {GENE} bigint, {VALUE} double", d | {"columns": [CELL, GENE, VALUE]}
        n, m = d["shape"]
    for group, (key, columns) in MEMBERS.items():
        if group not in file:
            continue
        side = {"obsp": n, "varp": m}.get(group)
        for name in file[group].keys():
            d = arrays.matrix_of(file[f"{group}/{name}"], f"{group}/{name}")
            want = [n, m] if side is None else [side, side]
            if d["shape"] != want:
                raise ValueError(f"{group}/{name} has shape {d['shape']}, not {want}")
            out[f"{group}/{name}"] = f"{key} string, {columns[0]} bigint, {columns[1]} bigint, {VALUE} double", d | {"name": name, "key": key, "columns": list(columns)}
    for group, index, extent in (("obsm", CELL, n), ("varm", GENE, m)):
        for path, (schema, d) in (_vectors(file, group, index) if group in file else {}).items():
            if path == "obsm/spatial":
                out["spatial"] = f"{CELL} bigint, coords array<double>", {k: v for k, v in d.items() if k != "name"} | {"columns": [CELL, "coords"]}
            elif d["rows"] != extent:
                if group == "obsm":
                    raise ValueError(f"{path} has {d['rows']} rows, not {extent}")
                log.append({"left_out": path, "why": f"{d['rows']} rows, not {extent}"})
            else:
                out[path] = schema, d
    return out, categories, log


class H5ad(arrays.PartSource):
    """``spark.read.format("h5ad").option("component", "obs").load(path)`` once registered; components are those of ``parts``."""

    @classmethod
    def name(cls) -> str:
        return "h5ad"

    def parts(self, file: hdf5.File) -> dict[str, tuple[str, dict]]:
        return parts(file)[0]


def spatial_of(file: hdf5.File) -> dict:
    """uns["spatial"]: for each library, its scale factors and its images (shape, dtype, base64 of the values)."""
    out: dict = {}
    if "uns/spatial" not in file:
        return out
    for library in file["uns/spatial"].keys():
        group, own = file[f"uns/spatial/{library}"], out.setdefault(library, {"images": {}, "scalefactors": {}})
        for key in group["images"].keys() if "images" in group else ():
            image = group[f"images/{key}"].read()
            own["images"][key] = {"shape": list(image.shape), "dtype": image.dtype.str, "data": base64.b64encode(np.ascontiguousarray(image).tobytes()).decode()}
        for key in group["scalefactors"].keys() if "scalefactors" in group else ():
            own["scalefactors"][key] = float(group[f"scalefactors/{key}"].scalar())
    return out


def image(stored: dict) -> np.ndarray:
    """An image of ``spatial_of`` as an array."""
    return np.frombuffer(base64.b64decode(stored["data"]), stored["dtype"]).reshape(stored["shape"])


def read(spark: SparkSession, path: str, wanted: tuple[str, ...] | str = PARTS, rows: int = arrays.ROWS) -> Dataset:
    """The dataset, or the parts of it that are named (or those of a preset); each a lazy table of ``rows`` rows of the file a partition."""
    wanted = PRESETS[wanted] if isinstance(wanted, str) else wanted
    with hdf5.File(path) as file:
        found, categories, log = parts(file)
        spatial = spatial_of(file) if "spatial" in wanted else {}
    tables: dict[str, DataFrame] = {}
    extents = {}
    for name, part in found.items():
        group, _, member = name.partition("/")
        if group == "layers":
            extents[member] = tuple(part[1]["shape"])
        if group in wanted:
            table = arrays.load(spark, H5ad, path, part, rows)
            for column, (listed, ordered) in categories.get(group, {}).items():
                table = with_categories(table, column, listed, ordered)
            tables[group] = tables[group].unionByName(table) if group in tables else table
    for name, schema in (("x", f"{CELL} long, {GENE} long, {VALUE} double"), ("obs", f"{CELL} long, {INDEX} string"), ("var", f"{GENE} long, {INDEX} string")):
        tables.setdefault(name, spark.createDataFrame([], schema))
    shape = found["x"][1]["shape"] if "x" in found else [found[k][1]["rows"] if k in found else 0 for k in ("obs", "var")]
    return Dataset(dims=Dims(*shape, source_format="h5ad"), layer_dims={k: v for k, v in extents.items() if "layers" in wanted}, uns={"spatial": spatial} if spatial else {}, log=tuple(log), **tables)


def inspect(path: str) -> dict[str, dict]:
    """Of every component: how it is stored, its rows and, where it is a matrix or vectors, its shape; entries if they are counted in the header. No data is read."""
    with hdf5.File(path) as file:
        found = parts(file)[0]
    return {k: {"stored": d["what"], "rows": d["rows"], "shape": d.get("shape"), "entries": d.get("stored"), "columns": len(d["fields"]) if "fields" in d else None} for k, (_, d) in found.items()}


def detect(path: str) -> bool:
    """Whether the file is HDF5 and has what an annotated matrix has."""
    try:
        with hdf5.File(path) as file:
            return "X" in file or ("obs" in file and "var" in file)
    except (ValueError, OSError, NotImplementedError):
        return False


# writing


def blocks(df: DataFrame, order: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows in order, block by block: sorted by ranges on executors, then taken partition by partition."""
    from tesserae.operators.select import ordered_blocks

    return ordered_blocks(df, order)


class SparseWriter:
    """A CSR group that rows are appended to in order.

    A chunk has to start at the row after the last one, and ``finish`` at the number of rows that was announced; both are errors otherwise.
    """

    def __init__(self, writer: hdf5.Writer, path: str, shape: tuple[int, int], progress: Callable[[int, int], None] | None = None):
        self.path, self.shape, self.writer, self.progress = path, shape, writer, progress
        writer.group(path, **encoding("csr_matrix", shape=np.array(shape, np.int64)))
        self.data, self.indices = writer.appender(f"{path}/data", "f8"), writer.appender(f"{path}/indices", "i8" if shape[1] > 2**31 else "i4")
        self.indptr = writer.appender(f"{path}/indptr", "i8")
        self.indptr.append(np.zeros(1, np.int64))
        self.rows = self.stored = 0

    def write_chunk(self, start: int, counts: np.ndarray, indices: np.ndarray, data: np.ndarray) -> None:
        """Rows [start, start + len(counts)), with so many entries each."""
        if start != self.rows:
            raise ValueError(f"{self.path}: a chunk that starts at row {start} came where row {self.rows} was due")
        if int(counts.sum()) != len(data):
            raise ValueError(f"{self.path}: {len(data)} entries where rows have {int(counts.sum())}")
        self.indices.append(indices)
        self.data.append(data)
        self.indptr.append(self.stored + np.cumsum(counts))
        self.stored += len(data)
        self.rows += len(counts)
        if self.progress:
            self.progress(self.rows, self.shape[0])

    def finish(self) -> None:
        if self.rows != self.shape[0]:
            raise ValueError(f"{self.path}: {self.rows} rows were written, {self.shape[0]} were announced")
        for array in (self.data, self.indices, self.indptr):
            array.close(**encoding("array"))


def _write_matrix(writer: hdf5.Writer, path: str, entries: DataFrame, i: str, j: str, shape: tuple[int, int], first: tuple[int, int], progress=None) -> None:
    folder = pieces.scratch(writer)
    t = pieces.spill(entries.select(F.col(i).cast("long"), F.col(j).cast("long"), F.col(VALUE).cast("double")), (i, j), folder)
    if len(t) and (t.least(i) < first[0] or t.most(i) >= first[0] + shape[0] or t.least(j) < first[1] or t.most(j) >= first[1] + shape[1]):
        raise ValueError(f"{path}: entries beyond {shape[0]} x {shape[1]}")
    writer.group(path, **encoding("csr_matrix", shape=np.array(shape, np.int64)))
    data, indices, pointers = (f"{path}/{k}" for k in ("data", "indices", "indptr"))
    # data last, as progress is told by it
    arrays_of = {indices: pieces.Column(t, j, "<i8" if shape[1] > 2**31 else "<i4", first[1]), pointers: pieces.Pointers(t, i, shape[0], first[0]), data: pieces.Column(t, VALUE, "<f8")}
    told = 0

    def heard(at: str, n: int) -> None:
        nonlocal told
        if progress and at == data and n < len(t) and (row := int(t.read(i, n, n + 1)[0]) - first[0]) > told:
            told = row
            progress(row, shape[0])

    pieces.write(entries.sparkSession, writer, arrays_of, folder, dict.fromkeys(arrays_of, encoding("array")), heard=heard)
    if progress:
        progress(shape[0], shape[0])
    pieces.gone(folder)


def _write_table(writer: hdf5.Writer, path: str, table: DataFrame, index: str, rows: int) -> None:
    """Columns by type: numbers and booleans (nullable where there are nulls), text, categories of columns that have a list."""
    names = [c for c in table.columns if c not in (index, INDEX)]
    listed = {f.name: f.metadata["categories"] for f in table.schema.fields if f.metadata and "categories" in f.metadata}
    ordered = {f.name: bool(f.metadata.get("ordered")) for f in table.schema.fields if f.metadata}
    nulls = table.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in names]).first().asDict() if names else {}
    label = F.col(INDEX) if INDEX in table.columns else F.col(index).cast("string")
    kinds, columns = dict(table.dtypes), [F.coalesce(label, F.lit("")).alias("_label")]
    writer.group(path, **encoding("dataframe", **{"_index": INDEX, "column-order": np.array(names, object) if names else np.zeros(0)}))
    #: by path in the file: the column it is of, its type
    made: dict[str, tuple[str, str]] = {f"{path}/{INDEX}": ("_label", "string")}
    for k, c in enumerate(names):
        column, base = F.col(f"`{c}`"), f"{path}/{c}"
        kind = kinds[c] if kinds[c] in arrays.ARROW else "double" if kinds[c].startswith("decimal") else "string"
        if c in listed:
            column = F.coalesce(F.array_position(F.array(*map(F.lit, listed[c])).cast("array<string>"), column.cast("string")) - 1, F.lit(-1)).cast("int")
            writer.group(base, **encoding("categorical", ordered=ordered.get(c, False)))
            writer.array(f"{base}/categories", np.array(listed[c], object), **encoding("string-array"))
            made[f"{base}/codes"] = f"c{k}", "tinyint" if len(listed[c]) < 128 else "int"
        else:
            empty = F.lit("") if kind == "string" else F.lit(False) if kind == "boolean" else F.lit(float("nan") if kind in ("float", "double") else 0).cast(kind)
            if nulls[c] and kind not in ("float", "double"):
                writer.group(base, **encoding("nullable-string-array" if kind == "string" else "nullable-boolean" if kind == "boolean" else "nullable-integer"))
                made |= {f"{base}/values": (f"c{k}", kind), f"{base}/mask": (f"m{k}", "boolean")}
                columns.append(column.isNull().alias(f"m{k}"))
            else:
                made[base] = f"c{k}", kind
            column = F.coalesce(column.cast(kind), empty)
        columns.append(column.alias(f"c{k}"))
    folder = pieces.scratch(writer)
    t = pieces.spill(table.select(F.col(f"`{index}`").alias("_at"), *columns), ("_at",), folder)
    if len(t) != rows:
        raise ValueError(f"{path} has {len(t)} rows, not {rows}")
    of = {at: pieces.stored(t, c, kind) for at, (c, kind) in made.items() if kind != "string"}
    found = pieces.texts(table.sparkSession, writer, t, [c for c, kind in made.values() if kind == "string"], folder)
    of |= {at: found[c] for at, (c, kind) in made.items() if kind == "string"}
    pieces.write(table.sparkSession, writer, of, folder, {at: encoding("string-array" if kind == "string" else "array") for at, (_, kind) in made.items()}, 1 << 14)
    pieces.gone(folder)


def _write_vectors(writer: hdf5.Writer, path: str, table: DataFrame, index: str, vec: str, rows: int) -> None:
    folder = pieces.scratch(writer)
    t = pieces.spill(table.select(F.col(index).alias("_at"), F.col(vec).cast("array<double>").alias("vec")), ("_at",), folder)
    if not len(t):
        return pieces.gone(folder)
    if t.least("vec") != t.most("vec"):
        raise ValueError(f"{path}: vectors of unlike lengths")
    if len(t) != rows:
        raise ValueError(f"{path} has {len(t)} rows, not {rows}")
    pieces.write(table.sparkSession, writer, {path: pieces.Column(t, "vec", "<f8")}, folder, {path: encoding("array")})
    pieces.gone(folder)


def write(ds: Dataset, path: str, progress: Callable[[int, int], None] | None = None) -> None:
    """The dataset as one file. ``progress(rows written, rows)`` is called as X is written.

    Layers of X's extent are layers; a layer of another extent is kept dense, as ``obsm/X_<name>`` if it has a row for each cell, else it is an
    error. Indices begin at 0 in the file.
    """
    d = ds.dims
    cells, genes, shape = d.first_cell, d.first_gene, (d.n_cells, d.n_genes)
    with hdf5.Writer(path) as writer:
        writer.group("", **encoding("anndata"))
        for group in ("layers", "obsm", "obsp", "varm", "varp", "uns"):
            writer.group(group, **encoding("dict"))
        _write_matrix(writer, "X", ds.x, CELL, GENE, shape, (cells, genes), progress)
        _write_table(writer, "obs", ds.obs, CELL, d.n_cells)
        _write_table(writer, "var", ds.var, GENE, d.n_genes)
        split = []
        for name, extent in sorted(ds.layer_dims.items()):
            rows = ds.layers.where(F.col("layer") == name)
            if tuple(extent) == shape:
                _write_matrix(writer, f"layers/{name}", rows, CELL, GENE, shape, (cells, genes))
            elif extent[0] == shape[0]:
                split.append(name)
                _write_dense(writer, f"obsm/X_{name}", rows, CELL, GENE, tuple(extent), (cells, genes))
            else:
                raise ValueError(f"layer {name} has {extent[0]} rows, X has {shape[0]}")
        if split:
            writer.array("uns/layers_of_other_extent", np.array(split, object), **encoding("string-array"))
        for group, index, table, rows in (("obsm", CELL, ds.obsm, d.n_cells), ("varm", GENE, ds.varm, d.n_genes)):
            for name in _names(table):
                _write_vectors(writer, f"{group}/{name}", table.where(F.col("name") == name), index, "vec", rows)
        for group, table, n in (("obsp", ds.obsp, d.n_cells), ("varp", ds.varp, d.n_genes)):
            for name in _names(table):
                _write_matrix(writer, f"{group}/{name}", table.where(F.col("name") == name), "i", "j", (n, n), (0, 0))
        if ds.spatial is not None:
            _write_vectors(writer, "obsm/spatial", ds.spatial, CELL, "coords", d.n_cells)
        for library, own in (ds.uns.get("spatial") or {}).items():
            writer.group(f"uns/spatial/{library}", **encoding("dict"))
            for key, stored in own.get("images", {}).items():
                writer.array(f"uns/spatial/{library}/images/{key}", image(stored), **encoding("array"))
            for key, value in own.get("scalefactors", {}).items():
                writer.array(f"uns/spatial/{library}/scalefactors/{key}", np.float64(value), **encoding("numeric-scalar"))


def _names(table: DataFrame | None) -> list[str]:
    return [] if table is None else sorted(r[0] for r in table.select("name").distinct().collect())  # members of a part


def _write_dense(writer: hdf5.Writer, path: str, entries: DataFrame, i: str, j: str, shape: tuple[int, int], first: tuple[int, int], encoded: bool = True) -> None:
    """A dense array of zeros and entries, in tiles that executors make."""
    pieces.dense(writer, path, entries.select(F.col(i).cast("long"), F.col(j).cast("long"), F.col(VALUE).cast("double")), shape, first, encoding("array") if encoded else {})
