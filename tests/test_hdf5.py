"""HDF5 files, H5AD and Loom, conversions, hints."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import api, cli
from tesserae.functions import hints
from tesserae.model import CELL, GENE, Dataset, Dims
from tesserae.sources import bundle, convert, h5ad, hdf5, loom, rds, registry


def test_arrays_round_trip(tmp_path):
    path, rng = str(tmp_path / "a.h5"), np.random.default_rng(1)
    words = [f"wörd{i}" * (i % 5) for i in range(5000)]
    with hdf5.Writer(path) as w:
        w.group("", **{"kind": "test", "n": 3, "list": np.array([1.5, 2.5]), "names": np.array(["a", "é"], object)})
        for kind in ("i1", "u2", "i4", "i8", "f4", "f8"):
            w.array(f"plain/{kind}", np.arange(10).astype(kind))
        w.array("words", words)
        w.array("flags", np.array([True, False]))
        grown = w.appender("grown", "i8", chunk=100)
        for i in range(60):
            grown.append(np.arange(i * 333, (i + 1) * 333))
        grown.close(unit="s")
        table = w.appender("table", "f8", (7,), chunk=16)
        table.append(np.arange(700.0).reshape(100, 7))
        table.close()
        text = w.appender("text", object, chunk=16)
        text.append(np.array(words[:50], object))
        text.close()
        w.compound("rows", {"index": ["x", "y"], "n": np.array([1, 2], "i4"), "v": np.array([[1.0, 2], [3, 4]])})
        for i in range(300):
            w.array(f"many/c{i}", np.array([i]))
        w.text("one", "hello")
        w.array("none", np.zeros((0, 3)))
        w.array("cube", rng.normal(size=(4, 3, 2)))
    with hdf5.File(path) as f:
        assert f.root.attrs["kind"] == "test" and f.root.attrs["n"] == 3 and f.root.attrs["list"].tolist() == [1.5, 2.5] and f.root.attrs["names"].tolist() == ["a", "é"]
        assert all((f[f"plain/{k}"].read() == np.arange(10)).all() and f[f"plain/{k}"].kind.dtype.str[1:] == k for k in f["plain"].keys())
        assert f["words"].read().tolist() == words and f["words"].read(7, 9).tolist() == words[7:9] and f["flags"].read().tolist() == [True, False]
        assert (f["grown"].read() == np.arange(19980)).all() and (f["grown"].read(15001, 15203) == np.arange(15001, 15203)).all() and f["grown"].attrs == {"unit": "s"}
        assert (f["table"].read(30, 55) == np.arange(700.0).reshape(100, 7)[30:55]).all() and f["text"].read(14, 18).tolist() == words[14:18]
        rows = f["rows"]
        assert f.field(rows.kind, rows.raw(), "index").tolist() == ["x", "y"] and f.field(rows.kind, rows.raw(), "v").tolist() == [[1, 2], [3, 4]]
        assert len(f["many"].keys()) == 300 and f["many/c250"].read().tolist() == [250] and f["one"].scalar() == "hello" and f["none"].read().shape == (0, 3)
        assert f["cube"].read().shape == (4, 3, 2) and "many/c301" not in f and f.get("nothing") is None
        with pytest.raises(KeyError):
            f["many/nothing"]
    (tmp_path / "b.h5").write_bytes(b"no such file" * 100)
    with pytest.raises(ValueError):
        hdf5.File(str(tmp_path / "b.h5"))


def test_rows_read_only_their_chunks(tmp_path, monkeypatch):
    path = str(tmp_path / "a.h5")
    with hdf5.Writer(path) as w:
        a = w.appender("a", "f8", chunk=1000)
        a.append(np.random.default_rng(0).normal(size=200_000))
        a.close()
    with hdf5.File(path) as f:
        a, read = f["a"], []
        whole = f._read
        monkeypatch.setattr(f, "_read", lambda at, n, **k: read.append(n) or whole(at, n, **k))
        a.read(150_000, 150_010)
        assert sum(read) < 40_000 < os.path.getsize(path) / 20


def test_filters():
    data = np.arange(100, dtype="<i4").tobytes()
    shuffled = np.frombuffer(data, np.uint8).reshape(100, 4).T.tobytes()
    assert hdf5._unfiltered(shuffled + b"abcd", [(hdf5.SHUFFLE, [4]), (hdf5.FLETCHER, [])], 0, 4) == data
    assert hdf5._lzf(bytes([2]) + b"abc" + bytes([0x20, 2]) + bytes([0xE0, 1, 0]), 0) == b"abcabc" + b"c" * 10
    with pytest.raises(NotImplementedError):
        hdf5._unfiltered(b"", [(99, [])], 0, 1)


def full(spark, n=40, m=9):
    """A dataset with every part, of n cells and m genes, made by rule."""
    cells, genes = spark.range(n).withColumnRenamed("id", CELL), spark.range(m).withColumnRenamed("id", GENE)
    x = cells.crossJoin(genes).where((F.col(CELL) * 7 + F.col(GENE)) % 5 == 0).withColumn("value", (F.col(CELL) + F.col(GENE) / 10 + 1).cast("double"))
    obs = cells.select(CELL, F.concat(F.lit("c"), F.col(CELL)).alias("_index"), (F.col(CELL) / 3).alias("number"), F.when(F.col(CELL) % 4 != 0, F.col(CELL) * 2).alias("some"), F.when(F.col(CELL) % 3 != 0, F.lit("é")).alias("text"), (F.col(CELL) % 2 == 0).alias("flag"), F.element_at(F.array(F.lit("b"), F.lit("a"), F.lit(None)), (F.col(CELL) % 3 + 1).cast("int")).alias("kind"))
    obs = bundle.with_categories(obs, "kind", ["b", "a", "unused"], True)
    var = genes.select(GENE, F.concat(F.lit("g"), F.col(GENE)).alias("_index"), F.col(GENE).cast("int").alias("rank"))
    vec = lambda t, i, k, name: t.select(F.lit(name).alias("name"), i, F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: (F.col(i) * j).cast("double")).alias("vec"))
    pairs = lambda t, i, name, k: t.select(F.lit(name).alias("name"), F.col(i).alias("i"), ((F.col(i) * 3 + 1) % k).alias("j"), (F.col(i) + 0.5).alias("value"))
    layers = x.select(F.lit("twice").alias("layer"), CELL, GENE, (F.col("value") * 2).alias("value"))
    image = np.arange(24, dtype="f4").reshape(2, 4, 3)
    import base64

    spatial = {"lib": {"images": {"hires": {"shape": [2, 4, 3], "dtype": "<f4", "data": base64.b64encode(image.tobytes()).decode()}}, "scalefactors": {"spot": 1.5}}}
    return Dataset(x, obs, var, Dims(n, m), layers, {"twice": (n, m)}, vec(cells, CELL, 3, "X_pca"), vec(genes, GENE, 2, "PCs"), pairs(cells, CELL, "near", n), pairs(genes, GENE, "like", m), vec(cells, CELL, 2, "s").select(CELL, F.col("vec").alias("coords")), {"spatial": spatial})


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("per", [7, 1000])
def test_h5ad_round_trip(spark, tmp_path, per):
    ds, path, heard = full(spark), str(tmp_path / "a.h5ad"), []
    h5ad.write(ds, path, progress=lambda done, of: heard.append((done, of)))
    assert heard[-1] == (40, 40) and [d for d, _ in heard] == sorted(d for d, _ in heard)
    back = h5ad.read(spark, path, rows=per)
    for name, table in ds.parts().items():
        assert rows(getattr(back, name)) == rows(table), name
    assert back.dims == Dims(40, 9, source_format="h5ad") and back.layer_dims == {"twice": (40, 9)} and back.uns == ds.uns
    assert back.x.rdd.getNumPartitions() == (6 if per == 7 else 1)
    assert back.obs.schema["kind"].metadata == {"categories": ["b", "a", "unused"], "ordered": True}
    assert dict(back.obs.dtypes) == dict(ds.obs.dtypes) and dict(back.var.dtypes) == dict(ds.var.dtypes)
    assert (h5ad.image(back.uns["spatial"]["lib"]["images"]["hires"]) == np.arange(24).reshape(2, 4, 3)).all()
    few = h5ad.read(spark, path, "metadata_only")
    assert few.obsm is None and few.x.count() == 0 and few.obs.count() == 40 and (few.dims.n_cells, few.dims.n_genes) == (40, 9)
    found = h5ad.inspect(path)
    assert found["x"] == {"stored": "sparse", "rows": 40, "shape": [40, 9], "entries": ds.x.count(), "columns": None} and found["obs"]["columns"] == 6 and found["varm/PCs"]["shape"] == [9, 2]
    spark.dataSource.register(h5ad.H5ad)
    assert rows(spark.read.format("h5ad").option("component", "obsp/near").option("rows", 11).load(path)) == rows(ds.obsp)


def test_h5ad_of_other_programs(spark, tmp_path):
    """CSC, dense X, old categories, compound tables, members that don't fit."""
    path = str(tmp_path / "old.h5ad")
    dense = np.array([[1, 0, 2.0], [0, 3, 0]])
    with hdf5.Writer(path) as w:
        w.array("X", dense)
        w.compound("obs", {"index": ["c0", "c1"], "n": np.array([5, 6], "i4"), "kind": np.array([1, -1], "i1")})
        w.array("uns/kind_categories", ["p", "q"])
        w.compound("var", {"index": ["g0", "g1", "g2"]})
        w.compound("obsm", {"X_pca": np.array([[1.0, 2], [3, 4]])})
        w.array("varm/bad", np.zeros((2, 2)))
    ds = h5ad.read(spark, path)
    assert sorted(map(tuple, ds.x.collect())) == [(0, 0, 1.0), (0, 2, 2.0), (1, 1, 3.0)]
    assert [tuple(r) for r in ds.obs.orderBy(CELL).collect()] == [(0, "c0", 5, "q"), (1, "c1", 6, None)] and ds.var.count() == 3
    assert [r.vec for r in ds.obsm.orderBy(CELL).collect()] == [[1, 2], [3, 4]] and ds.varm is None and ds.log[0]["left_out"] == "varm/bad"

    path = str(tmp_path / "csc.h5ad")
    with hdf5.Writer(path) as w:
        w.group("X", **{"h5sparse_format": "csc", "h5sparse_shape": np.array([2, 3])})
        for name, values in (("data", np.array([1, 3, 2], "f4")), ("indices", np.array([0, 1, 0], "i4")), ("indptr", np.array([0, 1, 2, 3], "i4"))):
            w.array(f"X/{name}", values)
        listed = w.array("obs/__categories/kind", ["p", "q"], ordered=True)
        w.group("obs", **{"_index": "id", "column-order": np.array(["kind", "n"], object)})
        w.array("obs/id", ["c0", "c1"])
        w.array("obs/kind", np.array([1, -1], "i1"), categories=listed)
        w.array("obs/n", np.array([5, 6], "u1"))
        w.group("var", **{"_index": "id"})
        w.array("var/id", ["g0", "g1", "g2"])
    ds = h5ad.read(spark, path, rows=2)
    assert sorted(map(tuple, ds.x.collect())) == [(0, 0, 1.0), (0, 2, 2.0), (1, 1, 3.0)] and ds.x.rdd.getNumPartitions() == 2
    assert [tuple(r) for r in ds.obs.orderBy(CELL).collect()] == [(0, "c0", "q", 5), (1, "c1", None, 6)]
    assert ds.obs.schema["kind"].metadata == {"categories": ["p", "q"], "ordered": True} and dict(ds.obs.dtypes)["n"] == "smallint"

    for group, values in (("layers/l", np.zeros((3, 3))), ("obsp/p", np.zeros((2, 3))), ("obsm/o", np.zeros((3, 1)))):
        path = str(tmp_path / f"{group.replace('/', '')}.h5ad")
        with hdf5.Writer(path) as w:
            w.array("X", dense)
            w.array(group, values)
        with pytest.raises(ValueError, match=group):
            h5ad.read(spark, path)


def test_chunks_have_to_come_in_order(tmp_path):
    with hdf5.Writer(str(tmp_path / "a.h5")) as w:
        out = h5ad.SparseWriter(w, "X", (4, 3))
        out.write_chunk(0, np.array([1, 0]), np.array([2]), np.array([1.0]))
        with pytest.raises(ValueError, match="starts at row 3"):
            out.write_chunk(3, np.array([1]), np.array([0]), np.array([1.0]))
        with pytest.raises(ValueError, match="entries where rows have"):
            out.write_chunk(2, np.array([2]), np.array([0]), np.array([1.0]))
        with pytest.raises(ValueError, match="2 rows were written"):
            out.finish()
        out.write_chunk(2, np.array([0, 1]), np.array([0]), np.array([5.0]))
        out.finish()


def test_layers_of_other_extents(spark, tmp_path):
    ds, path = full(spark), str(tmp_path / "a.h5ad")
    narrow = ds.layers.where("gene_idx < 4").withColumn("layer", F.lit("narrow"))
    h5ad.write(ds.with_(layers=ds.layers.unionByName(narrow), layer_dims={**ds.layer_dims, "narrow": (40, 4)}), path)
    back = h5ad.read(spark, path)
    assert list(back.layer_dims) == ["twice"]
    got = back.obsm.where("name = 'X_narrow'").select(CELL, F.posexplode("vec").alias(GENE, "value")).where("value <> 0")
    assert rows(got.withColumn(GENE, F.col(GENE).cast("long"))) == rows(narrow.drop("layer"))
    with pytest.raises(ValueError):
        h5ad.write(ds.with_(layer_dims={"twice": (41, 9)}), str(tmp_path / "b.h5ad"))
    with pytest.raises(ValueError):
        h5ad.write(ds.with_(dims=Dims(39, 9)), str(tmp_path / "c.h5ad"))


@pytest.mark.parametrize("per", [2, None])
def test_loom_round_trip(spark, tmp_path, per):
    ds, path = full(spark), str(tmp_path / "a.loom")
    loom.write(ds, path)
    back = loom.read(spark, path, per)
    for name in ("x", "layers", "obsm", "varm", "obsp", "varp"):
        assert rows(getattr(back, name)) == rows(getattr(ds, name)), name
    assert rows(back.obs.select(CELL, "_index", "number", "kind")) == rows(ds.obs.select(CELL, "_index", "number", F.coalesce("kind", F.lit("")).alias("kind")))
    assert back.dims == Dims(40, 9, source_format="loom", source_version="3.0.0")
    with hdf5.Writer(str(tmp_path / "b.loom")) as w:
        w.array("matrix", np.array([[1.0, 0], [0, 2], [3, 0]]))
        w.array("layers/bad", np.zeros((2, 2)))
        w.array("col_attrs/_X", np.array([1.0, 2]))
        w.array("col_attrs/_Y", np.array([3.0, 4]))
        w.array("col_graphs/knn/a", np.array([0, 1, 7]))
        w.array("col_graphs/knn/b", np.array([1, 0, 0]))
    ds = loom.read(spark, str(tmp_path / "b.loom"))
    assert sorted(map(tuple, ds.x.collect())) == [(0, 0, 1.0), (0, 2, 3.0), (1, 1, 2.0)] and ds.log[0]["left_out"] == "layers/bad"
    assert [(r.name, r.vec) for r in ds.obsm.orderBy(CELL).collect()] == [("X_umap", [1, 3]), ("X_umap", [2, 4])]
    assert sorted(map(tuple, ds.obsp.collect())) == [("knn", 0, 1, 1.0), ("knn", 1, 0, 1.0)]


def test_conversions(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    ds, heard = full(spark), []
    few = ds.with_(varp=None, varm=None, obs=ds.obs.drop("kind", "flag", "text", "some"))
    rds.write(few, at("a.rds"))
    convert.convert(spark, at("a.rds"), at("b.h5ad"), lambda *x: heard.append(x))
    convert.convert(spark, at("b.h5ad"), at("c.h5ad"))
    convert.convert(spark, at("c.h5ad"), at("d.rds"), lambda *x: heard.append(x))
    assert heard[-1] == (40, 40)
    for name in ("b.h5ad", "c.h5ad", "d.rds"):
        report = api.validate(spark, at("a.rds"), at(name))
        assert report.passed, report.summary()
    assert rows(rds.read(spark, at("d.rds")).spatial) == rows(ds.spatial)
    with pytest.raises(ValueError):
        convert.convert(spark, at("a.rds"), at("b.what"))


def test_formats_by_content(spark, tmp_path):
    ds, known = full(spark), registry.default()
    for name in ("h5ad", "loom"):
        known.get(name).write(ds, str(tmp_path / f"x.{name}"))
        os.rename(tmp_path / f"x.{name}", tmp_path / f"{name}.data")
    rds.write(ds.with_(varp=None), str(tmp_path / "seurat.data"))
    (tmp_path / "none.data").write_bytes(b"nothing")
    assert [known.detect(str(tmp_path / f"{n}.data")).name for n in ("h5ad", "loom", "seurat")] == ["h5ad", "loom", "seurat"]
    assert known.detect(str(tmp_path / "none.data")) is None


def test_hints(tmp_path, capsys):
    assert hints.kind_of(FileNotFoundError("x")) == "file_not_found" and hints.kind_of(ValueError("5 entries are more than one file may have (4)")) == "out_of_memory"
    assert hints.kind_of(ValueError("a is no HDF5 file")) == "invalid_h5ad" and hints.kind_of(KeyError("var has no column 'x'")) == "missing_field"
    assert hints.kind_of(ValueError("X has shape [1, 2], obs and var have 3 and 4 rows")) == "dimension_mismatch" and hints.hint(RuntimeError("what")) is None
    assert hints.explained(RuntimeError("what")) == "what" and "Hint: " in hints.explained(MemoryError("x"))
    (tmp_path / "bad.h5ad").write_bytes(b"nothing at all")
    assert cli.main(["inspect", str(tmp_path / "bad.h5ad")]) == 2 and "Hint: " in capsys.readouterr().err


def test_api(spark, tmp_path, capsys):
    path = str(tmp_path / "a.h5ad")
    api.write_h5ad(full(spark), path)
    ds = api.read_h5ad(spark, path, normalize=True, top_genes=4, gene_id_column="rank")
    assert ds.dims.n_genes == 4 and all(len(r._index) == 1 for r in ds.var.collect()) and ds.x.agg(F.max("value")).first()[0] < 10
    assert api.inspect(spark, path)["parts"]["x"]["shape"] == [40, 9] and set(api.formats()) == {"bundle", "h5ad", "loom", "sce", "seurat"}
    api.write_rds(full(spark).with_(varp=None), str(tmp_path / "a.rds"))
    assert cli.main(["simplify-seurat", str(tmp_path / "a.rds"), str(tmp_path / "b.rds")]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"cells": 40, "genes": 9}
    assert api.validate(spark, str(tmp_path / "a.rds"), str(tmp_path / "b.rds")).passed
    assert cli.main(["convert", path, str(tmp_path / "c.loom")]) == 0 and api.read_loom(spark, str(tmp_path / "c.loom")).dims.n_cells == 40


def test_writer_keeps_rows_off_the_driver(spark, tmp_path, monkeypatch):
    """Arrays of many pieces, made by executors: no block of rows comes to the driver."""
    from pyspark.sql import functions as F

    from tesserae.model import Dataset, Dims
    from tesserae.operators import select
    from tesserae.sources import h5ad, pieces

    monkeypatch.setattr(select, "ordered_blocks", lambda *_: 1 / 0)
    monkeypatch.setattr(pieces, "PIECE", 1 << 15)
    n = 70_000
    x = spark.range(n).selectExpr("id % 7000 AS cell_idx", "id div 7000 * 3 AS gene_idx", "cast(id AS double) AS value").where("cell_idx <> 5")
    obs = spark.range(7000).select(F.col("id").alias("cell_idx"), F.concat(F.lit("é"), "id").alias("_index"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("word"), F.when(F.col("id") % 3 == 0, F.col("id").cast("int")).alias("number"))
    var = spark.range(30).select(F.col("id").alias("gene_idx"), F.concat(F.lit("g"), "id").alias("_index"))
    obsm = spark.range(7000).select(F.lit("two").alias("name"), F.col("id").alias("cell_idx"), F.array(F.col("id").cast("double"), F.lit(0.5)).alias("vec"))
    heard = []
    h5ad.write(Dataset(x, obs, var, Dims(7000, 30), obsm=obsm), f"{tmp_path}/a.h5ad", lambda *a: heard.append(a))
    back = h5ad.read(spark, f"{tmp_path}/a.h5ad", rows=999)
    for a, b in ((x, back.x), (obs.select(back.obs.columns), back.obs.withColumn("number", F.col("number").cast("int"))), (var, back.var), (obsm, back.obsm)):
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert heard[-1] == (7000, 7000) and [h[0] for h in heard] == sorted({h[0] for h in heard}) and len(heard) > 1
    assert [p.name for p in tmp_path.iterdir()] == ["a.h5ad"]


@pytest.mark.parametrize("shape", [(7, 5000), (900, 3), (3000, 2000)])
def test_dense_arrays_are_tiles_that_executors_make(spark, tmp_path, monkeypatch, shape):
    """Tiles without an entry are not stored, rows do not go through the driver, and what comes back is the same, from any range of rows."""
    from pyspark.sql import functions as F

    from tesserae.operators import select
    from tesserae.sources import arrays, h5ad, pieces

    monkeypatch.setattr(select, "ordered_blocks", lambda *_: 1 / 0)
    monkeypatch.setattr(pieces, "PIECE", 64)
    rng = np.random.default_rng(1)
    at = np.unique(np.concatenate([rng.integers(0, shape[0] * shape[1], 300), [shape[0] * shape[1] - 1]]))
    want = sorted((int(k) // shape[1], int(k) % shape[1], float(n + 1)) for n, k in enumerate(at))
    path = str(tmp_path / "x.h5")
    with hdf5.Writer(path) as w:
        entries = spark.createDataFrame([(i + 2, j + 1, v) for i, j, v in want], "cell_idx long, gene_idx long, value double")
        h5ad._write_dense(w, "X", entries, "cell_idx", "gene_idx", shape, (2, 1))
        h5ad._write_dense(w, "none", entries.where(F.lit(False)), "cell_idx", "gene_idx", shape, (2, 1))
    with hdf5.File(path) as f:
        x, d = f["X"], arrays.matrix_of(f["X"], "X")
        assert x.shape == shape and d["values"] <= shape[0] * shape[1] and not f["none"].read().any() and f["none"].stored_values() == 0
        dense = np.zeros(shape)
        for i, j, v in want:
            dense[i, j] = v
        assert (x.read() == dense).all()
        cuts = [0, shape[0] // 3, shape[0] // 3 + 1, shape[0]]
        assert (np.concatenate([x.read(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]) == dense).all()
        got = [(int(i), int(j), float(v)) for a, b in zip(cuts, cuts[1:], strict=False) for row, column, value in arrays.entries(f, d, a, b) for i, j, v in zip(row, column, value, strict=True)]
        assert sorted(got) == want
        if shape[0] * shape[1] > 1 << 20:  # fewer tiles than the matrix has
            assert len(list(x.nonzero(0, shape[0]))) >= 1 and (tmp_path / "x.h5").stat().st_size < 1 << 18
    with pytest.raises(ValueError), hdf5.Writer(path) as w:
        h5ad._write_dense(w, "X", entries, "cell_idx", "gene_idx", (shape[0], shape[1] - 1), (2, 1))


def test_tiles_of_one_entry_need_no_deflater(monkeypatch):
    """Of a matrix with few entries tiles are small, and those of one entry are put together as whole arrays."""
    import zlib

    from tesserae.sources import pieces

    assert pieces.tile_of((120_000, 900_000), 3_600_000) == (1, 128)
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.standard_normal(60), [np.inf, np.nan, -0.0, 5e-324]])
    for size in (1, 7, 128):
        for place in range(size):
            want = np.zeros((len(values), size))
            want[:, place] = values
            assert [zlib.decompress(x.tobytes()) for x in pieces.single(place, size, values)] == [x.tobytes() for x in want]
    key = np.sort(rng.integers(0, 5000, 3000))
    place, value = rng.integers(0, 128, 3000), rng.random(3000)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    want = np.zeros((len(begin), 128))
    want[np.searchsorted(key[begin], key), place] = value
    asked, deflate = [], zlib.compress
    monkeypatch.setattr(zlib, "compress", lambda *x: asked.append(1) or deflate(*x))
    data, starts, lengths = pieces.deflated(begin, place, value, 128, 1)
    assert len(asked) == int((np.diff(np.append(begin, 3000)) > 1).sum()) and not (starts % 8).any()
    assert [zlib.decompress(data[a : a + n].tobytes()) for a, n in zip(starts, lengths, strict=True)] == [x.tobytes() for x in want]


def test_loom_parts_are_written_at_the_same_time(spark, tmp_path, monkeypatch):
    """Attributes of rows and of columns wait for each other; a part that fails is an error once all have ended."""
    import threading

    from tesserae.sources import pieces

    both, attributes, path = threading.Barrier(2, timeout=30), loom._write_attributes, str(tmp_path / "a.loom")
    monkeypatch.setattr(loom, "_write_attributes", lambda *a: (both.wait(), attributes(*a)))
    ds = full(spark)
    loom.write(ds, path)
    back = loom.read(spark, path)
    assert back.dims.n_cells == 40 and back.x.exceptAll(ds.x).isEmpty() and ds.x.exceptAll(back.x).isEmpty()
    assert [p.name for p in tmp_path.iterdir()] == ["a.loom"]
    ended = []
    with pytest.raises(ZeroDivisionError):
        pieces.together(spark, [lambda: 1 / 0, lambda: ended.append(spark.range(3).count())])
    assert ended == [3] and pieces.together(spark, [lambda k=k: k for k in range(20)]) == list(range(20))


def test_threads_put_arrays_into_one_file(spark, tmp_path):
    from tesserae.sources import pieces

    arrays_of = {f"g{k % 3}/a{k}": np.arange(k * 50, dtype="i8") for k in range(1, 60)}
    with hdf5.Writer(str(tmp_path / "a.h5")) as w:
        pieces.together(spark, [lambda k=k, v=v: w.array(k, v) for k, v in arrays_of.items()])
    with hdf5.File(str(tmp_path / "a.h5")) as f:
        assert all((f[k].read() == v).all() and len(f[k]) == len(v) for k, v in arrays_of.items())
