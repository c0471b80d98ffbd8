"""Seurat and SingleCellExperiment objects, there and back."""

import numpy as np
import pandas as pd
import pytest

from tesserae.model import Dataset, Dims
from tesserae.operators import compare
from tesserae.sources import rdata as r
from tesserae.sources import rds


@pytest.fixture
def ds(spark):
    x = spark.createDataFrame([(0, 0, 1.0), (0, 2, 2.0), (2, 1, 3.5)], "cell_idx long, gene_idx long, value double")
    obs = spark.createDataFrame([(0, "c0", 1, 0.5, "a", True), (1, "c1", None, None, None, None), (2, "c2", 3, 2.5, "b", False)], "cell_idx long, _index string, n int, score double, kind string, ok boolean")
    var = spark.createDataFrame([(i, f"g{i}") for i in range(3)], "gene_idx long, _index string")
    obsm = spark.createDataFrame([("pca", i, [float(i), -1.0]) for i in range(3)], "name string, cell_idx long, vec array<double>")
    obsp = spark.createDataFrame([("nn", 0, 1, 0.5), ("nn", 2, 0, 1.0)], "name string, i long, j long, value double")
    full = spark.createDataFrame([("data", 1, 1, 7.0)], "layer string, cell_idx long, gene_idx long, value double")
    return Dataset(x, obs, var, Dims(3, 3, active_assay="RNA"), full, {"data": (3, 3)}, obsm, obsp=obsp)


@pytest.mark.parametrize("kind", ["seurat", "sce"])
def test_round_trip(spark, tmp_path, ds, kind):
    path = str(tmp_path / "x.rds")
    rds.write(ds, path, kind)
    got = rds.read(spark, path)
    if kind == "sce":
        assert got.obsp is None
        ds = ds.with_(obsp=None)
        assert [x[1] for x in got.var.orderBy("gene_idx").collect()] == ["g0", "g1", "g2"]
    else:
        assert got.dims.active_assay == "RNA" and got.dims.source_version == "V5"
    report = compare.compare(ds, got.with_(obs=got.obs.select(ds.obs.columns)))
    assert report.passed, report.summary()
    with pytest.raises(ValueError):
        rds.write(ds, path, kind, most=1)


def test_split_layers_and_factors(spark, tmp_path):
    """A V5 object whose counts are split over two layers, with a factor in its metadata."""
    part = lambda rows, n: rds.dgc(pd.DataFrame(rows, columns=["cell_idx", "gene_idx", "value"]), [f"c{i}" for i in range(n)], ["g0", "g1"])
    matrices = r.named({"counts.10": part([(0, 0, 1.0)], 2), "counts.2": part([(0, 1, 2.0)], 1), "scale.data": None})
    of = lambda n: r.strings(n, package=r.strings("SeuratObject"))
    kind = r.ints([2, r.NA_INT, 1], levels=r.strings("u", "v"))
    kind.attrs["class"] = r.strings("factor")
    meta = r.named({"kind": kind, "flag": r.Vector("logical", np.array([1, r.NA_INT, 0], np.int32))})
    meta.attrs |= {"row.names": r.strings("a", "b", "c"), "class": r.strings("data.frame")}
    x = r.S4({"assays": r.named({"RNA": r.S4({"layers": matrices, "class": of("Assay5")})}), "meta.data": meta, "active.assay": r.strings("RNA"), "class": of("Seurat")})
    path = tmp_path / "x.rds"
    path.write_bytes(r.dumps(x))
    got = rds.read(spark, str(path))
    assert sorted(map(tuple, got.x.collect())) == [(0, 0, 1.0), (2, 1, 2.0)] and (got.dims.n_cells, got.dims.n_genes) == (3, 2)
    assert [tuple(v) for v in got.obs.orderBy("cell_idx").select("_index", "kind", "flag").collect()] == [("a", "v", True), ("b", None, None), ("c", "u", False)]
    kept = rds.read(spark, str(path), keep_layers=True)
    assert set(kept.layer_dims.values()) | {(kept.dims.n_cells, kept.dims.n_genes)} == {(3, 2)}
    assert rds.version(x) == "V5" and rds.kind_of(x) == "seurat"
    with pytest.raises(ValueError):
        rds.kind_of(r.S4({"class": r.strings("lm")}))


@pytest.mark.parametrize("kind", ["seurat", "sce"])
def test_objects_keep_rows_off_the_driver(spark, tmp_path, ds, kind, monkeypatch):
    """Objects and files are made of executors' pieces, and entries come back from them."""
    from tesserae.sources import pieces

    monkeypatch.setattr(type(ds.x), "toPandas", lambda _: 1 / 0)
    monkeypatch.setattr(pieces, "PIECE", 2)
    x = rds.to_object(ds, kind)
    assert rds.from_object(spark, x).x.exceptAll(ds.x).isEmpty()
    m = rds.dgc_of(ds.x, rds.names_of(ds.obs, "cell_idx", str(tmp_path), "c"), rds.names_of(ds.var, "gene_idx", str(tmp_path), "g"), str(tmp_path))
    assert sorted(map(tuple, rds.entries(spark, m).collect())) == [(0, 0, 1.0), (0, 2, 2.0), (2, 1, 3.5)]
    rds.save(spark, x, str(tmp_path / "x.rds"))
    got = rds.read(spark, str(tmp_path / "x.rds"))
    assert sorted(map(tuple, got.x.collect())) == [(0, 0, 1.0), (0, 2, 2.0), (2, 1, 3.5)]
    assert [tuple(v) for v in got.obs.orderBy("cell_idx").select("_index", "n", "score", "kind", "ok").collect()] == [("c0", 1, 0.5, "a", True), ("c1", None, None, None, None), ("c2", 3, 2.5, "b", False)]


def test_streams_keep_long_vectors_in_files(tmp_path, monkeypatch):
    """Of a stream only a window is held; what it gives equals the object that is read as a whole."""
    import io

    from tesserae.sources import pieces

    monkeypatch.setattr(r, "LONG", 3)
    monkeypatch.setattr(r, "WINDOW", 16)
    texts = [f"c{i}" for i in range(200)] + [None, "", "é" * 40, "a", None] + ["same"] * 70
    x = r.named({"n": r.ints(range(100)), "d": r.doubles([0.5, float("nan"), 1.0, 2.0]), "s": r.strings(*texts), "short": r.strings("u", None), "b": r.Vector("logical", np.array([1, r.NA_INT, 0], np.int32))})
    for data in (r.dumps(x), r.dumps(x, compress=False)):
        got = r.load(io.BytesIO(data), pieces.Kept(str(tmp_path)))
        assert [isinstance(v.values, pieces.Source) for v in got.values] == [True, True, True, False, True]
        assert got["s"].values.load() == texts and got["s"].values.read(198, 207) == texts[198:207] and got["short"].values == ["u", None]
        assert got["n"].values.read(5, 8).tolist() == [5, 6, 7] and np.array_equal(got["d"].values.load(), x["d"].values, equal_nan=True)
        assert got["b"].values.load().tolist() == [1, r.NA_INT, 0]
        with pytest.raises(EOFError):
            r.load(io.BytesIO(r.dumps(x, compress=False)[:-40]), pieces.Kept(str(tmp_path)))
    latin = r.dumps(r.strings(*["a", "b", "c", "d"]), compress=False).replace((r.CHAR | 64 << 12).to_bytes(4, "big") + b"\0\0\0\1c", (r.CHAR | 4 << 12).to_bytes(4, "big") + b"\0\0\0\1\xe9")
    assert r.load(io.BytesIO(latin), pieces.Kept(str(tmp_path))).values.load() == ["a", "b", "é", "d"]


def test_long_objects_are_read_in_ranges(spark, tmp_path, monkeypatch):
    """Vectors beyond the threshold, of a file and of an object in memory, factors and nulls among them; no row is parsed on the driver, none loaded as a whole."""
    from tesserae.sources import pieces

    n = r.LONG + 900
    m = rds.dgc(pd.DataFrame({"cell_idx": range(n), "gene_idx": [i % 2 for i in range(n)], "value": [float(i) for i in range(n)]}), [f"c{i}" for i in range(n)], ["g0", "g1"])
    of = lambda k: r.strings(k, package=r.strings("SeuratObject"))
    kind = r.ints([r.NA_INT if i % 3 == 0 else 1 + i % 2 for i in range(n)], levels=r.strings("u", "v"))
    kind.attrs["class"] = r.strings("factor")
    meta = r.named({"kind": kind, "a, b": r.strings(*[None if i % 5 == 0 else f"t{i}" for i in range(n)]), "d": r.doubles([float("nan") if i % 7 == 0 else i for i in range(n)])})
    meta.attrs |= {"row.names": r.strings(*[f"r{i}" for i in range(n)]), "class": r.strings("data.frame")}
    emb = r.S4({"cell.embeddings": r.doubles(range(2 * n), dim=r.ints([n, 2])), "class": of("DimReduc")})
    x = r.S4({"assays": r.named({"RNA": r.S4({"layers": r.named({"counts": m}), "class": of("Assay5")})}), "meta.data": meta, "active.assay": r.strings("RNA"), "reductions": r.named({"two": emb}), "class": of("Seurat")})
    path = tmp_path / "x.rds"
    path.write_bytes(r.dumps(x))
    monkeypatch.setattr(pieces.Source, "load", lambda _: 1 / 0)
    for got in (rds.read(spark, str(path)), rds.from_object(spark, x)):
        assert sorted(map(tuple, got.x.collect())) == [(i, i % 2, float(i)) for i in range(n)]
        want = [(f"r{i}", None if i % 3 == 0 else "uv"[i % 2], None if i % 5 == 0 else f"t{i}", None if i % 7 == 0 else float(i)) for i in range(n)]
        assert [tuple(v) for v in got.obs.orderBy("cell_idx").select("_index", "kind", "`a, b`", "d").collect()] == want
        assert [tuple(v) for v in got.obsm.orderBy("cell_idx").select("name", "vec").collect()] == [("two", [float(i), float(n + i)]) for i in range(n)]
        assert got.layers is None and got.varm is None and got.spatial is None
