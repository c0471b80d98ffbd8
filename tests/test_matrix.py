"""The matrix engine: known values, properties, and every registered query."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesserae.functions import dtypes, names, text
from tesserae.model import CELL, GENE, VALUE, Dataset, Dims
from tesserae.operators import aggregate, check, compare, diagnose, layers, layout, select, transform
from tesserae.sources import bundle, registry
from tesserae.streaming import running

X = "cell_idx long, gene_idx long, value double"


def coo(spark, rows):
    return spark.createDataFrame([(c, g, float(v)) for c, row in enumerate(rows) for g, v in enumerate(row) if v], X)


def dataset(spark, rows, **parts):
    n, m = len(rows), len(rows[0])
    obs = spark.createDataFrame([(i, f"Cell_{i}") for i in range(n)], "cell_idx long, _index string")
    var = spark.createDataFrame([(j, f"ENSG{j:05d}") for j in range(m)], "gene_idx long, ensembl_id string")
    return Dataset(coo(spark, rows), obs, var, Dims(n, m), **parts)


def values(x):
    return {(r[CELL], r[GENE]): r[VALUE] for r in x.collect()}


def test_normalise(spark):
    rng = random.Random(1)
    rows = [[rng.choice([0, 0, rng.uniform(0, 100)]) for _ in range(7)] for _ in range(9)] + [[0] * 7]
    got = values(transform.normalised(coo(spark, rows)))
    want = {(c, g): math.log(v * 10000 / sum(r) + 1) for c, r in enumerate(rows) for g, v in enumerate(r) if v}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_normalise_negative_values(spark):
    got = values(transform.normalised(spark.createDataFrame([(0, 0, 10001.0), (0, 1, -1.0), (1, 0, -3.0), (2, 0, 0.0), (3, 0, 20003.0), (3, 1, -3.0)], X)))
    assert got[0, 1] == float("-inf") and got[1, 0] == -3.0 and got[2, 0] == 0.0 and math.isnan(got[3, 1])


def test_variance_counts_every_cell(spark):
    rows = [[1, 0, 5], [3, 0, 0], [0, 0, 1]]
    ds = dataset(spark, rows)
    got = {r.gene_idx: r.variance for r in transform.gene_variances(ds.x, ds.var, ds.dims).collect()}
    assert got == pytest.approx({g: sum((r[g] - sum(q[g] for q in rows) / 3) ** 2 for r in rows) / 3 for g in range(3)})


@pytest.mark.parametrize("n", [1, 3, 7, 8, 19])
def test_top_genes(spark, n):
    ds = dataset(spark, [[(g + 1) * c for g in range(8)] for c in range(5)], layers=None)
    with pytest.warns(UserWarning) if n >= 8 else pytest.MonkeyPatch.context():
        got = transform.select_top_genes(ds, n)
    kept = min(n, 8)
    assert got.dims.n_genes == kept and sorted(r.ensembl_id for r in got.var.collect()) == [f"ENSG{g:05d}" for g in range(8 - kept, 8)]
    assert {k[1] for k in values(got.x)} == set(range(kept))


def test_top_genes_ties_go_to_the_lower_index(spark):
    ds = dataset(spark, [[1, 1, 0, 1], [0, 0, 0, 0]])
    assert [r.gene_idx for r in transform.top_genes(transform.gene_variances(ds.x, ds.var, ds.dims), 2).collect()] == [0, 1]
    with pytest.raises(ValueError):
        transform.select_top_genes(ds, 0)


def test_gene_ids(spark):
    ds = dataset(spark, [[1, 1, 1]] * 3)
    got = transform.use_gene_ids(ds, "ensembl_id")
    assert got.var.columns == ["gene_idx", "_index", "ensembl_id"] and all(r._index == r.ensembl_id for r in got.var.collect())
    again = transform.use_gene_ids(got.with_(var=got.var.withColumn("n", F.when(F.col(GENE) == 1, 5))), "n").var
    assert again.columns == ["gene_idx", "_index", "ensembl_id", "n"] and [r._index for r in again.orderBy(GENE).collect()] == ["", "5", ""]
    with pytest.raises(KeyError):
        transform.use_gene_ids(ds, "absent")


def test_selection_filters_everything_by_gene(spark):
    full = spark.createDataFrame([("a", 0, 1, 2.0), ("a", 1, 3, 4.0), ("b", 0, 0, 9.0)], "layer string, cell_idx long, gene_idx long, value double")
    varm = spark.createDataFrame([("PCs", g, [float(g)]) for g in range(4)], "name string, gene_idx long, vec array<double>")
    varp = spark.createDataFrame([("g", 1, 3, 1.0), ("g", 0, 1, 2.0)], "name string, i long, j long, value double")
    ds = dataset(spark, [[1, 2, 3, 4], [0, 1, 0, 5]], layers=full, layer_dims={"a": (2, 4), "b": (2, 1)}, varm=varm, varp=varp)
    got = select.keep_genes(ds, spark.createDataFrame([(3,), (1,)], "gene_idx long"))
    assert values(got.x) == {(0, 0): 2, (0, 1): 4, (1, 0): 1, (1, 1): 5}
    assert sorted(map(tuple, got.layers.collect())) == [("a", 0, 0, 2.0), ("a", 1, 1, 4.0), ("b", 0, 0, 9.0)] and got.layer_dims == {"a": (2, 2), "b": (2, 1)}
    assert [tuple(r) for r in got.varp.collect()] == [("g", 0, 1, 1.0)] and sorted(r.vec[0] for r in got.varm.collect()) == [1, 3]
    cells = select.keep_cells(ds, spark.createDataFrame([(1,)], "cell_idx long"))
    assert values(cells.x) == {(0, 1): 1, (0, 3): 5} and cells.dims.n_cells == 1 and cells.obs.first()._index == "Cell_1"


def test_renumbering_is_dense(spark):
    ids = random.Random(2).sample(range(-50, 10_000), 700)
    got = {r[0]: r[1] for r in select.renumbered(spark.createDataFrame([(i,) for i in ids + ids[:9]], "cell_idx long"), CELL).collect()}
    assert got == {v: i for i, v in enumerate(sorted(ids))}
    assert select.renumbered(spark.createDataFrame([], "cell_idx long"), CELL).count() == 0
    assert not select.is_contiguous(spark.createDataFrame([(1,), (3,)], "a long"), "a").first()[0] and select.is_contiguous(spark.createDataFrame([], "a long"), "a").first()[0]


def test_layouts_round_trip(spark):
    rows = [[1, 0, 2], [0, 3, 0]]
    x = coo(spark, rows)
    lines = {r.cell_idx: (r.indices, r.data) for r in layout.csr(x).collect()}
    assert lines == {0: ([0, 2], [1.0, 2.0]), 1: ([1], [3.0])}
    assert {r.gene_idx: (r.indices, r.data) for r in layout.csc(x).collect()} == {0: ([0], [1.0]), 1: ([1], [3.0]), 2: ([0], [2.0])}
    for there in (layout.unpacked(layout.csr(x), CELL, GENE), layout.unpacked(layout.csc(x), GENE, CELL), layout.transposed(layout.transposed(x)), layout.merged(layout.chunked(x, 1))):
        assert values(there) == values(x)
    dense = layout.dense_rows(x, spark.range(3).select(F.col("id").alias(CELL)), Dims(3, 3))
    assert {r.cell_idx: r.vec for r in dense.collect()} == {0: [1, 0, 2], 1: [0, 3, 0], 2: [0, 0, 0]} and values(layout.from_dense(dense)) == values(x)


def test_chunk_functions_see_chunks_in_order(spark):
    x = coo(spark, [[c * 3 + g + 1 for g in range(3)] for c in range(7)])
    got = layout.process_chunks(x, 3, lambda k, d: pd.DataFrame({"chunk": [k], "n": [len(d)], "first": [d[VALUE].iloc[0]]}), "chunk long, n long, first double").collect()
    assert sorted(map(tuple, got)) == [(0, 9, 1.0), (1, 9, 10.0), (2, 3, 19.0)]
    assert layout.map_batches(x, lambda d: d.assign(value=d[VALUE] * 2), X).agg(F.sum(VALUE)).first()[0] == 2 * sum(range(1, 22))


@pytest.mark.parametrize(("a", "b", "mse", "exact"), [([1, 2, 3], [2, 3, 4], 1, 0), ([0, 0], [3, 4], 12.5, 0), ([1, 2, 3, 4], [1, 2, 9, 9], 15.25, 0.5)])
def test_metrics_by_hand(spark, a, b, mse, exact):
    got = compare.matrix_accuracy(coo(spark, [a]), coo(spark, [b]), Dims(1, len(a))).first()
    assert (got.mse, got.exact) == (mse, exact)


def test_metrics_over_implicit_zeros(spark):
    rng = random.Random(3)
    a = [[rng.choice([0, 0, 1, 2.5]) for _ in range(6)] for _ in range(5)]
    b = [[rng.choice([v, v, 0, v + 1]) for v in r] for r in a]
    got = compare.matrix_accuracy(coo(spark, a), coo(spark, b), Dims(5, 6)).first()
    p, q = pd.Series(sum(a, [])), pd.Series(sum(b, []))
    assert got.pearson == pytest.approx(p.corr(q)) and got.mae == pytest.approx((p - q).abs().mean()) and got.max_error == (p - q).abs().max()
    assert got.mre == pytest.approx(((p - q).abs() / p)[p > 0].mean()) and got.exact == pytest.approx((p == q).mean())
    same = compare.meets(compare.matrix_accuracy(coo(spark, a), coo(spark, a), Dims(5, 6)), 1e-7).first()
    assert same.passed and same.pearson == pytest.approx(1) and same.exact == 1


def test_constant_and_empty_matrices(spark):
    one = lambda v: compare.matrix_accuracy(coo(spark, [[v, v]]), coo(spark, [[v, v]]), Dims(1, 2)).first()
    assert one(3).pearson == 1 and one(0).pearson == 1
    assert compare.matrix_accuracy(coo(spark, [[3, 3]]), coo(spark, [[4, 4]]), Dims(1, 2)).first().pearson == 0
    none = spark.createDataFrame([], X)
    got = compare.matrix_accuracy(none, none, Dims(0, 0)).first()
    assert (got.pearson, got.mse, got.sparsity_a) == (0, 0, 1)


@pytest.mark.parametrize(("a", "b", "ari", "nmi"), [("ABABC", "ABABC", 1, 1), ("AABB", "XYXY", -0.5, 0), ("AAA", "AAA", 1, 1), ("A", "B", 0, 1), ("AABBCC", "XXYYZZ", 1, 1)])
def test_label_agreement(spark, a, b, ari, nmi):
    got = compare.label_agreement(spark.createDataFrame(list(zip(a, b)), "a string, b string"), "a", "b").first()
    assert got.ari == pytest.approx(ari) and got.nmi == pytest.approx(nmi, abs=1e-12)


def test_dataset_comparison(spark):
    ds = dataset(spark, [[1, 0, 2], [0, 3, 0]])
    assert compare.compare(ds, ds).passed
    changed = ds.with_(x=ds.x.withColumn(VALUE, F.col(VALUE) + 1e-3), obs=ds.obs.withColumn("_index", F.when(F.col(CELL) == 0, None).otherwise(F.col("_index"))))
    report = compare.compare(ds, changed)
    assert report.failed_components == ["expression", "obs"] and report.max_difference == pytest.approx(1e-3) and "FAIL obs" in report.summary()
    assert not compare.compare(ds, ds, tolerance=0).passed  # strictly under the tolerance
    assert compare.compare(ds, ds.with_(obsm=spark.createDataFrame([("a", 0, [1.0])], "name string, cell_idx long, vec array<double>"))).failed_components == ["obsm"]


def test_checks(spark):
    bad = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (5, 0, 1.0), (0, -1, 1.0), (1, 1, None)], X)
    got = check.sparse_errors(bad, Dims(2, 2)).first().asDict()
    assert got == {"cell_out_of_bounds": 1, "gene_out_of_bounds": 1, "null_entries": 1, "duplicates": 1, "passed": False}
    with pytest.raises(ValueError, match="duplicates: 1"):
        check.require_sparse(bad, Dims(2, 2))
    ds = dataset(spark, [[1, 0], [0, 1]])
    assert check.require_sparse(ds.x, ds.dims) is ds.x and all(r.passed for r in check.dimensions(ds).collect())
    assert not all(r.passed for r in check.dimensions(ds.with_(dims=Dims(3, 2))).collect())
    assert check.required(ds) == [] and check.required(ds, "seurat") == ["no active assay"]


def test_schema(spark):
    ds = dataset(spark, [[0] * 10] * 5)
    given = check.CELLXGENE_V5_OBS[::2]
    got = check.schema(ds.with_(obs=ds.obs.withColumns({c: F.lit("val") for c in given})))
    assert got.missing_obs == tuple(c for c in check.CELLXGENE_V5_OBS if c not in given) and got.missing_var == ("feature_is_filtered",)
    whole = ds.with_(obs=ds.obs.withColumns({c: F.lit("val") for c in check.CELLXGENE_V5_OBS}), var=ds.var.withColumn("feature_is_filtered", F.lit(False)))
    assert check.schema(whole).passed and not check.schema(ds, "other").passed


def test_layers(spark):
    parts = spark.createDataFrame([("counts.10", 0, 0, 1.0), ("counts.2", 0, 1, 2.0), ("data.x", 1, 0, 3.0), ("plain", 0, 0, 4.0)], "layer string, cell_idx long, gene_idx long, value double")
    dims = {"counts.2": (3, 2), "counts.10": (4, 2), "data.x": (7, 2), "plain": (7, 2)}
    merged, out = layers.merge(parts, dims)
    assert sorted(map(tuple, merged.collect())) == [("counts", 0, 0, 1.0), ("counts", 4, 1, 2.0), ("data.x", 1, 0, 3.0), ("plain", 0, 0, 4.0)]  # "10" before "2"
    assert out == {"counts": (7, 2), "data.x": (7, 2), "plain": (7, 2)}
    padded, out = layers.pad(parts, dims)
    assert ("counts.2", 4, 1, 2.0) in set(map(tuple, padded.collect())) and out["counts.2"] == (7, 2)
    with pytest.raises(ValueError):
        layers.merge(parts, dims | {"counts.2": (3, 5)})
    assert layers.main_layer(["z", "data"]) == "data" and layers.main_layer(["z", "b"]) == "b"


def test_names():
    assert [names.sanitised(x) for x in ("a b", "a  /b", "9x", "", "a.b_", "né")] == ["a_b", "a_b", "X9x", "unnamed", "a.b", "né"]
    assert names.without_repeats(["a", "a", "b", "a"]) == ["a", "a_dup2", "b", "a_dup3"]
    assert names.truncated("é" * 129) == "é" * 128 and names.truncated("a" + "é" * 128).encode() == ("a" + "é" * 127).encode()


def test_diagnose(spark):
    ds = dataset(spark, [[1]])
    ds = ds.with_(obs=ds.obs.toDF(CELL, "_index").select(CELL, "_index", F.lit(1).alias("a b"), F.lit(2).alias("a/b"), F.lit(3).alias("7")))
    found = diagnose.issues(ds)
    assert diagnose.score(found) == 97 and {i.kind for i in found} == {"special_characters", "numeric_start"} and diagnose.convertible(found)
    clean = diagnose.clean(ds)
    assert clean.obs.columns == [CELL, "_index", "a_b", "a_b_dup2", "X7"] and clean.obs.first()["a_b_dup2"] == 2
    assert diagnose.read_audit(diagnose.audit(clean)) == list(clean.log) == diagnose.preview(ds)


def test_functions(spark):
    assert [text.size(n) for n in (5, 2048, 3 * 1024**3)] == ["5 B", "2.00 KB", "3.00 GB"] and text.number(1234567) == "1,234,567"
    got = dtypes.integers_restored(spark.createDataFrame([(1.0, 1.5, None, float(2**40))], "a double, b double, c double, d double"))
    assert [t for _, t in got.dtypes] == ["int", "double", "double", "double"]
    assert aggregate.estimate_memory(2, 3).total == 72 and aggregate.advise(aggregate.estimate_memory(2, 3), 10**6) == "fits"


def test_bundle(spark, tmp_path):
    ds = dataset(spark, [[1, 0, 2], [0, 3, 0]], uns={"k": [1, {"a": None}]})
    obs = bundle.with_categories(ds.obs.withColumn("kind", F.when(F.col(CELL) == 0, "b")), "kind", ["b", "unused", "a"])
    ds = ds.with_(obs=obs, obsm=spark.createDataFrame([("pca", 0, [1.0, 2.0]), ("pca", 1, [3.0, 4.0])], "name string, cell_idx long, vec array<double>"))
    bundle.write(ds, str(tmp_path / "d"))
    got = bundle.read(spark, str(tmp_path / "d"))
    assert compare.compare(ds, got).passed and got.dims == ds.dims and got.uns == ds.uns
    assert got.obs.schema["kind"].metadata["categories"] == ["b", "unused", "a"]
    assert [r.kind_code for r in bundle.codes(got.obs, "kind").orderBy(CELL).collect()] == [0, None] and [r.kind_code for r in bundle.codes(got.obs, "kind", "NA").orderBy(CELL).collect()] == [0, 3]
    part = bundle.read(spark, str(tmp_path / "d"), "metadata_only")
    assert part.obsm is None and part.x.count() == 0 and part.obs.count() == 2
    assert {r.part: r.rows for r in bundle.inspect(spark, str(tmp_path / "d")).collect()} == {"x": 3, "obs": 2, "var": 3, "obsm": 2}
    assert [r.c for r in bundle.decoded(spark.createDataFrame([(0, 1), (1, -1)], "i int, c int"), "c", ["u", "v"]).orderBy("i").collect()] == ["v", None]
    assert bundle.masked(spark.createDataFrame([(1, True)], "v int, m boolean"), "v", "m").first().v is None


def test_registry(tmp_path):
    r = registry.default()
    r.register(registry.Format("own", (".own",), detect=lambda p: p == "x"))
    assert r.detect("A.SCE.RDS").name == "sce" and r.detect("b.rds").name == "seurat" and r.detect("x").name == "own" and r.detect("y") is None
    assert "bundle" in r and r.readable() == r.writable() == ["bundle", "h5ad", "loom", "sce", "seurat"] and r.list() == ["bundle", "h5ad", "loom", "own", "sce", "seurat"]
    with pytest.raises(KeyError):
        r.get("absent")


def test_running_totals(spark, tmp_path):
    folder = str(tmp_path / "in")
    coo(spark, [[1, 2], [0, 3]]).write.parquet(folder)
    go = lambda: running.keep_totals(running.arriving(spark, folder), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
    go()
    coo(spark, [[0, 4], [5, 0]]).write.mode("append").parquet(folder)
    go()
    last = spark.read.parquet(str(tmp_path / "out"))
    last = last.where(F.col("batch") == last.agg(F.max("batch")).first()[0])
    assert {r.cell_idx: (r.nnz, r.total) for r in last.collect()} == {0: (3, 7.0), 1: (2, 8.0)}


def test_dense_rows_stay_in_workers(spark, monkeypatch):
    """Dense totals and entries, a cell without entries and a NaN among them, without an array of a whole row in the JVM."""
    from tesserae.model import Dims
    from tesserae.operators import layout

    x = spark.createDataFrame([(5, 3, 2.0), (5, 4, float("nan")), (7, 3, 0.0), (7, 6, 1.5)], "cell_idx long, gene_idx long, value double")
    cells, d = spark.createDataFrame([(5,), (6,), (7,)], "cell_idx long"), Dims(3, 4, first_cell=5, first_gene=3)
    monkeypatch.setattr(layout, "dense_rows", lambda *_: 1 / 0)
    assert sorted(str(tuple(r)) for r in layout.dense_entries(x, cells, d).collect()) == ["(5, 3, 2.0)", "(5, 4, nan)", "(7, 6, 1.5)"]
    assert sorted(str(tuple(r)) for r in layout.dense_totals(x, cells, d).collect()) == ["(5, nan, 2)", "(6, 0.0, 4)", "(7, 1.5, 3)"]


def test_dense_rows_share_a_block(spark):
    """Rows as wide as a block, one after the other in the same memory: none has another's values."""
    from tesserae.model import Dims
    from tesserae.operators import layout

    width = 1 << 17
    x = spark.createDataFrame([(c, (c * 7919) % width, float(c + 1)) for c in range(12)], "cell_idx long, gene_idx long, value double")
    cells = spark.range(13).select(F.col("id").alias(CELL)).coalesce(1)
    assert values(layout.dense_entries(x, cells, Dims(13, width))) == values(x)
    assert {r.cell_idx: (r.total, r.zeros) for r in layout.dense_totals(x, cells, Dims(13, width)).collect()} == {c: (c + 1.0, width - 1) for c in range(12)} | {12: (0.0, width)}


def test_split_layers_are_dense_in_workers_only(spark):
    """Layers of another extent as dense rows, without an array of a whole row in the JVM: a cell without entries, a NaN, and none at all."""
    from tesserae.operators import layers, layout

    t = spark.createDataFrame([("a", 0, 0, 1.0), ("w", 0, 3, 2.0), ("w", 2, 1, float("nan")), ("v", 1, 0, 4.0)], "layer string, cell_idx long, gene_idx long, value double")
    dims, schema = {"a": (3, 3), "w": (3, 4), "v": (2, 1)}, "cell_idx long, gene_idx long, value double"
    got = layers.over_split(t, dims, (3, 3), layout.nonzero(), schema)
    assert sorted(str(tuple(r)) for r in got.collect()) == ["('X_v', 1, 0, 4.0)", "('X_w', 0, 3, 2.0)", "('X_w', 2, 1, nan)"]
    width = layers.over_split(t, dims, (3, 3), lambda cell, rows: {"cell_idx": cell, "n": rows.shape[1] + 0 * cell}, "cell_idx long, n long")
    assert sorted(map(tuple, width.collect())) == [("X_v", 0, 1), ("X_v", 1, 1), ("X_w", 0, 4), ("X_w", 1, 4), ("X_w", 2, 4)]
    assert layers.over_split(t, {"a": (3, 3)}, (3, 3), layout.nonzero(), schema).isEmpty()
