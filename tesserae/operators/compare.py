"""Comparison of two datasets, part by part.

Matrices are aligned by index in one full outer join of stored entries. The pairs that are zero on both sides
are not rows of it, so counts and means use the extents: N = cells x genes, and N less the joined rows pairs are 0, 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.model import CELL, GENE, VALUE, Dataset, Dims

#: Difference of equal doubles, least size for a relative error, share of variance that counts as none.
EPSILON, RELATIVE_FROM, CONSTANT = 2.220446049250313e-16, 1e-10, 1e-10


def paired(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = (CELL, GENE)) -> DataFrame:
    """keys, a, b (zero where one has no entry), in_a, in_b."""
    left = a.select(*keys, F.col(VALUE).alias("a"), F.lit(True).alias("in_a"))
    right = b.select(*keys, F.col(VALUE).alias("b"), F.lit(True).alias("in_b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    there = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return left.join(right, list(keys), "full_outer").select(*keys, zero("a"), zero("b"), there("in_a"), there("in_b"))


def _pearson(n: Column) -> Column:
    """From sums over the stored pairs and n pairs in all; 1 if both are constant and equal, 0 if either is constant or there is none."""
    sa, sb = (F.coalesce(F.sum(c), F.lit(0.0)) for c in "ab")
    saa, sbb, sab = (F.coalesce(F.sum(F.col(p) * F.col(q)), F.lit(0.0)) for p, q in ("aa", "bb", "ab"))
    va, vb, cov = saa - sa * sa / n, sbb - sb * sb / n, sab - sa * sb / n
    # of a constant column the sums leave rounding error only
    flat_a, flat_b = va <= CONSTANT * F.greatest(saa, F.lit(1e-300)), vb <= CONSTANT * F.greatest(sbb, F.lit(1e-300))
    same = F.abs(sa / n - sb / n) < 1e-10
    return F.when(flat_a & flat_b & same, 1.0).when(flat_a | flat_b, 0.0).otherwise(cov / F.sqrt(F.greatest(va, F.lit(1e-300)) * F.greatest(vb, F.lit(1e-300))))


def matrix_accuracy(a: DataFrame, b: DataFrame, dims: Dims) -> DataFrame:
    """One row of every matrix metric, from one join and one aggregate.

    pearson, mse, exact (share of pairs closer than a double's epsilon), mae, max_error, mre (over pairs whose first value
    is not 0), sparsity_a, sparsity_b, sparsity_kept, nnz_equal. NaN differences count in nan_pairs and nowhere else.
    """
    if not dims.size:
        zero = [F.lit(0.0).alias(c) for c in ("pearson", "mse", "exact", "mae", "max_error", "mre")]
        return a.agg(*zero, F.lit(1.0).alias("sparsity_a"), F.lit(1.0).alias("sparsity_b"), F.lit(1.0).alias("sparsity_kept"), F.lit(True).alias("nnz_equal"), F.lit(0).cast("long").alias("nan_pairs"))
    n = F.lit(float(dims.size))
    p = paired(a, b).withColumn("d", F.abs(F.col("a") - F.col("b")))
    d = F.when(~F.isnan("d"), F.col("d"))
    large = F.abs(F.col("a")) > RELATIVE_FROM
    none = lambda c: F.coalesce(c, F.lit(0.0))
    nnz_a, nnz_b = F.count_if("in_a"), F.count_if("in_b")
    return p.agg(
        _pearson(n).alias("pearson"),
        (none(F.sum(d * d)) / n).alias("mse"),
        ((F.count_if(F.col("d") < EPSILON) + (n - F.count(F.lit(1)))) / n).alias("exact"),
        (none(F.sum(d)) / n).alias("mae"),
        none(F.max(d)).alias("max_error"),
        none(F.avg(F.when(large, d / F.abs(F.col("a"))))).alias("mre"),
        (1 - nnz_a / n).alias("sparsity_a"),
        (1 - nnz_b / n).alias("sparsity_b"),
        (1 - F.abs(nnz_a - nnz_b) / n).alias("sparsity_kept"),
        (nnz_a == nnz_b).alias("nnz_equal"),
        F.count_if(F.isnan("d")).alias("nan_pairs"),
    )


def meets(metrics: DataFrame, tolerance: float, metadata: bool = True, categories: bool = True, embedding_error: float = 0.0) -> DataFrame:
    """The metrics with ``passed``: all gates at that tolerance, those of metadata, categories and embeddings among them."""
    c = F.col
    gate = (c("pearson") > 0.99999) & (c("mre") < tolerance) & (c("max_error") < 100 * tolerance) & (c("sparsity_kept") > 0.999) & (c("mse") < tolerance**2) & (c("exact") > 0.999) & c("nnz_equal")
    return metrics.withColumn("passed", gate & F.lit(bool(metadata and categories and embedding_error < tolerance)))


def stored_pearson(a: DataFrame, b: DataFrame, every: int = 1) -> DataFrame:
    """n and pearson over the entries that either has, or every so manieth of them (by the sum of their indices): a sampled measure beside the exact one."""
    p = paired(a.where((F.col(CELL) + F.col(GENE)) % every == 0), b.where((F.col(CELL) + F.col(GENE)) % every == 0))
    n = F.count(F.lit(1)).cast("double")
    return p.agg(F.count(F.lit(1)).alias("n"), _pearson(n).alias("pearson"))


#: Least correlation of datasets that came by different formats.
CROSS_FORMAT = 0.9999


def cross_format(a: Dataset, b: Dataset, tolerance: float = 1e-7) -> Report:
    """The comparison of all components, and the correlation of X over all cells and genes, which has to exceed 0.9999. Layouts don't matter, as X is long."""
    found = compare(a, b, tolerance)
    r = matrix_accuracy(a.x, b.x, a.dims).first()
    return Report((*found.results, Result("correlation", r.pearson > CROSS_FORMAT, f"pearson {r.pearson:.6f}; sparsity {r.sparsity_a:.4f} and {r.sparsity_b:.4f}")))


def label_agreement(labels: DataFrame, a: str, b: str) -> DataFrame:
    """ari and nmi of two labellings of the same rows, from their contingency table.

    Label pairs are counted once; marginals are sums of those counts.
    """
    from tesserae.operators.aggregate import contingency

    cells = contingency(labels, a, b)
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    side = lambda k: cells.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias(f"pairs_{k}"), F.sum(F.col("n") * F.log("n")).alias(f"log_{k}"), F.count(F.lit(1)).alias(f"k_{k}"))
    both = cells.agg(F.sum(pairs("n")).alias("pairs"), F.sum(F.col("n") * F.log("n")).alias("log"), F.sum("n").alias("n"))
    t = both.join(side("a"), how="cross").join(side("b"), how="cross")  # one row each
    n = F.col("n").cast("double")
    expected = F.col("pairs_a") * F.col("pairs_b") / F.when(n > 1, n * (n - 1) / 2.0)
    most = (F.col("pairs_a") + F.col("pairs_b")) / 2.0
    flat = F.abs(most - expected) < 1e-10
    ari = F.when(F.coalesce(n, F.lit(0.0)) < 2, 0.0).when(flat, F.when(F.abs(F.col("pairs") - expected) < 1e-10, 1.0).otherwise(0.0)).otherwise(F.try_divide(F.col("pairs") - expected, most - expected))
    h_a, h_b = F.log(n) - F.col("log_a") / n, F.log(n) - F.col("log_b") / n
    mutual = F.log(n) + (F.col("log") - F.col("log_a") - F.col("log_b")) / n
    nmi = F.when(F.coalesce(n, F.lit(0.0)) < 1, 0.0).when((F.col("k_a") <= 1) & (F.col("k_b") <= 1), 1.0).when(h_a + h_b < 1e-15, 0.0).otherwise(2 * mutual / F.when(h_a + h_b >= 1e-15, h_a + h_b))
    return t.select(ari.alias("ari"), F.greatest(nmi, F.lit(0.0)).alias("nmi"))


def matrices_equal(a: DataFrame, b: DataFrame, tolerance: float, keys: tuple[str, ...] = (CELL, GENE)) -> DataFrame:
    """only_a, only_b (entries without a partner), max_difference, passed: same entries, all differences under the tolerance."""
    p = paired(a, b, keys)
    both = F.col("in_a") & F.col("in_b")
    d = F.when(both, F.abs(F.col("a") - F.col("b")))
    out = p.agg(F.count_if(~F.col("in_b")).alias("only_a"), F.count_if(~F.col("in_a")).alias("only_b"), F.coalesce(F.max(F.when(~F.isnan(d), d)), F.lit(0.0)).alias("max_difference"))
    return out.withColumn("passed", (F.col("only_a") == 0) & (F.col("only_b") == 0) & (F.col("max_difference") < tolerance))


def tables_equal(a: DataFrame, b: DataFrame, index: str, tolerance: float) -> DataFrame:
    """column, mismatches, max_difference, passed for each annotation column: joined by index, nulls equal nulls only.

    A column that one table lacks, or of another type, fails with the number of rows as mismatches. Doubles may
    differ by less than the tolerance.
    """
    spark, names = a.sparkSession, sorted((set(a.columns) | set(b.columns)) - {index})
    kinds_a, kinds_b = dict(a.dtypes), dict(b.dtypes)
    joined = a.select(index, *[F.col(f"`{c}`").alias(f"a_{c}") for c in a.columns if c != index], F.lit(1).alias("_a")).join(b.select(index, *[F.col(f"`{c}`").alias(f"b_{c}") for c in b.columns if c != index], F.lit(1).alias("_b")), index, "full_outer")
    one_sided = F.col("_a").isNull() | F.col("_b").isNull()
    sums = []
    for i, c in enumerate(names):
        if kinds_a.get(c) != kinds_b.get(c):
            sums += [F.count(F.lit(1)).alias(f"m{i}"), F.lit(0.0).alias(f"d{i}")]
            continue
        x, y = F.col(f"`a_{c}`"), F.col(f"`b_{c}`")
        if kinds_a[c] in ("double", "float"):
            d = F.abs(x - y).cast("double")
            bad = (x.isNull() != y.isNull()) | (F.coalesce(d, F.lit(0.0)) >= tolerance) & ~F.coalesce(F.isnan(x) & F.isnan(y), F.lit(False))
            sums += [F.count_if(one_sided | bad).alias(f"m{i}"), F.coalesce(F.max(F.when(~F.isnan(d), d)), F.lit(0.0)).alias(f"d{i}")]
        else:
            sums += [F.count_if(one_sided | ~x.eqNullSafe(y)).alias(f"m{i}"), F.lit(0.0).alias(f"d{i}")]
    if not names:
        return spark.createDataFrame([], "column string, mismatches long, max_difference double, passed boolean")
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").cast("long").alias("mismatches"), F.col(f"d{i}").alias("max_difference")) for i, c in enumerate(names)])
    return joined.agg(*sums).select(F.explode(rows).alias("r")).select("r.*").withColumn("passed", F.col("mismatches") == 0)


def embeddings_accuracy(a: DataFrame, b: DataFrame, index: str = CELL) -> DataFrame:
    """name, n, mean_error, max_error, pearson over the coordinates of vectors that both have; vectors of another length fail with null."""
    j = a.select("name", index, F.col("vec").alias("va")).join(b.select("name", index, F.col("vec").alias("vb")), ["name", index])
    e = j.select("name", F.explode(F.arrays_zip("va", "vb")).alias("p")).select("name", F.col("p.va").cast("double").alias("a"), F.col("p.vb").cast("double").alias("b"))
    d, n = F.abs(F.col("a") - F.col("b")), F.count(F.lit(1)).cast("double")
    return e.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_error"), F.max(d).alias("max_error"), _pearson(n).alias("pearson"))


def embeddings_equal(a: DataFrame, b: DataFrame, tolerance: float, index: str = CELL) -> DataFrame:
    """name, only_a, only_b, shape_differs, max_difference, passed for each embedding."""
    j = a.select("name", index, F.col("vec").alias("va")).join(b.select("name", index, F.col("vec").alias("vb")), ["name", index], "full_outer")
    d = F.array_max(F.zip_with("va", "vb", lambda x, y: F.abs(x - y)))
    out = j.groupBy("name").agg(F.count_if(F.col("vb").isNull()).alias("only_a"), F.count_if(F.col("va").isNull()).alias("only_b"), F.count_if(F.size("va") != F.size("vb")).alias("shape_differs"), F.coalesce(F.max(F.when(F.size("va") == F.size("vb"), d)).cast("double"), F.lit(0.0)).alias("max_difference"))
    return out.withColumn("passed", (F.col("only_a") + F.col("only_b") + F.col("shape_differs") == 0) & (F.col("max_difference") < tolerance))


def grouped_equal(a: DataFrame, b: DataFrame, group: str, keys: tuple[str, str], tolerance: float) -> DataFrame:
    """group, only_a, only_b, max_difference, passed for each layer or each pairwise matrix."""
    p = paired(a, b, (group, *keys))
    d = F.when(F.col("in_a") & F.col("in_b"), F.abs(F.col("a") - F.col("b")))
    out = p.groupBy(group).agg(F.count_if(~F.col("in_b")).alias("only_a"), F.count_if(~F.col("in_a")).alias("only_b"), F.coalesce(F.max(F.when(~F.isnan(d), d)), F.lit(0.0)).alias("max_difference"))
    return out.withColumn("passed", (F.col("only_a") + F.col("only_b") == 0) & (F.col("max_difference") < tolerance))


def metadata_accuracy(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Columns that only one has, and those whose types differ."""
    x, y = dict(a.dtypes), dict(b.dtypes)
    return {"missing": sorted(set(x) - set(y)), "extra": sorted(set(y) - set(x)), "retyped": sorted(c for c in set(x) & set(y) if x[c] != y[c])}


def metadata_values(a: DataFrame, b: DataFrame, index: str) -> DataFrame:
    """column, kind (number or category), max_error, codes_differ for the columns of one type that both have, over rows that both have.

    Of doubles and floats the largest difference of values that aren't null; of columns with category lists the rows whose places in
    their own table's list differ, as a changed order of categories changes the codes.
    """
    from tesserae.sources.bundle import codes

    x, y = dict(a.dtypes), dict(b.dtypes)
    both = sorted(c for c in set(x) & set(y) - {index} if x[c] == y[c])
    listed = [c for c in both if all("categories" in t.schema[c].metadata for t in (a, b))]
    numbers = [c for c in both if x[c] in ("double", "float")]
    if not listed and not numbers:
        return a.sparkSession.createDataFrame([], "column string, kind string, max_error double, codes_differ long")

    def side(t: DataFrame, name: str) -> DataFrame:
        for c in listed:
            t = codes(t, c)
        return t.select(index, *[F.col(f"`{c}`").alias(f"{name}_{c}") for c in numbers], *[F.col(f"`{c}_code`").alias(f"{name}_{c}") for c in listed])

    joined = side(a, "a").join(side(b, "b"), index)
    sums = [F.coalesce(F.max(F.abs(F.col(f"`a_{c}`") - F.col(f"`b_{c}`"))).cast("double"), F.lit(0.0)).alias(f"n{i}") for i, c in enumerate(numbers)]
    sums += [F.count_if(F.col(f"`a_{c}`") != F.col(f"`b_{c}`")).alias(f"c{i}") for i, c in enumerate(listed)]
    none = F.lit(0).cast("long")
    rows = [F.struct(F.lit(c).alias("column"), F.lit("number").alias("kind"), F.col(f"n{i}").alias("max_error"), none.alias("codes_differ")) for i, c in enumerate(numbers)]
    rows += [F.struct(F.lit(c).alias("column"), F.lit("category").alias("kind"), F.lit(0.0).alias("max_error"), F.col(f"c{i}").alias("codes_differ")) for i, c in enumerate(listed)]
    return joined.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@dataclass(frozen=True)
class Result:
    component: str
    passed: bool
    message: str
    max_difference: float | None = None


REPORT = T.StructType([T.StructField("component", T.StringType()), T.StructField("passed", T.BooleanType()), T.StructField("message", T.StringType()), T.StructField("max_difference", T.DoubleType())])


@dataclass(frozen=True)
class Report:
    results: tuple[Result, ...]

    @property
    def passed(self) -> bool:
        return all(r.passed for r in self.results)

    @property
    def failed_components(self) -> list[str]:
        return [r.component for r in self.results if not r.passed]

    @property
    def max_difference(self) -> float:
        return max((r.max_difference for r in self.results if r.max_difference is not None), default=0.0)

    def summary(self) -> str:
        good = sum(r.passed for r in self.results)
        return f"{good} of {len(self.results)} components passed" + "".join(f"\n{'ok  ' if r.passed else 'FAIL'} {r.component}: {r.message}" for r in self.results)

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(r.component, r.passed, r.message, r.max_difference) for r in self.results], REPORT)


def compare(a: Dataset, b: Dataset, tolerance: float = 1e-7) -> Report:
    """All components of two datasets. A part that only one has fails; layouts do not matter. Spatial, varm and uns are not compared."""
    out: list[Result] = []
    if (a.dims.n_cells, a.dims.n_genes) != (b.dims.n_cells, b.dims.n_genes):
        out.append(Result("dims", False, f"{a.dims.n_cells} x {a.dims.n_genes} and {b.dims.n_cells} x {b.dims.n_genes}"))
    m = matrices_equal(a.x, b.x, tolerance).first()
    out.append(Result("expression", m.passed, f"{m.only_a} and {m.only_b} entries without a partner", m.max_difference))
    for name, index in (("obs", CELL), ("var", GENE)):
        rows = tables_equal(getattr(a, name), getattr(b, name), index, tolerance).collect()  # a row for each column
        bad = [r["column"] for r in rows if not r["passed"]]
        out.append(Result(name, not bad, f"{len(rows)} columns" + (f"; differ: {', '.join(bad)}" if bad else ""), max((r["max_difference"] for r in rows), default=0.0)))
    grouped = (("layers", lambda x, y: grouped_equal(x, y, "layer", (CELL, GENE), tolerance)), ("obsm", lambda x, y: embeddings_equal(x, y, tolerance)), ("obsp", lambda x, y: grouped_equal(x, y, "name", ("i", "j"), tolerance)), ("varp", lambda x, y: grouped_equal(x, y, "name", ("i", "j"), tolerance)))
    for name, f in grouped:
        x, y = getattr(a, name), getattr(b, name)
        if x is None and y is None:
            continue
        if x is None or y is None:
            out.append(Result(name, False, "only one has it"))
            continue
        total = f(x, y).agg(F.bool_and("passed").alias("passed"), F.count(F.lit(1)).alias("n"), F.max("max_difference").alias("d")).first()
        out.append(Result(name, total.passed is not False, f"{total.n} members", total.d))
    return Report(tuple(out))


def full_accuracy(a: Dataset, b: Dataset, tolerance: float = 1e-7) -> DataFrame:
    """Matrix metrics with what obs, var and embeddings add: metadata_match (columns and types), categories_match (codes), number_error, embedding_error.

    passed: the gates of the matrix, and equal extents. ``strict``: all gates, those of metadata, categories and embeddings too.
    """
    same = (a.dims.n_cells, a.dims.n_genes) == (b.dims.n_cells, b.dims.n_genes)
    columns = [metadata_accuracy(getattr(a, t), getattr(b, t)) for t in ("obs", "var")]
    values = [r for t, i in (("obs", CELL), ("var", GENE)) for r in metadata_values(getattr(a, t), getattr(b, t), i).collect()]  # a row for each column
    errors = [] if a.obsm is None or b.obsm is None else embeddings_accuracy(a.obsm, b.obsm).agg(F.max("max_error")).collect()
    metadata = not any(v for c in columns for v in c.values())
    categories = not any(r.codes_differ for r in values)
    embedding = float(errors[0][0] or 0.0) if errors else 0.0
    metrics = matrix_accuracy(a.x, b.x, a.dims)
    strict = meets(metrics, tolerance, metadata, categories, embedding).withColumnRenamed("passed", "strict")
    out = meets(strict, tolerance).withColumn("passed", F.col("passed") & F.lit(same)).withColumn("strict", F.col("strict") & F.lit(same))
    return out.withColumns({"metadata_match": F.lit(metadata), "categories_match": F.lit(categories), "number_error": F.lit(max((r.max_error for r in values), default=0.0)), "embedding_error": F.lit(embedding)})
