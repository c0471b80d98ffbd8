"""The registered queries of the matrix engine and the SQL each is held against; those of files are in ``files``.

Keys are the operators' names in the blueprint. Every query runs over whole tables. Doubles are rounded on both sides, as sums in another order
differ in their last digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import names, text
from tesserae.model import CELL, GENE, VALUE
from tesserae.operators import aggregate, check, compare, diagnose, layers, layout, select, transform
from tesserae.plans import star
from tesserae.plans.book import CTE, ORACLES, QUERIES, again, query, rounded

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
FLAGSHIP = "O_top_genes"


# transforms


@query("SELECT cell_idx, gene_idx, round(value, 6) AS value FROM z", "x", "z")
def O_norm_log1p(spark, sf):
    return rounded(transform.normalised(star.x(spark, sf)), VALUE)


@query("SELECT cell_idx, gene_idx, round(ln(value + 1), 6) AS value FROM x", "x")
def O_fn_ln(spark, sf):
    return rounded(transform.log1p(star.x(spark, sf)), VALUE)

VARIANCE = """SELECT p_partkey AS gene_idx, round(coalesce(mu, 0), 6) AS mean, round(coalesce((ss + mu * mu * (n - k)) / n, 0), 6) AS variance
FROM part LEFT JOIN (SELECT z.gene_idx, any_value(mu) AS mu, any_value(k) AS k, sum((value - mu) * (value - mu)) AS ss
  FROM z JOIN (SELECT gene_idx, sum(value) / any_value(n) AS mu, count(*) AS k FROM z, d GROUP BY gene_idx) g ON z.gene_idx = g.gene_idx GROUP BY z.gene_idx) v ON p_partkey = v.gene_idx, d"""


@query(VARIANCE, "x", "z", "d")
def O_gene_variance(spark, sf):
    x = transform.normalised(star.x(spark, sf))
    return rounded(transform.gene_variances(x, star.var(spark, sf), star.dims(spark, sf)), "mean", "variance")


@query(f"SELECT gene_idx, mean, variance FROM ({VARIANCE.replace('round(coalesce((ss', 'coalesce((ss + mu * mu * (n - k)) / n, 0) AS v, round(coalesce((ss')}) ORDER BY v DESC, gene_idx LIMIT 20", "x", "z", "d")
def O_top_genes(spark, sf):
    x = transform.normalised(star.x(spark, sf))
    return rounded(transform.top_genes(transform.gene_variances(x, star.var(spark, sf), star.dims(spark, sf)), 20), "mean", "variance")


@query("SELECT p_partkey AS gene_idx, coalesce(CAST(p_brand AS VARCHAR), '') AS _index, p_name, p_size FROM part")
def O_proj_gene_id(spark, sf):
    return transform.use_gene_ids(star.dataset(spark, sf), "p_brand").var.select(GENE, "_index", "p_name", "p_size")


# selection


@query("SELECT new AS cell_idx, gene_idx, value FROM x JOIN (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS new FROM orders WHERE o_orderstatus = 'F') ON cell_idx = k", "x")
def O_sel_rows(spark, sf):
    kept = star.obs(spark, sf).where("o_orderstatus = 'F'").select(CELL)
    return select.rows(star.x(spark, sf), kept)


@query("SELECT cell_idx, gene_idx - 50 AS gene_idx, value FROM x WHERE gene_idx >= 50 AND gene_idx < 90", "x")
def O_sel_cols_range(spark, sf):
    return select.columns_between(star.x(spark, sf), 50, 90)


@query("SELECT cell_idx, new AS gene_idx, value FROM x JOIN (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS new FROM part WHERE p_size % 3 = 0) ON gene_idx = k", "x")
def O_sel_cols_sparse(spark, sf):
    return select.rows(star.x(spark, sf), star.var(spark, sf).where("p_size % 3 = 0").select(GENE), GENE)


@query("SELECT new AS gene_idx, p_name, p_size FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS new FROM part WHERE p_size % 3 = 0)")
def O_sel_cols_keep(spark, sf):
    ds = star.dataset(spark, sf)
    return select.keep_genes(ds, ds.var.where("p_size % 3 = 0").select(GENE)).var.select(GENE, "p_name", "p_size")


@query("SELECT max(p_partkey) - min(p_partkey) + 1 = count(DISTINCT p_partkey) AS contiguous FROM part")
def O_sel_contig(spark, sf):
    return select.is_contiguous(star.var(spark, sf), GENE)


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS cell_idx, o_orderstatus, o_orderpriority FROM orders WHERE o_orderpriority LIKE '1%'")
def O_sel_df_rows(spark, sf):
    obs = star.obs(spark, sf)
    new = select.renumbered(obs.where("o_orderpriority LIKE '1%'").select(CELL), CELL)
    return obs.join(new, CELL).select(F.col("new").alias(CELL), "o_orderstatus", "o_orderpriority")


@query("SELECT * FROM x WHERE cell_idx >= 100 AND cell_idx < 600", "x")
def O_sel_chunk_rows(spark, sf):
    return select.rows_between(star.x(spark, sf), 100, 600)


@query("SELECT o_orderkey AS cell_idx, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 600")
def O_sel_df_slice(spark, sf):
    return select.rows_between(star.obs(spark, sf), 100, 600).select(CELL, "o_orderstatus")


@query("SELECT p_name FROM part")
def O_sel_column(spark, sf):
    return star.var(spark, sf).select("p_name")


@query("SELECT CAST(floor(cell_idx / 1000) AS BIGINT) AS cell_block, CAST(floor(gene_idx / 64) AS BIGINT) AS gene_block, count(*) AS n, sum(value) AS total FROM x GROUP BY 1, 2", "x")
def O_proj_index_select(spark, sf):
    return select.blocks(star.x(spark, sf), 1000, 64).groupBy("cell_block", "gene_block").agg(F.count(F.lit(1)).alias("n"), F.sum(VALUE).alias("total"))


# layouts


@query("SELECT gene_idx, count(*) AS n, min(cell_idx) AS first, CAST(sum(cell_idx) AS BIGINT) AS cells, sum(value) AS total FROM x GROUP BY gene_idx", "x")
def O_cvt_csr_csc(spark, sf):
    x = layout.csc(layout.unpacked(layout.csr(star.x(spark, sf)), CELL, GENE))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    pieces = x.select(GENE, F.size("indices").cast("long").alias("n"), F.element_at("indices", 1).alias("first"), F.aggregate("indices", F.lit(0).cast("long"), lambda a, v: a + v).alias("cells"), total("data").alias("total"))
    return pieces.groupBy(GENE).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("cells").alias("cells"), F.sum("total").alias("total"))


@query("SELECT cell_idx, count(*) AS n, min(gene_idx) AS first, max(gene_idx) AS last FROM x GROUP BY cell_idx", "x")
def O_cvt_csc_csr(spark, sf):
    x = layout.csr(layout.unpacked(layout.csc(star.x(spark, sf)), GENE, CELL))
    pieces = x.select(CELL, F.size("indices").cast("long").alias("n"), F.element_at("indices", 1).alias("first"), F.element_at("indices", -1).alias("last"))
    return pieces.groupBy(CELL).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


again("O_cvt_csr_csc_par", "O_cvt_csr_csc")
for name in ("O_cvt_csc_csr_par", "O_cvt_auto"):
    again(name, "O_cvt_csc_csr")


@query("SELECT o_orderkey AS cell_idx, coalesce(sum(value), 0) AS total, CAST(any_value(m) - count(value) AS BIGINT) AS zeros FROM orders CROSS JOIN d LEFT JOIN x ON cell_idx = o_orderkey GROUP BY 1", "x", "d")
def O_cvt_csr_dense(spark, sf):
    return layout.dense_totals(star.x(spark, sf), star.obs(spark, sf), star.dims(spark, sf))


@query("SELECT gene_idx, coalesce(sum(value), 0) AS total, CAST(any_value(n) - count(value) AS BIGINT) AS zeros FROM (SELECT p_partkey AS gene_idx FROM part) g CROSS JOIN d LEFT JOIN x USING (gene_idx) GROUP BY 1", "x", "d")
def O_cvt_row_major(spark, sf):
    """The dense rows of the transposed matrix: genes as rows."""
    d = star.dims(spark, sf)
    turned = type(d)(d.n_genes, d.n_cells, first_cell=d.first_gene, first_gene=d.first_cell)
    return layout.dense_totals(layout.transposed(star.x(spark, sf)), star.var(spark, sf).select(F.col(GENE).alias(CELL)), turned).withColumnRenamed(CELL, GENE)


@query("SELECT * FROM x", "x")
def O_cvt_dense_csr(spark, sf):
    return layout.dense_entries(star.x(spark, sf), star.obs(spark, sf), star.dims(spark, sf))


@query("SELECT CAST(floor(cell_idx / 5000) AS BIGINT) AS chunk, count(*) AS nnz, sum(value) AS total FROM x GROUP BY 1", "x")
def O_cvt_chunk_split(spark, sf):
    return layout.chunked(star.x(spark, sf), 5000).groupBy("chunk").agg(F.count(F.lit(1)).alias("nnz"), F.sum(VALUE).alias("total"))


@query("SELECT * FROM x", "x")
def O_cvt_chunk_merge(spark, sf):
    return layout.merged(layout.chunked(star.x(spark, sf), 5000))


@query("SELECT gene_idx AS cell_idx, cell_idx AS gene_idx, value FROM x", "x")
def O_cvt_transpose_dgc(spark, sf):
    return layout.transposed(star.x(spark, sf))


# counts


@query("SELECT count(*) AS nnz FROM x", "x")
def O_agg_nnz(spark, sf):
    return aggregate.nnz(star.x(spark, sf))


@query("SELECT round(1 - count(*) / any_value(n * m * 1.0), 6) AS sparsity FROM x, d", "x", "d")
def O_agg_sparsity(spark, sf):
    return rounded(aggregate.matrix_sparsity(star.x(spark, sf), star.dims(spark, sf)).select("sparsity"), "sparsity")


@query("SELECT round(100 * (1 - count(*) / any_value(n * m * 1.0)), 6) AS percent FROM x, d", "x", "d")
def O_agg_sparsity_insp(spark, sf):
    return rounded(aggregate.matrix_sparsity(star.x(spark, sf), star.dims(spark, sf)).select("percent"), "percent")


@query("SELECT round(1 - count(*) / any_value(n * m * 1.0), 6) AS by_value FROM x, d WHERE value <> 0", "x", "d")
def O_agg_sparsity_x(spark, sf):
    return rounded(aggregate.matrix_sparsity(star.x(spark, sf), star.dims(spark, sf), dense=True).select("by_value"), "by_value")


@query("SELECT count(*) * 16 + (any_value(n) + 1) * 8 AS csr_bytes, count(*) * 16 + (any_value(m) + 1) * 8 AS csc_bytes, 2 * (count(*) * 16 + (any_value(n) + 1) * 8) AS csr_peak_bytes, 2 * (count(*) * 16 + (any_value(m) + 1) * 8) AS csc_peak_bytes FROM x, d", "x", "d")
def O_agg_mem(spark, sf):
    return aggregate.memory(star.x(spark, sf), star.dims(spark, sf))


@query("SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2")
def O_agg_contingency(spark, sf):
    return aggregate.contingency(star.obs(spark, sf), "o_orderstatus", "o_orderpriority")


# comparison


def _metrics(spark, sf) -> DataFrame:
    x = star.x(spark, sf)
    return compare.matrix_accuracy(x, star.other(x), star.dims(spark, sf))


def _metric(name: str, sql: str) -> None:
    def run(spark, sf):
        return rounded(_metrics(spark, sf).select(name), name)

    run.__name__ = {"pearson": "O_cmp_pearson", "mse": "O_cmp_mse", "exact": "O_cmp_exact", "mae": "O_cmp_mae", "max_error": "O_cmp_max", "mre": "O_cmp_mre", "sparsity_kept": "O_cmp_sparsity_kept"}[name]
    query(f"SELECT round({sql}, 6) AS {name} FROM p, (SELECT n * m * 1.0 AS t FROM d)", "x", "y", "d", "p")(run)


PEARSON = "(sum(a * b) - sum(a) * sum(b) / any_value(t)) / sqrt((sum(a * a) - sum(a) * sum(a) / any_value(t)) * (sum(b * b) - sum(b) * sum(b) / any_value(t)))"
_metric("pearson", "(sum(a * b) - sum(a) * sum(b) / any_value(t)) / sqrt((sum(a * a) - sum(a) * sum(a) / any_value(t)) * (sum(b * b) - sum(b) * sum(b) / any_value(t)))")
_metric("mse", "sum((a - b) * (a - b)) / any_value(t)")
_metric("exact", "(count(CASE WHEN abs(a - b) < 2.220446049250313e-16 THEN 1 END) + any_value(t) - count(*)) / any_value(t)")
_metric("mae", "sum(abs(a - b)) / any_value(t)")
_metric("max_error", "max(abs(a - b))")
_metric("mre", "avg(CASE WHEN abs(a) > 1e-10 THEN abs(a - b) / abs(a) END)")
_metric("sparsity_kept", "1 - abs(count(CASE WHEN in_a THEN 1 END) - count(CASE WHEN in_b THEN 1 END)) / any_value(t)")


@query("SELECT count(*) AS n, round(corr(a, b), 6) AS pearson FROM (SELECT coalesce(x.value, 0) AS a, coalesce(y.value, 0) AS b FROM x FULL OUTER JOIN y ON x.cell_idx = y.cell_idx AND x.gene_idx = y.gene_idx WHERE (coalesce(x.cell_idx, y.cell_idx) + coalesce(x.gene_idx, y.gene_idx)) % 3 = 0)", "x", "y")
def O_cmp_sample(spark, sf):
    x = star.x(spark, sf)
    return rounded(compare.stored_pearson(x, star.other(x), 3), "pearson")


def _nearly(x: DataFrame) -> DataFrame:
    """x with a few entries changed by little."""
    return x.withColumn(VALUE, F.when((F.col(CELL) + F.col(GENE)) % 2003 == 0, F.col(VALUE) + 1e-5).otherwise(F.col(VALUE)))


GATES = """w AS (SELECT cell_idx, gene_idx, value AS a, CASE WHEN (cell_idx + gene_idx) % 2003 = 0 THEN value + 1e-5 ELSE value END AS b FROM x),
q AS (SELECT sum((a - b) * (a - b)) / any_value(n * m * 1.0) AS mse, max(abs(a - b)) AS most, avg(CASE WHEN abs(a) > 1e-10 THEN abs(a - b) / abs(a) END) AS mre, (count(CASE WHEN abs(a - b) < 2.220446049250313e-16 THEN 1 END) + any_value(n * m) - count(*)) / any_value(n * m * 1.0) AS exact, corr(a, b) AS r FROM w, d)"""
CTE["gates"] = GATES


@query("SELECT t AS tolerance, r > 0.99 AND mre < t AND most < 100 * t AND mse < t * t AND exact > 0.999 AND e < t AND k AS passed FROM q, (VALUES (1e-9, 0.0, true), (1e-8, 0.0, true), (1e-6, 0.0, true), (1e-3, 0.0, true), (0.5, 0.7, true), (0.25, 0.0, false)) v(t, e, k)", "x", "d", "gates")
def O_cmp_gate(spark, sf):
    """Some tolerances, some errors of embeddings, categories that match or do not."""
    x = star.x(spark, sf)
    metrics = compare.matrix_accuracy(x, _nearly(x), star.dims(spark, sf))
    rows = [compare.meets(metrics, t, True, k, e).select(F.lit(t).alias("tolerance"), "passed") for t, e, k in ((1e-9, 0.0, True), (1e-8, 0.0, True), (1e-6, 0.0, True), (1e-3, 0.0, True), (0.5, 0.7, True), (0.25, 0.0, False))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query(
    "SELECT mse < 1e-10 AND most < 1e-3 AND mre < 1e-5 AND exact > 0.999 AS passed, false AS strict, true AS metadata_match, true AS categories_match, (SELECT max(CASE WHEN o_orderkey % 3 = 0 THEN 0.25 ELSE 0 END)::DOUBLE FROM orders) AS number_error, (SELECT max(CASE WHEN o_orderkey % 10 = 0 THEN 0.125 ELSE 0 END)::DOUBLE FROM orders) AS embedding_error FROM q",
    "x", "d", "gates",
)
def O_cmp_full(spark, sf):
    ds = star.rich(spark, sf)
    obs = ds.obs.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 0.25).otherwise(F.col("o_totalprice")))
    d = star.dims(spark, sf)
    near = _nearly(star.x(spark, sf)).withColumns({CELL: F.col(CELL) - d.first_cell, GENE: F.col(GENE) - d.first_gene})
    obsm = ds.obsm.withColumn("vec", F.transform("vec", lambda v: F.when((F.col(CELL) + d.first_cell) % 10 == 0, v + 0.125).otherwise(v)))
    return rounded(compare.full_accuracy(ds, ds.with_(x=near, obs=obs, obsm=obsm), 1e-5).select("passed", "strict", "metadata_match", "categories_match", "number_error", "embedding_error"), "number_error", "embedding_error")


LABELS = """k AS (SELECT quality AS a, toxic AS b, count(*) * 1.0 AS n FROM labels GROUP BY 1, 2), ka AS (SELECT a, sum(n) AS n FROM k GROUP BY a), kb AS (SELECT b, sum(n) AS n FROM k GROUP BY b),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM k) AS ij, (SELECT sum(n * (n - 1) / 2) FROM ka) AS i, (SELECT sum(n * (n - 1) / 2) FROM kb) AS j, (SELECT sum(n) FROM k) AS t,
 (SELECT sum(n * ln(n)) FROM k) AS lij, (SELECT sum(n * ln(n)) FROM ka) AS li, (SELECT sum(n * ln(n)) FROM kb) AS lj)"""
CTE["labels"] = LABELS


@query("SELECT round((ij - i * j / (t * (t - 1) / 2)) / ((i + j) / 2 - i * j / (t * (t - 1) / 2)), 6) AS ari FROM s", "labels")
def O_cmp_ari(spark, sf):
    return rounded(compare.label_agreement(spark.read.parquet(f"{sf}/labels.parquet"), "quality", "toxic").select("ari"), "ari")


@query("SELECT round(2 * (ln(t) + (lij - li - lj) / t) / (2 * ln(t) - li / t - lj / t), 6) AS nmi FROM s", "labels")
def O_cmp_nmi(spark, sf):
    return rounded(compare.label_agreement(spark.read.parquet(f"{sf}/labels.parquet"), "quality", "toxic").select("nmi"), "nmi")


@query("SELECT count(CASE WHEN NOT in_b THEN 1 END) AS only_a, count(CASE WHEN NOT in_a THEN 1 END) AS only_b, max(CASE WHEN in_a AND in_b THEN abs(a - b) END) AS max_difference, false AS passed FROM p", "x", "y", "p")
def O_cmp_matrix(spark, sf):
    x = star.x(spark, sf)
    return compare.matrices_equal(x, star.other(x), 1e-7)


@query(
    "SELECT 'o_orderpriority' AS \"column\", 0 AS mismatches, 0.0::DOUBLE AS max_difference, true AS passed UNION ALL SELECT 'o_orderstatus', (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0), 0.0, (SELECT count(*) = 0 FROM orders WHERE o_orderkey % 5 = 0) UNION ALL SELECT 'o_totalprice', (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0), 0.25, (SELECT count(*) = 0 FROM orders WHERE o_orderkey % 3 = 0)"
)
def O_cmp_df(spark, sf):
    a = star.obs(spark, sf).select(CELL, "o_orderstatus", "o_orderpriority", "o_totalprice")
    b = a.withColumn("o_orderstatus", F.when(F.col(CELL) % 5 == 0, "?").otherwise(F.col("o_orderstatus"))).withColumn("o_totalprice", F.when(F.col(CELL) % 3 == 0, F.col("o_totalprice") + 0.25).otherwise(F.col("o_totalprice")))
    return rounded(compare.tables_equal(a, b, CELL, 1e-7), "max_difference")


@query("SELECT 'missing' AS kind, 'o_custkey' AS \"column\" UNION ALL SELECT 'extra', 'extra' UNION ALL SELECT 'retyped', 'o_totalprice'")
def O_cmp_meta_columns(spark, sf):
    a = star.obs(spark, sf)
    b = a.drop("o_custkey").withColumn("extra", F.lit(1)).withColumn("o_totalprice", F.col("o_totalprice").cast("string"))
    found = compare.metadata_accuracy(a, b)
    return spark.createDataFrame([(k, c) for k, v in found.items() for c in v], "kind string, column string")


@query("SELECT 'only_first' AS side, column_name AS \"column\" FROM (VALUES ('o_custkey'), ('o_orderdate'), ('o_orderkey'), ('o_orderpriority'), ('o_orderstatus'), ('o_totalprice')) t(column_name) UNION ALL SELECT 'only_second', c FROM (VALUES ('p_brand'), ('p_name'), ('p_partkey'), ('p_retailprice'), ('p_size'), ('p_type')) t(c)")
def O_except_cols(spark, sf):
    """Columns of obs that var lacks, and the other way round."""
    found = compare.metadata_accuracy(star.obs(spark, sf).drop(CELL), star.var(spark, sf).drop(GENE))
    return spark.createDataFrame([(k, c) for k, name in (("only_first", "missing"), ("only_second", "extra")) for c in found[name]], "side string, column string")


@query("SELECT 'o_totalprice' AS \"column\", 'number' AS kind, max(CASE WHEN o_orderkey % 3 = 0 THEN 0.25 ELSE 0 END)::DOUBLE AS max_error, 0 AS codes_differ FROM orders UNION ALL SELECT 'o_orderpriority', 'category', 0, count(*) FILTER (WHERE o_orderpriority <> '3-MEDIUM') FROM orders")
def O_cmp_meta(spark, sf):
    """Prices changed by a quarter here and there; the same categories in the reverse order, so that all codes but the middle one's differ."""
    from tesserae.sources.bundle import with_categories

    a = star.obs(spark, sf).select(CELL, "o_totalprice", "o_orderpriority")
    b = a.withColumn("o_totalprice", F.when(F.col(CELL) % 3 == 0, F.col("o_totalprice") + 0.25).otherwise(F.col("o_totalprice")))
    listed = list(star.PRIORITIES)
    a, b = with_categories(a, "o_orderpriority", listed), with_categories(b, "o_orderpriority", listed[::-1])
    return rounded(compare.metadata_values(a, b, CELL), "max_error")


EMB = "e AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS a, generate_subscripts(embedding, 1) AS i, vec_id FROM embeddings), f AS (SELECT a, CASE WHEN (vec_id + i) % 10 = 0 THEN a + 0.125 ELSE a END AS b FROM e)"
CTE["emb"] = EMB


def _embeddings(spark, sf):
    a = star.obsm(spark, sf)
    b = a.withColumn("vec", F.transform("vec", lambda v, i: F.when((F.col(CELL) + i + 1) % 10 == 0, v + 0.125).otherwise(v)))
    return a, b


@query("SELECT 'X_emb' AS name, count(*) AS n, round(avg(abs(a - b)), 6) AS mean_error, round(max(abs(a - b)), 6) AS max_error, round(corr(a, b), 6) AS pearson FROM f", "emb")
def O_cmp_emb_acc(spark, sf):
    return rounded(compare.embeddings_accuracy(*_embeddings(spark, sf)), "mean_error", "max_error", "pearson")


@query("SELECT 'X_emb' AS name, 0 AS only_a, 0 AS only_b, 0 AS shape_differs, round(max(abs(a - b)), 6) AS max_difference, false AS passed FROM f", "emb")
def O_cmp_emb(spark, sf):
    return rounded(compare.embeddings_equal(*_embeddings(spark, sf), 1e-7), "max_difference")


@query("SELECT layer, count(CASE WHEN (cell_idx * 31 + gene_idx) % 11 = 0 THEN 1 END) AS only_a, 0 AS only_b, max(CASE WHEN (cell_idx * 31 + gene_idx) % 11 <> 0 AND (cell_idx + gene_idx) % 7 = 0 THEN 0.5 ELSE 0 END)::DOUBLE AS max_difference, false AS passed FROM l GROUP BY layer", "l")
def O_cmp_layers(spark, sf):
    a = star.layers(spark, sf)
    return compare.grouped_equal(a, star.other(a), "layer", (CELL, GENE), 1e-7)


@query("SELECT 'g' AS name, count(*) FILTER (WHERE (s * 31 + p) % 11 = 0) AS only_a, 0 AS only_b, 0.0::DOUBLE AS max_difference, count(*) FILTER (WHERE (s * 31 + p) % 11 = 0) = 0 AS passed FROM (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)")
def O_cmp_pairwise(spark, sf):
    g = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.lit("g").alias("name"), F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.avg("l_discount").alias(VALUE))
    return compare.grouped_equal(g, g.where((F.col("i") * 31 + F.col("j")) % 11 != 0), "name", ("i", "j"), 1e-7)


DATASET = """SELECT 'expression' AS component, (SELECT count(*) = 0 FROM p WHERE NOT in_a OR NOT in_b OR abs(a - b) >= 1e-7) AS passed UNION ALL SELECT 'obs', (SELECT count(*) = 0 FROM orders WHERE o_orderkey % 3 = 0)
UNION ALL SELECT 'var', (SELECT count(*) = 0 FROM part WHERE p_partkey < 0) UNION ALL SELECT 'layers', (SELECT count(*) = 0 FROM l WHERE layer = 'counts.N') UNION ALL SELECT 'obsm', (SELECT count(*) = 0 FROM orders WHERE o_orderkey < 0) UNION ALL SELECT 'obsp', (SELECT count(*) = 0 FROM orders WHERE o_orderkey % 50 = 1) UNION ALL SELECT 'varp', true"""


def _two(spark, sf):
    """A dataset and one whose X, obs, one layer and pairwise matrix differ."""
    ds, d = star.rich(spark, sf), star.dims(spark, sf)
    x = star.other(star.x(spark, sf)).withColumns({CELL: F.col(CELL) - d.first_cell, GENE: F.col(GENE) - d.first_gene})
    obs = ds.obs.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 0.25).otherwise(F.col("o_totalprice")))
    layers_ = ds.layers.withColumn(VALUE, F.when(F.col("layer") == "counts.N", F.col(VALUE) + 1).otherwise(F.col(VALUE)))
    return ds, ds.with_(x=x, obs=obs, layers=layers_, obsp=ds.obsp.where((F.col("i") + d.first_cell) % 50 != 1))


CTE["report"] = f"r AS ({DATASET})"


@query(DATASET, "x", "y", "p", "l")
def O_cmp_dataset(spark, sf):
    return compare.compare(*_two(spark, sf)).frame(spark).select("component", "passed")


@query(DATASET + " UNION ALL SELECT 'correlation', " + PEARSON + " > 0.9999 FROM p, (SELECT n * m * 1.0 AS t FROM d)", "x", "y", "d", "p", "l")
def O_cmp_x_format(spark, sf):
    return compare.cross_format(*_two(spark, sf)).frame(spark).select("component", "passed")


@query("SELECT (SELECT count(*) FILTER (WHERE passed) FROM r) AS passed, (SELECT string_agg(component, ',' ORDER BY component) FILTER (WHERE NOT passed) FROM r) AS failed, (SELECT max(abs(a - b)) FROM p WHERE in_a AND in_b) AS max_difference", "x", "y", "p", "l", "report")
def O_chk_report(spark, sf):
    report = compare.compare(*_two(spark, sf))
    return spark.createDataFrame([(sum(r.passed for r in report.results), ",".join(sorted(report.failed_components)), max(r.max_difference for r in report.results if r.component == "expression"))], "passed long, failed string, max_difference double")


# checks


DIMS = """SELECT 'obs.cell_idx' AS component, (SELECT max(o_orderkey) - min(o_orderkey) < n - 1 AND count(*) = n - 1 FROM orders) AS passed FROM d UNION ALL SELECT 'var.gene_idx', (SELECT max(p_partkey) - min(p_partkey) < m FROM part) FROM d UNION ALL SELECT 'x.cell_idx', (SELECT max(cell_idx) < n - 1 FROM x0) FROM d UNION ALL SELECT 'x.gene_idx', (SELECT max(gene_idx) < m FROM x0) FROM d
UNION ALL SELECT 'obsm.cell_idx', (SELECT max(o_orderkey) - c0 < n - 1 FROM orders) FROM d UNION ALL SELECT 'spatial.cell_idx', (SELECT max(o_orderkey) - c0 < n - 1 FROM orders) FROM d UNION ALL SELECT 'varm.gene_idx', (SELECT max(p_partkey) - g0 < m FROM part) FROM d
UNION ALL SELECT 'obsp.i', (SELECT max(o_orderkey) - c0 < n - 1 FROM orders) FROM d UNION ALL SELECT 'obsp.j', (SELECT max(o_custkey % n) < n - 1 FROM orders) FROM d UNION ALL SELECT 'varp.i', (SELECT max(p_partkey) - g0 < m FROM part) FROM d UNION ALL SELECT 'varp.j', (SELECT max((p_partkey - g0) * 7 % m) < m FROM part) FROM d"""


@query(DIMS, "x", "d", "x0")
def O_chk_dims(spark, sf):
    """Extents that say one cell less than there are."""
    ds = star.rich(spark, sf)
    return check.dimensions(ds.with_(dims=type(ds.dims)(ds.dims.n_cells - 1, ds.dims.n_genes))).select("component", "passed")


@query("SELECT 0 AS cell_out_of_bounds, 0 AS gene_out_of_bounds, 0 AS null_entries, (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM x) AS duplicates, (SELECT count(*) FROM lineitem) = (SELECT count(*) FROM x) AS passed", "x")
def O_chk_sparse(spark, sf):
    raw = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias(CELL), F.col("l_partkey").alias(GENE), F.col("l_quantity").alias(VALUE))
    return check.sparse_errors(raw, star.dims(spark, sf))


@query("SELECT 'anndata' AS kind, (SELECT count(*) FROM orders WHERE o_orderkey < 0) = 0 AS obs_missing UNION ALL SELECT 'seurat', (SELECT count(*) FROM orders WHERE o_orderkey < 0) = 0")
def O_chk_required(spark, sf):
    """A dataset whose obs is empty."""
    ds = star.dataset(spark, sf)
    ds = ds.with_(obs=ds.obs.where("o_orderkey < 0"))
    return spark.createDataFrame([(k, "obs has no rows" in check.required(ds, k)) for k in ("anndata", "seurat")], "kind string, obs_missing boolean")


@query("SELECT kind, component, n FROM (VALUES ('none', 'obs', 12), ('none', 'var', 1), ('some', 'obs', 10), ('some', 'var', 0), ('all', 'obs', 0), ('all', 'var', 0)) t(kind, component, n)")
def O_chk_schema(spark, sf):
    ds = star.dataset(spark, sf)
    obs, var = check.SCHEMAS["cellxgene-v5"]
    some = ds.with_(obs=ds.obs.withColumns({c: F.lit("val") for c in obs[:2]}), var=ds.var.withColumn(var[0], F.lit(False)))
    every = some.with_(obs=ds.obs.withColumns({c: F.lit("val") for c in obs}))
    found = {k: check.schema(d) for k, d in (("none", ds), ("some", some), ("all", every))}
    return spark.createDataFrame([(k, c, len(m)) for k, r in found.items() for c, m in (("obs", r.missing_obs), ("var", r.missing_var))], "kind string, component string, n int")


@query("SELECT 'l_discount' AS name, true AS hdf5, true AS r UNION ALL SELECT 'embedding', false, false")
def O_chk_types(spark, sf):
    rows = check.types(spark.read.parquet(f"{sf}/lineitem.parquet").select("l_discount")) + check.types(spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding"))
    return spark.createDataFrame([(n, h, r) for n, _, h, r in rows], "name string, hdf5 boolean, r boolean")


# layers


@query("SELECT 'counts' AS layer, cell_idx + n * CASE layer WHEN 'counts.A' THEN 0 WHEN 'counts.N' THEN 1 ELSE 2 END AS cell_idx, gene_idx, value FROM l, d", "l", "d")
def O_union_layers(spark, sf):
    ds = star.dataset(spark, sf)
    return layers.merge(ds.layers, ds.layer_dims)[0]


@query("SELECT layer, cell_idx + n * CASE layer WHEN 'counts.A' THEN 0 WHEN 'counts.N' THEN 1 ELSE 2 END AS cell_idx, gene_idx, value FROM l, d", "l", "d")
def O_pad_layers(spark, sf):
    ds = star.dataset(spark, sf)
    return layers.pad(ds.layers, ds.layer_dims)[0]


@query("SELECT cell_idx + n * k AS cell_idx, gene_idx, value FROM x, d, (VALUES (0), (1)) t(k)", "x", "d")
def O_union_rows(spark, sf):
    x, d = star.x(spark, sf), star.dims(spark, sf)
    return layers.stack([(x, d.n_cells, d.n_genes)] * 2)


@query("SELECT cell_idx, gene_idx + m * k AS gene_idx, value FROM x, d, (VALUES (0), (1)) t(k)", "x", "d")
def O_union_cols(spark, sf):
    x, d = star.x(spark, sf), star.dims(spark, sf)
    return layers.stack([(x, d.n_cells, d.n_genes)] * 2, axis=1)


@query("SELECT layer, row_number() OVER (ORDER BY layer) - 1 AS place FROM (SELECT DISTINCT 'counts.' || (l_linenumber + 7) AS layer FROM lineitem)")
def O_sort_suffix(spark, sf):
    found = [r[0] for r in spark.read.parquet(f"{sf}/lineitem.parquet").select(F.concat(F.lit("counts."), (F.col("l_linenumber") + 7).cast("string"))).distinct().collect()]  # names of layers
    return spark.createDataFrame([(n, i) for i, n in enumerate(layers.groups(dict.fromkeys(found, (1, 1)))["counts"])], "layer string, place long")


@query("SELECT 'X_wide' AS name, cell_idx - c0 AS cell_idx, gene_idx - g0 AS gene_idx, value FROM x, d", "x", "d")
def O_snk_split_dims(spark, sf):
    """A layer that is one gene wider than X, beside three that are not."""
    ds = star.rich(spark, sf)
    n, m = ds.dims.n_cells, ds.dims.n_genes
    wide = ds.x.select(F.lit("wide").alias("layer"), CELL, GENE, VALUE)
    return layers.over_split(ds.layers.unionByName(wide), ds.layer_dims | {"wide": (n, m + 1)}, (n, m), layout.nonzero(), f"{CELL} long, {GENE} long, {VALUE} double")


# order


@query("SELECT p_brand, p_name, p_partkey, p_retailprice, p_size, p_type, p_partkey AS gene_idx FROM part")
def O_sort_columns(spark, sf):
    return select.sorted_columns(star.var(spark, sf), GENE)


# functions


@query("SELECT p_partkey, replace(p_name, ' ', '_') AS name, replace(p_name, ' ', '_') || '_' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '_b!' ELSE '' END AS odd FROM part")
def O_fn_sanitize(spark, sf):
    """Names with blanks; names with each of the 29 special characters twice in a row, and some at their end."""
    t = spark.read.parquet(f"{sf}/part.parquet")
    mark = F.substring(F.lit(names.SPECIAL), (F.col("p_partkey") % len(names.SPECIAL) + 1).cast("int"), F.lit(1))
    odd = F.concat("p_name", mark, mark, "p_partkey", mark, F.when(F.col("p_partkey") % 2 == 0, "b!").otherwise(""))
    return t.select("p_partkey", names.sanitised_column(F.col("p_name")).alias("name"), names.sanitised_column(odd).alias("odd"))


@query("SELECT p_partkey, CASE WHEN k = 1 THEN p_name ELSE p_name || '_dup' || k END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def O_fn_dedup(spark, sf):
    return names.without_repeats_column(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.col("p_name").alias("name")), "name", "p_partkey").select("p_partkey", "name")


@query("SELECT doc_id, strlen(t) AS bytes, text LIKE replace(replace(replace(t, '\\', '\\\\'), '%', '\\%'), '_', '\\_') || '%' ESCAPE '\\' AS prefix, strlen(text) <= 256 OR strlen(t) > 252 AS full FROM (SELECT doc_id, coalesce(text, '') AS text, list_reduce(list_filter([1], lambda q: false) || [0], lambda a, b: a) AS z, t FROM documents, LATERAL (SELECT CASE WHEN strlen(coalesce(text, '')) <= 256 THEN coalesce(text, '') ELSE (SELECT max_by(substr(coalesce(text, ''), 1, k), k) FROM range(60, 257) r(k) WHERE strlen(substr(coalesce(text, ''), 1, k)) <= 256) END AS t) q)")
def O_fn_truncate(spark, sf):
    """Documents' texts cut to 256 bytes at a character's end."""
    t = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = t.withColumn("t", names.truncated_column(F.col("text")))
    return cut.select("doc_id", F.octet_length("t").cast("long").alias("bytes"), F.col("text").startswith(F.col("t")).alias("prefix"), ((F.octet_length("text") <= 256) | (F.octet_length("t") > 252)).alias("full"))


def _messy(spark, sf):
    ds = star.dataset(spark, sf)
    return ds.with_(obs=ds.obs.withColumnRenamed("o_orderstatus", "order status").withColumnRenamed("o_custkey", "1key"))


@query("SELECT * FROM (VALUES ('obs', 'order status', 'special_characters', 'info', 'order_status'), ('obs', '1key', 'numeric_start', 'info', 'X1key')) t(component, \"column\", kind, severity, fix)")
def O_fn_issues(spark, sf):
    return diagnose.frame(diagnose.issues(_messy(spark, sf)), spark)


@query("SELECT o_orderkey AS cell_idx, o_orderstatus AS order_status, o_custkey AS X1key FROM orders")
def O_fn_clean(spark, sf):
    return diagnose.clean(_messy(spark, sf)).obs.select(CELL, "order_status", "X1key")


@query("SELECT * FROM (VALUES ('obs', '1key', 'X1key'), ('obs', 'order status', 'order_status')) t(component, \"from\", \"to\")")
def O_fn_audit(spark, sf):
    log = diagnose.read_audit(diagnose.audit(diagnose.clean(_messy(spark, sf))))
    return spark.createDataFrame([(m["component"], m["from"], m["to"]) for m in log], "component string, from string, to string")


@query("SELECT l_quantity::INTEGER AS l_quantity, l_discount FROM lineitem")
def O_fn_dtype(spark, sf):
    from tesserae.functions import dtypes

    return dtypes.integers_restored(spark.read.parquet(f"{sf}/lineitem.parquet").select("l_quantity", "l_discount"))


@query("SELECT s_suppkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.2f KB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.2f MB', b / 1048576.0) WHEN b < 1099511627776 THEN printf('%.2f GB', b / 1073741824.0) ELSE printf('%.2f TB', b / 1099511627776.0) END AS size FROM (SELECT s_suppkey, CAST(s_suppkey AS BIGINT) * s_suppkey * 10000 AS b FROM supplier)")
def O_fn_bytes(spark, sf):
    n = F.col("s_suppkey").cast("long")
    return spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", text.size_column(n * n * 10000).alias("size"))


@query("SELECT * FROM (VALUES (5.25, '5.2s'), (75.0, '1m 15s'), (3700.0, '1h 1m')) t(seconds, shown)")
def O_fn_duration(spark, sf):
    return spark.createDataFrame([(s, text.duration(s)) for s in (5.25, 75.0, 3700.0)], "seconds double, shown string")


@query("SELECT o_orderkey, format('{:,}', o_orderkey * 1000) AS shown FROM orders")
def O_fn_number(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", text.number_column(F.col("o_orderkey") * 1000).alias("shown"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events")
def O_fn_uns(spark, sf):
    from tesserae.functions import dtypes

    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", dtypes.nested("props", "$.k").alias("k"))


# chunks


@query("SELECT CAST(floor(cell_idx / 1000) AS BIGINT) AS chunk, count(*) AS nnz, sum(value) AS total, max(value) AS largest FROM x GROUP BY 1", "x")
def O_udf_chunk(spark, sf):
    import pandas as pd

    def summary(chunk: int, entries: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [chunk], "nnz": [len(entries)], "total": [entries[VALUE].sum()], "largest": [entries[VALUE].max()]})

    return layout.process_chunks(star.x(spark, sf), 1000, summary, "chunk long, nnz long, total double, largest double")


@query("SELECT CAST(floor(cell_idx / 700) AS BIGINT) AS chunk, cell_idx AS first, gene_idx AS gene, value FROM (SELECT *, row_number() OVER (PARTITION BY CAST(floor(cell_idx / 700) AS BIGINT) ORDER BY cell_idx, gene_idx) AS k FROM x) WHERE k = 1", "x")
def O_str_process(spark, sf):
    """A function that relies on the order within a chunk: its first entry."""
    import pandas as pd

    def first(chunk: int, entries: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [chunk], "first": [entries[CELL].iloc[0]], "gene": [entries[GENE].iloc[0]], "value": [entries[VALUE].iloc[0]]})

    return layout.process_chunks(star.x(spark, sf), 700, first, "chunk long, first long, gene long, value double")


from tesserae.plans import files  # noqa: E402, F401  (registers its queries)
