"""A dataset made of star-schema tables: orders are cells, parts are genes, quantities are values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.model import CELL, GENE, VALUE, Dataset, Dims


def x(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return lines.groupBy(F.col("l_orderkey").alias(CELL), F.col("l_partkey").alias(GENE)).agg(F.sum("l_quantity").alias(VALUE))


def other(x: DataFrame) -> DataFrame:
    """x with some entries changed and some gone."""
    changed = F.when((F.col(CELL) + F.col(GENE)) % 7 == 0, F.col(VALUE) + 0.5).otherwise(F.col(VALUE))
    return x.where((F.col(CELL) * 31 + F.col(GENE)) % 11 != 0).withColumn(VALUE, changed)


def layers(spark: SparkSession, sf: str) -> DataFrame:
    """A layer counts.<flag> for each return flag, of all cells and genes."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return lines.groupBy(F.concat(F.lit("counts."), "l_returnflag").alias("layer"), F.col("l_orderkey").alias(CELL), F.col("l_partkey").alias(GENE)).agg(F.sum("l_quantity").alias(VALUE))


def obs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet").withColumn(CELL, F.col("o_orderkey"))


def var(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").withColumn(GENE, F.col("p_partkey"))


def obsm(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.lit("X_emb").alias("name"), F.col("vec_id").alias(CELL), F.col("embedding").cast("array<double>").alias("vec"))


def dims(spark: SparkSession, sf: str) -> Dims:
    """Extents from the annotation tables, by two aggregates over a key column each."""
    n, lo = spark.read.parquet(f"{sf}/orders.parquet").agg(F.count(F.lit(1)), F.min("o_orderkey")).first()
    m, first = spark.read.parquet(f"{sf}/part.parquet").agg(F.count(F.lit(1)), F.min("p_partkey")).first()
    return Dims(n, m, first_cell=lo, first_gene=first)


def dataset(spark: SparkSession, sf: str) -> Dataset:
    d = dims(spark, sf)
    flags = [f"counts.{f}" for f in "ANR"]
    return Dataset(x(spark, sf), obs(spark, sf), var(spark, sf), d, layers(spark, sf), {f: (d.n_cells, d.n_genes) for f in flags}, obsm(spark, sf))


#: The order priorities, as an ordered list of categories.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def rich(spark: SparkSession, sf: str) -> Dataset:
    """A dataset with every part, indices from 0, with a nullable and a categorical column."""
    from tesserae.sources.bundle import with_categories

    d = dims(spark, sf)
    cell, gene = F.col(CELL) - d.first_cell, F.col(GENE) - d.first_gene
    moved = lambda t: t.withColumns({CELL: cell, GENE: gene})
    cells = obs(spark, sf).withColumn(CELL, cell)
    genes = var(spark, sf).withColumn(GENE, gene)
    half = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("half")
    table = cells.select(CELL, F.concat(F.lit("c"), "o_orderkey").alias("_index"), "o_orderkey", "o_custkey", half, "o_orderstatus", "o_totalprice", "o_orderpriority", (F.col("o_custkey") % 2 == 0).alias("even"))
    vec = lambda t, name, i, *c: t.select(F.lit(name).alias("name"), i, F.array(*[F.col(x).cast("double") for x in c]).alias("vec"))
    near = cells.select(F.lit("near").alias("name"), F.col(CELL).alias("i"), (F.col("o_custkey") % d.n_cells).alias("j"), F.col("o_totalprice").alias(VALUE))
    like = genes.select(F.lit("like").alias("name"), F.col(GENE).alias("i"), (F.col(GENE) * 7 % d.n_genes).alias("j"), F.col("p_size").cast("double").alias(VALUE))
    flags = {f"counts.{f}": (d.n_cells, d.n_genes) for f in "ANR"}
    return Dataset(
        moved(x(spark, sf)), with_categories(table, "o_orderpriority", list(PRIORITIES), True), genes.select(GENE, F.concat(F.lit("g"), "p_partkey").alias("_index"), "p_name", "p_size", "p_retailprice"),
        Dims(d.n_cells, d.n_genes, active_assay="RNA"), moved(layers(spark, sf)), flags, vec(cells, "X_two", CELL, "o_totalprice", "o_custkey"), vec(genes, "loads", GENE, "p_retailprice", "p_size"), near, like,
        vec(cells, "s", CELL, "o_custkey", "o_totalprice").select(CELL, F.col("vec").alias("coords")),
    )
