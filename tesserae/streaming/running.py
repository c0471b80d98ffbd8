"""Running counts over arriving entries. An extension: the batch operators do not need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserae.model import CELL, VALUE, X_SCHEMA


def arriving(spark: SparkSession, path: str, files_at_a_time: int = 64) -> DataFrame:
    """Entries of the Parquet files in a folder, those that come later too."""
    return spark.readStream.schema(X_SCHEMA).option("maxFilesPerTrigger", files_at_a_time).parquet(path)


def totals(entries: DataFrame) -> DataFrame:
    """cell_idx, nnz, total so far. Sums do not depend on the order of arrival; variable genes do need all entries."""
    return entries.groupBy(CELL).agg(F.count(F.lit(1)).alias("nnz"), F.sum(VALUE).alias("total"))


def keep_totals(entries: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write the totals after each batch to ``table``/batch=<n>, all that is there by now; a repeated batch replaces itself."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={n}")

    return totals(entries).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
