"""What the corpus operators share: row identity, the shared folder, Arrow helpers.

Row identity. ``doc_id`` may be null or repeated, so operators that must tell rows apart
use the *locator* of a row, ``(_file, _row)``: a 64-bit hash of the Parquet file's path and
the row's index in that file. It is the same in every scan of the table. Input that is not
read straight from Parquet is written to the shared folder first.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import folders

#: Column names reserved for the operators' own use inside a plan.
FILE, ROW = "_file", "_row"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share (see ``tesserae.folders``); it goes when the session's process ends."""
    return folders.new(spark, name)


Batches = Iterator[pa.RecordBatch]


def released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow, after which the worker gives memory it no longer uses back to the system, as workers are used again."""

    @functools.wraps(run)
    def held(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return held


#: Bytes of a batch that goes to a Python worker, unless the session names a number other than Spark's own.
BATCH_BYTES, SPARKS_OWN = 4 << 20, "67108864b"


def arrow_map(df: DataFrame, run: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``df.mapInArrow`` by ``released``, in batches that are small however long the texts are."""
    limit, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(limit) == SPARKS_OWN:
        conf.set(limit, BATCH_BYTES)
    return df.mapInArrow(released(run), schema)


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and checkpoints of steps that nothing refers to any more; it only notices when both garbage collectors ran."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _locator(docs: DataFrame) -> tuple[Column, Column]:
    # by metadataColumn, as a table may have a column named _metadata
    metadata = docs.metadataColumn("_metadata")
    return F.xxhash64(metadata.getField("file_path")), metadata.getField("row_index")


def anchored(docs: DataFrame) -> DataFrame:
    """``docs`` itself if its rows have locators, else a stored copy of it, whose rows have."""
    try:
        docs.select(*_locator(docs)).schema  # resolves the plan
        return docs
    except AnalysisException:
        return stored(docs, "rows")


def located(docs: DataFrame, *columns: str) -> DataFrame:
    """The given columns of anchored ``docs`` with the locator columns ``_file`` and ``_row``."""
    file, row = _locator(docs)
    return docs.select(*[F.col(f"`{c}`") for c in columns], file.alias(FILE), row.alias(ROW))


def rows_of(docs: DataFrame, located_rows: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of anchored ``docs`` whose locators are in ``located_rows``; columns named like the locators are kept apart."""
    file, row = _locator(docs)
    inside = [f"c{i}" for i in range(len(docs.columns))]
    numbered = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(docs.columns, inside, strict=True)], file.alias(FILE), row.alias(ROW))
    out = numbered.join(located_rows.select(FILE, ROW), [FILE, ROW], how)
    return out.select(*[F.col(x).alias(c) for c, x in zip(docs.columns, inside, strict=True)])


def text_of(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle of this session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of doc_id.

    A first pass counts (no text is read for that), so that the second only passes on about as many rows
    as are wanted, and no task sends the driver more than its share.
    """
    n = rows.count()
    h = F.xxhash64(F.col("doc_id"), F.lit(17))
    share = min(1.0, 1.1 * most / max(1, n))
    few = rows if share >= 1 else rows.where(h < F.lit(int(-(2**63) + share * (2**64 - 1))))
    return few.orderBy(h, "doc_id").limit(most)
