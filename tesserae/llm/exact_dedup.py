"""Exact dedup by stateful streaming.

A streaming query reads (digest, stable identifier, content locator) and keeps one state per digest,
without expiry, in a RocksDB state store: the smallest identifier with its locator, and the number of
rows. Tasks aggregate before the shuffle, so a group of copies is a row per task, however large.
The stream takes bounded micro-batches and starts again from its checkpoint in the shared folder.

Digests alone don't decide: rows whose digest was hit again are grouped by their full texts (combined
before the shuffle as well), and a digest with two texts is split up by text. Only texts of hits move: a filter of bounded size, of
hashed locators of hits, is applied where texts are read, so other texts never enter a shuffle (but for the filter's false positives).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import folders
from tesserae.llm.common import FILE, ROW, anchored, located, rows_of, shared_folder, stored, text_of

#: Each run of these characters counts as one space.
WHITE = r"[\x20\x09-\x0D]+"
#: Bytes of digest table that a micro-batch reads.
BATCH_BYTES = 1 << 30
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Of the state stores: on disk, all of an executor's in so much memory, and gone from it once a batch is committed.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
}


def normalised(text: F.Column) -> F.Column:
    """White space runs as one space; texts without a run or another blank than a space are left as they are."""
    return F.when(text.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(text, WHITE, " ")).otherwise(text)


def identifier() -> F.Column:
    """Sorts by doc_id (null last), then by locator."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(FILE).alias("file"), F.col(ROW).alias("row"))


def first_of_each(digests: DataFrame) -> DataFrame:
    """Of streamed or batch rows (digest, doc_id, _file, _row): digest, first (smallest identifier), n. Keyed state, no watermark."""
    return digests.groupBy("digest").agg(F.min(identifier()).alias("first"), F.count(F.lit(1)).alias("n"))


def run_stream(spark: SparkSession, path: str, checkpoint: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Stream the Parquet digest table at ``path`` through the keyed state; returns the state: digest, first, n.

    Calling it again with the same checkpoint takes up what has been added to ``path`` since.
    """
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(path)
    conf, before = spark.conf, {}
    # read when a query starts; put back at once
    for k, v in STATE_CONF.items():
        before[k] = conf.get(k, None)
        conf.set(k, v)
    try:
        query = first_of_each(source).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("noop").start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    query.awaitTermination()
    state = spark.read.format("statestore").load(checkpoint)
    first, n = state.schema["value"].dataType.names
    return state.select(F.col("key.digest").alias("digest"), F.col(f"value.`{first}`").alias("first"), F.col(f"value.`{n}`").alias("n"))


#: Words of 64 bits of the filter of hits, at most (8 MB; a broadcast of about 40 MB).
FILTER_WORDS = 1 << 20
#: Parts in which copies are combined first, then all together, so that no task gets a row of a hot group from every task before it.
COMBINERS = 16


def filtered(rows: DataFrame, hits: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """``rows`` without most of those whose locators aren't in ``hits``; none that is gets lost.

    Rows with ``_file`` and ``_row``. A hash of the locator is a bit of ``words`` words, which is what is broadcast, however many hits there are: beyond some ten million
    hits the filter lets more and more other rows pass.
    """
    at = F.pmod(F.xxhash64(FILE, ROW), F.lit(64 * words))
    word, bit = F.shiftright(at, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    table = hits.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return rows.withColumn("_word", word).join(F.broadcast(table), "_word").where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")


def dedup(docs: DataFrame, bits: int = 256, batch_bytes: int = BATCH_BYTES, folder: str | None = None) -> DataFrame:
    """The group of equal texts of every row.

    Texts are equal if identical once each run of ``[\\x20\\x09-\\x0D]`` is one space; null counts as
    empty. Of equal texts the row with the smallest doc_id stays (null ids come last; of rows with one
    doc_id, the first by locator). Returns, one row for each row of ``docs``: doc_id, _file, _row, keep_id,
    group_size, kept, text_sha256. Other columns are not read; an empty table gives an empty table.
    ``bits`` shortens the digests of the state, for tests of what happens when two texts share one. ``folder``, in a store that all machines
    reach, keeps digests and state: a call that was broken off goes on where it was if it is called again with the same ``docs`` and folder.
    """
    spark = docs.sparkSession
    docs = anchored(docs)
    sha = F.sha2(normalised(text_of()).cast("binary"), 256)
    rows = located(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), FILE, ROW, text_of().alias("text"))
    folder = folder or shared_folder(spark, "exact")
    table = rows.select("doc_id", FILE, ROW, F.unhex(sha).alias("sha")).withColumn("digest", F.col("sha") if bits == 256 else F.substring("sha", 1, bits // 8))
    if not folders.exists(spark, f"{folder}/digests/_SUCCESS"):
        table.write.mode("overwrite").parquet(f"{folder}/digests")
    state = run_stream(spark, f"{folder}/digests", f"{folder}/checkpoint", batch_bytes)
    digests = spark.read.schema(table.schema).parquet(f"{folder}/digests")

    # hits: rows of a digest that more than one row has, by full text
    joined = stored(digests.join(state, "digest").select("doc_id", FILE, ROW, "sha", "digest", "first", "n"), "exact-joined")
    hits = joined.where("n > 1").select(FILE, ROW, "digest")
    texts = filtered(rows, hits).join(hits, [FILE, ROW]).select(FILE, ROW, "doc_id", normalised(F.col("text")).alias("norm"), "digest")
    parts = texts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(COMBINERS))).groupBy("digest", "norm", "part").agg(F.min(identifier()).alias("first"), F.count(F.lit(1)).alias("n"))
    classes = parts.groupBy("digest", "norm").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    split = classes.groupBy("digest").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("digest")
    split = split.checkpoint()  # empty but for digests that two texts share
    out = joined
    if not split.isEmpty():
        mixed = joined.join(split, "digest", "left_semi").select(FILE, ROW)
        own = texts.join(split, "digest", "left_semi").select(FILE, ROW, "digest", "norm")
        by_text = own.join(classes.join(split, "digest", "left_semi"), ["digest", "norm"]).select(FILE, ROW, "first", "n")
        base = joined.join(mixed, [FILE, ROW], "left_anti")
        out = base.unionByName(joined.drop("first", "n").join(by_text, [FILE, ROW]))
    return out.select(
        "doc_id", FILE, ROW, F.col("first.id").alias("keep_id"), F.col("n").cast("long").alias("group_size"),
        ((F.col("first.file") == F.col(FILE)) & (F.col("first.row") == F.col(ROW))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts (see ``dedup``), with all of its columns, whatever their names."""
    docs = anchored(docs)
    return rows_of(docs, dedup(docs).where("kept"))
