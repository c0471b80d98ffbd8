"""A corpus pipeline: language ID, exact dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; ``run`` writes each
stage's rows to the shared folder and reads them again for the next. Stages return the columns of documents (``COLUMNS``); columns
beyond those go. Null, empty and letterless texts have no language and go in the first stage; null doc_ids and repeated rows are rows like others, told apart
by locator, until exact dedup leaves one of each text. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, exact_dedup, langid, mixing, near_dedup
from tesserae.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is not rejected (operator 1); texts without a letter have none. The model learns from the rows that op1_language_id's does."""
    model = langid.train(docs.where(~langid.held_out()))
    judged = langid.predict(docs, model, keep=("text", "lang", "source", "n_chars"))
    return judged.where(~F.col("rejected")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (operator 5)."""
    return exact_dedup.deduplicated(docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates (operator 8)."""
    return near_dedup.deduplicated(docs).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mixture, repeated as it repeats them (operator 2)."""
    return mixing.mixed(docs).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row (operator 7)."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True, decoded=False)


STAGES = [("language_id", identified), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs


#: Trained models, sampling and automata can't be written in SQL; tests/llm/test_contracts.py holds each stage against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
