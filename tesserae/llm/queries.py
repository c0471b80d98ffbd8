"""The registered query of each corpus operator. Each applies the operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tesserae.llm import bpe

    return bpe.encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), ids=False, decoded=False)


@query
def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import media

    return media.audio(documents(spark, sf_dir), digests=True)


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import line_dedup

    return line_dedup.dedup_lines(documents(spark, sf_dir), min_docs=10, min_chars=1, text=False)


ORACLES["op10_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key
GROUP BY doc_id
"""


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import exact_dedup

    return exact_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op5_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import langid

    docs = documents(spark, sf_dir).withColumn("held_out", langid.held_out())
    model = langid.train(docs.where("NOT held_out"))
    return langid.predict(docs, model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import near_dedup

    return near_dedup.near_dedup(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import toxicity

    docs = documents(spark, sf_dir).withColumn("held_out", toxicity.held_out())
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    model = toxicity.train(docs.where("NOT held_out"), labels)
    return toxicity.score(docs, model, keep=("held_out",)).select("doc_id", "held_out", "score", "predicted")


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import mixing

    return mixing.mixture(documents(spark, sf_dir)).select("doc_id", "source", "n_tokens", "epoch", "block", "position")


@query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import licenses

    return licenses.scan_documents(documents(spark, sf_dir))


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import secrets

    return secrets.scan_documents(documents(spark, sf_dir), secrets.train())
