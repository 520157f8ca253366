"""From raw documents to token ids: the stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept, and returns a DataFrame.
All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import base, bpe, decontaminate, quality, secrets, simhash


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more; the classifier learns from these documents and the labels."""
    model = quality.fit(docs, base.load(spark, sf_dir, "labels"), base.crc_mod("doc_id", 5) != 0)
    return quality.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates, that with the smallest doc_id."""
    return simhash.deduplicated(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a test item."""
    return decontaminate.clean(docs, base.load(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in their texts replaced by a mark, and n_chars counted again."""
    cleaned = secrets.redacted(docs, secrets.fit(docs))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of all documents: their token ids, and a digest of the texts that these decode to."""
    import public_tokenizers

    coded = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_copies),
    ("secrets", redact_secrets),
    ("bpe", encode_tokens),
]

#: No stage but the exact parts of some can be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents, each stage's result written as Parquet and read again."""
    docs = base.load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = base.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
