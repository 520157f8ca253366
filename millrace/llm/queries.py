"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, bpe, decontaminate, gif, language, quality, secrets, simhash, suffix_tree, token_counts, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    docs = base.load(spark, sf_dir, "documents")
    return bpe.encode_decode(docs, vocabulary("word_bpe_49k.json")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op10_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as GIFs in a table, read back and decoded."""
    docs = base.load(spark, sf_dir, "documents")
    stored = base.written(gif.store_texts(docs), "gif").withColumn("media_bytes", F.length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    found = gif.decode_column(stored, others=("n_bytes", "media_bytes", "media_sha256"), channels=1)
    return found.select(
        "doc_id",
        "n_bytes",
        F.length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, length(pixels) - 15, 16)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.concat_ws(",", F.col("greys").cast("array<string>")).alias("feature"),
        F.size("frames").alias("n_frames"),
        F.to_json(F.transform("frames", lambda f: F.struct(f["start_ms"].alias("start_ms"), f["delay_ms"].alias("delay_ms"), f["colours"].alias("colours")))).alias("frames"),
    )


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of all documents over a byte-level vocabulary."""
    return token_counts.token_counts(base.load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learnt from three quarters of them."""
    docs = base.load(spark, sf_dir, "documents")
    held_out = base.crc_mod("doc_id", 4) == 2
    model = language.fit(docs, ~held_out)
    return language.predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of all documents, learnt from four fifths of the positive labels."""
    docs, labels = base.load(spark, sf_dir, "documents"), base.load(spark, sf_dir, "labels")
    held_out = base.crc_mod("doc_id", 5) == 0
    scored = quality.score(docs, quality.fit(docs, labels, ~held_out))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: by the fixed patterns, and with what the random field adds."""
    docs = base.load(spark, sf_dir, "documents")
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secrets.find(docs, secrets.fit(docs)).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans")
    )


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    records = warc.read(warc.write(warc.plan(base.load(spark, sf_dir, "pages"))))
    number = lambda c: F.nullif(F.regexp_extract(c, r"page:(-?\d+)>", 1), F.lit("")).cast("long")
    return records.select(
        # what was just written reads back whole: a gap would be a lost page, so it ends the query
        F.when(F.coalesce("error", "warning").isNull(), number("record_id")).otherwise(F.raise_error(F.concat_ws(" ", "archive", "start", "end", "error", "warning")).cast("long")).alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.substring_index("payload_digest", ":", -1)).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


ORACLES["op1_warc"] = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
m AS (SELECT digest, min(page_id) AS least FROM d WHERE n >= 100 GROUP BY digest)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN m.least <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m.least <> d.page_id THEN m.least END AS refers_to
FROM d LEFT JOIN m ON d.digest = m.digest AND d.n >= 100
"""


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate groups of all documents."""
    found = simhash.groups(base.load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item that any document holds a copy of."""
    return decontaminate.find(base.load(spark, sf_dir, "documents"), base.load(spark, sf_dir, "benchmark"))


@query
def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of all documents, learnt from four fifths of them."""
    docs = base.load(spark, sf_dir, "documents")
    held_out = F.coalesce(base.crc_mod("doc_id", 5) == 1, F.lit(False))
    return suffix_tree.fit_and_score(docs, ~held_out, kept={"held_out": held_out})
