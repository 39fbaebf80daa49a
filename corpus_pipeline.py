"""The corpus pipeline: toxic documents go, near-duplicates go, secrets are masked, sources are mixed, the rest is packed.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; each result is written as Parquet
and read again. All stages but the last return the columns of ``documents`` (any further columns stay, too). Nulls,
empty texts, repeated rows and empty tables are handled as the operators' modules state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import new_path
from ledgerlens.llm.mixing import mix_documents
from ledgerlens.llm.near_dedup import drop_near_duplicates
from ledgerlens.llm.packing import encode_pieces, place
from ledgerlens.llm.secret_scan import redact
from ledgerlens.llm.toxicity import reject_toxic

#: Texts at least this similar are near-duplicates here; op10's own threshold is 85.
NEAR_PERCENT = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go; it learns from ``labels``."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays."""
    return drop_near_duplicates(docs, percent=NEAR_PERCENT)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; ``n_chars`` follows the text where it changed."""
    before = docs.withColumn("__text", F.col("text"))
    masked = redact(before)
    n = F.when(F.col("text") == F.col("__text"), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(n)).drop("__text")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives its share: whole epochs and a prefix of the next."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's pieces with their places in sequences of 2048 tokens."""
    import public_tokenizers

    pieces = encode_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return place(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the classifier, the confirmed components and the packing; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
