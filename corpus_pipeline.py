"""The corpus pipeline: quality rules, near-dedup, personal data, mixing, encoding; each stage reads what the one before it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findloom.llm import bpe, mixing, neardup, pii, quality
from findloom.llm.common import shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars being counted again."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail. Short documents are judged by their lines alone: one word is enough here."""
    return _documents(quality.quality(docs, min_words=1).where("kept").withColumn("text", F.col("clean_text")))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, and of rows that share it the smallest text. Texts without words are in no
    group and all stay."""
    kept = neardup.verdicts(docs).where("kept and component is not null").select("doc_id", "content", "component").distinct()
    content = F.md5(F.col("text").cast("binary"))
    first = docs.join(kept, (content == kept["content"]) & docs["doc_id"].eqNullSafe(kept["doc_id"])).select("component", *[docs[c] for c in COLUMNS])
    first = first.groupBy("component").agg(F.min(F.struct(*COLUMNS)).alias("d")).select("d.*")
    return first.unionByName(docs.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).select(*COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets."""
    return _documents(pii.mask_pii(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights (size to the power 0.5), in a global shuffle."""
    return mixing.mix(docs, mixing.source_rates(docs)).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the ids of each text."""
    import public_tokenizers

    return bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "source", F.size("ids").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", neardup_stage),
    ("PII", pii_stage),
    ("mixing sources", mixing_stage),
    ("BPE encoding", encoding_stage),
]
#: The shingle links, the tokenizer and the added kinds of personal data have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{k}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
