"""Corpus pipeline: stages over ``documents``, each calling one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all
its predecessor kept, and its decisions take effect.  :func:`run` writes every
stage's result as Parquet in the shared folder and rereads it as the next
stage's input.  All stages but the last return the columns of ``documents``;
the last adds the token ids of each text and the SHA-256 of the text they
decode to, which identifies it without storing it again.

Edge cases are those of the operators: null texts count as empty; rows with a
null doc_id cannot be named and are never dropped as near duplicates; an empty
table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, common, decontaminate, exact_dedup, near_dedup, quality


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score(docs, labels).where(F.col("score") >= quality.THRESHOLD).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near duplicates (five words, 0.8)."""
    return near_dedup.deduplicate(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    found = decontaminate.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~decontaminate.contaminated(F.col("n_words"), decontaminate.n_hit())).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the digest of the text that these decode to."""
    vocabulary = bpe.load_vocabulary(spark)
    out = bpe.encode(docs, vocabulary, decoded=True)
    return out.select("row.*", F.size("ids").cast("bigint").alias("n_tokens"), F.col("ids").alias("token_ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("benchmark decontamination", clean_of_benchmark),
    ("BPE encoding and decoding", tokens),
]

#: The classifier and the encoder cannot be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
