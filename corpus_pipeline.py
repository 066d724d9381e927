"""The corpus pipeline: toxic documents go, one of each group of near-duplicates stays, personal data get pseudonyms,
sources are mixed to their weights, and what is left is encoded.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutylens.llm import bpe, mixing, near_text, pii, toxicity
from dutylens.llm.common import new_folder
from dutylens.llm.queries import PII_KEY, tokenizer_file


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 3: documents with a score of 0.7 or more go."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 9: SimHash fingerprints and their search, components and choice of one document, with links by 5-word shingles at an exact similarity of 0.8.

    Near fingerprints are candidates, checked exactly. SimHash alone doesn't reach all links of that similarity (README, "Pipeline"), so texts
    that meet by minimum hashes are candidates beside them.
    """
    return near_text.keep_one(docs, width=5, similarity=0.8)


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 8: texts with pseudonyms; n_chars, where there is one, follows."""
    out = pii.pseudonymise(docs, PII_KEY)
    if "n_chars" in out.columns and "text" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(out.schema["n_chars"].dataType))
    return out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 2: each document as often as its source's weight asks, from not at all to three times."""
    return mixing.mix_rows(docs, weights=(5, 2, 1), share=1.0, max_passes=3)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 5: doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of the mix."""
    return bpe.encode_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", without_near_duplicates),
    ("pii", with_pseudonyms),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: Neither the trees nor the encoder can be said in SQL; tests/llm (test_pipeline_run) hold run() against plain Python for all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
