"""Obligations from documents as they arrive; an extension, as the batch analysis has no stream of its own.

Ingestion and extraction look at one document at a time, so a micro-batch needs no state: each is turned into
obligations and appended. A document that arrives again gives the same identifiers, and the table is keyed by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dutylens.operators import ingest
from dutylens.plans.pipeline import obligations_of


def read_text_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """path, raw of each new text or Markdown file of a folder."""
    d = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.{txt,md}").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return d.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def obligations_of_batch(batch: DataFrame) -> DataFrame:
    pol = ingest.policies(batch.withColumn("doc", F.xxhash64("path")))
    sentences = ingest.sentences(ingest.sections(pol))
    return obligations_of(sentences.withColumn("ord", F.xxhash64("doc", "section_index", "sentence_index")))


def append_obligations(stream: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the obligations of each micro-batch to Parquet files under `table`, one folder per batch, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        obligations_of_batch(batch).write.mode("overwrite").parquet(f"{table}/batch={epoch}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
