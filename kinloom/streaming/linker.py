"""Incremental linking: new records of a stream against a fixed set of S1 entities.

The entity side is static: its token weights and the idf table are tables. A micro-batch of new records is weighted with that idf and
joined by (country, token), the best entities of each record are kept, and the batch is appended. Records seen before are
dropped within a watermark, so a source that repeats itself links once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from kinloom.operators import retrieval


def link_batch(batch: DataFrame, s1_weights: DataFrame, idf: DataFrame, k: int = 3) -> DataFrame:
    """(cand, s1, sim, rank) for a batch of records (id, part, text)."""
    counts = retrieval.token_counts(batch, retrieval.word_tokens(F.col("text")))
    found = retrieval.cosine_top_k(retrieval.tfidf_weights(counts, idf), s1_weights, k)
    return found.select(F.col("q").alias("cand"), F.col("c").alias("s1"), "sim", "rank")


def link_stream(records: DataFrame, s1_weights: DataFrame, idf: DataFrame, path: str, checkpoint: str, k: int = 3, late: str = "10 minutes") -> DataStreamWriter:
    """A writer that appends the links of a stream of records (id, part, text, seen timestamp) to a Parquet path; start() runs it.

    Each batch is written under its number, so a batch that is replayed after a failure replaces itself.
    """
    fresh = records.withWatermark("seen", late).dropDuplicatesWithinWatermark(["id"])

    def write(batch: DataFrame, number: int) -> None:
        link_batch(batch.select("id", "part", "text"), s1_weights, idf, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
