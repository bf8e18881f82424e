"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; ``run`` writes each stage's result as a table in the
shared folder and reads it again, so a lost executor never costs more than the running stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import line_dedup, mixing, near_duplicates, packing, quality, simhash
from kinloom.llm.common import stored, table
from kinloom.llm.queries import tokenizer_files


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, holds to be well written and not toxic."""
    return quality.keep_good(docs, quality.train(docs, quality.graded(table(spark, sf_dir, "labels"))))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of two or more lines, and of single lines of 50 words or more, go from the texts; every document stays, and n_chars is counted anew."""
    out = line_dedup.remove_repeated_lines(docs, min_lines=2, long_words=50)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("__line_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard similarity of five-word shingles 0.8 or more) stays: the one with the smallest doc_id, once. Rows without an id stay.

    SimHash groups come first, by the Gray-order index; their links are checked exactly, and bands of minimum hashes find the links that no fingerprint of few differing bits shows.
    """
    alike = simhash.simhash_components(docs, words=5, size=1, distance=4)
    groups = near_duplicates.near_duplicate_components(docs, words=5, threshold=0.8, proposed=alike)
    heads = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(heads, "doc_id", "left_semi").select(docs.columns)
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is not null and n > 1").isEmpty():
        kept = kept.withColumn("__form", F.xxhash64("text")).dropDuplicates(["doc_id", "__form"]).select(docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson copies of the documents, so that sources weigh as the square root of their size; in a global random order."""
    return mixing.poisson_mix(docs, seed="pipeline-1", temperature=0.5).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their ids, packed in sequences of at most 1024; copy tells the copies of a document apart."""
    return packing.pack_documents(docs.withColumn("copy", F.monotonically_increasing_id()), sequence=1024, end_id=2, with_ids=True, carry=("copy",), **tokenizer_files())


STAGES = [
    ("quality_classifier", keep_good_documents),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("poisson_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The classifier, near-duplicates and the tokenizer are not expressible in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
