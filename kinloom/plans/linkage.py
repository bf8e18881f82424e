"""The linkage plan over one relation of records: a cheap score in place of a trained model, everything else as in production."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators import decision, retrieval
from kinloom.sources import records


def link(rows: DataFrame, k: int = 10, miss: float = 0.05) -> DataFrame:
    """(source1_entity_id, matched_entity_ids) for every S1 record, from one lazy plan: retrieval, one-to-one assignment, expected F0.5."""
    as_text = lambda r: r.select(F.col("entity_id").alias("id"), F.col("country").alias("part"), F.concat_ws(" ", "name", "addr").alias("text"))
    s1, pool = rows.where("src = 1"), rows.where("src <> 1")
    found = retrieval.tfidf_top_k(as_text(s1), as_text(pool), k, retrieval.word_tokens(F.col("text")))
    scored = found.select("s1", "cand", F.least(F.col("block_sim"), F.lit(1.0)).alias("p"))
    chosen = decision.expected_f(decision.one_to_one(scored, 0.01), miss)
    return records.id_lists(s1, chosen.where("p >= 0.5"), "matched_entity_ids")
