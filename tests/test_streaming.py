from pyspark.sql import functions as F

from kinloom.operators import retrieval
from kinloom.streaming.linker import link_batch, link_stream


def test_stream_links_as_a_batch_does(spark, tmp_path):
    s1 = spark.createDataFrame([("S1-1", "x", "alpha beta gamma"), ("S1-2", "x", "delta beta"), ("S1-3", "y", "alpha beta gamma")], "id string, part string, text string")
    rows = [("S2-1", "x", "gamma alpha", 0), ("S2-2", "x", "delta delta beta", 1), ("S2-3", "y", "beta", 2), ("S2-1", "x", "gamma alpha", 3), ("S2-4", "x", "nothing", 4)]
    new = spark.createDataFrame(rows, "id string, part string, text string, s int").withColumn("seen", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))).drop("s")
    counts = retrieval.token_counts(s1, retrieval.word_tokens(F.col("text")))
    idf = retrieval.idf_table(s1, counts, min_df=1, max_df=1.0)
    weights = retrieval.tfidf_weights(counts, idf)
    for i, part in enumerate(new.randomSplit([1.0, 1.0], 3)):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(new.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = link_stream(stream, weights, idf, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted((r.cand, r.s1, r.sim, r["rank"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r.cand, r.s1, r.sim, r["rank"]) for r in link_batch(new.dropDuplicates(["id"]), weights, idf).collect())
    assert got == want and {g[0] for g in got} == {"S2-1", "S2-2", "S2-3"}
