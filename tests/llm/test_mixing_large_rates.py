import numpy as np
from pyspark.sql import functions as F

from kinloom.llm.mixing import poisson_mix


def test_large_rates_are_drawn(spark):
    """Two sources of 200 documents, of rates 1000 and 5000: counts have the mean and the spread of the distribution."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") < 200, "a").otherwise("b").alias("source"))
    weights = spark.createDataFrame([("a", 1000.0), ("b", 5000.0)], "source string, weight double")
    counts = poisson_mix(docs, weights, budget=3000.0, order=False).groupBy("doc_id", "rate").count().collect()
    for rate in (1000.0, 5000.0):
        got = np.array([r["count"] for r in counts if abs(r.rate - rate) < 1e-6])
        assert len(got) == 200 and abs(got.mean() - rate) < 5 * (rate / 200) ** 0.5 and 0.8 < got.std() / rate**0.5 < 1.2
