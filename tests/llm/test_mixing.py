import math

from pyspark.sql import functions as F

from kinloom.llm.mixing import poisson_mix, poisson_table, source_rates

SCHEMA = "doc_id long, text string, source string, rate string, extra int"


def docs_of(spark):
    rows = [(i, "x" * (10 + i % 7), "hot" if i % 3 == 0 else f"s{i % 5}", "r", 1) for i in range(600)]
    rows += [(7, "again", "s2", "r", 1), (None, "no id", "s1", "r", 1), (9001, None, None, "r", 1), (9002, "null source", None, "r", 1), (9003, "", "empty", "r", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_counts_do_not_depend_on_partitions_and_salting(spark):
    docs = docs_of(spark)
    key = lambda df: sorted(((r.doc_id, r.source, r.copy_no, r.shuffle_key, r.text) for r in df.collect()), key=repr)
    one = key(poisson_mix(docs))
    assert one == key(poisson_mix(docs.repartition(11)))
    assert one == key(poisson_mix(docs, broadcast_sources=0))
    assert poisson_mix(docs).columns.count("rate") == 1
    keys = [r.shuffle_key for r in poisson_mix(docs).collect()]
    assert keys == sorted(keys)


def test_weights_are_met_on_average(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("ten chars!").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    got = {r.source: r["count"] for r in poisson_mix(docs, weights).groupBy("source").count().collect()}
    assert abs(got["a"] - 15_000) < 600 and abs(got["b"] - 5_000) < 400
    rates = {r.source: r.rate for r in source_rates(docs, weights)[0].collect()}
    assert math.isclose(rates["a"], 3.0) and math.isclose(rates["b"], 1 / 3)
    assert poisson_mix(docs, weights.where("source = 'a'")).where("source = 'b'").count() == 0


def test_table_is_the_distribution(spark):
    table = spark.range(1).select(poisson_table(F.lit(2.5)).alias("t")).first().t
    assert all(math.isclose(c, sum(math.exp(-2.5) * 2.5**j / math.factorial(j) for j in range(k + 1)), rel_tol=1e-12) for k, c in enumerate(table))


def test_empty(spark):
    assert poisson_mix(docs_of(spark).limit(0)).collect() == []


def test_rows_that_share_an_id_have_their_own_draws(spark):
    rows = [(7, "same text", "a")] * 400 + [(None, "no id", "a")] * 400 + [(None, f"other {i}", "a") for i in range(400)] + [(i, "plain one", "a") for i in range(1000, 1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = poisson_mix(docs.repartition(5), weights=spark.createDataFrame([("a", 1.0)], "source string, weight double")).collect()
    assert len({r.shuffle_key for r in out}) == len(out)
    for keep in (lambda r: r.doc_id == 7, lambda r: r.text == "no id", lambda r: r.text.startswith("other")):
        assert 300 < sum(map(keep, out)) < 500
    key = lambda r: (r.doc_id or -1, r.text, r.copy_no, r.shuffle_key)
    assert sorted(map(key, out)) == sorted(map(key, poisson_mix(docs.repartition(3), weights=spark.createDataFrame([("a", 5.0)], "source string, weight double")).collect()))
