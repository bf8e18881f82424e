import numpy as np
from pyspark.sql import functions as F

from kinloom.llm.common import table
from kinloom.llm.quality import Features, fit_ordinal, graded, keep_good, score_documents, train


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = train(docs, graded(labels), sample_rows=3000)
    held = labels.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").offset(3000)
    scored = score_documents(docs, model).join(held, "doc_id").toPandas()
    good = (scored.quality == 1) & (scored.toxic == 0)
    assert len(scored) > 900
    assert scored.keep[good].mean() > 0.98
    assert scored.keep[scored.quality == 0].mean() < 0.08
    assert scored.keep[scored.toxic == 1].mean() < 0.2
    assert (model.thresholds[1:] >= model.thresholds[:-1]).all()
    again = train(docs.repartition(7), graded(labels.repartition(3)), sample_rows=3000)
    assert np.allclose(model.weights, again.weights) and np.allclose(model.thresholds, again.thresholds)


def test_odd_rows_and_columns(spark):
    rows = [(1, "good words here", 5), (2, None, 5), (3, "", 5), (None, "bad!!! bad!!!", 5), (1, "good words here", 5), (4, "good " * 200_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (99, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = train(docs, graded(labels))
    out = score_documents(docs, model).collect()
    assert len(out) == 6 and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in out)
    kept = keep_good(docs, model)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0 for r in out if r.keep)) == sorted(r.doc_id or 0 for r in kept.collect())
    no_model = train(docs, graded(labels.limit(0)))
    assert no_model is None and all(r.keep and r.expected_grade is None for r in score_documents(docs, no_model).collect())
    assert keep_good(docs, None).count() == 6
    assert score_documents(docs.limit(0), model).collect() == [] and train(docs.limit(0), graded(labels)) is None


def test_fit_recovers_an_ordinal_model():
    rng = np.random.default_rng(0)
    truth = np.zeros(40)
    truth[:6] = [3, -3, 2, -2, 1.5, -1.5]
    rows = [np.flatnonzero(rng.random(40) < 0.3).astype(np.int32) for _ in range(3000)]
    score = np.array([truth[r].sum() for r in rows]) + rng.logistic(size=3000)
    grades = (score > -1).astype(int) + (score > 1)
    model = fit_ordinal(rows, grades, 3, l1=1e-3, least_z=0)
    assert np.corrcoef(model.weights[:40], truth)[0, 1] > 0.98
    assert model.thresholds[0] < model.thresholds[1]


def test_features_are_a_set():
    f = Features()
    assert (f("Word word, WORD") == np.unique(f("Word word, WORD"))).all() and len(f(None)) == len(f(""))


def test_query_against_a_direct_formula(spark):
    """The query's model applied by hand: the sum of the weights of a text's features, one logistic curve for each threshold."""
    from kinloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    model = train(docs, graded(table(spark, sf, "labels")))
    features, want = Features(), {}
    for r in docs.collect():
        score = sum(float(model.weights[f]) for f in features(r.text))
        tails = [1 / (1 + np.exp(cut - score)) for cut in model.thresholds]
        want[r.doc_id] = (sum(tails), tails[-1], tails[-1] >= 0.5)
    got = {r.doc_id: (r.expected_grade, r.tail_probability, r.keep) for r in QUERIES["op6_quality"](spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[i][:2], want[i][:2], atol=1e-9) and got[i][2] == want[i][2] for i in want)


def test_repeated_ids_count_once(spark):
    docs = spark.createDataFrame([(i % 50, f"word{i % 50} " * 5) for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    once = train(docs.dropDuplicates(), graded(labels))
    many = train(docs, graded(labels))
    assert np.allclose(once.weights, many.weights) and np.allclose(once.thresholds, many.thresholds)
