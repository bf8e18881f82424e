import numpy as np

from kinloom.llm import quality


def features(spark, n=600):
    rng = np.random.default_rng(5)
    grades = rng.integers(0, 3, n)
    rows = [np.unique(np.r_[rng.integers(0, 400, 60), 5000 + g, 9000]).astype(np.int32) for g in grades]
    found = spark.createDataFrame([(i, int(g), r.tolist()) for i, (g, r) in enumerate(zip(grades, rows, strict=True))], "doc_id long, grade int, found array<int>")
    return rows, grades, found


def test_the_fit_in_a_task_is_the_fit_of_all_rows(spark):
    rows, grades, found = features(spark)
    want = quality.fit_ordinal(rows, grades, 3)
    got = quality.fit_in_task(found.repartition(3), 3, 1e-4)
    assert np.array_equal(got.weights, want.weights) and np.array_equal(got.thresholds, want.thresholds)
    assert quality.fit_in_task(found.limit(0), 3, 1e-4) is None


def test_training_neither_fits_nor_collects_features_in_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 3} other{i % 5}") for i in range(60)], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 3) for i in range(60)], "doc_id long, grade int")

    def never(*_):
        raise AssertionError("in the driver")

    monkeypatch.setattr(quality, "telling", never)
    model = quality.train(docs, ratings)
    assert (model.weights != 0).any() and len(model.thresholds) == 2
