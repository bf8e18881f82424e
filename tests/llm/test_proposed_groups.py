"""The SimHash step of the pipeline, and the features that reach the driver."""

import numpy as np

import corpus_pipeline
from kinloom.llm import near_duplicates, quality, simhash
from tests.llm.test_near_duplicates import brute, rows_near_the_threshold


def test_stage_takes_groups_from_simhash_and_checks_them(spark, monkeypatch):
    rows = [r for r in rows_near_the_threshold() if r[0] is not None and r[0] != 7][:150]
    calls, real = [], simhash.simhash_components
    monkeypatch.setattr(simhash, "simhash_components", lambda docs, **how: calls.append(how) or real(docs, **how))
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in brute(rows) if i == c) and calls


def test_proposed_groups_are_checked_not_believed(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l m n"), (4, None), (None, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wrong = spark.createDataFrame([(1, 1), (3, 1), (4, 1), (2, 2), (None, 1), (9, 1)], "doc_id long, component_id long")
    got = near_duplicates.near_duplicate_components(docs, proposed=wrong)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_collected_features_give_the_fit_of_all(spark):
    rng = np.random.default_rng(2)
    grades = rng.integers(0, 3, 120)
    rows = [np.unique(np.r_[rng.integers(0, 400, 60), 5000 + g, 9000]).astype(np.int32) for g in grades]
    found = spark.createDataFrame([(i, int(g), r.tolist()) for i, (g, r) in enumerate(zip(grades, rows, strict=True))], "doc_id long, grade int, found array<int>")
    few = quality.telling(found).sort_by("doc_id")
    few_rows = [np.array(x, np.int32) for x in few["found"].to_pylist()]
    assert sum(map(len, few_rows)) < sum(map(len, rows)) / 4
    a, b = (quality.fit_ordinal(x, grades, 3, steps=50) for x in (rows, few_rows))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.thresholds, b.thresholds)
