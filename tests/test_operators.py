"""Brute force, metamorphic and edge-case tests of context, decision, sampling and learning."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from kinloom.operators import context, decision, learned, retrieval, sampling
from kinloom.sources import records

PAIRS = "s1 string, cand string, p double"


def frame(spark, seed=1, n=40):
    random.seed(seed)
    rows = [(f"S1-{random.randrange(n // 4):02d}", f"S2-{c:02d}", round(random.random(), 2)) for c in range(n // 2) for _ in range(3)]
    return spark.createDataFrame(list({(a, b): (a, b, p) for a, b, p in rows}.values()), PAIRS)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("operator", [context.claims, context.entity_shape, context.best_other, lambda d: decision.assign(d, "hard"), lambda d: decision.assign(d, "soft"), lambda d: decision.one_to_one(d, 0.1), lambda d: decision.expected_f(d, 0.1), decision.expected_f_exact, decision.expected_f_joint])
def test_partitioning_does_not_matter(spark, operator):
    df = frame(spark)
    rounded = lambda d: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows_of(d)]
    assert rounded(operator(df)) == rounded(operator(df.repartition(7).orderBy(F.rand(3))))
    assert operator(df.limit(0)).collect() == []


def test_claims_need_the_whole_frame(spark):
    df = frame(spark)
    half = df.where(F.xxhash64("s1") % 2 == 0)
    whole = {(r.s1, r.cand): r.n_claims for r in context.claims(df).collect()}
    part = {(r.s1, r.cand): r.n_claims for r in context.claims(half).collect()}
    assert all(part[k] <= whole[k] for k in part) and any(part[k] < whole[k] for k in part)


def f05(tp, t, p):
    return 1.0 if t == p == 0 else 0.0 if t == 0 or p == 0 else 1.25 * tp / (0.25 * t + p)


def expected(ps, k):
    total = 0.0
    for truth in itertools.product((0, 1), repeat=len(ps)):
        weight = math.prod(p if y else 1 - p for p, y in zip(ps, truth, strict=True))
        total += weight * f05(sum(truth[:k]), sum(truth), k)
    return total


def test_joint_decoder_is_best_of_all_outcomes(spark):
    random.seed(5)
    lists = {f"e{i}": sorted((round(random.random(), 3) for _ in range(random.randint(1, 6))), reverse=True) for i in range(25)} | {"sure": [1.0, 1.0, 0.0], "none": [0.0], "even": [0.5, 0.5]}
    df = spark.createDataFrame([(e, f"c{i}", p) for e, ps in lists.items() for i, p in enumerate(ps)], PAIRS)
    kept = {r.s1: r["count"] for r in decision.expected_f_joint(df).groupBy("s1").count().collect()}
    for e, ps in lists.items():
        values = [expected(ps, k) for k in range(len(ps) + 1)]
        assert values[kept.get(e, 0)] >= max(values) - 1e-9, (e, ps, values, kept.get(e, 0))


def test_decoders_are_near_the_best_of_all_outcomes(spark):
    random.seed(9)
    lists = {f"e{i}": sorted((random.betavariate(0.6, 0.8) for _ in range(6)), reverse=True) for i in range(60)}
    df = spark.createDataFrame([(e, f"c{i}", p) for e, ps in lists.items() for i, p in enumerate(ps)], PAIRS)
    regret = {}
    for name, op in (("plain", decision.expected_f), ("exact", decision.expected_f_exact)):
        kept = {r.s1: r["count"] for r in op(df).groupBy("s1").count().collect()}
        regret[name] = sum(max(expected(ps, k) for k in range(7)) - expected(ps, kept.get(e, 0)) for e, ps in lists.items())
    assert max(regret.values()) / len(lists) < 1e-3


def test_ties_go_to_the_smaller_entity(spark):
    df = spark.createDataFrame([("b", "x", 0.5), ("a", "x", 0.5), ("a", "y", 0.2)], PAIRS)
    assert rows_of(decision.assign(df, "hard")) == [("a", "x", 0.5), ("a", "y", 0.2)]
    assert rows_of(decision.assign(df, "soft"))[0][2] == 0.25
    with pytest.raises(ValueError):
        decision.assign(df, "other")


def test_gang_of_the_survey(spark):
    df = spark.createDataFrame([("e", "1", 0.9, "k"), ("e", "2", 0.2, "k"), ("e", "3", 0.7, "z"), ("e", "4", 0.5, ""), ("f", "5", 0.3, "k"), ("f", "6", 0.3, "k")], PAIRS + ", key string")
    got = {r.cand: (r.gang_n, r.gang_max) for r in context.gang(df, "key").collect()}
    assert got == {"1": (2, 0.2), "2": (2, 0.9), "3": (1, -1.0), "4": (0, -1.0), "5": (2, 0.3), "6": (2, 0.3)}


def test_caps_and_siblings(spark):
    pool = spark.createDataFrame([("a", "X", "k"), ("b", "X", "k"), ("c", "X", "k"), ("d", "X", "j"), ("e", "Y", "j"), ("f", "X", "")], "id string, part string, key string")
    ranked = spark.createDataFrame([("s", "a", 1), ("s", "d", 2), ("t", "f", 1)], "s1 string, cand string, rank int")
    assert rows_of(retrieval.sibling_pairs(ranked, pool, top=2, cap=2)) == [("s", "d")]
    assert rows_of(retrieval.sibling_pairs(ranked, pool, top=2, cap=3)) == [("s", "a"), ("s", "b"), ("s", "c"), ("s", "d")]
    s1 = spark.createDataFrame([("s", "X", "j"), ("t", "X", ""), ("u", "Z", "k")], "id string, part string, key string")
    assert rows_of(retrieval.direct_key_pairs(s1, pool, 3)) == [("s", "d")]


def test_sampling_is_nested_and_disjoint(spark):
    ids = spark.range(500).select(F.concat(F.lit("S1-"), "id").alias("entity_id"))
    small, large = ({r.entity_id for r in records.sample_entities(ids, n).collect()} for n in (20, 60))
    assert small < large
    s1 = ids.withColumnRenamed("entity_id", "s1")
    used = s1.limit(100)
    sampling.require_disjoint(sampling.holdout(s1, used, 50), used, "s1")
    with pytest.raises(ValueError):
        sampling.require_disjoint(used, used.limit(1), "s1")
    folds = sampling.hash_folds(ids, "entity_id").collect()
    assert {r.fold for r in folds} == {-1, 0, 1, 2, 3, 4} and all(r.hidden == (r.fold == -1) for r in folds)


def test_calibration_is_monotone_and_crossfit(spark):
    random.seed(2)
    rows = [(i % 3, p, int(random.random() < p * p)) for i in range(900) for p in [random.random()]]
    out = learned.crossfit_isotonic(spark.createDataFrame(rows, "fold int, p double, y int"), 3).orderBy("fold", "p").collect()
    for k in range(3):
        values = [r.calibrated for r in out if r.fold == k]
        assert values == sorted(values) and min(values) >= 1e-6


def test_temperature_recovers_the_truth(spark):
    random.seed(3)
    z = [random.gauss(0, 2) for _ in range(20000)]
    rows = [(1 / (1 + math.exp(-2 * x)), int(random.random() < 1 / (1 + math.exp(-x)))) for x in z]
    assert abs(learned.fit_temperature(spark.createDataFrame(rows, "p double, y int")) - 2.0) < 0.15


def test_fold_trees_score_rows_with_models_that_never_saw_them(spark):
    random.seed(4)
    rows = [(i, i % 2, float(x), int(x > 0.5)) for i in range(400) for x in [random.random()]]
    df = spark.createDataFrame(rows, "number long, fold int, x double, y int")
    trees = learned.FoldTrees(["x"], folds=2, rounds=3, depth=2).fit(df)
    scored = trees.score(df).collect()
    assert sum((r.p > 0.5) == (r.y == 1) for r in scored) > 380 and trees.importance()[0][0] == "x"


def test_score_edges_and_breakdown(spark):
    e = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s1 string")
    truth = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "s1 string, cand string")
    pred = spark.createDataFrame([("a", "1"), ("c", "9"), ("a", "1")], "s1 string, cand string")
    got = {r.s1: r.f for r in decision.entity_scores(e, truth, pred).collect()}
    assert got == {"a": 1.25 / 1.5, "b": 0.0, "c": 0.0, "d": 1.0}


def test_files(spark, tmp_path):
    path = tmp_path / "source.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Quoted" Name\t\tUS\nS1-2\tPlain\t1 Rd, Town\tIndia\n', encoding="utf-8")
    rows = records.read_source(spark, str(path))
    assert rows_of(rows) == [("S1-1", '"Quoted" Name', "", "US"), ("S1-2", "Plain", "1 Rd, Town", "India")]
    with pytest.raises(ValueError):
        records.read_source(spark, str(path), columns=("entity_id", "nothing"))
    both = records.build_records({1: rows, 2: rows.withColumn("entity_id", F.lit("S2-1"))})
    assert both.count() == 4 and set(both.columns) == {"entity_id", "src", "name", "addr", "country"}
    lists = records.id_lists(rows, spark.createDataFrame([("S1-1", "S2-2"), ("S1-1", "S2-1"), ("S1-1", "S2-1")], "s1 string, cand string"), "matched_entity_ids")
    records.write_lists(lists, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-2\nS1-2\t\n"


def test_every_rule_of_the_validator(spark):
    own = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "entity_id string")
    lists = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", "S1-2"), ("S1-9", "Q-1,S3-7"), ("S1-2", None)], "source1_entity_id string, matched_entity_ids string")
    cands = spark.createDataFrame([("S1-1", "S2-1")], "s1 string, cand string")
    known = spark.createDataFrame([("S2-1",), ("S1-2",)], "entity_id string")
    got = {r.rule: r.n for r in records.validate_lists(lists, cands, own, known).collect()}
    assert got == {"malformed_row": 0, "duplicate_entity": 1, "duplicate_id_in_list": 1, "self_match": 1, "wrong_prefix": 1, "missing_entity": 1, "unknown_entity": 1, "unknown_id": 2, "not_a_candidate": 3}
