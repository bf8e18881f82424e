"""Decision tables against the single rules, the rule parser, and what must fail loudly."""

import pytest
from pyspark.sql import functions as F

from kinloom.operators import decision
from kinloom.sources import records


@pytest.fixture(scope="module")
def linked(spark):
    pairs = spark.createDataFrame([(f"e{i % 7}", f"c{(i * 5) % 11}", ((i * 37) % 97 + 0.5) / 98) for i in range(40)], "s1 string, cand string, p double").dropDuplicates(["s1", "cand"])
    truth = spark.createDataFrame([(f"e{i}", f"c{i}") for i in range(5)], "s1 string, cand string")
    entities = spark.createDataFrame([(f"e{i}",) for i in range(9)], "s1 string")
    return pairs, truth, entities


@pytest.mark.parametrize("mode", ["none", "hard", "soft"])
def test_grid_is_the_single_rules(spark, linked, mode):
    pairs, truth, entities = linked
    grid = {(r.rule, r.value): r.f05 for r in decision.decision_grid(pairs, truth, entities, (mode,), (0.3, 0.7), (0.0, 0.4), exact=True).collect()}
    own = decision.assign(pairs, mode)
    rules = {"threshold": decision.select_threshold, "expected_f": decision.expected_f, "expected_f_exact": decision.expected_f_exact}
    assert len(grid) == 6
    for (rule, value), f05 in grid.items():
        scores = decision.entity_scores(entities, truth, rules[rule](own, value))
        assert scores.agg(F.round(F.avg("f"), 6)).head()[0] == f05


def test_tuning_tries_leads_on_the_best(linked):
    pairs, truth, entities = linked
    rows = decision.tune_rules(pairs, truth, entities, (1.0, 1.25), (0.0,), (0.5,), (0.1, 0.9)).collect()
    flat = [r for r in rows if r.delta == 0]
    top = max(r.f05 for r in flat)
    best = next(r for r in flat if r.f05 == top)
    assert len(flat) == 3 and all((r.method, r.a, r.b, r.t) == (best.method, best.a, best.b, best.t) for r in rows if r.delta > 0)


def test_rules_as_text(linked):
    assert decision.parse_rule("soft:expected_f:0.1") == (None, "soft", "expected_f", 0.1)
    assert decision.parse_rule("fr=hard:threshold:0.7") == ("fr", "hard", "threshold", 0.7)
    with pytest.raises(ValueError):
        decision.parse_rule("hard:nothing:1")
    with pytest.raises(ValueError):
        decision.redecide(linked[0].withColumn("slice", F.lit("fr")), ("fr=hard:threshold:0.7",))


def test_missing_record_ends_the_job(spark):
    pairs = spark.createDataFrame([("a", "x"), ("b", "y")], "s1 string, cand string")
    own = spark.createDataFrame([("x", "one")], "cand string, name string")
    assert records.gather(pairs.where("cand = 'x'"), own, "cand").collect()[0].name == "one"
    with pytest.raises(Exception, match="no record for cand y"):
        records.gather(pairs, own, "cand").collect()


@pytest.mark.parametrize(
    "text, want",
    [
        ("", {"empty_file": 1}),
        ("source1_entity_id,matched_entity_ids\nS1-1,S2-1\n", {"comma_file": 1}),
        ("id\tids\nS1-1\tS2-1\n", {"bad_header": 1}),
        ("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\n\nS1-3\t\n", {"malformed_row": 1}),
    ],
)
def test_files(spark, tmp_path, text, want):
    path = tmp_path / "lists.tsv"
    path.write_text(text)
    got = {r.rule: r.n for r in records.validate_lines(spark, str(path)).collect()}
    assert got == {"empty_file": 0, "comma_file": 0, "bad_header": 0, "malformed_row": 0} | want
