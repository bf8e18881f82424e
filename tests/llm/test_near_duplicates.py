import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from kinloom.llm.common import table
from kinloom.llm import near_duplicates
from kinloom.llm.near_duplicates import near_duplicate_components

SF = "/root/testdata/sf0.001"


def brute_set(text, k=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(k, len(found))
    return frozenset(tuple(found[i : i + k]) for i in range(len(found) - k + 1)) if found else frozenset()


def brute(rows, threshold=0.8):
    sets = [brute_set(t) for _, t in rows]
    same = lambda a, b: a == b or (len(a | b) > 0 and len(a & b) / len(a | b) >= threshold)
    near, comp, changed = [[j for j, b in enumerate(sets) if same(a, b)] for a in sets], list(range(len(rows))), True
    while changed:
        new = [min(comp[j] for j in n) for n in near]
        changed, comp = new != comp, new
    least = {}
    for c, (i, _) in zip(comp, rows, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted(((i, least.get(c)) for (i, _), c in zip(rows, comp, strict=True)), key=repr)


def rows_near_the_threshold():
    """Texts with copies of similarity 0.6 to 0.95, at various lengths."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        words = [f"w{x}" for x in rng.integers(0, 2000, int(rng.integers(6, 300)))]
        rows.append((i, " ".join(words)))
        for _ in range(4):
            cut = int(len(words) * rng.uniform(0.03, 0.35))  # a new tail: a share of the shingles goes
            rows.append((1000 + len(rows), " ".join(words[: len(words) - cut] + [f"n{x}" for x in rng.integers(0, 2000, int(rng.integers(0, cut + 1)))])))
    rows += [(3000 + i, rows[0][1].upper()) for i in range(40)] + [(None, rows[5][1]), (None, "alone " * 9), (7, rows[9][1])]
    return rows + [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "one"), (5004, "a b c d e f"), (5005, "a b c d e g"), (5006, "b c d e f g"), (5007, "word " * 30000)]


def test_links_are_exactly_those_of_the_contract(spark):
    rows = rows_near_the_threshold()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicate_components(df).collect()), key=repr)
    assert got == brute(rows)


def test_stage_keeps_one_of_each_group_only(spark):
    rows = [r for r in rows_near_the_threshold() if r[0] is not None and r[0] != 7]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in brute(rows) if i == c)


def test_empty(spark):
    assert near_duplicate_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_later_stages_keep_each_document_of_the_tables(spark):
    docs = table(spark, SF, "documents")
    near = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, c in brute(rows) if i == c)
    mixed = corpus_pipeline.mix_sources(spark, near, SF)
    whole = corpus_pipeline.pack_sequences(spark, mixed, SF).groupBy("doc_id").agg(F.sum(F.expr("if(start = 0, 1, 0)")).alias("n"))
    assert {r.doc_id: r.n for r in whole.collect()} == {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}


def test_large_groups_whose_members_meet_only_in_one_text(spark, monkeypatch):
    """Variants of a text are similar to it and not to one another; the crowd is joined in tasks of parts, and no pairs of it are listed."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(500, " ".join(base))]
    for i in range(150):
        words = list(base)
        for k in rng.choice(24, 2, replace=False):
            words[int(k) * 5 + int(rng.integers(0, 5))] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"u{i}_{j}" for j in range(30))) for i in range(5)]
    want = brute(rows)
    assert sum(c == 0 for _, c in want) > 100
    for few, node in ((32, 2048), (4, 40)):
        monkeypatch.setattr(near_duplicates, "FEW", few)
        monkeypatch.setattr(near_duplicates, "NODE_ROWS", node)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert sorted(map(tuple, near_duplicates.near_duplicate_components(df).collect())) == sorted(want)
