"""The cosine top-k join against brute force, over cells of all sizes."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinloom.operators import retrieval


def weights(seed, name, n):
    """Records of one to three parts; many have equal tokens and weights, so scores tie."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        for part in rng.sample(["x", "y", "z"], rng.choice([1, 1, 1, 2, 3])):
            rows += [(f"{name}-{i:03d}", part, f"t{t}", rng.choice([0.25, 0.5, 1.0])) for t in rng.sample(range(25), rng.randint(1, 5))]
    return rows + [(f"{name}-{n}", None, "t1", 1.0)]


def brute(queries, index, k):
    sims = {}
    for q, p, t, w in queries:
        for c, p2, t2, v in index:
            if p is not None and (p, t) == (p2, t2):
                sims[q, c] = sims.get((q, c), 0.0) + w * v
    out = []
    for q in {q for q, _ in sims}:
        best = sorted((-round(s, 9), c) for (own, c), s in sims.items() if own == q)[:k]
        out += [(q, c, -s, r) for r, (s, c) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("query_rows", "index_weights"), [(1 << 15, 6_000_000), (10, 64 * 25), (7, 1)])
def test_blocks_give_the_pairs_of_brute_force(spark, monkeypatch, query_rows, index_weights):
    monkeypatch.setattr(retrieval, "QUERY_ROWS", query_rows)
    monkeypatch.setattr(retrieval, "INDEX_WEIGHTS", index_weights)
    queries, index = weights(1, "q", 60), weights(2, "c", 90 if index_weights > 1 else 12)
    schema = "id string, part string, token string, w double"
    got = retrieval.cosine_top_k(spark.createDataFrame(queries, schema), spark.createDataFrame(index, schema), 4)
    assert sorted(map(tuple, got.collect())) == brute(queries, index, 4)
    none = spark.createDataFrame([], schema)
    assert retrieval.cosine_top_k(none, none, 4).collect() == []


def test_best_of_rounds_before_it_ranks():
    rng = np.random.default_rng(4)
    for n, k in ((5, 10), (300, 3), (5000, 10), (1000, 5)):
        scores = rng.integers(0, 40, n) / 40 + rng.uniform(-2e-10, 2e-10, n)
        scores[rng.random(n) < 0.5] = 0
        at, units = retrieval.best_of(scores, k)
        want = sorted((-np.floor(scores[i] * 1e9 + 0.5), i) for i in np.flatnonzero(scores > 0))[:k]
        assert sorted(zip(-units, at, strict=True)) == want


def test_no_list_of_pairs(spark):
    """The pairs that share a token grow with the square of the table: no join may write them."""
    texts = spark.createDataFrame([(f"{i:04d}", "x", f"w{i % 30} v{i % 7} u{i}") for i in range(400)], "id string, part string, text string")
    found = retrieval.tfidf_top_k(texts, texts, 3, retrieval.word_tokens(F.col("text")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join Inner, \(+part#", plan)
    assert found.count() == 1200


def test_cells_are_built_in_little_more_than_their_numbers():
    """Two tasks of an executor build a cell's index at once, beside a JVM that fills its heap (component_states on 1 GB)."""
    rng = np.random.default_rng(1)

    def batches(n, size=10_000, tokens=20):
        for at in range(0, n, size):
            ids = pa.array([f"S2-{i:08d}" for i in range(at, at + size)])
            edges = pa.array(np.arange(size + 1, dtype=np.int32) * tokens)
            keys, w = pa.array(rng.integers(0, 5000, size * tokens)), pa.array(rng.random(size * tokens))
            lists = [pa.ListArray.from_arrays(edges, x) for x in (keys, w)]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(size, np.int64)), pa.array(np.zeros(size, bool)), ids, *lists], names=["cell", "is_query", "id", "keys", "w"])

    def with_query(rows):
        for batch in rows:
            yield batch
        yield batch.slice(0, 1).set_column(1, "is_query", pa.array([True]))

    given = list(batches(50_000))
    tracemalloc.start()
    found = [r for b in retrieval._cells(3)(with_query(given)) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["q"] for r in found] == ["S2-00040000"] * 3
    assert peak < 33 * 1_000_000, peak / 1_000_000
