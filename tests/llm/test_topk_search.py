import numpy as np
from pyspark.sql import functions as F

from kinloom.llm.topk_search import top_k

SCHEMA = "vec_id long, embedding array<float>, rank string, q int"


def brute(rows, k):
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ok = [(i, v) for i, v in ok if sum(float(x) ** 2 for x in v) < 2**61]
    out = []
    for q in sorted({i for i, _ in ok if i % 5 == 0}):
        own = min((list(v) for i, v in ok if i == q))
        found = sorted((-int(np.dot(own, v)), i) for i, v in ok if i != q and len(v) == len(own))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return out


def check(spark, rows, k, **how):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 5 == 0, k, **how).collect())
    assert got == sorted(brute(rows, k))


def test_against_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(60)]  # one vector many times
    rows += [(300, None), (301, [1.0] * 7 + [None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [0.1] * 8), (305, [0.0] * 8), (310, [])]
    rows += [(5, rows[5][1]), (10, rows[11][1]), (400, [0.5] * 3), (401, [0.5] * 3), (405, [9000.0] * 8)]
    check(spark, rows, 5)
    check(spark, rows, 5, block_rows=7, bins=16)


def test_few_candidates_and_empty(spark):
    check(spark, [(0, [0.5, 0.5]), (1, [0.25, -1.0])], 5)
    check(spark, [(0, [0.5, 0.5])], 5)
    check(spark, [], 5)


def test_very_large_components(spark):
    big = [(i, [float(x)] * 8) for i, x in ((20, 1e20), (21, 1e12), (25, 1e6), (26, -1e6), (30, 2e6), (31, 3.0))]
    check(spark, big, 5)
    check(spark, [(i, [1e7] * 64) for i in range(4)] + [(5, [0.5] * 64), (6, [1e6] * 64)], 5)
