import numpy as np

from kinloom.llm.embedding_dedup import embedding_components

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, n_links int"


def brute(rows, threshold):
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    link = np.zeros((len(rows), len(rows)), bool)
    for a in ok:
        for b in ok:
            u, v = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
            if a != b and len(u) == len(v):
                link[a, b] = u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold
    comp = [k for k, _ in rows]
    while True:
        new = [comp[i] if comp[i] is None else min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(len(rows))]
        if new == comp:
            break
        comp = new
    return [(k, int(link[i].sum()), comp[i], None if k is None else k == comp[i]) for i, (k, _) in enumerate(rows)]


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    rows = []
    for c in range(40):
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows) * 3 % 1009, (base[c] + rng.normal(0, 0.07, 16)).tolist()))
    rows += [(2000 + i, (base[0] + rng.normal(0, 0.03, 16)).tolist()) for i in range(250)]  # a crowd
    rows += [(3000 + i, rows[5][1]) for i in range(70)]  # copies
    rows += [(9001, None), (9002, [0.0] * 16), (9003, [None] + [1.0] * 15), (9004, [float("nan")] * 16), (None, rows[0][1]), (9005, []), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (9008, [1e-30, 2e-30]), (4000, [float("inf")] * 16)]
    df = spark.createDataFrame([(k, v, 0, "x", 1) for k, v in rows], SCHEMA).repartition(4)
    want, got = brute(rows, 0.95), [tuple(r) for r in embedding_components(df, 0.95, least_shards=3, slice_bytes=200 * 64, widest=64).collect()]
    total = sum(w[1] for w in want)
    assert len(got) == len(want) and total > 1000
    have = sorted(got, key=repr)
    want = sorted(want, key=repr)
    assert [(a[:4], b) for a, b in zip(have, want, strict=True) if a[:4] != b] == []
    assert got[0][4] > 24 and got[0][5] >= 0.98


def test_recall_of_graphs_much_larger_than_the_beam(spark):
    """One shard of 6000 vectors, beams of 24: the audit's recall and that of all links, against a scan."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1500, 32))
    v = (np.repeat(base, 4, axis=0) + rng.normal(0, 0.12, (6000, 32))).astype(np.float32)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(axis=1) - 1
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    got = embedding_components(df, 0.95, least_shards=1).collect()
    assert got[0].audit_links >= 24 and got[0].audit_recall >= 0.9 and got[0].scanned_share < 0.01
    assert all(r.n_links <= links[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) >= 0.98 * links.sum() > 5000


def test_links_are_so_few_that_the_sample_grows(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(1000, 24)).astype(np.float32)
    v[999] = v[0] * 1.01
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embedding_components(df, 0.95, least_shards=2).collect()}
    assert got[999].component_id == 0 and got[0].n_links == 1 and got[0].audit_links == 2 and got[0].audit_recall == 1.0


def test_empty(spark):
    assert embedding_components(spark.createDataFrame([], SCHEMA)).collect() == []
