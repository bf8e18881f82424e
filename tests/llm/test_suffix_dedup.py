import hashlib

import numpy as np
import pytest

from kinloom.llm.suffix_dedup import remove_repeats

SCHEMA = "doc_id long, text string, n_bytes int, chunk string"


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    key = lambda i: (i is None, i or 0)
    least = {}
    for i, b in data:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s not in least or key(i) < least[s]:
                least[s] = key(i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < key(i):
                gone[p : p + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(bool(gone[k]) and (k == 0 or not gone[k - 1]) for k in range(len(b)))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def sample_rows():
    rng = np.random.default_rng(8)
    words = ["alpha", "beta", "gamma", "délta", "ε", "of", "the", "and", "x" * 30]
    text = lambda n: " ".join(rng.choice(words, n))
    shared = [text(30), text(12), text(60), "z" * 120, "ab" * 70]
    rows = []
    for i in range(60):
        parts = [text(int(rng.integers(1, 40))) for _ in range(3)]
        for s in rng.choice(len(shared), int(rng.integers(0, 3))):
            parts.insert(int(rng.integers(0, 4)), shared[s])
        rows.append((int(rng.integers(0, 1000)) * 100 + i, "\n".join(parts)))
    rows += [(90_000_000 + i, rows[3][1]) for i in range(20)]
    rows += [(5, None), (6, ""), (7, "short"), (None, rows[0][1]), (None, text(50)), (rows[2][0], rows[2][1]), (8, "z" * 3000), (9, "z" * 49), (10, "z" * 50), (11, "nul\x00" * 40), (12, "nul\x00" * 30)]
    return rows


@pytest.mark.parametrize("how", [{}, {"chunk_bytes": 2000, "bucket_bytes": 4000}, {"chunk_bytes": 3000, "bucket_bytes": 4000, "hot_docs": 3}])
def test_equals_brute_force(spark, how):
    rows = sample_rows()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(4)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept).decode()) for r in remove_repeats(df, digest=True, **how).collect()), key=repr)
    want = brute(rows, 50)
    assert len(got) == len(want)
    assert [a for a, b in zip(got, want) if a != b] == []


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_documents_longer_than_a_chunk(spark):
    rng = np.random.default_rng(12)
    base = "".join(rng.choice(list("abcdefgh "), 9000))
    rows = [(1, base[2000:2600]), (2, base), (3, base[:5000] + "new" + base[4000:]), (4, "z" * 5000), (5, "z" * 3000), (None, base[1000:4000]), (2**63 - 1, "own " + base[:2500]), (6, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in remove_repeats(df, length=50, chunk_bytes=1024, bucket_bytes=4096, digest=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()]
    got = [(*r[:4], bytes(r[4]).decode()) for r in got]
    assert sorted(got, key=repr) == sorted(brute(rows, 50), key=repr)
