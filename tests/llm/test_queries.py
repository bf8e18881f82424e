"""The queries themselves on the smallest tables: against SQL where there is some, else against brute force."""

import duckdb
import pytest

from kinloom.llm.common import table
from kinloom.llm.queries import ORACLES, QUERIES
from tests.llm.test_embedding_dedup import brute as brute_embeddings
from tests.llm.test_simhash import brute_components
from tests.llm.test_suffix_dedup import brute as brute_suffix

SF = "/root/testdata/sf0.001"


def normal(value):
    return float(f"{value:.9g}") + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(map(normal, r))) for r in df.select(*cols).collect())
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(normal(r[names.index(c)]) for c in cols)) for r in cur.fetchall())


def documents(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


def test_suffix_dedup(spark):
    got = sorted(map(tuple, QUERIES["op5_suffix_dedup"](spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)
    assert got == brute_suffix(documents(spark), 50) and sum(r[2] for r in got) > 0


def test_simhash(spark):
    got = sorted(map(tuple, QUERIES["op7_simhash"](spark, SF).select("doc_id", "fingerprint", "component_id").collect()))
    assert got == sorted((i, f"{p:016x}", c) for i, p, c in brute_components(documents(spark), 4, 4))


def test_embeddings(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in table(spark, SF, "embeddings").collect()]
    out = QUERIES["op8_hnsw_dedup"](spark, SF).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert out[0].audit_recall is None or out[0].audit_recall >= 0.9
    assert got == {v: (n, c, k) for v, n, c, k in brute_embeddings(rows, 0.95)}


def test_packing(spark):
    rows = QUERIES["op4_best_fit_packing"](spark, SF).collect()
    total = sum(r.length for r in rows)
    bins = {}
    for r in rows:
        bins[r.sequence_id] = bins.get(r.sequence_id, 0) + r.length
    assert max(bins.values()) <= 1024 and len(bins) <= 1.02 * -(-total // 1024) + 2


def test_quality(spark):
    rows = QUERIES["op6_quality"](spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count() and {r.keep for r in rows} == {True, False}
