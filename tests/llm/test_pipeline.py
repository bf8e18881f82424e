import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402
from kinloom.llm.common import table  # noqa: E402
from kinloom.llm.packing import Encoder  # noqa: E402
from kinloom.llm.queries import tokenizer_files  # noqa: E402
from tests.llm.test_line_dedup import brute as brute_lines  # noqa: E402
from tests.llm.test_near_duplicates import brute as brute_near  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, docs, SF)
    assert good.columns == docs.columns
    good_rows = good.collect()
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in good_rows}
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert np.mean([i in kept for i in clean]) > 0.95

    lines = stages["line_dedup"](spark, good, SF)
    assert lines.columns == docs.columns
    want = {(i, t) for i, *_, t in brute_lines([(r.doc_id, r.text) for r in good_rows], 2, 50)}
    line_rows = lines.collect()
    assert {(r.doc_id, r.text) for r in line_rows} == want and all(r.n_chars == len(r.text) for r in line_rows)

    near = stages["simhash_dedup"](spark, lines, SF)
    assert near.columns == docs.columns
    groups = brute_near([(r.doc_id, r.text) for r in line_rows])
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, c in groups if i == c)

    mixed = stages["poisson_mix"](spark, near, SF)
    assert mixed.columns == docs.columns
    packed = stages["best_fit_packing"](spark, mixed, SF)
    whole = packed.groupBy("doc_id").agg(F.sum(F.expr("if(start = 0, 1, 0)")).alias("n"))
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert {r.doc_id: r.n for r in whole.collect()} == counts

    # the sequences can be built from the result alone, and hold every copy's tokens
    own = Encoder(tokenizer_files()["tokenizer_path"])
    rows = packed.collect()
    bins, copies = {}, {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.ids))
        copies.setdefault((r.doc_id, r.copy), []).append((r.start, r.ids))
    for parts in bins.values():
        at = 0
        for offset, ids in sorted(parts):
            assert offset == at
            at += len(ids)
        assert at <= 1024
    texts = {r.doc_id: r.text for r in near.collect()}
    assert len(copies) == mixed.count()
    for (doc, _), parts in copies.items():
        assert [x for _, ids in sorted(parts) for x in ids] == [*own(texts[doc] or ""), 2]


def test_odd_rows_run_through(spark):
    rows = [(1, "a fine text of words\nand more", "en", "s", 28, 1), (1, "a fine text of words\nand more", "en", "s", 28, 1), (None, None, None, None, None, None), (2, "", "en", None, 0, 2), (3, "word " * 100_000, None, "s", 5, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank int")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert name == "best_fit_packing" or docs.columns[-1] == "rank"
        docs.collect()


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
