import corpus_pipeline
from kinloom.llm.line_dedup import remove_repeated_lines
from tests.llm.test_line_dedup import brute


def rows_with_passages():
    long, short = " ".join(f"p{i}" for i in range(50)), " ".join(f"q{i}" for i in range(49))
    rows = [(i, f"before {i}\n{long}\nbetween {i}\n{short}\nafter {i}") for i in range(5)]
    return rows + [(10, long), (11, short), (12, f"{long}\n\n{long}\nend"), (13, f"pair a\npair b\n{long}"), (14, f"pair a\npair b\n{long}\nown 14"), (None, f"{long}\nlast")], long


def test_a_long_line_is_a_run(spark):
    rows, long = rows_with_passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = remove_repeated_lines(df, 2, long_words=50).collect()
    want = brute(rows, 2, long_words=50)
    assert sorted(((r.doc_id, r["__line_n"], r["__line_removed"], r["__line_runs"], r.text) for r in got), key=repr) == want
    assert {r.doc_id: (r["__line_removed"], r["__line_runs"]) for r in got} == {0: (0, 0), 1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (1, 1), 10: (1, 1), 11: (0, 0), 12: (2, 2), 13: (1, 1), 14: (3, 1), None: (1, 1)}


def test_stage_removes_long_lines(spark):
    rows, long = rows_with_passages()
    out = corpus_pipeline.drop_repeated_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in out.collect() if long in (r.text or "")} == {0}
