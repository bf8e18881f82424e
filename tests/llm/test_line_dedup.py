import numpy as np
import pytest

from kinloom.llm.line_dedup import remove_repeated_lines


def brute(rows, m, long_words=None):
    """Rows (doc_id, text) by the definition, suffix against suffix: (doc_id, lines, removed lines, runs, text left)."""
    docs = sorted({(i is None, i or 0, t or "") for i, t in rows})
    content = {d: [(r, x) for r, x in enumerate(d[2].split("\n")) if x.strip(" ")] for d in docs}
    lines = {d: [x for _, x in content[d]] for d in docs}
    is_long = lambda x: long_words is not None and x.strip(" ").count(" ") + 1 >= long_words
    places = [(d, p) for d in docs for p in range(len(lines[d]))]
    by_line = {}
    for d, p in places:
        by_line.setdefault(lines[d][p], []).append((d, p))

    def common(a, b):
        (d, p), (e, q), n = a, b, 0
        while p + n < len(lines[d]) and q + n < len(lines[e]) and lines[d][p + n] == lines[e][q + n]:
            n += 1
        return n

    longest = {a: max((common(a, b) for b in by_line[lines[a[0]][a[1]]] if b != a), default=0) for a in places}
    enough = lambda d, p, n: n >= m or any(is_long(x) for x in lines[d][p : p + n])
    runs = [(d, p, n) for (d, p), n in longest.items() if n and enough(d, p, n) and longest.get((d, p - 1)) != n + 1]
    copy, own, stay = ({d: set() for d in docs} for _ in range(3))
    seen = {}
    for d, p in places:
        if p + m <= len(lines[d]):
            e, q = seen.setdefault(tuple(lines[d][p : p + m]), (d, p))
            if (e, q) != (d, p):
                (own if e == d else copy)[d] |= set(range(p, p + m))
                stay[e] |= set(range(q, q + m)) if e == d else set()
        if is_long(lines[d][p]) and seen.setdefault(lines[d][p], (d, p)) != (d, p):
            copy[d].add(p)
    starts = {(d, p) for d, p, _ in runs}
    out = []
    for i, t in rows:
        d = (i is None, i or 0, t or "")
        gone = copy[d] | (own[d] - stay[d])
        raw = {content[d][p][0] for p in gone}
        kept = "\n".join(x for r, x in enumerate(d[2].split("\n")) if r not in raw) if raw else t
        n_runs = sum(p - 1 not in gone or (d, p) in starts for p in gone)
        out.append((i, len(content[d]), len(raw), n_runs, kept))
    return sorted(out, key=repr)


def remove(spark, rows, m, **more):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, doc string, pos int").repartition(4)
    out = remove_repeated_lines(df, m, **more)
    assert {"doc", "pos"} <= set(out.columns)
    return sorted(((r.doc_id, r["__line_n"], r["__line_removed"], r["__line_runs"], r.text) for r in out.collect()), key=repr)


def lines(text):
    return text.replace(" ", "\n")


def test_runs_overlap_and_first_copies_stay_whole(spark):
    rows = [(1, "p q"), (2, "q r"), (3, "p q r"), (10, "a b a b a"), (20, "x x x"), (30, "c d e f c d e f c d e f c d"), (40, "g h"), (41, "g h i j"), (42, "g h i j")]
    got = {r[0]: r[1:] for r in remove(spark, [(i, lines(t)) for i, t in rows], 2)}
    assert got[1][1:] == (0, 0, lines("p q")) and got[2][1:] == (0, 0, lines("q r"))
    assert got[3][1:] == (3, 2, "")  # two runs, each with a first copy; no run of three
    assert got[10][1:] == (2, 1, lines("a b a"))
    assert got[20][1:] == (1, 1, lines("x x"))
    assert got[30][1:] == (9, 1, lines("c d e f c"))
    assert got[41][3] == lines("i j") and got[42][1:] == (4, 1, "")


def test_a_very_long_document_takes_linear_time(spark):
    import time

    took = []
    for n in (5_000, 20_000):
        text = "\n".join(f"{i} {i % 7}" for i in range(n)) + "\nsame line" * n
        began = time.time()
        got = remove(spark, [(1, text), (2, text)], 2)
        took.append(time.time() - began)
        assert [r[1:4] for r in got] == [(2 * n, n - 2, 1), (2 * n, 2 * n, 1)]
    assert took[1] < 4 * took[0] + 5


@pytest.mark.parametrize(("m", "more"), [(1, {}), (2, {}), (2, {"long_words": 7}), (3, {"long_words": 7}), (5, {})])
def test_equals_brute_force(spark, m, more):
    rng = np.random.default_rng(m)
    words = [f"line {i}" for i in range(12)] + ["", "  ", "é", "one long line of seven words here"]
    rows = [(int(i), "\n".join(rng.choice(words, int(rng.integers(1, 25))))) for i in rng.permutation(40)]
    rows += [(100 + i, rows[0][1]) for i in range(15)] + [(None, rows[1][1]), (None, None), (200, None), (201, ""), (202, "\n\n"), (rows[2][0], rows[2][1]), (203, "same\n" * 300)]
    rows += [(300 + i, "\n".join(rows[i][1].split("\n") * 3)) for i in range(5)]
    got, want = remove(spark, rows, m, **more), brute(rows, m, **more)
    assert [x for x in zip(got, want, strict=True) if x[0] != x[1]] == []


def test_empty(spark):
    assert remove_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
