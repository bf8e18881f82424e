import re

import numpy as np
import xxhash

from kinloom.llm.simhash import simhash_components


def brute_print(text, words, seed=42):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not found:
        return 0
    k = min(words, len(found))
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i : i + k]), seed) for i in range(len(found) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, words, distance, size=1):
    prints = np.array([[brute_print(t, words, 42 + w) for w in range(size)] for _, t in rows], np.uint64)
    comp = list(range(len(rows)))
    near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= distance
    changed = True
    while changed:
        new = [min(comp[j] for j in np.flatnonzero(near[i])) for i in range(len(rows))]
        changed, comp = new != comp, new
    least = {}
    for c, (i, _) in zip(comp, rows, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted(((i, int(p[0]), least.get(c)) for (i, _), p, c in zip(rows, prints, comp, strict=True)), key=repr)


def rows_for_test():
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(300)] + ["Ünïcode", "Émile x", "A"]
    rows = []
    for i in range(60):
        words = rng.choice(vocab, 200).tolist()
        rows.append((i, " ".join(words)))
        for c in range(int(rng.integers(0, 4))):
            copy = list(words)
            for _ in range(c):
                copy[int(rng.integers(0, 200))] = "changed"
            rows.append((1000 + len(rows), "\n".join(copy).upper() if c == 1 else " ".join(copy)))
    rows += [(5000 + i, rows[0][1]) for i in range(40)]
    return rows + [(7, rows[3][1]), (9001, None), (9002, ""), (9003, " \t\n"), (9004, "one"), (None, rows[4][1]), (9005, "word " * 30000)]


def as_rows(df):
    return sorted(((r.doc_id, r.print0 & (1 << 64) - 1, r.component_id) for r in df.collect()), key=repr)


def test_components_equal_brute_force(spark):
    rows = rows_for_test()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, component_id int, print0 string").repartition(5)
    assert as_rows(simhash_components(docs, 4, 1, 4)) == brute_components(rows, 4, 4)
    # crowded nodes are cut into parts without losing a pair
    assert as_rows(simhash_components(docs, 4, 1, 4, node_rows=8)) == brute_components(rows, 4, 4)


def test_two_words(spark):
    rows = rows_for_test()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert as_rows(simhash_components(docs, 5, 2, 21)) == brute_components(rows, 5, 21, 2)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(docs).collect() == []
