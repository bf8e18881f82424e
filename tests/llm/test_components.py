import random

from kinloom.llm.components import connected_components


def test_against_union_find(spark):
    random.seed(1)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(200)]
    edges += [(3, 3), (None, 4), (5, None), (-7, 2)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {r.node: r.root for r in connected_components(df).collect()} == {x: root(x) for x in up}


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
