"""Connected components of an edge table, by alternating stars.

Each round points every node's larger neighbours at its smallest neighbour, then every node's smaller neighbours at the smallest of
them; after about log2(n) rounds every component is a star around its smallest node. Rounds are tables in the shared folder, so no
links or components reach the driver, and a lost executor costs only the running round. Hubs are safe: minima are combined before
the shuffle, and the joins back are plain inner joins whose large partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")  # a table, so that Spark can split a hub's join
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    down = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root being the smallest node of its component. Null ends and loops count for nothing."""
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.col("a").isNull().alias("x"), F.col("b").isNull().alias("y"))
    stars = stored(ends.where("not x and not y and a <> b").select("a", "b").distinct(), "edges")
    mark = _mark(stars)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        stars = stored(_small_star(_large_star(stars)), "stars")
        was, mark = mark, _mark(stars)
        if was == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots).distinct()
