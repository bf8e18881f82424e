from pyspark.sql import functions as F

from kinloom.functions import text
from kinloom.operators import learned
from kinloom.queries import QUERIES, er, pool_of

SF = "/root/testdata/sf0.001"


def test_the_whole_vocabulary_is_used(spark):
    """The last of 200,001 words, dearer than all others, is still known."""
    common = spark.range(200_000).select(F.concat(F.lit("zz"), F.col("id").cast("string")).alias("word"), F.lit(1.0).alias("cost"))
    costs = common.unionByName(spark.createDataFrame([("blue", 9.0), ("harbour", 9.5)], "word string, cost double"))
    rows = spark.createDataFrame([(1, "blueharbour"), (2, "blueharbour"), (3, ""), (4, None), (5, "qq")], "id long, text string")
    got = {r.id: (r.text, r.words) for r in learned.segment(rows, costs).collect()}
    assert got == {1: ("blueharbour", "blue harbour"), 2: ("blueharbour", "blue harbour"), 3: ("", ""), 4: (None, ""), 5: ("qq", "qq")}


def test_whole_names_are_split(spark):
    rows = pool_of(er(spark, SF)).select(F.col("entity_id").alias("id"), F.array_join(text.name_tokens(F.col("name")), "").alias("whole"))
    want = {r.id: r.whole for r in rows.collect()}
    got = {r.id: r for r in QUERIES["segment_domain"](spark, SF).collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.words.replace(" ", "") == (r.text or "") for r in got.values())
