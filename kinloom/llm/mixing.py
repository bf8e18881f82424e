"""Mixing sources to target weights by Poisson replication (native).

Each source gets a target share of the characters of the mix; its repetition rate is share * budget / characters it has. A document's
count is drawn from the Poisson distribution of its source's rate by inverting the distribution at a number hashed from the seed
and its id, so the count depends on nothing else: not on partitions, order or retries. The document is then exploded to its copies,
and the copies are put in one global order of hashed keys: keys are uniform, so equal ranges of them are partitions of equal size, without
sampling, and each partition is sorted.

Rows that share their id (or have none) are named by id, a hash of their other columns, and a number among rows that are equal in all: each has
a draw and a place in the order of its own. Equal rows are numbered by input partition, with the counts of those before, so a group that holds a third
of all rows is not in one task; which of several equal rows has which number makes no difference.

A rate above MOST_RATE, where exp(-rate) would leave the doubles, is drawn as the sum of independent draws of an equal part of it, each
with its own hash: such sums have the Poisson distribution of the whole rate. The distribution is inverted by a table of cumulative probabilities per source, so the documents are joined with one small row per
source: broadcast when there are at most ``broadcast_sources`` of them (counted first), else spread over salts, because one source
may hold a third of the rows.

Defined results: a null text has 0 characters; a null source is a source of its own; rows with a null or repeated doc_id each
have a draw of their own; a source without characters, or without a weight when weights are given, has rate 0; an empty table
gives no rows. Copies of a draw beyond ``rate + 12 * sqrt(rate) + 40`` have a probability below 1e-16 and are not drawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.common import hash_long, hash_unit, partitions, stored

SALTS = 64
MOST_RATE = 500.0


def source_rates(documents: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, budget: float = 1.0) -> tuple[DataFrame, int]:
    """(source, rate), and the characters of the corpus: weights is (source, weight), or the shares are characters ** temperature; budget is a multiple of the corpus."""
    size = documents.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("chars"))
    if weights is None:
        size = size.withColumn("weight", F.pow(F.col("chars").cast("double"), F.lit(float(temperature))))
    else:
        given = weights.groupBy("source").agg(F.sum("weight").cast("double").alias("weight"))
        size = size.join(given, size["source"].eqNullSafe(given["source"]), "left").select(size["source"], "chars", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    size = stored(size, "sources")
    total = size.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight")).first()
    goal, weight = float(total["all_chars"] or 0) * budget, float(total["all_weight"] or 0)
    rate = F.when((F.col("chars") > 0) & F.lit(weight > 0), F.col("weight") * F.lit(goal / (weight or 1.0)) / F.col("chars")).otherwise(F.lit(0.0))
    return size.select("source", rate.alias("rate")), int(total["all_chars"] or 0)


def poisson_table(rate: Column) -> Column:
    """Cumulative probabilities P(count <= 0), P(count <= 1), ... of the Poisson distribution with this mean."""
    most = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(40.0)).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))
    step = lambda a, k: F.struct(
        (a["p"] * rate / k).alias("p"), (a["c"] + a["p"] * rate / k).alias("c"), F.concat(a["all"], F.array(a["c"] + a["p"] * rate / k)).alias("all")
    )
    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: a["all"])


def _named(documents: DataFrame) -> DataFrame:
    """The documents with __name: the id, or for ids that are null or repeated one that tells all rows apart."""
    spark = documents.sparkSession
    ids = documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("__again"), F.lit(1).alias("__one"))
    own = F.col("doc_id").cast("string")
    if ids.isEmpty():
        return documents.withColumn("__name", own)
    both = documents.join(ids, documents["doc_id"].eqNullSafe(ids["__again"]), "left").drop("__again")
    same = F.concat_ws("#", F.coalesce(own, F.lit("null")), F.xxhash64(*documents.columns).cast("string"))
    again = stored(both.where("__one is not null").drop("__one").withColumn("__same", same).withColumn("__part", F.spark_partition_id()), "again")
    sizes = again.groupBy("__same", "__part").agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.partitionBy("__same").orderBy("__part")) - F.col("__size")
    sizes = sizes.select(F.col("__same").alias("__s"), F.col("__part").alias("__p"), before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__same", "__part").orderBy("__same"))
    numbered = again.withColumn("__place", place).join(sizes, (F.col("__same") == F.col("__s")) & (F.col("__part") == F.col("__p")))
    name = F.concat_ws("#", "__same", (F.col("__place") + F.col("__before")).cast("string"))
    return both.where("__one is null").drop("__one").withColumn("__name", own).unionByName(numbered.withColumn("__name", name).select(*documents.columns, "__name"))


def poisson_mix(
    documents: DataFrame, weights: DataFrame | None = None, seed: str = "mix-1", temperature: float = 0.5, budget: float = 1.0, broadcast_sources: int = 10_000, order: bool = True, part_chars: int = 32 << 20
) -> DataFrame:
    """The copies of the documents with copy_no (from 1), rate and shuffle_key, in the global order of shuffle_key, in partitions of about part_chars."""
    rates, chars = source_rates(documents, weights, temperature, budget)
    draws = F.greatest(F.ceil(F.col("rate") / F.lit(MOST_RATE)), F.lit(1)).cast("int")
    rates = rates.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"), draws.alias("__draws"), poisson_table(F.col("rate") / draws).alias("__table"))
    kept = _named(documents.select(*[c for c in documents.columns if c not in ("copy_no", "rate", "shuffle_key")]))
    if rates.count() <= broadcast_sources:
        joined = kept.join(F.broadcast(rates), kept["source"].eqNullSafe(F.col("__source")))
    else:
        salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        kept = kept.withColumn("__own", F.pmod(F.xxhash64("__name"), F.lit(SALTS)).cast("int"))
        joined = kept.join(salted, kept["source"].eqNullSafe(F.col("__source")) & (F.col("__own") == F.col("__salt"))).drop("__own", "__salt")
    drawn = lambda at: F.size(F.filter("__table", lambda c: c < at))
    more = lambda n, k: n + drawn(hash_unit(F.lit(seed), F.lit("draw"), "__name", k.cast("string")))
    rest = F.when(F.col("__draws") > 1, F.aggregate(F.sequence(F.lit(2), F.greatest("__draws", F.lit(2))), F.lit(0), more)).otherwise(F.lit(0))
    counted = joined.withColumn("__n", F.when(F.col("__rate") > 0, drawn(hash_unit(F.lit(seed), "__name")) + rest).otherwise(F.lit(0)))
    copies = counted.where("__n > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    copies = copies.withColumn("rate", F.col("__rate")).withColumn("shuffle_key", hash_long(F.lit(seed), F.lit("order"), "__name", F.col("copy_no").cast("string")))
    copies = copies.drop("__source", "__rate", "__draws", "__table", "__n", "__name")
    if not order:
        return copies
    parts = max(partitions(documents.sparkSession), -(-int(chars * budget) // part_chars))
    return copies.repartitionById(parts, F.floor(F.col("shuffle_key") * F.lit(parts / 2**52)).cast("int")).sortWithinPartitions("shuffle_key", "doc_id", "copy_no")
