"""Folds, samples and splits by hash: the same rows whatever the partitioning, order or engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_number(*parts: Column | str) -> Column:
    """A long below 2**32 from an md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def hash_folds(entities: DataFrame, key: str, folds: int = 5, hidden: int = 20, seed: str = "fold") -> DataFrame:
    """hidden: a percentage of the entities that training never sees; fold: of the others, -1 for hidden ones."""
    out = entities.withColumn("hidden", hash_number(F.lit(f"{seed}-hidden"), key) % 100 < hidden)
    return out.withColumn("fold", F.when(F.col("hidden"), -1).otherwise(hash_number(F.lit(seed), key) % folds).cast("int"))


def inner_stop_group(number: Column) -> Column:
    """About a twentieth of the entities, by integer arithmetic alone, to stop training early."""
    return (number * F.lit(2654435761)) % 1000 < 50


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: str = "strata") -> DataFrame:
    """n rows of each stratum. Each salt's first n come first, so that a stratum of very many rows is ranked in parts."""
    order = [hash_number(F.lit(seed), key), F.col(key)]
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(64))).withColumn("__rn", F.row_number().over(Window.partitionBy(stratum, "__salt").orderBy(*order))).where(F.col("__rn") <= n)
    return salted.withColumn("__rn", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("__rn") <= n).drop("__salt", "__rn")


def thin_negatives(labelled: DataFrame, percent: int, max_rank: int = 5, seed: str = "neg") -> DataFrame:
    """All positives, the negatives of the first ranks, and a percentage of the others, weighted by its inverse."""
    hard = (F.col("y") == 1) | (F.col("rank") <= max_rank)
    drawn = hash_number(F.lit(seed), "s1", "cand") % 100 < percent
    return labelled.where(hard | drawn).withColumn("weight", F.when(hard, 1.0).otherwise(F.lit(100.0 / percent)))


def holdout(entities: DataFrame, used: DataFrame, n: int, key: str = "s1", seed: str = "holdout") -> DataFrame:
    """n entities outside those used, the same ones for the same seed."""
    rest = entities.select(key).distinct().join(used.select(key).distinct(), key, "left_anti")
    return rest.orderBy(hash_number(F.lit(seed), key), key).limit(n)


def require_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """Raises if the two share an entity."""
    if not a.select(key).join(b.select(key), key, "left_semi").isEmpty():
        raise ValueError(f"the two frames share values of {key}")


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    true = truth.select("s1", "cand", F.lit(1).alias("y")).distinct()
    return pairs.join(true, ["s1", "cand"], "left").na.fill(0, ["y"])
