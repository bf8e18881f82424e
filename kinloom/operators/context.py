"""Features of a scored pair among its competitors: windows over the entity (s1) or over the record (cand), always over the whole frame.

Frames have (s1, cand, p). Ranks break ties by id, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRONG = 0.5


def _by(*keys: str):
    return Window.partitionBy(*keys)


def _best_first(*keys: str, tie: str = "cand"):
    return Window.partitionBy(*keys).orderBy(F.desc("p"), tie)


def claims(pairs: DataFrame) -> DataFrame:
    """How contested the record is: rank of this claim (ties share), gap to the best claim, number of claims and of strong ones."""
    rank = F.rank().over(Window.partitionBy("cand").orderBy(F.desc("p")))
    return pairs.withColumns(
        {
            "claim_rank": rank,
            "claim_gap": F.max("p").over(_by("cand")) - F.col("p"),
            "n_claims": F.count(F.lit(1)).over(_by("cand")),
            "n_strong_claims": F.sum((F.col("p") >= STRONG).cast("long")).over(_by("cand")),
        }
    )


def entity_shape(pairs: DataFrame) -> DataFrame:
    """Within the entity: rank, gap to the best, number of candidates and of strong ones, sum and share of p, second best p (0 if none)."""
    ranked = pairs.withColumn("p_rank", F.row_number().over(_best_first("s1")))
    own = _by("s1")
    return ranked.withColumns(
        {
            "p_gap": F.max("p").over(own) - F.col("p"),
            "n_candidates": F.count(F.lit(1)).over(own),
            "n_strong": F.sum((F.col("p") >= STRONG).cast("long")).over(own),
            "sum_p": F.sum("p").over(own),
            "p_second": F.coalesce(F.max(F.when(F.col("p_rank") == 2, F.col("p"))).over(own), F.lit(0.0)),
        }
    ).withColumn("p_share", F.coalesce(F.try_divide(F.col("p"), F.col("sum_p")), F.lit(0.0)))


def rank_features(pairs: DataFrame, score: str) -> DataFrame:
    """rank_in_entity, max_in_entity, gap_to_best, n_candidates and is_best by a score."""
    ranked = pairs.withColumn("rank_in_entity", F.row_number().over(Window.partitionBy("s1").orderBy(F.desc(score), "cand")))
    top = F.max(score).over(_by("s1"))
    return ranked.withColumns({"max_in_entity": top, "gap_to_best": top - F.col(score), "n_candidates": F.count(F.lit(1)).over(_by("s1")), "is_best": (F.col("rank_in_entity") == 1).cast("int")})


def best_other(pairs: DataFrame) -> DataFrame:
    """The best claim on the record by another entity (0 if none), and the margin over it."""
    ranked = pairs.withColumn("rn", F.row_number().over(_best_first("cand", tie="s1")))
    nth = lambda n: F.coalesce(F.max(F.when(F.col("rn") == n, F.col("p"))).over(_by("cand")), F.lit(0.0))
    other = F.when(F.col("rn") == 1, nth(2)).otherwise(nth(1))
    return ranked.withColumn("best_other", other).withColumn("margin", F.col("p") - F.col("best_other")).drop("rn")


def gang(pairs: DataFrame, key: str, name: str = "gang") -> DataFrame:
    """Candidates of the entity with the same key: their number, and the best p among the others (-1 if none). An empty key has number 0."""
    own = _by("s1", key)
    ranked = pairs.withColumn("rn", F.row_number().over(_best_first("s1", key)))
    n = F.count(F.lit(1)).over(own)
    nth = lambda k: F.max(F.when(F.col("rn") == k, F.col("p"))).over(own)
    best = F.when(F.col("rn") == 1, nth(2)).otherwise(nth(1))
    filled = F.coalesce(F.col(key), F.lit("")) != ""
    return ranked.withColumns({f"{name}_n": F.when(filled, n).otherwise(F.lit(0).cast("long")), f"{name}_max": F.when(filled & (n > 1), best).otherwise(F.lit(-1.0))}).drop("rn")


def twins(pairs: DataFrame, key: str, number: str) -> DataFrame:
    """Candidates of the entity with the same name key: their number, whether a better one has another non-empty house number, and the gap to the best."""
    own, order = _by("s1", key), _best_first("s1", key)
    first = F.first(number).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    better = (F.max("p").over(own) > F.col("p")) & (F.col(number) != "") & (first != "") & (first != F.col(number))
    return pairs.withColumns({"twin_n": F.count(F.lit(1)).over(own), "twin_flag": better.cast("int"), "twin_gap": F.max("p").over(own) - F.col("p")})


def agreement(pairs: DataFrame, attribute: str, top: int = 3) -> DataFrame:
    """How the entity's best other candidates agree with this one on an attribute: (s1, cand, n_peers, n_agree, best_agree)."""
    ranked = pairs.withColumn("rn", F.row_number().over(_best_first("s1")))
    peers = ranked.where(F.col("rn") <= top).select(F.col("s1").alias("own"), F.col("cand").alias("peer"), F.col("p").alias("pj"), F.col(attribute).alias("peer_value"))
    both = ranked.join(peers, (F.col("s1") == F.col("own")) & (F.col("cand") != F.col("peer")), "left").select("s1", "cand", attribute, "peer", "pj", "peer_value")
    same = (F.col(attribute) == F.col("peer_value")) & (F.col(attribute) != "")
    return both.groupBy("s1", "cand").agg(F.count("peer").alias("n_peers"), F.count_if(same).alias("n_agree"), F.coalesce(F.max(F.when(same, F.col("pj"))), F.lit(0.0)).alias("best_agree"))


def within_source(pairs: DataFrame, source: str = "src") -> DataFrame:
    """Strong candidates of the entity from the same source, and the rank within it."""
    return pairs.withColumns({"n_strong_source": F.sum((F.col("p") > STRONG).cast("long")).over(_by("s1", source)), "rank_in_source": F.row_number().over(_best_first("s1", source))})


def merge_scores(pairs: DataFrame, models: dict[str, DataFrame]) -> DataFrame:
    """pairs with ``ce``, the mean of the models (s1, cand, score) that scored the pair (null if none), and its rank and gap within the entity."""
    out = pairs
    for name, scores in models.items():
        out = out.join(scores.select("s1", "cand", F.col("score").alias(f"ce_{name}")), ["s1", "cand"], "left")
    given = F.filter(F.array(*[F.col(f"ce_{m}") for m in models]), lambda x: x.isNotNull())
    out = out.withColumn("ce", F.try_divide(F.aggregate(given, F.lit(0.0), lambda a, x: a + x), F.size(given)))
    order = Window.partitionBy("s1").orderBy(F.col("ce").desc_nulls_last(), "cand")
    return out.withColumns({"ce_rank": F.when(F.col("ce").isNotNull(), F.row_number().over(order)), "ce_gap": F.max("ce").over(_by("s1")) - F.col("ce")})


def contention(pairs: DataFrame) -> DataFrame:
    """(pairs, records, mean_claims, row_mean_claims): claims per record, plain and weighted by rows."""
    per = pairs.groupBy("cand").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("double")
    return per.agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("records"), F.round(F.avg(n), 6).alias("mean_claims"), F.round(F.try_divide(F.sum(n * n), F.sum(n)), 6).alias("row_mean_claims"))


def pseudo_labels(pairs: DataFrame, high: float = 0.995, low: float = 0.005, margin: float = 0.5, share: float = 0.05) -> DataFrame:
    """(s1, cand, y, weight): confident best claims as positives, and a hashed share of confident negatives, weighted by its inverse."""
    rows = best_other(claims(pairs))
    keep = F.conv(F.substring(F.md5(F.concat_ws("|", "s1", "cand")), 1, 8), 16, 10).cast("long") < F.lit(int(share * 2**32))
    positive = (F.col("p") > high) & (F.col("claim_rank") == 1) & (F.col("margin") > margin)
    negative = (F.col("p") < low) & keep
    rows = rows.where(positive | negative)
    return rows.select("s1", "cand", positive.cast("int").alias("y"), F.when(positive, 1.0).otherwise(F.lit(1 / share)).alias("weight"))


def slice_pseudo_labels(pairs: DataFrame, high: float = 0.97, low: float = 0.03, margin: float = 0.3, twin: float = 0.3, plausible: float = 0.01, most: tuple[int, int, int, int] = (120_000, 100_000, 20_000, 50_000)) -> DataFrame:
    """(s1, cand, kind, label) from one slice's pairs (s1, cand, p1, p, house1, house2), unique: confident best claims with one house number as
    positives, confident negatives (plausible to the first model or not), and twins, which are an accepted entity's other middling pairs. Samples of each kind by hash, of at most ``most`` rows."""
    rows = best_other(claims(pairs)).withColumn("accepted", (F.col("p") > high) & (F.col("claim_rank") == 1) & (F.col("margin") > margin) & (F.col("house1") == F.col("house2")) & (F.col("house1") != ""))
    rows = rows.withColumn("owner", F.coalesce(F.max("accepted").over(_by("s1")), F.lit(False)))
    kinds = {
        "positive": F.col("accepted"),
        "plausible": (F.col("p") < low) & (F.col("p1") >= plausible),
        "implausible": (F.col("p") < low) & (F.col("p1") < plausible),
        "twin": F.col("owner") & (F.col("p") < twin) & (F.col("p") >= low),
    }
    out = None
    for (kind, test), n in zip(kinds.items(), most, strict=True):
        part = rows.where(test).select("s1", "cand", F.lit(kind).alias("kind"), F.lit(1.0 if kind == "positive" else 0.0).alias("label"))
        part = part.orderBy(F.md5(F.concat_ws("|", "s1", "cand")), "s1", "cand").limit(n)
        out = part if out is None else out.unionByName(part)
    return out


def hard_negatives(labelled: DataFrame, per_entity: int = 2) -> DataFrame:
    """(s1, cand, kind): of the negatives (y = 0) of each entity, the most probable and one chosen by hash."""
    rows = labelled.where("y = 0").withColumns(
        {"hard": F.row_number().over(_best_first("s1")), "dice": F.row_number().over(Window.partitionBy("s1").orderBy(F.md5(F.concat_ws("|", "s1", "cand")), "cand"))}
    )
    return rows.where((F.col("hard") <= per_entity) | (F.col("dice") == 1)).select("s1", "cand", F.when(F.col("hard") <= per_entity, "hard").otherwise("random").alias("kind"))


def score_band(pairs: DataFrame, low: float = 0.01, high: float = 0.999, most: int = 8) -> DataFrame:
    """The pairs worth a second look: p in a band and among the entity's first."""
    ranked = pairs.withColumn("rn", F.row_number().over(_best_first("s1")))
    return ranked.where(F.col("p").between(low, high) & (F.col("rn") <= most)).drop("rn")


def log_odds(p: Column, clip: float = 1e-6) -> Column:
    bounded = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.log(bounded / (F.lit(1.0) - bounded))


def affine_log_odds(p: Column, a: Column | float, b: Column | float) -> Column:
    """sigmoid(a * logit(p) + b)"""
    a, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(a * log_odds(p) + b)))
