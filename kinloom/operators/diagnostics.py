"""Reports on retrieval, pruning and runs, and the features that only whole frames can give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.similarity import jaccard, kernel


def _share(hits: Column, n: Column) -> Column:
    return F.round(F.try_divide(hits.cast("double"), n.cast("double")), 6)


def missed_profile(truth: DataFrame, ranked: DataFrame, records: DataFrame, slice_of: Column) -> DataFrame:
    """(found, slice, n, empty_addr): what the true records look like that retrieval missed, beside those it found. records: (cand, name, addr)."""
    hit = ranked.select("s1", "cand", F.lit(True).alias("found")).distinct()
    rows = truth.join(hit, ["s1", "cand"], "left").na.fill(False, ["found"]).join(records, "cand")
    return rows.groupBy("found", slice_of.alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim("addr") == "").alias("empty_addr"))


def size_bin(n: Column, edges: tuple[int, ...] = (25, 50, 100, 200)) -> Column:
    """The half-open bin (low, high] of a count."""
    out, low = None, "-inf"
    for edge in edges:
        name = F.lit(f"({low}, {edge}]")
        out = F.when(n <= edge, name) if out is None else out.when(n <= edge, name)
        low = edge
    return out.otherwise(F.lit(f"({low}, inf]"))


def prune_losses(labelled: DataFrame, min_p: float, most: int, per_source: int) -> DataFrame:
    """(reason, size_bin, n) of the true pairs: kept, or lost by a low p, a low rank or both, by the number of candidates of the entity. labelled: (s1, cand, src, p, y)."""
    order = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("p"), "cand"))
    rows = labelled.withColumns({"rank": order("s1"), "rank_in_source": order("s1", "src"), "n": F.count(F.lit(1)).over(Window.partitionBy("s1"))}).where("y = 1")
    low_p, low_rank = F.col("p") < min_p, (F.col("rank") > most) & (F.col("rank_in_source") > per_source)
    reason = F.when(low_p & low_rank, "low p and low rank").when(low_p, "low p only").when(low_rank, "low rank only").otherwise("kept")
    return rows.groupBy(reason.alias("reason"), size_bin(F.col("n"), (2, 5, 9)).alias("size_bin")).agg(F.count(F.lit(1)).alias("n"))


def pivot_grid(grid: DataFrame, ps: tuple[float, ...]) -> DataFrame:
    """A grid (k, min_p, recall) with a column for each min_p."""
    return grid.groupBy("k").pivot("min_p", list(ps)).agg(F.first("recall")).select("k", *[F.col(f"`{p}`").alias(f"recall_{str(p).replace('.', '_')}") for p in ps])


def rank_runs(runs: DataFrame) -> DataFrame:
    """Runs (name, holdout, oof, valid): those with a hold-out score first, by it; then the others by their out-of-fold score. Only a valid one with a hold-out can win."""
    place = F.row_number().over(Window.orderBy(F.col("holdout").isNull(), F.desc(F.coalesce("holdout", "oof", F.lit(0.0))), "name"))  # a table of a few runs
    out = runs.withColumn("place", place)
    wins = F.col("valid") & F.col("holdout").isNotNull()
    return out.withColumn("winner", wins & (F.col("place") == F.min(F.when(wins, F.col("place"))).over(Window.partitionBy())))


def hardest_negatives(labelled: DataFrame, per_positive: int = 3) -> DataFrame:
    """The positives, and of all negatives the most similar, ``per_positive`` for each positive: (s1, cand, block_sim, y)."""
    n = labelled.where("y = 1").count()
    order = [F.desc("block_sim"), F.asc("s1"), F.asc("cand")]
    return labelled.where("y = 1").unionByName(labelled.where("y = 0").orderBy(*order).limit(per_positive * n)).select("s1", "cand", "block_sim", "y")


def within(pairs: DataFrame, p: str = "p", prefix: str = "w") -> DataFrame:
    """Nine columns of a score among the entity's candidates and among the record's claims."""
    own, claim = Window.partitionBy("s1"), Window.partitionBy("cand")
    rank = lambda key, tie: F.row_number().over(Window.partitionBy(key).orderBy(F.desc(p), tie))
    rows = pairs.withColumns({f"{prefix}_rank": rank("s1", "cand"), f"{prefix}_crank": rank("cand", "s1")})
    nth = lambda n: F.coalesce(F.max(F.when(F.col(f"{prefix}_crank") == n, F.col(p))).over(claim), F.lit(0.0))
    rows = rows.withColumns(
        {
            f"{prefix}_gap": F.col(p) - F.max(p).over(own),
            f"{prefix}_sum": F.sum(p).over(own),
            f"{prefix}_n05": F.sum((F.col(p) > 0.5).cast("long")).over(own),
            f"{prefix}_cn05": F.sum((F.col(p) > 0.5).cast("long")).over(claim),
            f"{prefix}_other": F.when(F.col(f"{prefix}_crank") == 1, nth(2)).otherwise(nth(1)),
        }
    )
    return rows.withColumns({f"{prefix}_share": F.coalesce(F.try_divide(p, f"{prefix}_sum"), F.lit(0.0)), f"{prefix}_margin": F.col(p) - F.col(f"{prefix}_other")})


def peer_agreement(pairs: DataFrame, records: DataFrame, top: int = 3) -> DataFrame:
    """(s1, cand, ag_tokens, ag_house, ag_other_tokens, ag_other_house, ag_tokens_mean): agreement with the entity's best other candidates, weighted by their p.

    records: (cand, src, addr_tokens array, house). The others: of another source only. The mean is over peers with p above a half.
    """
    rows = pairs.select("s1", "cand", "p").join(records, "cand")
    rank = F.row_number().over(Window.partitionBy("s1").orderBy(F.desc("p"), "cand"))
    names = {"s1": "own", "cand": "peer", "p": "pj", "src": "peer_src", "addr_tokens": "peer_tokens", "house": "peer_house"}
    peers = rows.withColumn("rn", rank).where(F.col("rn") <= top).drop("rn").withColumnsRenamed(names)
    both = rows.join(peers, (F.col("s1") == F.col("own")) & (F.col("cand") != F.col("peer")), "left")
    tokens = F.when(F.size(F.array_union("addr_tokens", "peer_tokens")) == 0, 0.0).otherwise(jaccard(F.col("addr_tokens"), F.col("peer_tokens")))
    house = ((F.col("house") == F.col("peer_house")) & (F.col("house") != "")).cast("double")
    both = both.withColumns({"t": F.col("pj") * tokens, "h": F.col("pj") * house, "raw": tokens})
    other = F.col("peer_src") != F.col("src")
    r = lambda c: F.round(c, 6)
    return both.groupBy("s1", "cand").agg(
        r(F.max("t")).alias("ag_tokens"), r(F.max("h")).alias("ag_house"), r(F.max(F.when(other, F.col("t")))).alias("ag_other_tokens"),
        r(F.max(F.when(other, F.col("h")))).alias("ag_other_house"), r(F.avg(F.when(F.col("pj") > 0.5, F.col("raw")))).alias("ag_tokens_mean"),
    )


def peer_similarity(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(s1, cand, peer1_sim, peer2_sim): mean token-set similarity of name and address to the entity's first and second candidate; -1 for itself or none. records: (cand, core_name, core_addr)."""
    rank = F.row_number().over(Window.partitionBy("s1").orderBy(F.desc("p"), "cand"))
    rows = pairs.select("s1", "cand", "p").withColumn("rn", rank).join(records, "cand")
    out, same = rows, kernel("token_set")
    for n in (1, 2):
        peer = rows.where(F.col("rn") == n).select(F.col("s1").alias(f"own{n}"), F.col("cand").alias(f"peer{n}"), F.col("core_name").alias(f"name{n}"), F.col("core_addr").alias(f"addr{n}"))
        out = out.join(peer, F.col("s1") == F.col(f"own{n}"), "left")
        sim = (same(F.col("core_name"), F.coalesce(f"name{n}", F.lit(""))) + same(F.col("core_addr"), F.coalesce(f"addr{n}", F.lit("")))) / 2
        out = out.withColumn(f"sim{n}", sim)
    value = lambda n: F.when(F.col(f"peer{n}").isNull() | (F.col(f"peer{n}") == F.col("cand")), -1.0).otherwise(F.round(f"sim{n}", 6))
    return out.select("s1", "cand", value(1).alias("peer1_sim"), value(2).alias("peer2_sim"))


def group_frequencies(records: DataFrame, keys: dict[str, tuple[str, ...]]) -> DataFrame:
    """(id, one column for each named key): log1p of the number of records with the same values of the key's columns; 0 if a value is empty."""
    out = records
    for name, columns in keys.items():
        filled = F.array_contains(F.array(*[F.coalesce(F.col(c), F.lit("")) == "" for c in columns]), False) & ~F.array_contains(F.array(*[F.coalesce(F.col(c), F.lit("")) == "" for c in columns]), True)
        counts = records.where(filled).groupBy(*columns).agg(F.log1p(F.count(F.lit(1))).alias(name))
        out = out.join(counts, list(columns), "left")
    return out.select("id", *[F.round(F.coalesce(n, F.lit(0.0)), 6).alias(n) for n in keys])


def state_pairs(s1: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides (id, part, state, ...) with ``part`` extended by state, so that a join on part compares equal states, and blank states with everything of the country.

    A record with a state stands under its state and under "any"; one without stands under every role by "any" alone.
    """
    same = lambda d: d.where("state <> ''").withColumn("part", F.concat_ws("|", "part", F.lit("state"), "state"))
    tag = lambda d, t: d.withColumn("part", F.concat_ws("|", "part", F.lit(t)))
    left = same(s1).unionByName(tag(s1, "pool-missing")).unionByName(tag(s1.where("state = ''"), "s1-missing"))
    right = same(pool).unionByName(tag(pool.where("state = ''"), "pool-missing")).unionByName(tag(pool.where("state <> ''"), "s1-missing"))
    return left, right
