"""Candidate retrieval: TF-IDF top-k joins, exact keys, sibling expansion, unions and their diagnostics.

A top-k cosine join deals records to cells, each a block of one partition's queries beside a block of its index; a cell's task holds the index, sums the
products of shared tokens query by query and keeps the k best of each, so that no list of pairs is ever written: what is shuffled are the
records, once for each block of the other side. Every pair that shares a token is scored. Tokens of too many records are dropped before (max_df); scores
are rounded before ranking and ties go to ids, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.text import tokens

#: A cell's queries, the weights of its index, and tokens of an idf table that is broadcast.
QUERY_ROWS, INDEX_WEIGHTS, FEW_TOKENS = 1 << 15, 6_000_000, 1_000_000


def word_tokens(text: Column) -> Column:
    """Lower-case words of letters, numbers and underscores."""
    return tokens(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " ")))


def char_grams(text: Column, n: int = 3) -> Column:
    """n-grams of each word padded by a space on both sides; a shorter padded word is one gram."""
    padded = F.transform(word_tokens(text), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = lambda w: F.when(F.length(w) <= n, F.array(w)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))
    )
    return F.flatten(F.transform(padded, grams))


def token_counts(records: DataFrame, grams: Column) -> DataFrame:
    """(id, part, token, tf). Texts are dealt out by id before they are cut, which shuffles less than their tokens."""
    return records.repartition("id").select("id", "part", F.explode(grams).alias("token")).groupBy("id", "part", "token").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return counts.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("df"))


def idf_table(pool: DataFrame, counts: DataFrame, min_df: int = 2, max_df: float = 0.1) -> DataFrame:
    """(token, idf): smooth idf over the pool's records, of tokens in at least min_df records and at most the share max_df of them."""
    n = pool.count()  # counted first, so that the plan has a constant and no join for it
    df = document_frequency(counts).where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n)))
    return df.select("token", (F.log(F.lit(1.0 + n) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))


def few_broadcast(idf: DataFrame) -> tuple[DataFrame, float]:
    """The table and about how many of its tokens a record of the pool has. It is broadcast if it was counted to have at most FEW_TOKENS rows, so that weights are made where the records are."""
    found = idf.agg(F.count(F.lit(1)).alias("n"), F.sum(F.exp(F.lit(1.0) - F.col("idf"))).alias("mean")).first()  # idf - 1 is the logarithm of records over df
    return F.broadcast(idf) if found.n <= FEW_TOKENS else idf, found.mean or 0.0


def tfidf_weights(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(id, part, token, w): sublinear term frequency times idf, of unit length per record."""
    raw = counts.join(idf, "token").withColumn("raw", (F.lit(1.0) + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))  # a record's tokens: one shuffle instead of two and a join
    return raw.select("id", "part", "token", (F.col("raw") / norm).alias("w"))


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, billionths) of the k highest scores above 0, rounded to nine digits; ties to smaller places."""
    floor = 0.0
    if len(scores) > 64 * k:  # the k-th of the highest scores by runs of 64 is at most the k-th of all
        tops = np.maximum.reduceat(scores, np.arange(0, len(scores), 64))
        floor = np.partition(tops, len(tops) - k)[len(tops) - k] - 2e-9
    at = np.flatnonzero((scores >= floor) & (scores > 0))
    units = np.floor(scores[at] * 1e9 + 0.5)
    if len(at) > k:
        last = np.partition(units, len(units) - k)[len(units) - k]
        above, even = np.flatnonzero(units > last), np.flatnonzero(units == last)
        kept = np.concatenate([above, even[: k - len(above)]])
        at, units = at[kept], units[kept]
    return at, units


class Grown:
    """A column of numbers that grows in place: freed pieces would stay with the process."""

    def __init__(self, kind: type):
        self.room, self.n = np.empty(0, kind), 0

    def add(self, more: np.ndarray) -> None:
        end = self.n + len(more)
        if end > len(self.room):
            self.room.resize(end + end // 4, refcheck=False)
        self.room[self.n : end] = more
        self.n = end

    def taken(self) -> np.ndarray:
        """The column, which this object then no longer holds."""
        out, self.room = self.room, np.empty(0, self.room.dtype)
        out.resize(self.n, refcheck=False)
        return out


class Index:
    """Posting lists of one cell's index: by token the places, in the order of ids, and weights of the records that have it.

    Records are added batch by batch and copied, so that no batch is held; two tasks of an executor build at once, so building takes little more than the numbers themselves.
    """

    def __init__(self):
        self.held, self.sizes, self.keys, self.weights = [], Grown(np.int32), Grown(np.int64), Grown(np.float64)

    def add(self, rows: pa.RecordBatch) -> None:
        self.held.append(rows.column("id").take(pa.array(np.arange(rows.num_rows))))
        self.sizes.add(pc.list_value_length(rows.column("keys")).to_numpy(zero_copy_only=False))
        self.keys.add(rows.column("keys").flatten().to_numpy())
        self.weights.add(rows.column("w").flatten().to_numpy())

    def built(self) -> Index:
        self.ids, self.held = pa.concat_arrays(self.held), []
        keys = self.keys.taken()
        order = np.argsort(keys, kind="stable").astype(np.int32)
        keys = keys[order]
        self.begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        self.end = np.append(self.begin[1:], len(keys))
        self.known = keys[self.begin]
        del keys
        self.w = self.weights.taken()[order]
        sizes = self.sizes.taken()
        self.place = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        return self

    def best(self, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """(q, c, sim) of the k best of each query."""
        keys, w = (queries.column(c).flatten().to_numpy() for c in ("keys", "w"))
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        hit = np.flatnonzero(self.known[at] == keys)
        owner = np.repeat(np.arange(queries.num_rows), pc.list_value_length(queries.column("keys")).to_numpy(zero_copy_only=False))[hit]
        edges = np.searchsorted(owner, np.arange(queries.num_rows + 1))
        first, last, w = self.begin[at[hit]], self.end[at[hit]], w[hit]
        none = np.empty(0, np.int64)
        q, c, sims = [none], [none], [none.astype(float)]
        for i in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[i], edges[i + 1])
            lists = list(zip(first[own].tolist(), last[own].tolist(), w[own].tolist(), strict=True))
            places, products = np.concatenate([self.place[s:e] for s, e, _ in lists]), np.concatenate([self.w[s:e] * v for s, e, v in lists])
            found, units = best_of(np.bincount(places, products, len(self.ids)), k)
            q.append(np.full(len(found), i))
            c.append(found)
            sims.append(units / 1e9)
        taken = [ids.take(pa.array(np.concatenate(x))) for ids, x in ((queries.column("id"), q), (self.ids, c))]
        return pa.RecordBatch.from_arrays([*taken, pa.array(np.concatenate(sims))], names=["q", "c", "sim"])


def _cells(k: int):
    """The k best of each query of a task's cells. Rows (cell, is_query, id, keys, w) come cell by cell, the index before the queries, each by id; queries are not held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, filling, index = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, is_query = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "is_query"))
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (is_query[1:] != is_query[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if cells[a] != cell:
                    cell, filling, index = cells[a], None, None
                rows = batch.slice(a, b - a)
                if not is_query[a]:
                    filling = filling or Index()
                    filling.add(rows)
                    continue
                if filling is not None:
                    index, filling = filling.built(), None
                if index is not None:
                    yield index.best(rows, k)

    return run


def _blocks(sizes: DataFrame, most: float) -> Column:
    """How many blocks of about ``most`` records column ``part`` needs; only the few parts that need several reach the driver."""
    large = sizes.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).collect()
    known = [x for r in large if r.part is not None for x in (F.lit(r.part), F.lit(int(-(-r.n // most))))]
    return F.coalesce(F.element_at(F.create_map(*known), F.col("part")), F.lit(1)) if known else F.lit(1)


def cosine_top_k(queries: DataFrame, index: DataFrame, k: int, query_sizes: DataFrame | None = None, index_sizes: DataFrame | None = None, mean: float = 64.0) -> DataFrame:
    """(q, c, sim, rank): of all index records that share (part, token) with a query, the k with the highest sum of products of weights.

    Both sides are (id, part, token, w), each token of a record once; weights are positive. Sizes are frames with a row (part, ...) for each record, if there is a cheaper one than the
    weights; mean says about how many tokens a record has. A record of several parts stands in the cells of each with all its tokens, so that a pair has its whole
    sum wherever it meets. Tokens are compared by 64-bit hashes of (part, token).
    """
    count = lambda sizes, weights: weights.select("id", "part").distinct() if sizes is None else sizes
    q_blocks = _blocks(count(query_sizes, queries), QUERY_ROWS)
    c_blocks = _blocks(count(index_sizes, index), max(1.0, INDEX_WEIGHTS / max(mean, 1.0)))

    def dealt(weights: DataFrame, is_query: bool, own: Column, other: Column) -> DataFrame:
        pairs = F.collect_list(F.struct(F.xxhash64("part", "token").alias("key"), "w")).alias("pairs")
        packed = weights.where("part is not null").groupBy("id").agg(pairs, F.collect_set("part").alias("parts"))
        rows = packed.select("id", "pairs", F.explode("parts").alias("part"))
        mine, theirs = F.pmod(F.xxhash64("id", F.lit(3)), own).cast("int"), F.explode(F.sequence(F.lit(0), other.cast("int") - 1))
        rows = rows.select("part", mine.alias("mine"), theirs.alias("theirs"), "id", F.col("pairs.key").alias("keys"), F.col("pairs.w").alias("w"))
        q, c = ("mine", "theirs") if is_query else ("theirs", "mine")
        return rows.select(F.xxhash64("part", q, c).alias("cell"), F.lit(is_query).alias("is_query"), "id", "keys", "w")

    cells = dealt(queries, True, q_blocks, c_blocks).unionByName(dealt(index, False, c_blocks, q_blocks))
    cells = cells.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell", "is_query", "id")
    kind = queries.schema["id"].dataType.simpleString()
    best = cells.mapInArrow(_cells(k), f"q {kind}, c {kind}, sim double")
    return top_pairs(best.repartition("q").dropDuplicates(["q", "c"]), k)


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The k most similar c of each q with their rank, ties to smaller c."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "c"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def tfidf_top_k(s1: DataFrame, pool: DataFrame, k: int, grams: Column, min_df: int = 2, max_df: float = 0.1, reverse: bool = False) -> DataFrame:
    """(s1, cand, block_sim, rank). Records are (id, part, text); idf is fitted on the pool. Reverse asks the pool for its best s1."""
    own, other = token_counts(s1, grams), token_counts(pool, grams)
    idf, mean = few_broadcast(idf_table(pool, other, min_df, max_df))
    a, b = tfidf_weights(own, idf), tfidf_weights(other, idf)
    found = cosine_top_k(b, a, k, pool, s1, mean) if reverse else cosine_top_k(a, b, k, s1, pool, mean)
    s, c = ("c", "q") if reverse else ("q", "c")
    return found.select(F.col(s).alias("s1"), F.col(c).alias("cand"), F.col("sim").alias("block_sim"), "rank")


def fill_similarity(pairs: DataFrame, s1_weights: DataFrame, pool_weights: DataFrame) -> DataFrame:
    """(s1, cand, block_sim) of given pairs; pairs without a shared token get 0."""
    left = pairs.join(s1_weights.select(F.col("id").alias("s1"), "token", F.col("w").alias("ws")), "s1")
    both = left.join(pool_weights.select(F.col("id").alias("cand"), "token", F.col("w").alias("wc")), ["cand", "token"])
    sims = both.groupBy("s1", "cand").agg(F.round(F.sum(F.col("ws") * F.col("wc")), 9).alias("block_sim"))
    return pairs.join(sims, ["s1", "cand"], "left").select("s1", "cand", F.coalesce("block_sim", F.lit(0.0)).alias("block_sim"))


def pool_cap(records: DataFrame, keys: tuple[str, ...], cap: int) -> DataFrame:
    """Records whose key has at most ``cap`` records, by a combined count and a join, so that a key of very many records is no hot spot."""
    size = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("pool_size")).where(F.col("pool_size") <= cap)
    return records.join(size, list(keys))


def exact_key_pairs(s1: DataFrame, pool: DataFrame, keys: dict[str, int], cap: int = 300) -> DataFrame:
    """(s1, cand, x): pairs with an equal non-empty key of at most ``cap`` records on either side; x has the bit of each key they share."""
    out = None
    for key, bit in keys.items():
        sides = [pool_cap(side.where(F.col(key) != "").select("id", "part", F.col(key).alias("key")).distinct(), ("part", "key"), cap).drop("pool_size") for side in (s1, pool)]
        left, right = sides[0].withColumnRenamed("id", "s1"), sides[1].withColumnRenamed("id", "cand")
        part = left.join(right, ["part", "key"]).select("s1", "cand", F.lit(bit).alias("x"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("s1", "cand").agg(F.bit_or("x").alias("x"))


def sibling_pairs(ranked: DataFrame, pool: DataFrame, top: int = 3, cap: int = 20) -> DataFrame:
    """(s1, cand): the records that share (part, key) with one of the entity's first ``top`` candidates, for keys of at most ``cap`` records."""
    keyed = pool.where("key <> ''")
    small = pool_cap(keyed, ("part", "key"), cap).select("id", "part", "key")
    best = ranked.where(F.col("rank") <= top).join(keyed.select(F.col("id").alias("cand"), "part", "key"), "cand").select("s1", "part", "key").distinct()
    return best.join(small, ["part", "key"]).select("s1", F.col("id").alias("cand")).distinct()


def direct_key_pairs(s1: DataFrame, pool: DataFrame, cap: int = 20) -> DataFrame:
    """(s1, cand): the records with the entity's own (part, key), for keys of at most ``cap`` records."""
    small = pool_cap(pool.where("key <> ''"), ("part", "key"), cap).select(F.col("id").alias("cand"), "part", "key")
    return s1.where("key <> ''").select(F.col("id").alias("s1"), "part", "key").join(small, ["part", "key"]).select("s1", "cand").distinct()


def union_blockers(passes: dict[str, DataFrame]) -> DataFrame:
    """(s1, cand, sim_<pass> and rank_<pass> of each pass, n_passes): absent scores 0, absent ranks 99. One shuffle for all passes."""
    out = None
    for own, rows in passes.items():
        cols = [F.col("block_sim" if kind == "sim" else "rank").alias(f"{kind}_{p}") if p == own else F.lit(None).cast("double" if kind == "sim" else "int").alias(f"{kind}_{p}") for p in passes for kind in ("sim", "rank")]
        part = rows.select("s1", "cand", *cols)
        out = part if out is None else out.unionByName(part)
    sims = [F.coalesce(F.max(f"sim_{p}"), F.lit(0.0)).alias(f"sim_{p}") for p in passes]
    ranks = [F.coalesce(F.min(f"rank_{p}"), F.lit(99)).alias(f"rank_{p}") for p in passes]
    count = sum((F.when(F.max(f"sim_{p}").isNotNull(), 1).otherwise(0) for p in passes), F.lit(0)).cast("int")
    return out.groupBy("s1", "cand").agg(*sims, *ranks, count.alias("n_passes"))


def extras(new: DataFrame, base: DataFrame) -> DataFrame:
    return new.select("s1", "cand").distinct().join(base.select("s1", "cand"), ["s1", "cand"], "left_anti")


def keep_best(pairs: DataFrame, n: int) -> DataFrame:
    """The n pairs of each entity with the highest block_sim, ties to smaller cand."""
    rank = F.row_number().over(Window.partitionBy("s1").orderBy(F.desc("block_sim"), "cand"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= n)


def orphans(s1: DataFrame, pairs: DataFrame) -> DataFrame:
    """Entities without any candidate."""
    return s1.select("id").join(pairs.select(F.col("s1").alias("id")).distinct(), "id", "left_anti")


def recall_at(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, hits, n_truth, recall, pairs): how many true pairs are among the first k candidates. The ks are a few constants."""
    labelled = ranked.select("s1", "cand", "rank").join(truth.select("s1", "cand", F.lit(1).alias("y")), ["s1", "cand"], "left")
    total = truth.agg(F.count(F.lit(1)).alias("n_truth"))
    sums = labelled.agg(*[F.count_if((F.col("rank") <= k) & F.col("y").isNotNull()).alias(f"h{k}") for k in ks], *[F.count_if(F.col("rank") <= k).alias(f"p{k}") for k in ks])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits"), F.col(f"p{k}").alias("pairs")) for k in ks])).alias("r")
    out = sums.select(rows).select("r.k", "r.hits", "r.pairs").crossJoin(F.broadcast(total))  # one row
    return out.select("k", "hits", "n_truth", F.round(F.try_divide(F.col("hits").cast("double"), F.col("n_truth").cast("double")), 9).alias("recall"), "pairs")


def recall_by(ranked: DataFrame, truth: DataFrame, slices: DataFrame, k: int) -> DataFrame:
    """(slice, hits, n_truth, recall) of the first k; slices is (s1, slice)."""
    hit = ranked.where(F.col("rank") <= k).select("s1", "cand", F.lit(1).alias("hit"))
    rows = truth.join(slices, "s1").join(hit, ["s1", "cand"], "left")
    out = rows.groupBy("slice").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("n_truth"))
    return out.withColumn("recall", F.round(F.col("hits").cast("double") / F.col("n_truth").cast("double"), 9))


def marginal_recall(united: DataFrame, truth: DataFrame, passes: tuple[str, ...], gate: float = 0.002) -> DataFrame:
    """(pass, hits, cumulative, gain, passes_gate): true pairs each pass finds, and what it adds to the passes before."""
    rows = truth.select("s1", "cand").join(united, ["s1", "cand"], "left")
    found = lambda p: F.coalesce(F.col(f"sim_{p}"), F.lit(0.0)) > 0
    any_of = lambda ps: F.array_contains(F.array(*[found(p) for p in ps]), True)
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(found(p)).alias(f"h_{p}") for p in passes], *[F.count_if(any_of(passes[: i + 1])).alias(f"c_{p}") for i, p in enumerate(passes)])
    before = lambda i: F.col(f"c_{passes[i - 1]}") if i else F.lit(0).cast("long")
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("pass"), F.col(f"h_{p}").alias("hits"), F.col(f"c_{p}").alias("cumulative"), (F.col(f"c_{p}") - before(i)).alias("gain")) for i, p in enumerate(passes)])).alias("r")
    return sums.select("n", rows).select("r.*", (F.try_divide(F.col("r.gain").cast("double"), F.col("n").cast("double")) >= gate).alias("passes_gate"))


def ceiling(recall: Column) -> Column:
    """The best macro F0.5 that candidates of this recall allow."""
    return F.lit(1.25) * recall / (F.lit(0.25) + recall)


def dense_top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, sim): the k nearest by cosine of each query among the other rows (vec_id, embedding).

    Queries are taken in blocks of at most 1024 rows; only a block is broadcast, and each block's partial top-k is cut by a window.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    rows = vectors.where("embedding is not null").select("vec_id", "embedding", F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("norm")).where("norm > 0")
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("norm").alias("q_norm"))
    blocks, out = max(1, -(-queries.count() // 1024)), None
    for b in range(blocks):
        block = F.broadcast(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b))  # about 1024 rows
        sims = rows.join(block, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(dot(F.col("q"), F.col("embedding")) / (F.col("norm") * F.col("q_norm")), 6).alias("sim"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id"))
        part = sims.withColumn("rank", rank).where(F.col("rank") <= k)
        out = part if out is None else out.unionByName(part)
    return out.select("query_id", "rank", "vec_id", "sim")
