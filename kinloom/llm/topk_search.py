"""Exact top-k search by distributed histogram selection.

Vectors become integers, floor(scale * x); a score is an integer inner product. For a block of queries, every candidate is scored in
each pass. A pass counts scores in equal bins between known limits (Cauchy-Schwarz gives the first limits); the summed histogram shows
in which bin each query's kth score lies, and the next pass refines that bin until it is one score wide. The last pass keeps the
scores above the kth and, of those equal to it, the smallest ids.

A task reports only its bins from the top down to its own kth score, and at most k ties, so a pass shuffles at most 2 * k rows per query
and task however many copies there are. Queries are taken in blocks of bounded size, and only a block (its vectors and limits) is
sent to the tasks.

Defined results: vectors that are null, hold null or non-finite components, or whose row has no id take no part; neither do vectors whose
integers have a squared norm of 2 ** 61 or more, as their scores might leave the 64-bit integers; vectors score only
against vectors of the same length; a query id that is repeated counts once, with its least vector; repeated candidates each
count, but never rows of the query's own id; fewer than k candidates give all; no queries give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1 << 21


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part."""
    doubles = F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), doubles.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)


def _integers(vectors: DataFrame, scale: float) -> DataFrame:
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x * F.lit(scale)).cast("double"), F.lit(2.0)))
    return vectors.where(norm < F.lit(float(2**61))).select("vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(scale))).alias("v"))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and a matrix for each length of vectors in the batch."""
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    column = batch.column("v")
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield ids[at], flat[starts[at][:, None] + np.arange(size)] if size else np.zeros((len(at), 0), np.int64)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, through floating point where that is exact."""
    if a.size == 0 or b.size == 0 or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _blocks(batches: Iterator[pa.RecordBatch], queries: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query numbers, candidate ids and scores (candidates x queries), a bounded number of cells at a time; own rows are masked by the caller."""
    for batch in batches:
        for ids, matrix in _by_length(batch):
            for numbers, query_ids, vectors in queries:
                if vectors.shape[1] != matrix.shape[1]:
                    continue
                rows = max(1, CELLS // max(1, len(numbers)))
                for at in range(0, len(ids), rows):
                    yield numbers, query_ids, ids[at : at + rows], _scores(matrix[at : at + rows], vectors)


def _histogram_task(block, k: int, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, low, width, span = block.value
        counts = np.zeros((len(low), bins), np.int64)
        for numbers, query_ids, ids, scores in _blocks(batches, queries):
            place = scores - low[numbers]
            valid = (place >= 0) & (place < span) & (ids[:, None] != query_ids)
            place //= width
            place += numbers * bins
            counts += np.bincount(place[valid], minlength=counts.size).reshape(counts.shape)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(counts[q, b])], names=["q", "bin", "n"])

    return run


def _answer_task(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, least = block.value
        ties: dict[int, np.ndarray] = {}
        for numbers, query_ids, ids, scores in _blocks(batches, queries):
            other = ids[:, None] != query_ids
            over_c, over_q = np.nonzero((scores > least[numbers]) & other)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[over_q]), pa.array(ids[over_c]), pa.array(scores[over_c, over_q])], names=["query_id", "vec_id", "score"])
            tie_q, tie_c = np.nonzero(((scores == least[numbers]) & other).T)
            for at in np.split(np.arange(len(tie_q)), np.flatnonzero(np.diff(tie_q)) + 1):
                if len(at):
                    q = int(tie_q[at[0]])
                    key = (int(query_ids[q]), int(least[numbers[q]]))
                    ties[key] = np.sort(np.concatenate([ties.get(key, np.empty(0, np.int64)), ids[tie_c[at]]]))[:k]
        rows = [(q, v, s) for (q, s), found in ties.items() for v in found.tolist()]
        q, v, s = zip(*rows, strict=True) if rows else ((),) * 3
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q, v, s)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, block_rows: int = 4096, bins: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query row against all other rows, ties to smaller ids."""
    spark = vectors.sparkSession
    rows = _integers(usable(vectors), scale)
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n_queries, limit = queries.count(), rows.agg(F.max(norm)).first()[0]
    blocks = max(1, -(-n_queries // block_rows))
    answers = None
    for number in range(blocks if n_queries else 0):
        held = sorted((r.vec_id, r.v) for r in queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).collect())  # a block's rows
        if not held:
            continue
        ids, lengths = np.array([i for i, _ in held], np.int64), np.array([len(v) for _, v in held])
        packed = []
        for size in np.unique(lengths):
            at = np.flatnonzero(lengths == size)
            packed.append((at, ids[at], np.array([held[i][1] for i in at], np.int64).reshape(len(at), size)))
        top = int(limit) + 1
        low, need = np.full(len(held), -top, np.int64), np.full(len(held), k, np.int64)
        span, exhausted = 2 * top + 1, np.zeros(len(held), bool)
        while span > 1:
            width = -(-span // bins)
            block = spark.sparkContext.broadcast((packed, low, width, span))
            found = rows.mapInArrow(_histogram_task(block, k, bins), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
            through = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
            spots: dict[int, list] = {}
            for r in found.select("q", "bin", "n", through.alias("through")).where(F.col("through") - F.col("n") < k).collect():  # k rows for each query of the block at most
                spots.setdefault(r.q, []).append((r.bin, r.through - r.n, r.through))
            for q in range(len(held)):
                spot = min((x for x in spots.get(q, []) if x[1] < need[q]), default=(0, 0, 0))
                if exhausted[q] or spot[2] < need[q]:
                    exhausted[q] = True  # fewer than k candidates: all are answers
                    continue
                low[q] += spot[0] * width
                need[q] -= spot[1]
            span = width
        least = np.where(exhausted, -top - 1, low)
        block = spark.sparkContext.broadcast((packed, least))
        part = rows.mapInArrow(_answer_task(block, k), "query_id long, vec_id long, score long")
        answers = part if answers is None else answers.unionByName(part)
    if answers is None:
        answers = spark.createDataFrame([], "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
