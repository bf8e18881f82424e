"""Near-duplicates by the exact Jaccard similarity of their shingle sets.

A text is cut into shingles as in simhash.py. Two texts are linked if the Jaccard similarity of their sets of distinct shingles (as 64-bit
hashes) is at least ``threshold``, and linked texts form components. Minimum hashes only propose pairs: a signature of BANDS * ROWS minima is
cut into bands, and texts that share a band are compared. A pair of similarity s shares none with probability (1 - s**ROWS)**BANDS: 4e-8 at
0.8, while texts that share a passage are rarely compared. Groups found by another operator (SimHash) can be given as ``proposed``: each of a group's texts is compared with the group's
smallest, and the bands find what is left, as a pair at 0.8 may differ in 40 of 128 bits of SimHash, which no index of bits serves.

Only distinct sets are compared, so copies cost nothing however many there are. A first round compares each text with the smallest id of each
of its bands; the second compares what shares a band and is not yet in one component. A band of up to FEW such texts gives its pairs; a larger one
is joined whole in one task, or in a task for each two of its parts if it has more than NODE_ROWS, and gives a forest, one row per text at most.

Defined results: a text without words has an empty set and is linked to its like only; a row without doc_id gets the component of its
neighbours but names none; repeated rows each give a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import stored
from kinloom.llm.components import connected_components
from kinloom.llm.gray_index import Forest
from kinloom.llm.simhash import SEED

BANDS, ROWS = 32, 4
PIECE = 1 << 12
FEW, NODE_ROWS = 32, 2048
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_FLIP, _TIMES = _DRAWN[0], _DRAWN[1] | np.uint64(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    k = min(words, len(found))
    starts = np.concatenate([[0], ends + 1])[: len(found) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64))


def band_keys(grams: np.ndarray) -> np.ndarray:
    """A key for each band of the signature; none for an empty set."""
    if not len(grams):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(grams), PIECE):
        least = np.minimum(least, ((grams[at : at + PIECE, None] ^ _FLIP) * _TIMES).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], np.uint64).view(np.int64)


def _described(documents: DataFrame, words: int) -> DataFrame:
    """(doc_id, form, id, n, bands): id names the shingle set, n is its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            bands = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("form"), pa.array(ids), pa.array([len(s) for s in sets], pa.int64()), bands], names=["doc_id", "form", "id", "n", "bands"])

    return documents.select("doc_id", "form", "text").mapInArrow(run, "doc_id long, form long, id long, n long, bands array<long>")


def _grams(ids: DataFrame, documents: DataFrame, distinct: DataFrame, words: int) -> DataFrame:
    """(id, grams): the shingle sets of the ids, each from one text that has it."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [shingle_set(t, words).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(grams, pa.binary())], names=["id", "grams"])

    needed = ids.distinct().join(distinct.select("id", "first"), "id")
    needed = needed.select("id", F.col("first.doc_id").alias("own"), F.col("first.form").alias("own_form"))
    texts = documents.join(needed, (F.col("form") == F.col("own_form")) & F.col("doc_id").eqNullSafe(F.col("own"))).select("id", "text").dropDuplicates(["id"])
    return stored(texts.mapInArrow(sets, "id long, grams binary"), "grams")


def _linked(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both / (len(x) + len(y) - both) >= threshold)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(held.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a").join(held.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
    return stored(both.select("a", "b", "x", "y").mapInArrow(similar, "a long, b long"), "links")


def join_node(ids: np.ndarray, roots: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links whose components, with those of equal roots, are those of all similar pairs; where sides are 0 and 1, of pairs across them."""
    sizes = np.array([len(x) for x in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by_code = owner[np.argsort(code, kind="stable")]
    n = np.bincount(code)
    begin, first = np.cumsum(n) - n, np.cumsum(sizes) - sizes
    forest, across = Forest(len(sets)), not (sides == 2).all()
    _, known = np.unique(roots, return_index=True)
    forest.join(np.arange(len(sets)), known[np.unique(roots, return_inverse=True)[1]])
    out, comp = [], forest.roots()
    for i in range(len(sets)):
        if (comp == comp[0]).all():
            break
        own = code[first[i] : first[i] + sizes[i]]
        at = np.repeat(begin[own] - (np.cumsum(n[own]) - n[own]), n[own]) + np.arange(int(n[own].sum()))
        both = np.bincount(by_code[at], minlength=len(sets))
        near = (both >= threshold * (sizes[i] + sizes - both)) & (comp != comp[i])
        if across:
            near &= sides != sides[i]
        found = np.flatnonzero(near)
        if len(found):
            forest.join(np.full(len(found), i), found)
            comp = forest.roots()
            out += [(int(ids[i]), int(ids[j])) for j in found]
    return out


def _crowded(apart: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of the rows (key, id, root, members), key by key."""
    parts = F.ceil(F.col("members") / NODE_ROWS).cast("int")
    rows = apart.select("id", "root", "key", parts.alias("parts"), F.pmod(F.xxhash64("id", F.lit(5)), parts).cast("int").alias("p"))
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("p") == F.col("q"), 2).when(F.col("p") < F.col("q"), 0).otherwise(1)
    rows = rows.select("key", F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high"), "id", "root", side.alias("side")).join(held, "id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        sets = [np.frombuffer(x, np.uint64) for x in pdf["grams"]]
        return pd.DataFrame(join_node(pdf["id"].to_numpy(), pdf["root"].to_numpy(), pdf["side"].to_numpy(), sets, threshold), columns=["a", "b"], dtype="int64")

    return stored(rows.groupBy("key", "low", "high").applyInPandas(run, "a long, b long"), "crowded")


def _proposed(proposed: DataFrame, rows: DataFrame, size) -> DataFrame:
    """Pairs (a, b): the set of each group's head, the document that the group is named by, and each other set of the group."""
    groups = proposed.where("doc_id is not null and component_id is not null").select("doc_id", "component_id").distinct()
    sets = stored(rows.join(groups, "doc_id").select("doc_id", "component_id", "id", "n").distinct(), "proposed")
    heads = sets.where("doc_id = component_id").select("component_id", F.col("id").alias("a"), F.col("n").alias("a_n"))
    return sets.join(heads, "component_id").where((F.col("id") != F.col("a")) & size(F.col("n"), F.col("a_n"))).select("a", F.col("id").alias("b"))


def near_duplicate_components(documents: DataFrame, words: int = 5, threshold: float = 0.8, proposed: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id): component_id is the smallest doc_id reachable by links. ``proposed`` (doc_id, component_id) names groups whose links are looked for first."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("form"), "text")
    rows = stored(_described(documents, words), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "form")).alias("first")
    distinct = stored(rows.groupBy("id").agg(first, F.first("n").alias("n"), F.first("bands").alias("bands")), "distinct")
    size = lambda x, y: F.least(x, y) >= F.greatest(x, y) * F.lit(threshold - 1e-9)

    banded = distinct.select("id", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min(F.struct("id", "n")).alias("c"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = stored(shared.select("key", F.col("c.id").alias("a"), F.col("c.n").alias("a_n")), "centres")
    members = stored(banded.join(shared, "key"), "members")
    stars = members.where((F.col("id") != F.col("a")) & size(F.col("n"), F.col("a_n"))).select("a", F.col("id").alias("b"))
    if proposed is not None:
        stars = stars.unionByName(_proposed(proposed, rows, size))
    stars = stored(stars.distinct(), "stars")
    ends = lambda pairs: pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    links = _linked(stars, _grams(ends(stars), documents, distinct, words), threshold)

    found = connected_components(links)
    rooted = members.join(found, members["id"] == found["node"], "left").select("key", "id", "n", F.coalesce("root", "id").alias("root"))
    rooted = stored(rooted, "rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members")).where("low <> high")
    apart = stored(rooted.join(stored(mixed.select("key", "members"), "mixed"), "key"), "apart")
    few = apart.where(F.col("members") <= FEW)
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & size(F.col("x.n"), F.col("y.n")))
    pairs = stored(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().join(stars, ["a", "b"], "left_anti"), "pairs")
    many = apart.where(F.col("members") > FEW)
    held = _grams(ends(pairs).union(many.select("id")), documents, distinct, words)
    links = links.unionByName(_linked(pairs, held, threshold)).unionByName(_crowded(many, held, threshold))

    found = connected_components(links)
    named = distinct.join(found, distinct["id"] == found["node"], "left").select("id", F.col("first.doc_id").alias("least"), F.coalesce("root", "id").alias("root"))
    heads = stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "heads")  # stored, so that Spark can split the join of a large component
    by_id = named.join(heads, "root").select(F.col("id").alias("own"), "component_id")
    return rows.join(by_id, rows["id"] == by_id["own"]).select("doc_id", "component_id")
