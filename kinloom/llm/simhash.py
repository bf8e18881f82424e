"""SimHash near-duplicates.

A text is lower-cased (A-Z only), split into words at ASCII white space, and cut into shingles of ``words`` words joined by single
spaces (a shorter text is one shingle; a text without words has fingerprint 0). Bit i of a fingerprint word is set if it is set in more
than half of the shingles' XXH64 hashes (seed 42 for the first word, 43 for the second, and so on). Fingerprints that differ in at most
``distance`` bits in all are linked, and linked documents form components.

Only distinct fingerprints are compared, so exact copies cost nothing however many there are. If fingerprints of w words differ in d bits,
some word differs in at most d / w; so for each word, fingerprints are dealt to the upper nodes of a Gray-order index (gray_index.py) that the word
matches, and each task joins the nodes it got, returning a spanning forest of what it found. Nodes with more than ``node_rows`` members
are cut into parts, and each pair of parts is a node of its own, so one crowded pattern neither lands in one task nor loses a pair. With
more fingerprints, nodes fix more blocks of bits, so that the number of members of a node does not grow with the table; which links are found never depends on it.

How bits tell similarity: shingle sets of cosine c differ in a share acos(c) / pi of the bits. Two words and 21 bits correspond to a
Jaccard similarity of about 0.8 (19.4 of 128 bits expected), while unrelated texts differ in 64 bits and practically never in 21.

Defined results: a null text has no words; a row without doc_id gets its fingerprint and the component of its neighbours but names
none (null where no member has an id); repeated rows each give a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import partitions, stored
from kinloom.llm.components import connected_components
from kinloom.llm.gray_index import Forest, gray_rank, linked_pairs, upper_masks

SEED = 42
PIECE = 1 << 16
TASK_ROWS = 1 << 18


def fingerprint(text: str | None, words: int, size: int = 1) -> list[int]:
    """``size`` words of 64 bits, as signed numbers."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not found:
        return [0] * size
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths) - 1
    k = min(words, len(found))
    starts = (ends - lengths + 1)[: len(found) - k + 1].tolist()
    stops = ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    out = []
    for seed in range(SEED, SEED + size):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(starts), PIECE):  # a very long text is counted in pieces
            hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + PIECE], stops[at : at + PIECE], strict=True)], "<u8")
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<i8")[0]))
    return out


def fingerprints(documents: DataFrame, words: int = 5, size: int = 1) -> DataFrame:
    """(doc_id, print0, print1, ...): a row for each document."""
    names = [f"print{w}" for w in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, words, size) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(prints[:, w]) for w in range(size))], names=["doc_id", *names])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(["doc_id long", *(f"{n} long" for n in names)]))


def _join_nodes(near: int, distance: int, columns: list[str]):
    """Joins the nodes of a task. Columns: node, side, id, the word the node is of, the other words."""

    def joined(table: np.ndarray) -> pa.RecordBatch | None:
        node, side = table[:, 0], table[:, 1]
        order = np.lexsort((gray_rank(table[:, 3].view(np.uint64).copy()), node))
        table = table[order]
        node, side, words = table[:, 0], table[:, 1], np.ascontiguousarray(table[:, 3:]).view(np.uint64)
        forest = Forest(len(table))
        # sides: 2 joins all of its node; a node made of two parts only asks for pairs across them
        for pick, across in ((side == 2, False), (side != 2, True)):
            ids = np.flatnonzero(pick)
            if not len(ids):
                continue
            for a, b in linked_pairs(np.ascontiguousarray(words[ids, 0]), node[ids], near, side=side[ids] if across else None):
                a, b = ids[a], ids[b]
                if words.shape[1] > 1:
                    close = np.bitwise_count(words[a] ^ words[b]).sum(axis=1) <= distance
                    a, b = a[close], b[close]
                forest.join(a, b)
        root = forest.roots()
        least = table[:, 2].copy()  # stars around the smallest id: other nodes with the same members give the same links
        np.minimum.at(least, root, table[:, 2])
        least = least[root]
        child = np.flatnonzero(least != table[:, 2])
        return pa.RecordBatch.from_arrays([pa.array(table[child, 2]), pa.array(least[child])], names=["a", "b"]) if len(child) else None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], axis=1))
                rows += batch.num_rows
            if rows >= TASK_ROWS:  # all whole nodes; the last may go on
                table = np.concatenate(held)
                cut = int(np.searchsorted(table[:, 0], table[-1, 0], "left"))
                held, rows = [table[cut:]], len(table) - cut
                if cut and (out := joined(table[:cut])) is not None:
                    yield out
        if rows and (out := joined(np.concatenate(held))) is not None:
            yield out

    return task


def _under(prints: DataFrame, masks: list[tuple[int, int]], size: int) -> DataFrame:
    """(node, id, word0, ...): the rows under each upper node they match; a node is a word's number, a mask's number and the bits the mask fixes."""
    out = None
    for w in range(size):
        own = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(mask).alias("mask")) for m, (word, mask) in enumerate(masks) if word == w])
        if not any(word == w for word, _ in masks):
            continue
        order = [w, *(k for k in range(size) if k != w)]
        part = prints.select("id", *[F.col(f"print{k}").alias(f"word{i}") for i, k in enumerate(order)], F.explode(own).alias("x"))
        node = F.xxhash64(F.lit(w), "x.m", F.col("word0").bitwiseAND(F.col("x.mask")))
        part = part.select(node.alias("node"), "id", *(f"word{k}" for k in range(size)))
        out = part if out is None else out.unionByName(part)
    return out


def _joined_nodes(under: DataFrame, size: int, near: int, distance: int, node_rows: int) -> DataFrame:
    spark = under.sparkSession
    sizes = under.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > node_rows)
    crowded = stored(sizes.select(F.col("node").alias("crowded"), F.ceil(F.col("n") / node_rows).cast("int").alias("parts")), "crowded")
    columns = ["node", "side", "id", *(f"word{k}" for k in range(size))]
    if crowded.isEmpty():
        dealt = under.withColumn("side", F.lit(2)).select(columns)
    else:
        both = under.join(crowded, under["node"] == crowded["crowded"], "left")
        whole = both.where("parts is null").withColumn("side", F.lit(2)).select(columns)
        # part p meets every part q: the pair's node is hashed from (node, min, max); alone, it is a whole node
        own = F.pmod(F.xxhash64(F.lit(7), *(f"word{k}" for k in range(size))), F.col("parts")).cast("int")
        parted = both.where("parts is not null").withColumn("p", own)
        parted = parted.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        side = F.when(F.col("p") == F.col("q"), 2).when(F.col("p") < F.col("q"), 0).otherwise(1)
        parted = parted.withColumn("side", side).withColumn("node", F.xxhash64("node", F.least("p", "q"), F.greatest("p", "q")))
        dealt = whole.unionByName(parted.select(columns))
    ordered = dealt.repartition(partitions(spark), "node").sortWithinPartitions("node")
    return ordered.mapInArrow(_join_nodes(near, distance, columns), "a long, b long")


def hamming_links(prints: DataFrame, size: int = 1, distance: int = 3, node_rows: int = 16_384) -> DataFrame:
    """Links (a, b) between ids of rows (id, print0, ...), distinct, whose components are those of all pairs that differ in at most ``distance`` bits.

    With many masks, a few go first; their components name the rows of the others, so a large group is linked once and not under every mask.
    """
    near, count, agree = distance // size, prints.count(), 2
    while agree < 4 and count >> (64 * agree // (near + agree)) > node_rows:
        agree += 1
    masks = [(w, m) for m in upper_masks(near, agree) for w in range(size)]
    first = len(masks) // 16
    if not first:
        return _joined_nodes(_under(prints, masks, size), size, near, distance, node_rows)
    step = len(masks) // first
    early = connected_components(_joined_nodes(_under(prints, masks[::step], size), size, near, distance, node_rows))
    rest = [m for i, m in enumerate(masks) if i % step]
    named = prints.join(early, prints["id"] == early["node"], "left").withColumn("id", F.coalesce("root", "id")).drop("node", "root")
    late = _joined_nodes(_under(named, rest, size), size, near, distance, node_rows)
    return early.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late)


def simhash_components(documents: DataFrame, words: int = 5, size: int = 2, distance: int = 21, node_rows: int = 16_384) -> DataFrame:
    """(doc_id, print0, ..., component_id): component_id is the smallest doc_id reachable by links."""
    names = [f"print{w}" for w in range(size)]
    rows = stored(fingerprints(documents, words, size), "prints")
    key = F.col("print0") if size == 1 else F.xxhash64(*names)
    rows = rows.withColumn("id", key)
    distinct = stored(rows.groupBy("id", *names).agg(F.min("doc_id").alias("least")), "distinct")
    found = connected_components(hamming_links(distinct, size, distance, node_rows))
    named = distinct.join(found, distinct["id"] == found["node"], "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    heads = stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "heads")  # stored, so that Spark can split the join of a large component
    by_id = named.join(heads, "root").select(F.col("id").alias("own"), "component_id")
    return rows.join(by_id, rows["id"] == by_id["own"]).select("doc_id", *names, "component_id")
