"""Embedding near-duplicates through navigable small-world graphs per shard.

Equal vectors are one node, weighted by its copies. The nodes are dealt by hash to shards of bounded bytes, each indexed by a
hierarchical navigable small-world graph (hnsw.py), and every node queries every shard, in slices of bounded bytes. A query whose whole beam lies
within the threshold is widened, and past ``widest`` is answered by a scan of the shard in blocks, so crowded neighbourhoods lose nothing.
What the graph finds is verified by cosine in double precision. A task returns only sums and a spanning forest, one row per query
and one per joined node at most, however many pairs it found; components come from the union of the forests.

Each task audits its recall against a scan, on a sample of its queries that grows until it holds AUDIT_LINKS true links to other vectors (or
AUDIT_MOST queries), and doubles the beam of all until PASSING of them are found; past ``widest`` all its queries are answered by the
scan. The audits are rows of the result too: their pooled recall is a column, and so is the share of queries that were scanned.

What is moved: a graph is its vectors in their own type and its links, sent once for each slice; a query is its vector, sent once for each shard.
Queries times shards grows with the square of the table once it is larger than a shard; that is inherent in querying every shard, and why
shards are as large as a task can hold.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components link with nothing and are their own
component; so do vectors of different lengths; a row without vec_id takes no part and gets null for the component; repeated rows count as other
vectors; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import stored
from kinloom.llm.components import connected_components
from kinloom.llm.gray_index import Forest
from kinloom.llm.hnsw import Graph

QUERY_BLOCK = 256
SLACK = 1e-4
AUDIT, AUDIT_LINKS, AUDIT_MOST = 48, 24, 1536
PASSING = 0.98
LINK_BYTES = 136  # of a node of a graph beside its vector, about
INDEX = "dim int, shard int, graph binary, ids binary, vectors binary, weights binary"
FOUND = "rep long, n_links long, other long, truth long, met long, asked long, scanned long"


def _unit(v: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that very large or small components neither overflow nor vanish."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _build(kind: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", key=lambda s: s * 2654435761 % 4294967291, kind="stable")  # not in the order of ids
        raw = np.stack(pdf["embedding"].to_numpy()).astype(kind)
        graph = Graph(_unit(raw).astype(np.float32))
        row = (int(pdf["dim"].iloc[0]), int(pdf["shard"].iloc[0]), graph.dump(), pdf["rep"].to_numpy(np.int64).tobytes(), raw.tobytes(), pdf["copies"].to_numpy(np.int64).tobytes())
        return pd.DataFrame([row], columns=["dim", "shard", "graph", "ids", "vectors", "weights"])

    return run


def _scan(x32: np.ndarray, q32: np.ndarray, todo: np.ndarray, least: float):
    rows = max(1, (1 << 21) // max(1, len(x32)))
    for at in range(0, len(todo), rows):
        q, n = np.nonzero(q32[todo[at : at + rows]] @ x32.T >= least)
        yield todo[at + q], n


def _find(graph: Graph, x32: np.ndarray, q32: np.ndarray, beam: int, widest: int, threshold: float, scanned: list[int]):
    """Yields (query numbers, node numbers) of pairs within the threshold (single precision, with slack); counts the queries answered by a scan."""
    todo = np.arange(len(q32))
    while len(todo):
        if beam >= len(x32) or beam > widest:
            scanned[0] += len(todo)
            yield from _scan(x32, q32, todo, threshold - SLACK)
            return
        wider = []
        for at in range(0, len(todo), QUERY_BLOCK):
            own = todo[at : at + QUERY_BLOCK]
            ids, sims = graph.search(q32[own], beam)
            full = sims[:, -1] >= threshold - SLACK
            wider.append(own[full])
            q, c = np.nonzero((sims >= threshold - SLACK) & ~full[:, None])
            yield own[q], ids[q, c]
        todo, beam = np.concatenate(wider), beam * 4


def _audit(graph: Graph, x32: np.ndarray, q32: np.ndarray, own: np.ndarray, ids: np.ndarray, beam: int, widest: int, threshold: float) -> tuple[int, int, int]:
    """The beam that finds enough of the true links of a sample to other vectors, those links, and how many of them it finds."""
    order, size = np.random.default_rng(len(own)).permutation(len(own)), AUDIT
    while True:
        sample = np.sort(order[:size])
        truth = {(int(a), int(b)) for q, n in _scan(x32, q32, sample, threshold) for a, b in zip(q, n, strict=True) if own[a] != ids[b]}
        if len(truth) >= AUDIT_LINKS or size >= min(AUDIT_MOST, len(own)):
            break
        size *= 4
    while True:
        got = {(int(sample[a]), int(b)) for q, n in _find(graph, x32, q32[sample], beam, widest, threshold, [0]) for a, b in zip(q, n, strict=True)}
        if len(truth & got) >= PASSING * len(truth) or beam > widest:
            return beam, len(truth), len(truth & got)
        beam *= 2


def _query(kind: str, threshold: float, least_beam: int, widest: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in FOUND.split(", ")})
        if not len(index) or not len(queries):
            return out
        row = index.iloc[0]
        dim = int(row["dim"])
        ids, weights = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["weights"], np.int64)
        x = _unit(np.frombuffer(row["vectors"], kind).reshape(-1, dim))
        x32 = x.astype(np.float32)
        graph = Graph.load(row["graph"], x32)
        own = queries["rep"].to_numpy(np.int64)
        q = _unit(np.stack(queries["embedding"].to_numpy()))
        q32 = q.astype(np.float32)
        beam, truth, met = _audit(graph, x32, q32, own, ids, least_beam, widest, threshold)
        counts, scanned = np.zeros(len(own), np.int64), [0]
        names, place = np.unique(np.concatenate([own, ids]), return_inverse=True)
        at_own, at_node = place[: len(own)], place[len(own) :]
        forest = Forest(len(names))
        for a, b in _find(graph, x32, q32, beam, widest, threshold, scanned):
            for s in range(0, len(a), 1 << 16):
                u, v = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
                real = (own[u] != ids[v]) & (np.einsum("ed,ed->e", q[u], x[v]) >= threshold)
                u, v = u[real], v[real]
                np.add.at(counts, u, weights[v])
                forest.join(at_own[u], at_node[v])
        root = forest.roots()
        child = np.flatnonzero(root != np.arange(len(root)))
        links = pd.DataFrame({"rep": names[child], "n_links": 0, "other": names[root[child]]})
        found = np.flatnonzero(counts)
        sums = pd.DataFrame({"rep": own[found], "n_links": counts[found], "other": own[found]})
        audit = pd.DataFrame({"truth": [truth], "met": [met], "asked": [len(own)], "scanned": [scanned[0]]})
        return pd.concat([sums, links, audit], ignore_index=True).reindex(columns=list(out.columns)).astype("Int64")

    return run


def embedding_components(
    vectors: DataFrame, threshold: float = 0.95, beam: int = 24, widest: int = 128, least_shards: int = 4, shard_bytes: int = 32 << 20, slice_bytes: int = 8 << 20
) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_links, audit_recall, scanned_share) for every row; the last three are of the whole table, and the recall is null without links to audit."""
    double = vectors.schema["embedding"].dataType.simpleString() != "array<float>"
    kind, width = ("<f8", 8) if double else ("<f4", 4)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>" if double else "array<float>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    copies = rows.where(good).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    name = [F.xxhash64(F.lit(k), "embedding").alias(f"name{k}") for k in range(2)]  # of vectors, which are long keys for a join
    nodes = stored(copies.select("rep", "copies", "embedding", F.size("embedding").alias("dim"), *name), "nodes")
    sizes = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    of_bytes = lambda each, most: F.ceil(F.col("n") * each / F.lit(float(most))).cast("int")
    shards = F.greatest(F.lit(least_shards), of_bytes(F.col("dim") * width + LINK_BYTES, shard_bytes))
    sizes = stored(sizes.select("dim", shards.alias("shards"), F.greatest(F.lit(1), of_bytes(F.col("dim") * width, slice_bytes)).alias("slices")), "sizes")
    sized = nodes.join(sizes, "dim")
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int")).select("dim", "shard", "rep", "copies", "embedding")
    graphs = stored(dealt.groupBy("dim", "shard").applyInPandas(_build(kind), INDEX), "graphs")
    served = graphs.join(sizes, "dim").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("dim", "shard", "slice", "graph", "ids", "vectors", "weights")
    asked = sized.withColumn("slice", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("slices")).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select("dim", "shard", "slice", "rep", "embedding")
    keys = ("dim", "shard", "slice")
    found = served.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_query(kind, threshold, beam, widest), FOUND)
    found = stored(found, "links")
    audit = found.where("asked is not null").agg(*[F.sum(c).alias(c) for c in ("truth", "met", "asked", "scanned")]).first()
    links = found.where("rep is not null")
    sums = links.groupBy("rep").agg(F.sum("n_links").alias("n")).withColumnRenamed("rep", "sum_rep")
    roots = connected_components(links.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    known = nodes.select("rep", "copies", "name0", "name1").join(sums, F.col("rep") == F.col("sum_rep"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    known = known.select("name0", "name1", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "rep").alias("root"))
    linked = rows.where(good).select("vec_id", *name).join(known, ["name0", "name1"]).select("vec_id", "n", "root")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("root"))
    total = {
        "audit_links": F.lit(audit["truth"] or 0).cast("long"),
        "audit_recall": F.lit(audit["met"] / audit["truth"] if audit["truth"] else None).cast("double"),
        "scanned_share": F.lit(audit["scanned"] / audit["asked"] if audit["asked"] else None).cast("double"),
    }
    out = linked.unionByName(alone)
    return out.select("vec_id", F.col("n").alias("n_links"), F.col("root").alias("component_id"), (F.col("vec_id") == F.col("root")).alias("kept")).withColumns(total)
