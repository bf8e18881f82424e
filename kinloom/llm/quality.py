"""A quality classifier: ordinal cumulative-link regression on graded ratings.

A document is the set of its features: hashed lower-case words without surrounding signs and their beginnings, and a few hashed shape features (shares of
words in capitals, with runs of signs, with digits, repeated at once, distinct words, mean length), each share in steps. All grades share one weight per
feature; ordered thresholds cut the score into grades: P(grade >= j) = sigmoid(score - threshold_j). The fit minimises the negative log
likelihood with an L1 penalty (proximal gradient with momentum), so words that tell nothing weigh exactly nothing and long texts gather no noise.

The fit takes at most ``sample_rows`` labelled documents, those with the smallest hashes of their ids. It runs in one task, as the sample is bounded; features that it would set aside
are counted out before. The numbers of the others, the weights that are not 0 and the thresholds are all that reaches the driver. Every document is scored, on its whole text.

Defined results: null and empty texts are scored by their shape features alone; labels that are null or lack a document are not used; a
document with several labels is used with each, and a labelled doc_id of several rows with one of its texts (the least hash); without usable labels every grade is null, and every document is kept; repeated rows
each give a row; an empty table gives no rows; other columns are kept by ``keep_good`` and ignored otherwise.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import stored

BITS = 20
LEAST_DOCS, LEAST_Z = 4, 3.5
PIECE = 1 << 18
BEGINNINGS = (4, 5, 6, 7)
CACHE_WORDS = 300_000


def _slot(name: str) -> int:
    return xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass"), 7) & ((1 << BITS) - 1)


class Features:
    """Turns texts into sorted arrays of feature numbers; remembers words it has seen, up to a bound. With weights, features of weight 0 are left out."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = weights
        self.words: dict[str, tuple[tuple[int, ...], bool, bool, bool]] = {}

    def _word(self, raw: str) -> tuple[tuple[int, ...], bool, bool, bool]:
        core = raw.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’…–—¡¿")
        signs = sum(not c.isalnum() for c in raw)
        slots = (_slot("w:" + core), *(_slot("b:" + core[:n]) for n in BEGINNINGS if len(core) > n))
        if self.weights is not None:
            slots = tuple(s for s in slots if self.weights[s])
        return slots, len(raw) > 1 and raw.upper() == raw and raw.lower() != raw, signs >= 2, any(c.isdigit() for c in raw)

    def __call__(self, text: str | None) -> np.ndarray:
        raw = (text or "").split()
        counts = Counter(raw)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        slots, caps, signs, digits, chars = set(), 0, 0, 0, 0
        known = self.words
        for word, n in counts.items():
            found = known.get(word)
            if found is None:
                found = known[word] = self._word(word)
            if found[0]:
                slots.update(found[0])
            if found[1]:
                caps += n
            if found[2]:
                signs += n
            if found[3]:
                digits += n
            chars += n * len(word)
        n = len(raw)
        twice = sum(map(eq, raw, raw[1:]))
        for name, share in (("caps", caps), ("signs", signs), ("digits", digits), ("twice", twice)):
            slots.add(_slot(f"s:{name}:{-1 if not share else int(np.ceil(10 * share / n))}"))
        slots.add(_slot(f"s:distinct:{int(10 * len(counts) / n) if n else -1}"))
        slots.add(_slot(f"s:length:{min(int(chars / n), 15) if n else -1}"))
        slots.add(_slot(f"s:words:{int(np.log2(n)) if n else -1}"))
        return np.fromiter(sorted(slots), np.int32, len(slots))


@dataclass
class Ordinal:
    """weights by feature number; thresholds rising, one less than grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ... in columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - scores[:, None], -40, 40)))


def _sums(places: np.ndarray, sizes: np.ndarray):
    """A function of values: the sum of the values at each group's places, groups one after another, some PIECE places at a time."""
    ends = np.cumsum(sizes)
    cuts = np.unique([0, *np.searchsorted(ends, np.arange(PIECE, ends[-1] if len(ends) else 0, PIECE)), len(sizes)])

    def sums(values: np.ndarray) -> np.ndarray:
        out = np.empty(len(sizes))
        for a, b in zip(cuts, cuts[1:], strict=False):
            owner = np.repeat(np.arange(b - a), sizes[a:b])
            out[a:b] = np.bincount(owner, values[places[ends[a] - sizes[a] : ends[b - 1]]], b - a)
        return out

    return sums


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, l1: float = 1e-4, steps: int = 1000, least_docs: int = LEAST_DOCS, least_z: float = LEAST_Z) -> Ordinal:
    """Fits by accelerated proximal gradient, over the features whose documents' mean grade differs from that of all by ``least_z`` standard errors."""
    size, n = 1 << BITS, len(rows)
    off = grades - grades.mean()
    seen, lean = np.zeros(size), np.zeros(size)
    for at in range(0, n, 512):  # a few documents at a time, so that the sample's features are never copied whole
        flat = np.concatenate(rows[at : at + 512])
        seen += np.bincount(flat, minlength=size)
        lean += np.bincount(flat, weights=np.repeat(off[at : at + 512], [len(r) for r in rows[at : at + 512]]), minlength=size)
    z = lean / np.sqrt(np.maximum(seen, 1) * max(off.var(), 1e-9))
    good = (seen >= least_docs) & (np.abs(z) >= least_z)
    if not good.any():
        good = seen == seen.max()
    number, used, seen = (np.cumsum(good) - 1).astype(np.int32), np.flatnonzero(good), seen[good]
    flat = np.concatenate([number[r[good[r]]] for r in rows])
    sizes = np.array([np.count_nonzero(good[r]) for r in rows])
    del number, lean, z, good
    docs = np.repeat(np.arange(n, dtype=np.int32), sizes)[np.argsort(flat, kind="stable")]
    by_doc, by_feature = _sums(flat, sizes), _sums(docs, np.bincount(flat, minlength=len(used)))
    scale = 1 / np.sqrt(np.maximum(seen, 1) / n + 0.01)  # rare features take longer steps
    scale = np.minimum(scale, 5.0)
    share = np.array([np.mean(grades >= j) for j in range(1, n_grades)])
    share = np.clip(share, 1e-3, 1 - 1e-3)
    cuts = np.log((1 - share) / share)
    w, look, momentum = np.zeros(len(used)), np.zeros(len(used)), 1.0
    power = np.ones(len(used))  # largest eigenvalue of the scaled Gram matrix, by a few power steps
    for _ in range(12):
        power = scale * by_feature(by_doc(scale * power))
        norm = np.linalg.norm(power)
        power /= norm
    step = 1 / (0.5 * norm / n + 1e-9)
    for _ in range(steps):
        score = by_doc(scale * look)
        tail = 1 / (1 + np.exp(np.clip(cuts[None] - score[:, None], -40, 40)))
        full = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        upper, lower = full[at, grades], full[at, grades + 1]
        slope = 1 - upper - lower
        p = np.maximum(upper - lower, 1e-9)
        grad = -scale * by_feature(slope) / n
        moved = look - step * grad
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * l1 * scale, 0)
        for j in range(n_grades - 1):
            d = tail[:, j] * (1 - tail[:, j]) / p
            cuts[j] -= 0.5 * (np.mean(d * (grades == j + 1)) - np.mean(d * (grades == j)))
        cuts = np.maximum.accumulate(cuts + np.arange(n_grades - 1) * 1e-6)
        next_momentum = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look = new + (momentum - 1) / next_momentum * (new - w)
        w, momentum = new, next_momentum
    weights = np.zeros(size)
    weights[used] = w * scale
    return Ordinal(weights, cuts)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): how many of two demands a text meets, to be well written and not to be toxic."""
    grade = F.col("quality").cast("int") + F.lit(1) - F.col("toxic").cast("int")
    return labels.where("doc_id is not null and quality in (0, 1) and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))


def train(documents: DataFrame, ratings: DataFrame, n_grades: int = 3, sample_rows: int = 12_288, l1: float = 1e-4) -> Ordinal | None:
    """Fits on a sample of ratings (doc_id, grade); the sample is bounded, so it may be broadcast and its features brought to one task."""
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    usable = ratings.join(own.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    sample = usable.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "grade").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "grade", "found"])

    joined = own.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("doc_id", "grade", "t.text")  # a repeated id counts once
    found = stored(joined.mapInArrow(run, "doc_id long, grade int, found array<int>"), "features")
    return fit_in_task(few_features(found), n_grades, l1)


def fit_in_task(found: DataFrame, n_grades: int, l1: float) -> Ordinal | None:
    """``fit_ordinal`` over the rows (doc_id, grade, found) in a task of its own, so that the driver holds none of them; None if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), schema=kinds).sort_by([("doc_id", "ascending"), ("grade", "ascending")])
        if not rows.num_rows:
            return
        flat, ends = rows["found"].combine_chunks().flatten().to_numpy(), np.cumsum(pc.list_value_length(rows["found"]).to_numpy())
        model = fit_ordinal(np.split(flat, ends[:-1]), rows["grade"].to_numpy(), n_grades, l1)
        slots = np.flatnonzero(model.weights).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"slots": [slots], "weights": [model.weights[slots]], "thresholds": [model.thresholds]}, fitted)

    kinds = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("found", pa.list_(pa.int32()))])
    fitted = pa.schema([("slots", pa.list_(pa.int32())), ("weights", pa.list_(pa.float64())), ("thresholds", pa.list_(pa.float64()))])
    out = found.coalesce(1).mapInArrow(run, "slots array<int>, weights array<double>, thresholds array<double>").toArrow()
    if not out.num_rows:
        return None
    slots, own, thresholds = (out[c].combine_chunks().flatten().to_numpy() for c in ("slots", "weights", "thresholds"))
    weights = np.zeros(1 << BITS)
    weights[slots] = own
    return Ordinal(weights, thresholds.copy())


def telling(found: DataFrame) -> pa.Table:
    """``few_features``, collected."""
    return few_features(found).toArrow()


def few_features(found: DataFrame) -> DataFrame:
    """The rows (doc_id, grade, found) with the features that ``fit_ordinal`` may use; it makes the same choice of them as of all."""
    total = found.agg(F.avg("grade").alias("mean"), F.var_pop("grade").alias("var")).first()
    slots = found.select(F.explode("found").alias("slot"), "grade").groupBy("slot").agg(F.count(F.lit(1)).alias("seen"), F.sum("grade").alias("sum"))
    z = (F.col("sum") - F.col("seen") * F.lit(total["mean"])) / F.sqrt(F.col("seen") * F.lit(max(total["var"] or 0.0, 1e-9)))
    most = slots.agg(F.max("seen")).first()[0]
    chosen = slots.where(((F.col("seen") >= LEAST_DOCS) & (F.abs(z) >= LEAST_Z - 1e-6)) | (F.col("seen") == F.lit(most))).select("slot").toArrow()["slot"].to_numpy()
    used = np.zeros(1 << BITS, bool)
    used[chosen] = True
    bits = np.packbits(used)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.unpackbits(bits).astype(bool)
        for batch in batches:
            kept = [x[used[x]] for x in (r.values.to_numpy() for r in batch.column("found"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(kept, pa.list_(pa.int32()))], names=["doc_id", "grade", "found"])

    return found.mapInArrow(run, found.schema)


def _scores(model: Ordinal, features: Features, texts: list) -> np.ndarray:
    return np.array([model.weights[features(t)].sum() for t in texts], np.float64)


def score_documents(documents: DataFrame, model: Ordinal | None, least_tail: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, keep): the tail is the probability of the best grade."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, expected_grade double, tail_probability double, keep boolean"
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select("doc_id", none.alias("expected_grade"), none.alias("tail_probability"), F.lit(True).alias("keep"))
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(held.value.weights)
        for batch in batches:
            tails = held.value.tails(_scores(held.value, features, batch.column("text").to_pylist()))
            cols = [batch.column("doc_id"), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least_tail)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "expected_grade", "tail_probability", "keep"])

    return rows.mapInArrow(run, schema)


def keep_good(documents: DataFrame, model: Ordinal | None, least_tail: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that ``score_documents`` would keep."""
    if model is None:
        return documents
    held = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(held.value.weights)
        for batch in batches:
            tails = held.value.tails(_scores(held.value, features, batch.column(place).to_pylist()))
            yield batch.filter(pc.greater_equal(pa.array(tails[:, -1]), least_tail))

    return documents.mapInArrow(run, documents.schema)
