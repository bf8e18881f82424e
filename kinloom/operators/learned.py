"""What is learned from data: lookup tables, calibration, boosted trees, ensembles and the prune stage."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators.context import log_odds
from kinloom.operators.sampling import inner_stop_group


def state_table(rows: DataFrame, least: int = 5, share: float = 0.9) -> DataFrame:
    """(country, loc, state): localities that stand with one state in at least ``least`` records and that share of them. rows: (country, locs array, state)."""
    seen = rows.where("state <> ''").select("country", F.explode("locs").alias("loc"), "state").where("loc <> ''")
    counts = seen.groupBy("country", "loc", "state").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("country", "loc").agg(F.sum("n").alias("total"))
    rows = counts.join(total, ["country", "loc"])
    return rows.where((F.col("n") >= least) & (F.col("n") / F.col("total") >= share)).select("country", "loc", "state", "n")


def fill_state(records: DataFrame, table: DataFrame) -> DataFrame:
    """records (id, country, locs, state) with blank states filled from their localities; of several, the best supported, then the smallest."""
    blank = records.where("state = ''").select("id", "country", F.explode("locs").alias("loc"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "state"))["state"]
    found = blank.join(table, ["country", "loc"]).groupBy("id").agg(best.alias("filled"))
    return records.join(found, "id", "left").withColumn("state", F.when(F.col("state") == "", F.coalesce("filled", F.lit(""))).otherwise(F.col("state"))).drop("filled")


def token_dictionary(pairs: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """(token, latin, n): for aligned true pairs (source array, target array) of equal length, each source word's most frequent target.

    Ties go to the smaller target. Give it pairs of training folds only: it reads labels.
    """
    aligned = pairs.where(F.size("source") == F.size("target")).select(F.explode(F.arrays_zip("source", "target")).alias("x")).select("x.source", "x.target")
    counts = aligned.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("n"), "target")).alias("b"), F.sum("n").alias("total"))
    rows = best.select(F.col("source").alias("token"), F.col("b.target").alias("latin"), (-F.col("b.n")).alias("n"), "total")
    return rows.where((F.col("n") >= least) & (F.col("n") >= F.lit(share) * F.col("total"))).select("token", "latin", "n")


def apply_dictionary(records: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, text, n_known, n_unknown): words replaced where the dictionary has them, in order. records: (id, words array)."""
    rows = records.select("id", F.posexplode("words").alias("i", "token")).join(dictionary, "token", "left")
    ordered = F.array_sort(F.collect_list(F.struct("i", F.coalesce("latin", "token").alias("w"))))
    return rows.groupBy("id").agg(F.concat_ws(" ", F.transform(ordered, lambda x: x["w"])).alias("text"), F.count("latin").alias("n_known"), F.count_if(F.col("latin").isNull()).alias("n_unknown"))


def word_costs(words: DataFrame, least: int = 2) -> DataFrame:
    """(word, cost): minus the log share of alphabetic words (column word) seen at least twice and longer than a letter."""
    counts = words.where(F.col("word").rlike(r"^\p{L}+$")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    rows = counts.crossJoin(F.broadcast(total))  # one row
    return rows.where(((F.col("n") >= least) & (F.length("word") >= 2)) | (F.col("word") == "a")).select("word", (-F.log(F.col("n") / F.col("total"))).alias("cost"))


def break_words(text: str, costs: dict[str, float], unknown: float = 12.0, longest: int = 20) -> list[str]:
    """The cheapest split of a run of letters; letters outside any known word cost ``unknown`` each."""
    best, back = [0.0], [0]
    for end in range(1, len(text) + 1):
        options = ((best[start] + costs.get(text[start:end], unknown * (end - start)), start) for start in range(max(0, end - longest), end))
        cost, start = min(options)
        best.append(cost)
        back.append(start)
    out, end = [], len(text)
    while end:
        out.append(text[back[end] : end])
        end = back[end]
    return out[::-1]


def segment(rows: DataFrame, costs: DataFrame, longest: int = 20) -> DataFrame:
    """(id, text, words): text split into known words of the whole vocabulary. Only pieces of at most ``longest`` letters that occur in the texts are looked up, by a join."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text in pdf["text"]:
                yield pd.DataFrame({"text": text, "word": sorted({text[i:j] for i in range(len(text)) for j in range(i + 1, min(i + longest, len(text)) + 1)})})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = [dict(zip(w, c, strict=True)) for w, c in zip(pdf["known"], pdf["costs"], strict=True)]
            yield pdf.assign(words=[" ".join(break_words(t, k, longest=longest)) for t, k in zip(pdf["text"], known, strict=True)])[["text", "words"]]

    texts = rows.select("text").where("text <> ''").distinct()
    found = texts.mapInPandas(pieces, "text string, word string").join(costs, "word").groupBy("text").agg(F.collect_list(F.struct("word", "cost")).alias("x"))
    known = texts.join(found, "text", "left").select("text", F.coalesce("x.word", F.array().cast("array<string>")).alias("known"), F.coalesce("x.cost", F.array().cast("array<double>")).alias("costs"))
    split = known.mapInPandas(run, "text string, words string")
    return rows.select("id", "text").join(split, "text", "left").select("id", "text", F.coalesce("words", F.lit("")).alias("words"))


def isotonic(scores: DataFrame, low: float = 1e-6, high: float = 1 - 1e-6):
    """A function from frames with ``p`` to frames with ``calibrated``; scores is (p, y[, weight])."""
    model = IsotonicRegression(featuresCol="p", labelCol="y", weightCol="weight", predictionCol="calibrated").fit(scores.select("p", F.col("y").cast("double"), (F.col("weight") if "weight" in scores.columns else F.lit(1.0)).alias("weight")))
    return lambda frame: model.transform(frame).withColumn("calibrated", F.least(F.greatest("calibrated", F.lit(low)), F.lit(high)))


def crossfit_isotonic(scores: DataFrame, folds: int) -> DataFrame:
    """Each fold calibrated by a fit on the others."""
    out = None
    for k in range(folds):
        part = isotonic(scores.where(F.col("fold") != k))(scores.where(F.col("fold") == k))
        out = part if out is None else out.unionByName(part)
    return out


class FoldTrees:
    """Boosted trees per fold: rows of fold k are scored by the model that never saw them, other rows by the mean of all models."""

    def __init__(self, features: list[str], folds: int = 3, rounds: int = 20, depth: int = 5, seed: int = 7):
        self.features, self.folds, self.rounds, self.depth, self.seed, self.models = features, folds, rounds, depth, seed, []

    def _vectors(self, rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.features, outputCol="__x", handleInvalid="keep").transform(rows)

    def fit(self, rows: DataFrame) -> FoldTrees:
        """rows: features, y, fold, number (of the entity) and optionally weight. A twentieth of the entities stops each fit early."""
        data = self._vectors(rows).withColumn("__y", F.col("y").cast("double")).withColumn("__stop", inner_stop_group(F.col("number")))
        data = data.withColumn("__w", F.col("weight") if "weight" in rows.columns else F.lit(1.0))
        for k in range(self.folds):
            trees = GBTClassifier(featuresCol="__x", labelCol="__y", weightCol="__w", validationIndicatorCol="__stop", maxIter=self.rounds, maxDepth=self.depth, seed=self.seed, validationTol=1e-9)
            self.models.append(trees.fit(data.where(F.col("fold") != k)))
        return self

    def score(self, rows: DataFrame, column: str = "p") -> DataFrame:
        out = self._vectors(rows)
        for k, model in enumerate(self.models):
            scored = model.copy({model.predictionCol: f"__c{k}", model.rawPredictionCol: f"__r{k}", model.probabilityCol: f"__q{k}"}).transform(out)
            out = scored.withColumn(f"__p{k}", vector_to_array(f"__q{k}")[1]).drop(f"__c{k}", f"__r{k}", f"__q{k}")
        names = [f"__p{k}" for k in range(len(self.models))]
        p = sum(F.col(n) for n in names) / len(names)
        if "fold" in rows.columns:
            for k, n in enumerate(names):
                p = F.when(F.col("fold") == k, F.col(n)).otherwise(p)
        return out.withColumn(column, p).drop("__x", *names)

    def importance(self) -> list[tuple[str, float]]:
        total = [sum(m.featureImportances[i] for m in self.models) / len(self.models) for i in range(len(self.features))]
        return sorted(zip(self.features, total, strict=True), key=lambda x: -x[1])


def blend(pairs: DataFrame, weights: dict[str, float], how: str = "logit") -> Column:
    """The weighted mean of score columns, of the probabilities or of their log-odds."""
    total = sum(weights.values())
    if how == "mean":
        return sum(F.col(c) * F.lit(w / total) for c, w in weights.items())
    if how == "logit":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-sum(log_odds(F.col(c)) * F.lit(w / total) for c, w in weights.items())))
    raise ValueError(f"unknown blend {how}")


def score_agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, pearson_logit, spearman) of two score columns; ranks of ties are averaged, from the counts of distinct scores."""
    n = pairs.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr(log_odds(F.col(a)), log_odds(F.col(b))), 6).alias("pearson_logit"))

    def ranks(c: str) -> DataFrame:
        counts = pairs.groupBy(c).agg(F.count(F.lit(1)).alias("k"))
        bins = counts.withColumn("__bin", F.floor(F.col(c) * 1000))  # sums per bin first, so that no task ranks all scores
        per_bin = bins.groupBy("__bin").agg(F.sum("k").alias("bk"))
        before = per_bin.withColumn("base", F.coalesce(F.sum("bk").over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most 1001 rows
        inside = F.coalesce(F.sum("k").over(Window.partitionBy("__bin").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return bins.join(F.broadcast(before), "__bin").select(c, (F.col("base") + inside + (F.col("k") + 1) / 2.0).alias(f"rank_{c}"))

    ranked = pairs.join(ranks(a), a).join(ranks(b), b)
    return n.crossJoin(ranked.agg(F.round(F.corr(f"rank_{a}", f"rank_{b}"), 6).alias("spearman")))  # one row each


def fit_temperature(scores: DataFrame, low: float = 0.05, high: float = 20.0, steps: int = 40, bins: int = 2000) -> float:
    """The T that minimises the log loss of sigmoid(logit(p) / T); scores is (p, y), summed in bins of log-odds, so the driver sees a bounded table."""
    z = log_odds(F.col("p"))
    cells = scores.select(F.round(z * (bins / 28), 0).alias("cell"), z.alias("z"), "y").groupBy("cell").agg(F.avg("z").alias("z"), F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).collect()

    def loss(t: float) -> float:
        out = 0.0
        for r in cells:
            m = r.z / t
            out += r.pos * math.log1p(math.exp(-m)) + (r.n - r.pos) * math.log1p(math.exp(m)) if abs(m) < 700 else (r.n - r.pos) * max(m, 0) + r.pos * max(-m, 0)
        return out

    a, b, golden = math.log(low), math.log(high), (math.sqrt(5) - 1) / 2
    for _ in range(steps):
        c, d = b - golden * (b - a), a + golden * (b - a)
        a, b = (a, d) if loss(math.exp(c)) < loss(math.exp(d)) else (c, b)
    return math.exp((a + b) / 2)


def prune(pairs: DataFrame, min_p: float | Column, most: int = 20, per_source: int = 10) -> DataFrame:
    """Pairs (s1, cand, src, p) with p of at least min_p among the entity's first ``most``, or its first ``per_source`` of their source."""
    order = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("p"), "cand"))
    ranked = pairs.withColumns({"rank": order("s1"), "rank_in_source": order("s1", "src")})
    return ranked.where((F.col("p") >= min_p) & ((F.col("rank") <= most) | (F.col("rank_in_source") <= per_source)))


def add_back_best(kept: DataFrame, pairs: DataFrame, least: float = 0.001) -> DataFrame:
    """(s1, cand): for each record none of whose pairs were kept, its best entity, if p is at least ``least``."""
    best = pairs.groupBy("cand").agg(F.min(F.struct((-F.col("p")).alias("n"), "s1")).alias("b")).select("b.s1", "cand", (-F.col("b.n")).alias("p"))
    return best.where(F.col("p") >= least).join(kept.select("cand").distinct(), "cand", "left_anti").select("s1", "cand", "p")


def prune_grid(labelled: DataFrame, truth_count: int, ks: tuple[int, ...], ps: tuple[float, ...]) -> DataFrame:
    """(k, min_p, pairs, recall) over a small grid in one pass; labelled is (rank, p, y)."""
    cells = [(k, p) for k in ks for p in ps]
    inside = lambda k, p: (F.col("rank") <= k) & (F.col("p") >= p)
    sums = labelled.agg(*[F.count_if(inside(k, p)).alias(f"n{i}") for i, (k, p) in enumerate(cells)], *[F.count_if(inside(k, p) & (F.col("y") == 1)).alias(f"h{i}") for i, (k, p) in enumerate(cells)])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("min_p"), F.col(f"n{i}").alias("pairs"), F.col(f"h{i}").alias("hits")) for i, (k, p) in enumerate(cells)])).alias("r")
    return sums.select(rows).select("r.k", "r.min_p", "r.pairs", F.round(F.col("r.hits") / F.lit(float(truth_count or 1)), 6).alias("recall"))
