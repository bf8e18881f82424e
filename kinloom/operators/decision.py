"""From scored pairs (s1, cand, p) to decisions, and what the decisions are worth.

Expected F0.5 decoders choose, per entity, how many of the best candidates to keep. ``expected_f`` uses a ratio of expectations and is
windows only; ``expected_f_exact`` keeps the exact distribution of the true positives, ``expected_f_joint`` also that of the missed
ones. The latter two fold a probability vector along each entity's list with array functions, so they stay on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators.context import affine_log_odds

B2 = 0.25


def assign(pairs: DataFrame, mode: str) -> DataFrame:
    """One entity per record: none, hard (the best claim stays, ties to the smaller s1) or soft (p * p / sum of p over the record)."""
    if mode == "none":
        return pairs
    if mode == "hard":
        rank = F.row_number().over(Window.partitionBy("cand").orderBy(F.desc("p"), "s1"))
        return pairs.withColumn("rn", rank).where("rn = 1").drop("rn")
    if mode == "soft":
        total = F.sum("p").over(Window.partitionBy("cand"))
        return pairs.withColumn("p", F.col("p") * F.col("p") / F.when(total > 0, total).otherwise(F.lit(1.0)))
    raise ValueError(f"unknown mode {mode}")


def one_to_one(pairs: DataFrame, delta: float = 0.0) -> DataFrame:
    """Each record's best claim, if it leads the second by delta (a missing second counts as 0)."""
    ranked = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("cand").orderBy(F.desc("p"), "s1")))
    second = F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("p"))).over(Window.partitionBy("cand")), F.lit(0.0))
    return ranked.withColumn("second", second).where((F.col("rn") == 1) & (F.col("p") - F.col("second") >= delta)).drop("rn", "second")


def select_threshold(pairs: DataFrame, threshold: float | Column) -> DataFrame:
    return pairs.where(F.col("p") >= threshold)


def _ranked(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("k", F.row_number().over(Window.partitionBy("s1").orderBy(F.desc("p"), "cand")))


def expected_f(pairs: DataFrame, miss: float = 0.0) -> DataFrame:
    """Keeps the first k of each entity that maximise 1.25 * sum of p / (0.25 * (sum of all p + miss) + k), unless no link at all is worth more."""
    own = Window.partitionBy("s1")
    upto = own.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _ranked(pairs).withColumns({"cum": F.sum("p").over(upto), "total": F.sum("p").over(own) + F.lit(float(miss))})
    rows = rows.withColumn("v", F.lit(1 + B2) * F.col("cum") / (F.lit(B2) * F.col("total") + F.col("k")))
    empty = F.exp(F.sum(F.log1p(-F.least(F.col("p"), F.lit(1 - 1e-12)))).over(own) - F.lit(float(miss)))
    rows = rows.withColumns({"best": F.max("v").over(own), "empty": empty})
    rows = rows.withColumn("cut", F.min(F.when(F.col("v") >= F.col("best"), F.col("k"))).over(own))
    return rows.where((F.col("k") <= F.col("cut")) & (F.col("best") > F.col("empty"))).drop("k", "cum", "total", "v", "best", "empty", "cut")


def _convolve(pmf: Column, p: Column) -> Column:
    """The distribution of a count after one more trial of probability p."""
    stay = F.concat(F.transform(pmf, lambda x: x * (F.lit(1.0) - p)), F.array(F.lit(0.0)))
    move = F.concat(F.array(F.lit(0.0)), F.transform(pmf, lambda x: x * p))
    return F.zip_with(stay, move, lambda a, b: a + b)


def _listed(pairs: DataFrame) -> DataFrame:
    """One row per entity: its probabilities, best first. Lists are as long as the candidates retrieval keeps per entity."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("n"), "cand")))
    return pairs.groupBy("s1").agg(F.transform(items, lambda x: F.least(F.greatest(-x["n"], F.lit(0.0)), F.lit(1.0))).alias("ps"))


def _keep_first(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    return _ranked(pairs).join(counts, "s1").where(F.col("k") <= F.col("n_keep")).drop("k", "n_keep")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def best_count_exact(ps: Column, miss: float = 0.0) -> Column:
    """How many to keep when the true positives have their exact distribution and missed links enter by their mean."""
    total = _sum(ps) + F.lit(float(miss))
    empty = F.exp(F.aggregate(ps, F.lit(0.0), lambda a, x: a + F.log1p(-F.least(x, F.lit(1 - 1e-12)))) - F.lit(float(miss)))
    start = F.struct(F.array(F.lit(1.0)).alias("pmf"), F.lit(0.0).alias("cum"), F.lit(0).alias("k"), empty.alias("best"), F.lit(0).alias("n"))

    def step(a: Column, p: Column) -> Column:
        grown = F.struct(_convolve(a["pmf"], p).alias("pmf"), (a["cum"] + p).alias("cum"), (a["k"] + 1).alias("k"), a["best"].alias("best"), a["n"].alias("n"))
        return F.element_at(F.transform(F.array(grown), _scored), 1)

    def _scored(g: Column) -> Column:
        value = F.aggregate(
            F.transform(g["pmf"], lambda x, i: x * F.lit(1 + B2) * i / (F.lit(B2) * (i + total - g["cum"]) + g["k"])), F.lit(0.0), lambda s, x: s + x
        )
        kept = F.transform(F.array(value), lambda v: F.struct(g["pmf"].alias("pmf"), g["cum"].alias("cum"), g["k"].alias("k"), F.greatest(v, g["best"]).alias("best"), F.when(v > g["best"], g["k"]).otherwise(g["n"]).alias("n")))
        return F.element_at(kept, 1)

    return F.aggregate(ps, start, step, lambda a: a["n"])


def expected_f_exact(pairs: DataFrame, miss: float = 0.0) -> DataFrame:
    return _keep_first(pairs, _listed(pairs).select("s1", best_count_exact(F.col("ps"), miss).alias("n_keep")))


def best_count_joint(ps: Column, most: int = 10) -> Column:
    """How many of the first ``most`` to keep when true positives and missed links both have their exact distributions; 0 is worth P(no link)."""
    head = F.slice(ps, 1, most)
    dist = lambda xs: F.aggregate(xs, F.array(F.lit(1.0)), _convolve)

    def value(k: Column) -> Column:
        inside, outside = dist(F.slice(ps, F.lit(1), k)), dist(F.slice(ps, k + 1, F.size(ps)))
        terms = F.transform(inside, lambda x, a: x * _sum(F.transform(outside, lambda y, b: y * F.lit(1 + B2) * a / (F.lit(B2) * (a + b) + k))))
        return _sum(terms)

    none = F.aggregate(ps, F.lit(1.0), lambda a, x: a * (F.lit(1.0) - x))
    start = F.struct(none.alias("best"), F.lit(0).alias("n"))
    values = F.transform(F.sequence(F.lit(1), F.size(head)), lambda k: F.struct(k.alias("k"), value(k).alias("v")))
    step = lambda a, x: F.when(x["v"] > a["best"] + 1e-12, F.struct(x["v"].alias("best"), x["k"].alias("n"))).otherwise(a)
    return F.aggregate(values, start, step, lambda a: a["n"])


def expected_f_joint(pairs: DataFrame, most: int = 10) -> DataFrame:
    return _keep_first(pairs, _listed(pairs).select("s1", best_count_joint(F.col("ps"), most).alias("n_keep")))


def decide_by_slice(pairs: DataFrame, params: DataFrame, base: dict[str, float]) -> DataFrame:
    """Log-odds adjustment by slice, then one entity per record over all slices, then each slice's threshold.

    pairs has ``slice``; params is a small table (slice, a, b, delta, threshold) whose nulls and missing rows inherit ``base``.
    """
    joined = pairs.join(params, "slice", "left")
    get = lambda c: F.coalesce(F.col(c), F.lit(float(base[c])))
    rows = joined.withColumns({c: get(c) for c in ("a", "b", "delta", "threshold")}).withColumn("p", affine_log_odds(F.col("p"), F.col("a"), F.col("b")))
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("cand").orderBy(F.desc("p"), "s1")))
    second = F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("p"))).over(Window.partitionBy("cand")), F.lit(0.0))
    kept = ranked.withColumn("second", second).where((F.col("rn") == 1) & (F.col("p") - F.col("second") >= F.col("delta")) & (F.col("p") >= F.col("threshold")))
    return kept.select("s1", "cand", "slice", "p")


def entity_scores(entities: DataFrame, truth: DataFrame, predicted: DataFrame, beta2: float = B2) -> DataFrame:
    """(s1, n_true, n_pred, tp, f) for every entity: no truth and no prediction is worth 1, one without the other 0."""
    pred = predicted.select("s1", "cand").distinct()
    true = truth.select("s1", "cand", F.lit(1).alias("y")).distinct()
    both = pred.join(true, ["s1", "cand"], "left").groupBy("s1").agg(F.count(F.lit(1)).alias("n_pred"), F.count("y").alias("tp"))
    count = true.groupBy("s1").agg(F.count(F.lit(1)).alias("n_true"))
    rows = entities.select("s1").distinct().join(count, "s1", "left").join(both, "s1", "left").na.fill(0, ["n_true", "n_pred", "tp"])
    part = F.lit(1 + beta2) * F.col("tp") / (F.lit(beta2) * F.col("n_true") + F.col("n_pred"))
    f = F.when((F.col("n_true") == 0) & (F.col("n_pred") == 0), 1.0).when((F.col("n_true") == 0) | (F.col("n_pred") == 0), 0.0).otherwise(part)
    return rows.withColumn("f", f)


def macro_f(scores: DataFrame) -> DataFrame:
    """(entities, f05, precision, recall): the mean of entity scores, and precision and recall over all pairs."""
    ratio = lambda a, b: F.round(F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double")), 6)
    return scores.agg(F.count(F.lit(1)).alias("entities"), F.round(F.avg("f"), 6).alias("f05"), ratio("tp", "n_pred").alias("precision"), ratio("tp", "n_true").alias("recall"))


def score_breakdown(scores: DataFrame) -> DataFrame:
    """(kind, entities, f05, mean_true, mean_pred) for entities with and without links."""
    kind = F.when(F.col("n_true") == 0, "singleton").otherwise("matched")
    return scores.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("entities"), *[F.round(F.avg(c), 6).alias(n) for c, n in (("f", "f05"), ("n_true", "mean_true"), ("n_pred", "mean_pred"))])


def rates(entities: DataFrame, predicted: DataFrame) -> DataFrame:
    """(slice, entities, singleton_rate, links_per_entity); entities is (s1, slice)."""
    count = predicted.groupBy("s1").agg(F.count(F.lit(1)).alias("n"))
    rows = entities.join(count, "s1", "left").na.fill(0, ["n"])
    return rows.groupBy("slice").agg(F.count(F.lit(1)).alias("entities"), F.round(F.avg((F.col("n") == 0).cast("double")), 6).alias("singleton_rate"), F.round(F.avg("n"), 6).alias("links_per_entity"))


def _f_value(n_true: Column, n_pred: Column, tp: Column) -> Column:
    part = F.lit(1 + B2) * tp / (F.lit(B2) * n_true + n_pred)
    return F.when((n_true == 0) & (n_pred == 0), 1.0).when((n_true == 0) | (n_pred == 0), 0.0).otherwise(part)


def _hits(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, x: a + x["y"])


def _entity_lists(rows: DataFrame, truth: DataFrame, entities: DataFrame, lists: dict[str, Column]) -> DataFrame:
    """(s1, n_true, one array per list): every entity's scored pairs, best first, as long as the candidates retrieval keeps; each struct has n = -p, cand and y."""
    true = truth.select("s1", "cand", F.lit(1).alias("y")).distinct()
    n_true = true.groupBy("s1").agg(F.count(F.lit(1)).alias("n_true"))
    marked = rows.join(true, ["s1", "cand"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    own = marked.groupBy("s1").agg(*[F.array_sort(F.collect_list(item)).alias(name) for name, item in lists.items()])
    out = entities.select("s1").distinct().join(n_true, "s1", "left").join(own, "s1", "left").na.fill(0, ["n_true"])
    return out.withColumns({name: F.coalesce(name, F.array()) for name in lists})


def _expected_count(items: Column, miss: Column) -> Column:
    """struct(n, tp) that expected_f keeps of a list."""
    total = F.aggregate(items, F.lit(0.0), lambda a, x: a - x["n"]) + miss
    empty = F.exp(F.aggregate(items, F.lit(0.0), lambda a, x: a + F.log1p(-F.least(-x["n"], F.lit(1 - 1e-12)))) - miss)
    start = F.struct(total.alias("total"), empty.alias("empty"), F.lit(0.0).alias("cum"), F.lit(0).alias("k"), F.lit(0).alias("seen"), F.lit(0.0).alias("best"), F.lit(0).alias("n"), F.lit(0).alias("tp"))

    def step(a: Column, x: Column) -> Column:
        cum, k, seen = a["cum"] - x["n"], a["k"] + 1, a["seen"] + x["y"]
        v = F.lit(1 + B2) * cum / (F.lit(B2) * a["total"] + k)
        pick = lambda new, old: F.when(v > a["best"], new).otherwise(a[old])
        return F.struct(a["total"].alias("total"), a["empty"].alias("empty"), cum.alias("cum"), k.alias("k"), seen.alias("seen"), pick(v, "best").alias("best"), pick(k, "n").alias("n"), pick(seen, "tp").alias("tp"))

    worth = lambda a, c: F.when(a["best"] > a["empty"], a[c]).otherwise(0)
    return F.aggregate(items, start, step, lambda a: F.struct(worth(a, "n").alias("n"), worth(a, "tp").alias("tp")))


def decision_grid(pairs: DataFrame, truth: DataFrame, entities: DataFrame, modes: tuple[str, ...], thresholds: tuple[float, ...], misses: tuple[float, ...] = (), exact: bool = False) -> DataFrame:
    """(mode, rule, value, f05) of every rule; entities is (s1), pairs are unique.

    One window over records serves all modes and one aggregate per entity holds its scored pairs, so the pairs are read and shuffled
    equally often for any grid: rules are evaluated on the lists, and only sums per rule are shuffled after that.
    """
    by = Window.partitionBy("cand")
    total = F.sum("p").over(by)
    ways = {"none": F.col("p"), "hard": F.when(F.row_number().over(by.orderBy(F.desc("p"), "s1")) == 1, F.col("p")), "soft": F.col("p") * F.col("p") / F.when(total > 0, total).otherwise(F.lit(1.0))}
    rows = pairs.select("s1", "cand", *[ways[m].alias(f"p_{m}") for m in modes])
    item = lambda m: F.when(F.col(f"p_{m}").isNotNull(), F.struct((-F.col(f"p_{m}")).alias("n"), "cand", "y"))
    per = _entity_lists(rows, truth, entities, {f"l_{m}": item(m) for m in modes})
    doubles = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    n_true = F.col("n_true")

    def cell(mode: str, rule: str, value: Column, kept: Column) -> Column:
        return F.struct(F.lit(mode).alias("mode"), F.lit(rule).alias("rule"), value.alias("value"), _f_value(n_true, kept["n"], kept["tp"]).alias("f"))

    counts = lambda kept: F.struct(F.size(kept).alias("n"), _hits(kept).alias("tp"))

    def rules(mode: str) -> list[Column]:
        own = F.col(f"l_{mode}")
        out = [F.transform(doubles(thresholds), lambda t: cell(mode, "threshold", t, counts(F.filter(own, lambda x: -x["n"] >= t))))]
        if misses:
            out.append(F.transform(doubles(misses), lambda m: cell(mode, "expected_f", m, _expected_count(own, m))))
        for miss in misses if exact else ():
            ps = F.transform(own, lambda x: -x["n"])
            out.append(F.array(cell(mode, "expected_f_exact", F.lit(float(miss)), counts(F.slice(own, F.lit(1), best_count_exact(ps, miss))))))
        return out

    cells = [c for mode in modes for c in rules(mode)]
    table = per.select("n_true", F.explode(F.concat(*cells)).alias("c")).select("c.*")
    return table.groupBy("mode", "rule", "value").agg(F.round(F.avg("f"), 6).alias("f05"))


def tune_rules(pairs: DataFrame, truth: DataFrame, entities: DataFrame, slopes: tuple[float, ...], shifts: tuple[float, ...], thresholds: tuple[float, ...], deltas: tuple[float, ...], least: float = 1e-3, most: int = 10) -> DataFrame:
    """(method, a, b, delta, t, f05): log-odds slopes by shifts under expected F, then thresholds, then leads (delta) for the best of these; t is 0 under expected F.

    A rising adjustment does not change which entity a record goes to, so records are given away once and every rule reads the same lists
    of won pairs. Equal values go to the earlier rule. The driver holds one row per rule.
    """
    by = Window.partitionBy("cand")
    rows = pairs.where(F.col("p") >= least).withColumn("rn", F.row_number().over(by.orderBy(F.desc("p"), "s1")))
    rows = rows.withColumn("second", F.max(F.when(F.col("rn") == 2, F.col("p"))).over(by)).where("rn = 1").select("s1", "cand", "p", "second")
    per = _entity_lists(rows, truth, entities, {"items": F.struct((-F.col("p")).alias("n"), "cand", "second", "y")})

    def evaluate(rules: list[tuple]) -> DataFrame:
        grid = F.array(*[F.struct(F.lit(m).alias("method"), *[F.lit(float(v)).alias(c) for c, v in zip("a b delta t".split(), r, strict=True)]) for m, *r in rules])
        each = per.select("n_true", "items", F.explode(grid).alias("r")).select("n_true", "items", "r.*")
        adjust = lambda p: affine_log_odds(p, F.col("a"), F.col("b"))
        lead = lambda x: adjust(-x["n"]) - F.when(x["second"].isNull(), 0.0).otherwise(adjust(x["second"]))
        each = each.withColumn("items", F.filter("items", lambda x: lead(x) >= F.col("delta")))
        each = each.withColumn("ps", F.transform("items", lambda x: adjust(-x["n"])))
        by_f = F.when(F.size("ps") == 0, 0).otherwise(best_count_joint(F.col("ps"), most))
        each = each.withColumn("n", F.when(F.col("method") == "ef", by_f).otherwise(F.size(F.filter("ps", lambda p: p >= F.col("t")))))
        f = _f_value(F.col("n_true"), F.col("n"), _hits(F.slice("items", F.lit(1), F.col("n"))))
        return each.groupBy("method", "a", "b", "delta", "t").agg(F.round(F.avg(f), 6).alias("f05"))

    rules = [("ef", a, b, 0.0, 0.0) for a in slopes for b in shifts] + [("thr", 1.0, 0.0, 0.0, t) for t in thresholds]
    first = evaluate(rules)
    found = {tuple(r)[:5]: r["f05"] for r in first.collect()}  # one row per rule
    method, a, b, _, t = max(rules, key=lambda r: found[r])
    table = pairs.sparkSession.createDataFrame([(*r, found[r]) for r in rules], first.schema)
    return table.unionByName(evaluate([(method, a, b, d, t) for d in deltas])) if deltas else table


def parse_rule(spec: str) -> tuple[str | None, str, str, float]:
    """"assign:select:value" or "slice=assign:select:value" as (slice or None, assign, select, value)."""
    slice_, _, rule = spec.rpartition("=")
    parts = rule.split(":")
    if len(parts) != 3 or parts[1] not in ("threshold", "expected_f", "expected_f_exact"):
        raise ValueError(f"{spec!r} is not assign:select:value")
    return slice_ or None, parts[0], parts[1], float(parts[2])


def redecide(pairs: DataFrame, specs: tuple[str, ...]) -> DataFrame:
    """(s1, cand, slice): pairs (s1, cand, slice, p) assigned once by the default rule over all slices, then selected by each slice's own rule."""
    rules = {r[0]: r[1:] for r in map(parse_rule, specs)}
    if None not in rules:
        raise ValueError("one rule without a slice is the default")
    select = {"threshold": select_threshold, "expected_f": expected_f, "expected_f_exact": expected_f_exact}
    assigned = assign(pairs, rules[None][0])
    own = F.coalesce("slice", F.lit("")).isin(*[k for k in rules if k])
    out = None
    for name, (_, how, value) in rules.items():
        part = select[how](assigned.where(~own if name is None else F.col("slice") == name), value).select("s1", "cand", "slice")
        out = part if out is None else out.unionByName(part)
    return out


def output_summary(lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rows, with_matches, singletons, singleton_rate, mean_matches, outside): one row about lists (s1, matched ids joined by commas) and the candidate pairs they must come from; null and empty lists hold nothing."""
    ids = F.filter(F.split(F.coalesce("ids", F.lit("")), ","), lambda x: x != "")
    rows = lists.select("s1", ids.alias("ids"))
    bad = rows.select("s1", F.explode("ids").alias("cand")).join(pairs.select("s1", "cand"), ["s1", "cand"], "left_anti").select("s1").distinct()
    n = F.size("ids")
    found = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(n > 0).alias("with_matches"), F.count_if(n == 0).alias("singletons"), F.round(F.avg((n == 0).cast("double")), 6).alias("singleton_rate"), F.round(F.avg(n), 6).alias("mean_matches"))
    return found.crossJoin(bad.agg(F.count(F.lit(1)).alias("outside")))  # one row each
