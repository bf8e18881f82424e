"""Removal of repeated runs of lines by a suffix array over line ids, built by distributed prefix doubling (native).

Lines with content get ids; a document is a sequence of ids, and documents are numbered in their order. A line that occurs once ends every
repeated run, so only suffixes that start at a repeated line are sorted, each up to the next line that occurs once:

1. Doubling. The rank by 2k lines is the place of the pair (rank by k lines here, ranks k places on) in a range-partitioned sort of the
   distinct pairs. A suffix keeps its ranks of all rounds, its ladder, and leaves the rounds when its rank is its own or its lines are
   at an end; equal ladders are then equal suffixes, and ladders order suffixes as a suffix array does.
2. Common prefixes. Neighbours in the array share as many rungs of their ladders as powers of two fit in their common prefix; the rest of it is
   found by going down the rungs at the places behind. The longest run that starts at a suffix and repeats anywhere is the larger of the
   common prefixes with its two neighbours (the whole suffix, if it has an equal).
3. Intervals. A run is maximal unless the one that starts a line before holds it. Suffixes that agree in their first ``min_lines`` lines are an
   interval of the array, found by two ranks that together span so many lines; its first place (in order of document and line) is the first copy.
4. Every copy but the first goes, of every repeated run of ``min_lines`` or more lines, and with ``long_words`` also of a single line of at
   least so many words (its single spaces and one); the runs of exactly so many lines cover all longer ones. Copies of a document's own lines never take lines of
   a first copy that recurs in it (``a b a b a`` leaves ``a b a``), so a first copy loses only lines with a still earlier copy in another document. The
   lines that go count as one run from where a maximal repeated run starts, or from a line that stays, to the next such place.

Pairs and ranks are combined before they are shuffled, copies are intervals and never listed pair by pair, and ranks return by plain inner
joins whose large partitions Spark splits, so a line that a third of the rows share is no hot spot. Text moves once, in the join at the end,
and is put together again in time linear in its lines.

Defined results: null text counts as empty; lines of spaces only have no id and always stay; equal rows (doc_id and text) count as one
document and get the same result; documents of one doc_id are ordered by a hash of their text; a null doc_id comes after all others; an
empty table gives no rows; other columns are kept (names starting with ``__line`` are used inside).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.common import stored

PART_BITS = 33  # monotonically_increasing_id counts within a partition in so many bits
ROUND_BITS, ROUNDS = 58, 31  # ranks of different rounds differ


def _sequences(documents: DataFrame, long_words: int | None) -> DataFrame:
    """(d, doc, form, n_raw, ids): the distinct documents, numbered in their order, and their lines with content."""
    text = F.coalesce("text", F.lit(""))
    spaces = lambda x: F.octet_length(F.trim(x)) - F.octet_length(F.replace(F.trim(x), F.lit(" "), F.lit("")))
    long = lambda x: F.lit(False) if long_words is None else spaces(x) >= long_words - 1
    ids = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("raw"), F.xxhash64(x).alias("a"), F.hash(x).alias("b"), (F.trim(x) != "").alias("filled"), long(x).alias("long")))
    docs = documents.select(F.col("doc_id").alias("doc"), F.xxhash64(text).alias("form"), ids.alias("lines"))
    docs = docs.select("doc", "form", F.size("lines").alias("n_raw"), F.filter("lines", lambda x: x["filled"]).alias("ids"))
    ordered = docs.dropDuplicates(["doc", "form"]).orderBy(F.col("doc").isNull(), "doc", "form")
    return stored(ordered.withColumn("d", F.monotonically_increasing_id()), "sequences")


def _repeated(sequences: DataFrame) -> DataFrame:
    """(d, pos, left, long_at, path): places of repeated lines, the lines up to one that occurs once, the next long line, and the rank by one line."""
    lines = sequences.select("d", F.posexplode("ids").alias("pos", "x")).select("d", "pos", "x.a", "x.b", "x.long")
    same = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("a", "b").select("a", "b", F.monotonically_increasing_id().alias("r"))
    places = lines.join(same, ["a", "b"]).select("d", "pos", "long", "r")
    forth, back = Window.partitionBy("d").orderBy("pos"), Window.partitionBy("d").orderBy(F.desc("pos"))
    isle = places.withColumn("isle", F.col("pos") - F.row_number().over(forth))
    left = F.max("pos").over(Window.partitionBy("d", "isle")) - F.col("pos") + 1
    long_at = F.min(F.when(F.col("long"), F.col("pos"))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    return stored(isle.select("d", "pos", left.alias("left"), long_at.alias("long_at"), F.array("r").alias("path")), "ranks")


def _ladders(ranks: DataFrame) -> DataFrame:
    """The suffixes with their ranks by 1, 2, 4, ... lines; each round moves only those that share their rank and go on."""
    ranks = ranks.withColumn("open", F.col("left") > 1)
    for k in range(ROUNDS):
        ahead = 1 << k
        there = ranks.select("d", (F.col("pos") - ahead).alias("pos"), F.col("path").alias("b"))
        moving = stored(ranks.where("open").join(there, ["d", "pos"]).withColumn("a", F.element_at("path", -1)), "moving")
        if moving.isEmpty():
            return ranks.drop("open")
        rank = F.monotonically_increasing_id() + (k + 1 << ROUND_BITS)
        order = moving.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).orderBy("a", "b").select("a", "b", "n", rank.alias("r"))
        moved = moving.join(order, ["a", "b"]).select("d", "pos", "left", "long_at", F.array_append("path", F.col("r")).alias("path"), ((F.col("n") > 1) & (F.col("left") > 2 * ahead)).alias("open"))
        ranks = stored(moved.unionByName(ranks.where("not open")), "ranks")
    raise RuntimeError(f"a repeated run of more than 2 ** {ROUNDS} lines")


def _classes(ranks: DataFrame) -> DataFrame:
    """A row for each distinct suffix: its place at in the array, its rank r, its first place (d, pos), its copies n, left and path."""
    own = F.element_at("path", -1)
    classes = ranks.groupBy(own.alias("r")).agg(F.min(F.struct("d", "pos")).alias("p"), F.count(F.lit(1)).alias("n"), F.first("left").alias("left"), F.first("path").alias("path"))
    classes = stored(classes.orderBy("path").withColumn("number", F.monotonically_increasing_id()), "array")
    part, inner = F.shiftright("number", PART_BITS), F.col("number").bitwiseAND((1 << PART_BITS) - 1)
    sizes = sorted((r.part, r.n) for r in classes.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition of a sort
    begins = [(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)]
    begin = F.broadcast(classes.sparkSession.createDataFrame(begins, "part long, begin long"))
    return classes.join(begin, part == begin["part"]).select((F.col("begin") + inner).alias("at"), "r", "p.d", "p.pos", "n", "left", "path")


def _common(array: DataFrame, ranks: DataFrame) -> DataFrame:
    """(at, lcp): the common prefix of the suffix at this place and the next, where they have one."""
    here, there = array.alias("x"), array.alias("y")
    pairs = here.join(there, F.col("x.at") + 1 == F.col("y.at")).select(
        "x.at", F.col("x.d").alias("xd"), F.col("x.pos").alias("xp"), F.col("x.left").alias("xl"), F.col("y.d").alias("yd"), F.col("y.pos").alias("yp"), F.col("y.left").alias("yl"),
        F.size(F.filter(F.zip_with("x.path", "y.path", lambda a, b: a == b), lambda e: e)).alias("rungs"),
    )
    pairs = stored(pairs.where("rungs > 0").withColumn("lcp", F.expr("shiftleft(1L, rungs - 1)")), "pairs")
    most = pairs.agg(F.max("rungs")).first()[0] or 0
    for k in range(most - 2, -1, -1):
        rung = ranks.where(F.size("path") > k).select("d", "pos", F.get("path", k).alias("rung"))  # a place without it shares no such prefix
        a, b = rung.toDF("xd", "xq", "a"), rung.toDF("yd", "yq", "b")
        going = (F.col("rungs") > k + 1) & (F.col("xl") > F.col("lcp")) & (F.col("yl") > F.col("lcp"))
        nowhere = -1 - F.col("at")  # pairs that are done meet nothing, each at a place of its own
        pairs = pairs.withColumn("xq", F.when(going, F.col("xp") + F.col("lcp")).otherwise(nowhere)).withColumn("yq", F.when(going, F.col("yp") + F.col("lcp")).otherwise(nowhere))
        pairs = pairs.join(a, ["xd", "xq"], "left").join(b, ["yd", "yq"], "left").withColumn("lcp", F.col("lcp") + F.when(F.col("a") == F.col("b"), 1 << k).otherwise(0)).drop("xq", "yq", "a", "b")
        if k % 4 == 0:
            pairs = stored(pairs, "pairs")
    return pairs.select("at", "lcp")


def maximal_runs(ranks: DataFrame, min_lines: int, long_words: int | None = None) -> DataFrame:
    """(d, pos, run): the maximal repeated runs, each place with the length of its run."""
    array = _classes(ranks)
    common = _common(array, ranks)
    both = common.unionByName(common.select((F.col("at") + 1).alias("at"), "lcp")).groupBy("at").agg(F.max("lcp").alias("lcp"))
    longest = F.greatest(F.coalesce("lcp", F.lit(0)), F.when(F.col("n") > 1, F.col("left")).otherwise(0)).cast("long")
    runs = array.join(both, "at", "left").select("r", longest.alias("run"))
    suffixes = ranks.select("d", "pos", "long_at", F.element_at("path", -1).alias("r")).join(runs, "r")
    enough = F.col("run") >= min_lines
    if long_words is not None:
        enough = enough | F.coalesce(F.col("long_at") < F.col("pos") + F.col("run"), F.lit(False))
    before = Window.partitionBy("d").orderBy("pos")
    held = (F.lag("pos").over(before) == F.col("pos") - 1) & (F.lag("run").over(before) == F.col("run") + 1)
    return suffixes.where(enough).withColumn("held", F.coalesce(held, F.lit(False))).where("not held").select("d", "pos", "run")


def _later(ranks: DataFrame, span: int) -> DataFrame:
    """(d, pos, first): the places of runs of exactly ``span`` lines that have an earlier copy, and the place of the first."""
    k = span.bit_length() - 1
    behind = span - (1 << k)
    rung = ranks.where(F.size("path") > k).select("d", "pos", "left", F.get("path", k).alias("x"))
    rows = rung.where(F.col("left") >= span)
    if behind:
        rows = rows.join(rung.select("d", (F.col("pos") - behind).alias("pos"), F.col("x").alias("y")), ["d", "pos"])
    else:
        rows = rows.withColumn("y", F.col("x"))
    rows = rows.select("d", "pos", "x", "y")
    first = rows.groupBy("x", "y").agg(F.min(F.struct("d", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return stored(rows.join(first, ["x", "y"]).where(F.struct("d", "pos") > F.col("first")).select("d", "pos", "first"), "later")


def later_copies(documents: DataFrame, min_lines: int = 2, long_words: int | None = None) -> DataFrame:
    """(doc, form, n_runs, n_removed, keep): for each document that loses lines the number of maximal runs, of lines, and for each line whether it stays."""
    sequences = _sequences(documents, long_words)
    ranks = _ladders(_repeated(sequences))
    later = _later(ranks, min_lines)
    edge = lambda rows, side, sign, kind: rows.select("d", F.col(side).cast("long").alias("at"), *[F.lit(sign if k == kind else 0).alias(k) for k in ("copy", "own", "stay", "start")])
    edges = edge(maximal_runs(ranks, min_lines, long_words), "pos", 1, "start")
    spans = [
        (later.where("first.d <> d"), min_lines, "copy"),
        (later.where("first.d = d"), min_lines, "own"),
        (later.where("first.d = d").select("d", F.col("first.pos").alias("pos")).distinct(), min_lines, "stay"),
    ]
    if long_words is not None:
        spans.append((_later(ranks.where("long_at = pos"), 1), 1, "copy"))
    for rows, span, kind in spans:
        edges = edges.unionByName(edge(rows, "pos", 1, kind)).unionByName(edge(rows.withColumn("end", F.col("pos") + span), "end", -1, kind))
    edges = edges.groupBy("d", "at").agg(*[F.sum(k).alias(k) for k in ("copy", "own", "stay", "start")])
    along = Window.partitionBy("d").orderBy("at")
    until = along.rowsBetween(Window.unboundedPreceding, 0)
    goes = (F.sum("copy").over(until) > 0) | ((F.sum("own").over(until) > 0) & (F.sum("stay").over(until) == 0))
    parts = edges.select("d", "at", "start", goes.alias("goes"), F.lead("at").over(along).alias("end"))
    opens = F.when((F.col("start") > 0) | ~F.coalesce(F.lag("goes").over(along), F.lit(False)), 1).otherwise(0)
    parts = parts.withColumn("opens", opens).where("goes").groupBy("d").agg(F.sum("opens").alias("n_runs"), F.array_sort(F.collect_list(F.struct("at", "end"))).alias("parts"))
    raws = F.flatten(F.transform("parts", lambda p: F.transform(F.slice("ids", (p["at"] + 1).cast("int"), (p["end"] - p["at"]).cast("int")), lambda x: x["raw"])))
    found = sequences.join(parts, "d").select("doc", "form", "n_runs", "n_raw", raws.alias("raws"))
    gaps = F.flatten(F.transform("raws", lambda r, i: F.concat(F.array_repeat(F.lit(True), (r - F.coalesce(F.get("raws", i - 1), F.lit(-1)) - 1).cast("int")), F.array(F.lit(False)))))
    rest = F.array_repeat(F.lit(True), (F.col("n_raw") - 1 - F.element_at("raws", -1)).cast("int"))
    return found.select("doc", "form", "n_runs", F.size("raws").cast("long").alias("n_removed"), F.concat(gaps, rest).alias("keep"))


def remove_repeated_lines(documents: DataFrame, min_lines: int = 2, long_words: int | None = None) -> DataFrame:
    """The documents with the later copies gone from text, and ``__line_n``, ``__line_removed`` and ``__line_runs``: lines with content, removed lines, and their maximal runs: where a maximal repeated run starts, or the line before stays."""
    gone = later_copies(documents, min_lines, long_words)
    gone = gone.withColumnsRenamed({"doc": "__line_doc", "form": "__line_form", "n_runs": "__line_runs", "n_removed": "__line_removed", "keep": "__line_keep"})
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.withColumn("__line_own", F.xxhash64(text))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("__line_doc")) & (F.col("__line_own") == F.col("__line_form")), "left")
    all_lines = F.split(text, "\n")
    kept = F.array_join(F.filter(all_lines, lambda x, i: F.get("__line_keep", i)), "\n")
    counts = {
        "__line_n": F.size(F.filter(all_lines, lambda x: F.trim(x) != "")).cast("long"),
        "__line_removed": F.coalesce("__line_removed", F.lit(0)).cast("long"),
        "__line_runs": F.coalesce("__line_runs", F.lit(0)).cast("long"),
    }
    done = rows.withColumns(counts).withColumn("text", F.when(F.col("__line_keep").isNull(), F.col("text")).otherwise(kept))
    return done.drop("__line_own", "__line_doc", "__line_form", "__line_keep")
