"""Chat formatting over reply trees (native).

Messages form trees: (conv_id, node_id, parent_id, role, text, score). Root-to-leaf paths are enumerated by self-joins on
ancestor links that double in length each round, so a path of n messages takes about log2(n) rounds and no text moves until the
paths are chosen. Links that are still there when they are longer than any conversation lie above a ring of messages; the smallest message of
each ring then loses its parent. Paths are ranked within a conversation by their mean score, then by length and leaf; each chosen path becomes
one formatted conversation with the spans of its assistant texts.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each message. Inside roles and texts a backslash is doubled and ``<|``
becomes ``<\\|`` (in roles, a newline becomes ``<\\n``); so a marker in the output is always a real one, and unescaping gives the
input back exactly.

Defined results: the smallest message of a ring of parents is a root; of rows that share a node_id the least by parent, role and text is the
message, and rows without node_id are left out; a parent that does not exist makes a root; null role or text counts as empty; null score as 0; a null conv_id is a conversation of its own (all rows whose
conv_id is null); rows of the same turn are ordered by role and text; an empty table gives no rows; columns other than those named
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def chain_messages(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as reply trees without branches: each row answers the row before it."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select("conv_id", place.alias("node_id"), "role", "text").select(
        "conv_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score")
    )


def _on(left: DataFrame, right: DataFrame, a: str, b: str) -> Column:
    return left["conv_id"].eqNullSafe(right["conv_id"]) & (left[a] == right[b])


def distinct_messages(messages: DataFrame) -> DataFrame:
    """One row for each node_id of a conversation."""
    rows = messages.where("node_id is not null").groupBy("conv_id", "node_id").agg(F.min(F.struct("parent_id", "role", "text", "score")).alias("m"))
    return rows.select("conv_id", "node_id", "m.parent_id", "m.role", "m.text", "m.score")


def _doubled(links: DataFrame, *carried: Column) -> DataFrame:
    """Links (conv_id, down, up) joined with themselves."""
    lower, upper = links.alias("lower"), links.withColumnsRenamed({"down": "mid", "up": "top"}).alias("upper")
    on = F.col("lower.conv_id").eqNullSafe(F.col("upper.conv_id")) & (F.col("lower.up") == F.col("upper.mid"))
    return lower.join(upper, on).select("lower.conv_id", "lower.down", F.col("upper.top").alias("up"), *carried)


def _without_rings(links: DataFrame, most: int) -> DataFrame:
    """The links, each at most one for a message, without that of the smallest message of each ring. Links that were doubled until they are longer than a conversation end on rings, and on every message of one."""
    far, step = links.withColumn("least", F.least("down", "up")), 1
    while step <= most:
        far, step = stored(_doubled(far, F.least("lower.least", "upper.least").alias("least")), "far"), step * 2
    rings = far.select("conv_id", F.col("up").alias("node_id")).distinct()
    first = far.join(rings, _on(far, rings, "down", "node_id"), "left_semi").where("down = least").select("conv_id", "down")
    return stored(links.join(first, _on(links, first, "down", "down"), "left_anti"), "links")


def reply_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """The top-ranked root-to-leaf paths of each conversation: (conv_id, path_rank, leaf, node_id, place), place from 0 at the root. A node_id is one message of its conversation."""
    nodes = messages.select("conv_id", "node_id", "parent_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    links = nodes.where("parent_id is not null").select("conv_id", F.col("node_id").alias("down"), F.col("parent_id").alias("up"))
    links = stored(links.join(nodes.select("conv_id", "node_id"), _on(links, nodes, "up", "node_id"), "left_semi"), "links")
    most, far, step = links.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0, links, 1
    rounds = [links]
    while not far.isEmpty():
        if step > most:
            links = _without_rings(links, most)
            far, step, rounds, most = links, 1, [links], 2**62
            continue
        far, step = stored(_doubled(far), "far"), step * 2
        rounds.append(far)
    parents = links.select("conv_id", F.col("up").alias("node_id")).distinct()
    leaves = nodes.join(parents, _on(nodes, parents, "node_id", "node_id"), "left_anti")
    paths = leaves.select("conv_id", F.col("node_id").alias("leaf"), "node_id", F.lit(0).cast("long").alias("height"))
    for k, far in enumerate(rounds[:-1]):  # after round k, paths reach 2 ** (k + 1) - 1 messages up
        up = paths.join(far, _on(paths, far, "node_id", "down")).select(paths["conv_id"], "leaf", F.col("up").alias("node_id"), (F.col("height") + (1 << k)).alias("height"))
        paths = stored(paths.unionByName(up), "paths")
    scored = paths.join(nodes, _on(paths, nodes, "node_id", "node_id")).select(paths["conv_id"], "leaf", paths["node_id"], "height", "score")
    branches = scored.groupBy("conv_id", "leaf").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))
    best = [F.desc("mean"), F.desc("n"), F.asc("leaf")]
    salt = F.pmod(F.xxhash64("leaf"), F.lit(64))  # a conversation may have very many branches: rank within salts first
    branches = branches.withColumn("salt", salt)
    branches = branches.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "salt").orderBy(*best))).where(F.col("rank") <= top)
    chosen = branches.withColumn("path_rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(*best))).where(F.col("path_rank") <= top)
    chosen = chosen.select(F.col("conv_id").alias("c"), F.col("leaf").alias("l"), "path_rank", "n")
    on = paths["conv_id"].eqNullSafe(chosen["c"]) & (paths["leaf"] == chosen["l"])
    return paths.join(chosen, on).select("conv_id", "path_rank", "leaf", "node_id", (F.col("n") - 1 - F.col("height")).alias("place"))


def format_conversations(messages: DataFrame, top: int = 1, learn_from: tuple[str, ...] = ("assistant",), distinct: bool = False) -> DataFrame:
    """One row per chosen path: (conv_id, path_rank, leaf, formatted, loss_spans), spans as (start, length) in code points of formatted. ``distinct`` says that no node_id is repeated or null."""
    messages = messages.select("conv_id", "node_id", "parent_id", "role", "text", "score")
    messages = stored(messages if distinct else distinct_messages(messages), "messages")
    paths = reply_paths(messages, top)
    on = paths["conv_id"].eqNullSafe(messages["conv_id"]) & (paths["node_id"] == messages["node_id"])
    turns = paths.join(messages, on).select(
        paths["conv_id"],
        "path_rank",
        "leaf",
        "place",
        F.coalesce("role", F.lit("")).isin(*learn_from).alias("learn"),
        F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n")).alias("head"),
        escape(F.coalesce("text", F.lit(""))).alias("body"),
    )
    length = F.length("head") + F.length("body") + F.lit(len(END))
    before = Window.partitionBy("conv_id", "path_rank", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(length).over(before), F.lit(0)) + F.length("head"))
    parts = F.array_sort(F.collect_list(F.struct("place", F.concat("head", "body", F.lit(END)).alias("part"))))
    spans = F.array_sort(F.collect_list(F.when(F.col("learn"), F.struct(F.col("start"), F.length("body").cast("long").alias("length")))))
    grouped = turns.groupBy("conv_id", "path_rank", "leaf").agg(parts.alias("parts"), spans.alias("loss_spans"))
    return grouped.select("conv_id", "path_rank", "leaf", F.concat_ws("", F.col("parts.part")).alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses formatted conversations: (conv_id, path_rank, leaf, chars, turns array of (role, text), loss string), from the strings and spans alone.

    Each string is cut at its markers once, and a span is read from the piece that it lies in, so the time is linear in the text."""
    key = ["conv_id", "path_rank", "leaf"]
    pieces = formatted.select(*key, F.length("formatted").cast("long").alias("chars"), F.posexplode(F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 2**30)).alias("i", "piece"))
    end = F.sum(F.length("piece") + F.lit(len(START))).over(Window.partitionBy(*key).orderBy("i"))
    pieces = pieces.select(*key, "chars", "i", "piece", (end - F.length("piece")).alias("at"), F.lit(None).cast("long").alias("length"))
    spans = formatted.select(*key, F.explode("loss_spans").alias("s")).select(*key, F.col("s.start").cast("long").alias("at"), F.col("s.length").cast("long").alias("length"))
    along = Window.partitionBy(*key).orderBy("at", F.col("length").isNotNull())
    both = pieces.unionByName(spans, allowMissingColumns=True)
    both = both.withColumn("own", F.last("piece", ignorenulls=True).over(along)).withColumn("own_at", F.last(F.when(F.col("length").isNull(), F.col("at")), ignorenulls=True).over(along))
    role = unescape_role(F.substring_index("piece", "\n", 1))
    text = unescape(F.substring_index(F.substring(F.col("piece"), F.locate("\n", F.col("piece")) + 1, F.length("piece")), "<|im_end|>", 1))
    learnt = unescape(F.substring(F.col("own"), (F.col("at") - F.col("own_at") + 1).cast("int"), F.col("length").cast("int")))
    is_span = F.col("length").isNotNull()
    grouped = both.groupBy(*key).agg(
        F.max("chars").alias("chars"),
        F.array_sort(F.collect_list(F.when(~is_span, F.struct("i", role.alias("role"), text.alias("text"))))).alias("turns"),
        F.array_sort(F.collect_list(F.when(is_span, F.struct("at", learnt.alias("text"))))).alias("loss"),
    )
    return grouped.select(*key, "chars", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), F.concat_ws("", F.col("loss.text")).alias("loss"))
