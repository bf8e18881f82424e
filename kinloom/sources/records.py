"""Readers and writers of linkage data, and the record view over the driver's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_COLUMNS = ("entity_id", "business_name", "business_address", "country")
STRINGS = T.StructType([T.StructField(c, T.StringType()) for c in RECORD_COLUMNS])


def read_source(spark: SparkSession, path: str, quoted: bool = False, columns: tuple[str, ...] = RECORD_COLUMNS) -> DataFrame:
    """A tab-separated source with a header: all columns strings, empty cells "", missing columns an error. Quoting is off unless asked for."""
    header = spark.read.csv(path, sep="\t", header=True, quote='"' if quoted else "", inferSchema=False).columns
    missing = [c for c in columns if c not in header]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = spark.read.csv(path, sep="\t", header=True, quote='"' if quoted else "", schema=schema, enforceSchema=False)
    return rows.select(*columns).na.fill("")


def build_records(sources: dict[int, DataFrame]) -> DataFrame:
    """The sources in one relation with the tag ``src``. The string id stays the key: a dense number would need a global sort."""
    out = None
    for number, rows in sources.items():
        part = rows.select("entity_id", F.lit(number).alias("src"), F.col("business_name").alias("name"), F.col("business_address").alias("addr"), "country")
        out = part if out is None else out.unionByName(part)
    return out.na.fill("", ["name", "addr", "country"])


def explode_truth(truth: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """(s1, cand) from lists of ids (source1_entity_id, matched_entity_ids); ``keep`` limits the entities by its column s1."""
    rows = truth.select(F.col("source1_entity_id").alias("s1"), F.explode(F.split(F.coalesce("matched_entity_ids", F.lit("")), ",")).alias("cand"))
    rows = rows.withColumn("cand", F.trim("cand")).where("cand <> ''").distinct()
    return rows if keep is None else rows.join(keep.select("s1").distinct(), "s1", "left_semi")


def records_by_id(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")


def sample_entities(entities: DataFrame, n: int, seed: int = 42, key: str = "entity_id") -> DataFrame:
    """The n entities with the smallest hashes: a larger n with the same seed holds a smaller one's."""
    return entities.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), key)), key).limit(n)


def id_lists(entities: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """(source1_entity_id, name): one row per entity, with its distinct ids sorted and joined by commas, "" for none."""
    lists = pairs.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set("cand")), ",").alias(name))
    own = entities.select(F.col("entity_id").alias("s1")).distinct()
    return own.join(lists, "s1", "left").select(F.col("s1").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def gather(pairs: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """pairs with the columns of the record that ``key`` names (records has a unique column of that name). A pair whose record is missing ends the job instead of vanishing."""
    found = pairs.join(records.withColumn("__found", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no record for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return found.withColumn(key, F.when(F.col("__found"), F.col(key)).otherwise(missing)).drop("__found")


def pack_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, links): every text once as (id, text), and the pairs without texts. pairs is (a, b, text_a, text_b, ...); an id has one text, of several the smallest."""
    both = pairs.select(F.col("a").alias("id"), F.col("text_a").alias("text")).unionByName(pairs.select(F.col("b").alias("id"), F.col("text_b").alias("text")))
    return both.groupBy("id").agg(F.min("text").alias("text")), pairs.drop("text_a", "text_b")


def unpack_pairs(texts: DataFrame, links: DataFrame) -> DataFrame:
    side = lambda s: texts.select(F.col("id").alias(s), F.col("text").alias(f"text_{s}"))
    return links.join(side("a"), "a", "left").join(side("b"), "b", "left")


def write_lists(lists: DataFrame, path: str) -> None:
    """Tab-separated, without quotes, sorted by entity."""
    lists.orderBy("source1_entity_id").write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="")


def fingerprint(pairs: DataFrame) -> DataFrame:
    """A checksum of pairs that does not depend on their order: (n, checksum)."""
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("s1", "cand").cast("decimal(38,0)")).alias("checksum"))


def validate_lists(matches: DataFrame, candidates: DataFrame | None, entities: DataFrame, known: DataFrame | None = None, prefixes: tuple[str, ...] = ("S2-", "S3-")) -> DataFrame:
    """(rule, n): the number of violations of each rule of a submission, as read from its file (source1_entity_id, matched_entity_ids)."""
    ids = F.split(F.coalesce("matched_entity_ids", F.lit("")), ",")
    rows = matches.select(F.col("source1_entity_id").alias("s1"), F.coalesce("matched_entity_ids", F.lit("")).alias("list"))
    cells = matches.select(F.col("source1_entity_id").alias("s1"), F.explode(ids).alias("cand")).where("cand <> ''")
    own = entities.select(F.col("entity_id").alias("s1")).distinct()
    rules = [
        ("malformed_row", rows.where("s1 is null or s1 = '' or list like '%\t%'")),
        ("duplicate_entity", rows.groupBy("s1").count().where("count > 1")),
        ("duplicate_id_in_list", cells.groupBy("s1", "cand").count().where("count > 1")),
        ("self_match", cells.where(F.col("cand").startswith("S1-"))),
        ("wrong_prefix", cells.where(~F.col("cand").startswith("S1-") & ~F.expr(" or ".join(f"startswith(cand, '{p}')" for p in prefixes)))),
        ("missing_entity", own.join(rows.select("s1").distinct(), "s1", "left_anti")),
        ("unknown_entity", rows.select("s1").distinct().join(own, "s1", "left_anti")),
    ]
    if known is not None:
        rules.append(("unknown_id", cells.join(known.select(F.col("entity_id").alias("cand")).distinct(), "cand", "left_anti")))
    if candidates is not None:
        rules.append(("not_a_candidate", cells.select("s1", "cand").distinct().join(candidates.select("s1", "cand").distinct(), ["s1", "cand"], "left_anti")))
    out = None
    for rule, bad in rules:
        count = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = count if out is None else out.unionByName(count)
    return out


def validate_lines(spark: SparkSession, path: str, header: tuple[str, ...] = ("source1_entity_id", "matched_entity_ids")) -> DataFrame:
    """(rule, n) of a file before it is parsed: empty_file, comma_file (a header with commas and no tab), bad_header, malformed_row (text, but no tab).

    A file with a wrong header is not read further, so its rows count no violations.
    """
    lines = spark.read.text(path)
    first = lines.head(1)
    top = first[0].value if first else ""
    names = tuple(c.strip().lower() for c in top.split("\t"))
    comma = "\t" not in top and "," in top
    bad = bool(first) and not comma and names != header
    rows = lines.where(F.trim(F.split("value", "\t")[0]) != "").where(~F.col("value").contains("\t")) if first and not comma and not bad else lines.limit(0)
    flags = spark.createDataFrame([("empty_file", int(not first)), ("comma_file", int(comma)), ("bad_header", int(bad))], "rule string, n long")
    return flags.unionByName(rows.agg(F.lit("malformed_row").alias("rule"), F.count(F.lit(1)).alias("n")))


# ---- the driver's documents as records --------------------------------------------------------------------------


def er_view(documents: DataFrame) -> DataFrame:
    """(entity_id, doc_id, src, country, name, addr, form): the first copy of most texts is an S1 record, everything else S2 or S3.

    First copies come from an aggregate by digest, so a text that a third of the rows share is combined before the shuffle.
    """
    docs = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("country"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", "country", F.md5("text").alias("form"), F.split("text", "\n", 3).alias("lines"))
    docs = docs.select("doc_id", "country", "form", F.get("lines", 0).alias("name"), F.coalesce(F.get("lines", 1), F.lit("")).alias("addr"))
    first = docs.groupBy("form").agg(F.min("doc_id").alias("first"))
    is_s1 = (F.col("doc_id") == F.col("first")) & (F.col("doc_id") % 4 != 0)
    rows = docs.join(first, "form").withColumn("src", F.when(is_s1, 1).otherwise(2 + F.col("doc_id") % 2).cast("int"))
    entity = F.concat(F.lit("S"), F.col("src").cast("string"), F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return rows.select(entity.alias("entity_id"), "doc_id", "src", "country", "name", "addr", "form")


def er_truth(records: DataFrame) -> DataFrame:
    """(s1, cand): S1 records and the other records with the same text."""
    s1 = records.where("src = 1").select(F.col("entity_id").alias("s1"), "form")
    return s1.join(records.where("src <> 1").select(F.col("entity_id").alias("cand"), "form"), "form").select("s1", "cand")
