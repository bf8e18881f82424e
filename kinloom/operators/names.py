"""Name variants: Latin spelling, aliases, appended websites, letters behind digits and words run together in domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions.text import NAME_STOPWORDS, SUFFIX_CANON, collapse_letters, fold_accents, leet, name_tokens, tokens
from kinloom.operators.learned import segment
from kinloom.operators.transliteration import transliterate

# What stands before a name, between its aliases and after it.
JUNK = r"^[^\p{L}\p{N}]+"
MESSRS = r"(?i)^\s*m/s\.?\s+"
ALIAS = r"(?i)\s+(?:d\.?\s?b\.?\s?a\.?|a\.?k\.?a\.?|t/a|trading\s+as)\s+"
SITE = r"(?i)\s*\|\s*(?:https?://)?(?:www\.)?([a-z0-9\-]+)\.[a-z]{2,4}\S*\s*$"
OWN_DOMAIN = r"^(?:www\.)?([a-z0-9\-]+)\.com$"

WIDE = "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F)) + "　 "
NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + "  "
LEGAL = tuple(dict.fromkeys(SUFFIX_CANON.values()))
DOMAIN_FLAG, ALIAS_FLAG, LEET_FLAG, NATIVE_FLAG, MIXED_FLAG = 1, 2, 4, 8, 16


def tidy(name: Column) -> Column:
    """Full-width characters as plain ones, no leading marks, no M/s. Null gives ""."""
    out = F.trim(F.translate(F.coalesce(name, F.lit("")), WIDE, NARROW))
    return F.trim(F.regexp_replace(F.regexp_replace(out, JUNK, ""), MESSRS, ""))


def _canon(found: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SUFFIX_CANON.items() for x in kv])
    return F.transform(found, lambda t: F.coalesce(F.try_element_at(table, t), t))


def _join(found: Column) -> Column:
    return F.array_join(found, " ")


def name_variants(records: DataFrame, dictionary: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """(id, core, full, key, squeezed, legal, alt, flags, oov, n_core, shown) for records (id, name); ids are unique.

    The name, its aliases and its website are read as texts of their own. dictionary (token, latin) spells Indic words, costs (word, cost)
    splits domains; without costs a domain is one word. ``alt`` holds the other readings, first seen first, joined by "|"; flags add up
    1 domain, 2 aliases, 4 digits for letters, 8 Indic words, 16 some but not all words Indic; oov is the share of Indic words outside the
    dictionary. Null and empty names give empty texts and zeros.
    """
    own = records.select("id", tidy(F.col("name")).alias("text"))
    spelled = own.join(transliterate(own, dictionary), "id")
    # spelling splits at spaces, so names without Indic words keep their own form
    rows = spelled.withColumn("latin", F.when(F.col("n_native") > 0, F.col("latin")).otherwise(F.col("text")))
    rows = rows.withColumn("site", F.regexp_extract("latin", SITE, 1)).withColumn("latin", F.regexp_replace("latin", SITE, ""))
    parts = F.filter(F.split("latin", ALIAS), lambda p: F.trim(p) != "")
    rows = rows.withColumn("parts", F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>")))
    site = F.when(F.col("site") != "", F.array(F.concat("site", F.lit(".com")))).otherwise(F.array().cast("array<string>"))
    texts = rows.select("id", F.posexplode(F.concat(F.array("latin"), "parts", site)).alias("i", "part"))
    stem = F.replace(F.regexp_extract(F.replace(F.trim(F.lower(fold_accents(F.col("part")))), F.lit(" "), F.lit("")), OWN_DOMAIN, 1), F.lit("-"), F.lit(""))
    texts = texts.withColumn("stem", F.when(stem != "", leet(stem)))
    if costs is None:
        texts = texts.withColumn("words", F.array("stem"))
    else:
        stems = texts.where("stem is not null").select(F.col("stem").alias("id"), F.col("stem").alias("text")).distinct()
        split = segment(stems, costs).select(F.col("id").alias("stem"), collapse_letters(tokens(F.col("words"))).alias("words"))
        texts = texts.join(split, "stem", "left")
    is_domain = F.col("stem").isNotNull()
    plain = name_tokens(F.col("part"))
    texts = texts.withColumn("raw", _canon(plain)).withColumn("whole", _canon(F.when(is_domain, F.col("words")).otherwise(F.transform(plain, leet))))
    known = lambda t: t.isin(*LEGAL)
    bare = F.filter("whole", lambda t: ~t.isin(*NAME_STOPWORDS))
    core = F.filter(bare, lambda t: ~known(t))
    texts = texts.withColumn("core", F.when(F.size(core) > 0, core).when(F.size(bare) > 0, bare).otherwise(F.col("whole")))
    plain_core = F.filter("raw", lambda t: ~known(t) & ~t.isin(*NAME_STOPWORDS))
    texts = texts.withColumn("variant", _join(F.col("core"))).withColumn("second", F.when(~is_domain, _join(F.when(F.size(plain_core) > 0, plain_core).otherwise(F.col("raw")))))
    texts = texts.withColumn("second", F.when(F.col("second") != F.col("variant"), F.col("second")))
    read = F.array_sort(F.collect_list(F.struct("i", "variant", "second", "whole", "core", is_domain.alias("domain"))))
    found = texts.groupBy("id").agg(read.alias("v")).withColumn("first", F.col("v")[0]).join(rows.select("id", "text", "latin", "parts", "n_native", "n_unknown"), "id")
    others = F.flatten(F.transform("v", lambda x: F.array(x["variant"], x["second"])))
    alt = F.array_distinct(F.filter(others, lambda x: x.isNotNull() & (x != "") & (x != F.col("first.variant"))))
    bit = lambda test, flag: F.when(test, flag).otherwise(0)
    native = F.col("n_native") > 0
    flags = bit(F.col("first.domain"), DOMAIN_FLAG) + bit(F.size("parts") > 1, ALIAS_FLAG) + bit(F.exists("v", lambda x: x["second"].isNotNull()), LEET_FLAG) + bit(native, NATIVE_FLAG)
    flags = flags + bit(native & (F.col("n_native") < F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))), MIXED_FLAG)
    return found.select(
        "id",
        F.col("first.variant").alias("core"),
        _join(F.col("first.whole")).alias("full"),
        _join(F.array_sort(F.array_distinct("first.core"))).alias("key"),
        F.array_join("first.core", "").alias("squeezed"),
        _join(F.array_sort(F.array_distinct(F.filter("first.whole", known)))).alias("legal"),
        F.array_join(alt, "|").alias("alt"),
        flags.alias("flags"),
        F.when(native, F.col("n_unknown") / F.col("n_native")).otherwise(0.0).alias("oov"),
        F.size("first.core").alias("n_core"),
        F.when(native, F.concat(F.lower("latin"), F.lit(" ("), "text", F.lit(")"))).otherwise(F.lower(fold_accents(F.col("text")))).alias("shown"),
    )
