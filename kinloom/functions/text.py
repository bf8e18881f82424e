"""Normalisation of business names and addresses, as Catalyst expressions.

Everything here is built-in functions, so it runs inside whole-stage code generation or, for array lambdas, on the JVM. Punctuation is
``[^\\p{L}\\p{N}_\\s]``: letters, numbers and underscores stay, and vowel signs of Indic scripts go, as with Unicode-aware ``\\w`` in
most regex engines outside Java.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms and function words dropped from the core of a name.
LEGAL_SUFFIXES = (
    "corp", "corporation", "inc", "incorporated", "co", "company", "ltd", "limited", "llc", "llp", "lp", "plc",
    "pvt", "private", "pte", "gmbh", "ag", "nv", "bv", "sa", "sas", "sarl", "srl", "spa", "ab", "oy", "as", "kk",
    "sasu", "eurl", "sci", "snc", "scop", "scm", "selarl",
    "and", "the", "of", "de", "du", "des", "la", "le", "les", "et", "aux", "au",
)

# Abbreviations of addresses.
ADDRESS_ABBREVIATIONS = {
    "rd": "road", "st": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane",
    "ct": "court", "pl": "place", "sq": "square", "hwy": "highway", "pkwy": "parkway", "ste": "suite", "apt": "apartment",
    "fl": "floor", "bldg": "building", "opp": "opposite", "nr": "near", "jn": "junction", "mkt": "market", "clny": "colony",
    "sec": "sector", "n": "north", "s": "south", "e": "east", "w": "west", "mt": "mount", "ft": "fort", "pk": "park",
    "bd": "boulevard", "bvd": "boulevard", "rte": "route", "imp": "impasse", "fbg": "faubourg", "res": "residence", "bat": "batiment",
}

# Words of addresses that tell little.
ADDRESS_STOPWORDS = (
    "near", "opposite", "behind", "beside", "next", "to", "at", "in", "on", "the", "of", "and", "no", "number",
    "de", "du", "des", "le", "la", "les", "et", "au", "aux", "chez", "sur",
)

# Legal classes by their words, in order of precedence.
LEGAL_CLASSES = (
    (("llc",), "LLC"), (("llp", "elelpi"), "LLP"), (("inc", "incorporated"), "INC"), (("corp", "corporation"), "CORP"),
    (("plc",), "PLC"), (("lp",), "LP"), (("sarl",), "SARL"), (("sas",), "SAS"), (("sasu",), "SASU"), (("eurl",), "EURL"),
    (("sci",), "SCI"), (("snc",), "SNC"), (("gmbh",), "GMBH"),
)
PRIVATE_WORDS = ("pvt", "private", "praivet", "prayvet", "privet", "piraivet")
LIMITED_WORDS = ("ltd", "limited", "limitet", "limted")
TRANSLITERATED_LEGAL = ("praivet", "prayvet", "privet", "piraivet", "limitet", "limited", "limted", "elelpi", "pvt", "ltd", "llp", "inc", "llc", "corp", "co")

# Blocks of Indic scripts, in the order of their code points.
SCRIPTS = (
    ("devanagari", 0x0900), ("bengali", 0x0980), ("gurmukhi", 0x0A00), ("gujarati", 0x0A80), ("oriya", 0x0B00),
    ("tamil", 0x0B80), ("telugu", 0x0C00), ("kannada", 0x0C80), ("malayalam", 0x0D00),
)
DOMAIN = r"(?i)^\W*(?:www\.)?([a-z0-9][a-z0-9\-]*)\.(?:com|in|net|org|co|fr|biz|info|us)\s*$"


def _fold_table() -> tuple[str, str]:
    """Latin letters whose compatibility decomposition is one ASCII letter and marks."""
    pairs = []
    for point in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base != chr(point):
            pairs.append((chr(point), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _fold_table()


def fold_accents(text: Column) -> Column:
    """Latin letters without their marks, and free-standing combining marks dropped."""
    return F.regexp_replace(F.translate(text, FOLD_FROM, FOLD_TO), "[̀-ͯ]", "")


def words(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


def clean(text: Column) -> Column:
    """Lower case, no accents, no possessives, & as a word, punctuation as spaces, single spaces. Null and "nan" give ""."""
    out = F.coalesce(text, F.lit(""))
    out = F.when(F.lower(out) == "nan", F.lit("")).otherwise(fold_accents(F.lower(out)))
    out = F.regexp_replace(out, r"['’]s\b", "")
    out = F.regexp_replace(F.replace(out, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def tokens(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, " "), lambda t: t != "")


def _or_whole(kept: Column, whole: Column) -> Column:
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(whole)


def core_name(name: Column) -> Column:
    """The cleaned name without legal forms and function words; the whole cleaned name if nothing is left."""
    cleaned = clean(name)
    return _or_whole(F.filter(tokens(cleaned), lambda t: ~t.isin(*LEGAL_SUFFIXES)), cleaned)


def norm_addr(addr: Column) -> Column:
    """The cleaned address with abbreviations written out."""
    table = F.create_map(*[F.lit(x) for kv in ADDRESS_ABBREVIATIONS.items() for x in kv])
    return F.array_join(F.transform(tokens(clean(addr)), lambda t: F.coalesce(F.try_element_at(table, t), t)), " ")


def core_addr(addr: Column) -> Column:
    full = norm_addr(addr)
    return _or_whole(F.filter(tokens(full), lambda t: ~t.isin(*ADDRESS_STOPWORDS)), full)


def blob(name: Column, addr: Column) -> Column:
    return F.trim(F.concat(core_name(name), F.lit(" "), core_addr(addr)))


def numeric_tokens(text: Column) -> Column:
    """The distinct runs of digits of the raw text."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\p{Nd}+)"), F.lit(1)))


def acronym(name: Column) -> Column:
    return F.array_join(F.transform(tokens(core_name(name)), lambda t: F.left(t, F.lit(1))), "")


def first_number(addr: Column) -> Column:
    return F.regexp_extract(F.coalesce(addr, F.lit("")), r"(\p{Nd}+)", 1)


def domain_stem(text: Column) -> Column:
    """'delta-trade.com' -> 'deltatrade'; '' if the text is no domain."""
    return F.replace(F.lower(F.regexp_extract(F.trim(fold_accents(F.coalesce(text, F.lit("")))), DOMAIN, 1)), F.lit("-"), F.lit(""))


def legal_form(name: Column) -> Column:
    """The canonical legal class of a name, '' for none."""
    own = tokens(clean(name))
    has = lambda keys: F.arrays_overlap(own, words(*keys))
    out = F.when(has(PRIVATE_WORDS) & has(LIMITED_WORDS), "PVT_LTD")
    for keys, name_of in LEGAL_CLASSES:
        out = out.when(has(keys), name_of)
    return out.when(has(LIMITED_WORDS), "LTD").otherwise("")


def is_native_script(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"[^\x{0}-\x{24F}]")


def script_class(text: Column) -> Column:
    """empty, the Indic script of the first Indic character, domain, other-nonlatin or latin."""
    own = F.coalesce(text, F.lit(""))
    point = F.ascii(F.regexp_extract(own, "([ऀ-ൿ])", 1))
    out = F.when(F.trim(own) == "", "empty")
    for name, start in SCRIPTS:
        out = out.when((point >= start) & (point < start + 0x80), name)
    return out.when(domain_stem(own) != "", "domain").when(is_native_script(own), "other-nonlatin").otherwise("latin")


def skeleton(core: Column) -> Column:
    """The consonants of a Latin name: phonetic spellings made equal, vowels after the first letter of a word and doubled letters dropped."""
    out = F.regexp_replace(F.lower(core), "[^a-z ]", "")
    out = F.regexp_replace(out, r"\by(?=[aeiou])", "")
    out = F.regexp_replace(out, "(?<=[aeiou])gh", "")
    for old, new in (("ction", "ksn"), ("tion", "sn"), ("ph", "f"), ("th", "t"), ("kh", "k"), ("sh", "s"), ("ch", "s"), ("ck", "k")):
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, r"c(?=[aoukrlt]|\b)", "k")
    out = F.translate(F.regexp_replace(out, "m(?=[^aeiou ])", "n"), "gbdvzjcq", "kptwsssk")
    out = F.trim(F.regexp_replace(out, " +", " "))
    return F.regexp_replace(F.regexp_replace(out, "(?<=[a-z])[aeiouy]+", ""), r"(.)\1+", "$1")


def translit_core(name: Column) -> Column:
    """The core of a Latin name without legal words, or the stem of a domain. Other scripts need translit dictionaries (operators/learned.py)."""
    stem, kept = domain_stem(name), F.filter(tokens(core_name(name)), lambda t: ~t.isin(*TRANSLITERATED_LEGAL))
    return F.when(stem != "", stem).otherwise(F.array_join(kept, " "))


def record_forms(records) -> Column:
    """The records with every normalised form that pair features need, computed once per record."""
    with_forms = records.withColumns(
        {
            "name_clean": clean(F.col("name")),
            "core_name": core_name(F.col("name")),
            "norm_addr": norm_addr(F.col("addr")),
            "core_addr": core_addr(F.col("addr")),
            "acronym": acronym(F.col("name")),
            "name_nums": numeric_tokens(F.col("name")),
            "addr_nums": numeric_tokens(F.col("addr")),
            "tl_core": translit_core(F.col("name")),
            "legal": legal_form(F.col("name")),
            "house": first_number(F.col("addr")),
            "stem": domain_stem(F.col("name")),
            "native": is_native_script(F.col("name")),
        }
    )
    return with_forms.withColumn("skel", skeleton(F.col("tl_core"))).withColumn("addr_empty", F.trim(F.coalesce("addr", F.lit(""))) == "")


# ---- second normaliser: token level -------------------------------------------------------------------------------

# Canonical legal forms.
SUFFIX_CANON = {
    "corporation": "corp", "corp": "corp", "incorporated": "inc", "inc": "inc", "company": "co", "co": "co", "compagnie": "co", "cie": "co",
    "limited": "ltd", "ltd": "ltd", "private": "pvt", "pvt": "pvt", "pte": "pvt", "llc": "llc", "pllc": "pllc", "llp": "llp", "lp": "lp",
    "plc": "plc", "pc": "pc", "sarl": "sarl", "sas": "sas", "sasu": "sasu", "sa": "sa", "sci": "sci", "snc": "snc", "eurl": "eurl",
}
NAME_STOPWORDS = ("and", "of", "the", "de", "des", "du", "la", "le", "les", "d", "l", "et", "a")
LEET_FROM, LEET_TO = "01568", "olsgb"


def collapse_letters(found: Column) -> Column:
    """Runs of single letters become one word: p l l c -> pllc."""
    single = lambda t: (F.length(t) == 1) & t.rlike(r"^\p{L}$")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("run"))
    closed = lambda a: F.when(a["run"] != "", F.concat(a["out"], F.array(a["run"]))).otherwise(a["out"])
    step = lambda a, t: F.when(single(t), F.struct(a["out"].alias("out"), F.concat(a["run"], t).alias("run"))).otherwise(
        F.struct(F.concat(closed(a), F.array(t)).alias("out"), F.lit("").alias("run"))
    )
    return F.aggregate(found, start, step, closed)


def leet(token: Column) -> Column:
    """Digits that stand for letters, in words that mix both and are no ordinals."""
    plain = token.rlike(r"^\d+(st|nd|rd|th)$") | token.rlike(r"^\p{Nd}+$") | token.rlike(r"^\p{L}+$")
    return F.when(plain, token).otherwise(F.translate(token, LEET_FROM, LEET_TO))


def name_tokens(name: Column) -> Column:
    """Latin words of a name: no accents or apostrophes, & and + as words, single letters joined."""
    out = F.replace(F.replace(F.lower(fold_accents(F.coalesce(name, F.lit("")))), F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and "))
    out = F.regexp_replace(F.regexp_replace(out, "['’`´]", ""), r"[^\p{L}\p{N}\s]", " ")
    return collapse_letters(tokens(F.trim(F.regexp_replace(out, r"\s+", " "))))


def bind(value: Column, use) -> Column:
    """use(value) with value evaluated once, however often ``use`` refers to it: Catalyst repeats a plain subexpression inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def canonical_name(name: Column) -> Column:
    """struct(full, core, key, legal): canonical words; those that are neither legal forms nor stop words; these sorted and distinct; the legal forms."""
    canon = F.create_map(*[F.lit(x) for kv in SUFFIX_CANON.items() for x in kv])
    legal = tuple(dict.fromkeys(SUFFIX_CANON.values()))

    def forms(full: Column, core: Column) -> Column:
        own = F.array_sort(F.array_distinct(F.filter(full, lambda t: t.isin(*legal))))
        return F.struct(
            F.array_join(full, " ").alias("full"), F.array_join(core, " ").alias("core"), F.array_join(F.array_sort(F.array_distinct(core)), " ").alias("key"), F.array_join(own, " ").alias("legal")
        )

    def chosen(full: Column, bare: Column) -> Column:
        core = F.filter(bare, lambda t: ~t.isin(*legal))
        return bind(core, lambda c: bind(F.when(F.size(c) > 0, c).when(F.size(bare) > 0, bare).otherwise(full), lambda kept: forms(full, kept)))

    words_of = F.transform(F.transform(name_tokens(name), leet), lambda t: F.coalesce(F.try_element_at(canon, t), t))
    return bind(words_of, lambda full: bind(F.filter(full, lambda t: ~t.isin(*NAME_STOPWORDS)), lambda bare: chosen(full, bare)))
