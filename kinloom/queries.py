"""Every query of the library over the driver's tables, and the same in DuckDB's SQL (kinloom/oracles.py).

The documents serve as records of three sources (sources/records.py): name and address are a text's first two lines, and texts that
are equal are true pairs. Pairs are the ten best TF-IDF candidates of each S1 record with a made-up but fixed probability.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import similarity, text
from kinloom.operators import addresses, context, decision, diagnostics, features, learned, names, retrieval, sampling, transliteration
from kinloom.oracles import ORACLES  # noqa: F401
from kinloom.sources import records

QUERIES: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def er(spark: SparkSession, sf: str) -> DataFrame:
    return records.er_view(table(spark, sf, "documents"))


def s1_of(rows: DataFrame) -> DataFrame:
    return rows.where("src = 1")


def pool_of(rows: DataFrame) -> DataFrame:
    return rows.where("src <> 1")


def as_texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("entity_id").alias("id"), F.col("country").alias("part"), F.concat_ws(" ", "name", "addr").alias("text"))


def candidates(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    rows = er(spark, sf)
    return retrieval.tfidf_top_k(as_texts(s1_of(rows)), as_texts(pool_of(rows)), k, retrieval.word_tokens(F.col("text")))


def number(entity: str):
    return F.substring(entity, 4, 20).cast("long")


def with_p(pairs: DataFrame) -> DataFrame:
    p = ((number("s1") * F.lit(2654435761) + number("cand") * F.lit(40503)) % 10007 + F.lit(0.5)) / F.lit(10007.0)
    return pairs.withColumn("p", p)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return with_p(candidates(spark, sf))


def with_record(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs with the candidate's source, country, core name as key and house number."""
    own = rows.select(F.col("entity_id").alias("cand"), "src", "country", text.core_name(F.col("name")).alias("key"), text.first_number(F.col("addr")).alias("house"))
    return pairs.join(own, "cand")


def r6(column):
    return F.round(column, 6)


# ---- records and text -------------------------------------------------------------------------------------------


@query
def er_view(spark, sf):
    return er(spark, sf).select("entity_id", "src", "country", "name", "addr")


@query
def gt_explode(spark, sf):
    rows = er(spark, sf)
    lists = records.id_lists(s1_of(rows), records.er_truth(rows), "matched_entity_ids")
    return records.explode_truth(lists)


@query
def submission_lists(spark, sf):
    rows = er(spark, sf)
    return records.id_lists(s1_of(rows), candidates(spark, sf).where("rank <= 3").select("s1", "cand"), "matched_entity_ids")


@query
def validator_report(spark, sf):
    rows = er(spark, sf)
    own, found = s1_of(rows), candidates(spark, sf)
    lists = records.id_lists(own, found.where("rank <= 2"), "matched_entity_ids")
    # violations on purpose: a repeated entity, a repeated id, a self match, a bad prefix, an unknown entity, an entity without a list
    bad = spark.createDataFrame([("S1-x", "S2-1,S2-1"), ("S1-x", "S1-9"), ("S1-y", "Q-1"), ("", "S2-00000002")], "source1_entity_id string, matched_entity_ids string")
    entities = own.select("entity_id").unionByName(spark.createDataFrame([("S1-z",)], "entity_id string"))
    return records.validate_lists(lists.unionByName(bad), found.where("rank <= 1"), entities, pool_of(rows))


@query
def sample_nested(spark, sf):
    return records.sample_entities(s1_of(er(spark, sf)).select("entity_id"), 50)


@query
def records_by_id(spark, sf):
    rows = er(spark, sf)
    return records.records_by_id(rows, candidates(spark, sf).where("rank = 1").select(F.col("cand").alias("entity_id"))).select("entity_id", "src", "name")


@query
def clean_text(spark, sf):
    return er(spark, sf).select("entity_id", text.clean(F.col("name")).alias("name_clean"), text.clean(F.col("addr")).alias("addr_clean"))


@query
def core_tokens(spark, sf):
    n, a = F.col("name"), F.col("addr")
    return er(spark, sf).select("entity_id", text.core_name(n).alias("core_name"), text.norm_addr(a).alias("norm_addr"), text.core_addr(a).alias("core_addr"), text.blob(n, a).alias("blob"))


@query
def numeric_tokens(spark, sf):
    body = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(text.numeric_tokens(body)), ",").alias("numbers"), text.first_number(body).alias("first_number"))


@query
def legal_form(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.legal_form(F.col("text")).alias("legal"))


@query
def acronym(spark, sf):
    return er(spark, sf).select("entity_id", text.acronym(F.col("name")).alias("acronym"))


@query
def script_class(spark, sf):
    return er(spark, sf).groupBy(text.script_class(F.col("name")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


@query
def domain_stem(spark, sf):
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return table(spark, sf, "pages").select("page_id", text.domain_stem(host).alias("stem"))


@query
def skeleton(spark, sf):
    return er(spark, sf).select("entity_id", text.skeleton(text.translit_core(F.col("name"))).alias("skel"))


@query
def canonical_names(spark, sf):
    return er(spark, sf).select("entity_id", text.canonical_name(F.col("name")).alias("n")).select("entity_id", "n.*")


@query
def name_variants(spark, sf):
    """Names dressed by source: a title in front, an alias with digits for letters, a website behind; French ones of source 2 are domains."""
    first = F.element_at(F.split(F.lower("name"), "[^a-z]+"), 1)
    dressed = (
        F.when(F.col("src") == 1, F.concat(F.lit("* M/s. "), "name"))
        .when((F.col("src") == 2) & (F.col("country") == "fr"), F.concat(first, F.lit("-online.com")))
        .when(F.col("src") == 2, F.concat(first, F.lit(" Ltd d.b.a. "), F.translate("name", "ol", "01")))
        .otherwise(F.concat("name", F.lit(" | https://www."), first, F.lit("-shop.com/x")))
    )
    own = er(spark, sf).select(F.col("entity_id").alias("id"), dressed.alias("name"))
    return names.name_variants(own, spark.createDataFrame([], "token string, latin string, n long"))


@query
def collapse_letters(spark, sf):
    return er(spark, sf).select("entity_id", F.array_join(text.name_tokens(F.col("name")), " ").alias("words"))


@query
def parse_address(spark, sf):
    sample = spark.createDataFrame([(-1, "No. 12-4, 3rd Main Rd, Near Park, Bangalore, KA 560001", "India"), (-2, "0045 W Oak St Apt 7B, Springfield, IL 62704", "US"), (-3, "12 bis r de la Paix, 59000 Lille", "France")], "id long, addr string, country string")
    rows = er(spark, sf).select(F.col("doc_id").alias("id"), "addr", "country").unionByName(sample)
    return addresses.parse_addresses(rows)


# ---- retrieval ----------------------------------------------------------------------------------------------------


@query
def token_df(spark, sf):
    return retrieval.document_frequency(retrieval.token_counts(as_texts(pool_of(er(spark, sf))), retrieval.word_tokens(F.col("text"))), ("part",))


@query
def tfidf_weights(spark, sf):
    pool = as_texts(pool_of(er(spark, sf)))
    counts = retrieval.token_counts(pool, retrieval.word_tokens(F.col("text")))
    return retrieval.tfidf_weights(counts, retrieval.idf_table(pool, counts)).select("id", "token", F.round("w", 9).alias("w"))


@query
def tfidf_topk(spark, sf):
    return candidates(spark, sf)


@query
def tfidf_reverse_topk(spark, sf):
    rows = er(spark, sf)
    return retrieval.tfidf_top_k(as_texts(s1_of(rows)), as_texts(pool_of(rows)), 5, retrieval.word_tokens(F.col("text")), reverse=True)


def names_only(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("entity_id").alias("id"), F.col("country").alias("part"), F.col("name").alias("text"))


def gram_candidates(spark, sf, k=5):
    rows = er(spark, sf)
    return retrieval.tfidf_top_k(names_only(s1_of(rows)), names_only(pool_of(rows)), k, retrieval.char_grams(F.col("text")), max_df=0.05)


@query
def char_trigram_topk(spark, sf):
    return gram_candidates(spark, sf)


def keyed(rows: DataFrame) -> DataFrame:
    core, addr = text.core_name(F.col("name")), text.core_addr(F.col("addr"))
    return rows.select(F.col("entity_id").alias("id"), F.col("country").alias("part"), core.alias("k_name"), addr.alias("k_addr"), text.acronym(F.col("name")).alias("k_acronym"))


@query
def exact_key_block(spark, sf):
    rows = er(spark, sf)
    return retrieval.exact_key_pairs(keyed(s1_of(rows)), keyed(pool_of(rows)), {"k_name": 1, "k_addr": 2, "k_acronym": 4}, cap=300)


@query
def key_pool_cap(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("key"), F.col("p_brand").alias("part"))
    return retrieval.pool_cap(parts, ("part", "key"), 4)


def sibling_key(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("entity_id").alias("id"), F.col("country").alias("part"), F.substring_index(text.core_name(F.col("name")), " ", 2).alias("key"))


def siblings(spark, sf):
    return retrieval.sibling_pairs(candidates(spark, sf), sibling_key(pool_of(er(spark, sf))), top=3, cap=50)


@query
def sibling_expand(spark, sf):
    return siblings(spark, sf)


@query
def direct_key_lookup(spark, sf):
    rows = er(spark, sf)
    return retrieval.direct_key_pairs(sibling_key(s1_of(rows)), sibling_key(pool_of(rows)), cap=50)


def united(spark, sf):
    rows = er(spark, sf)
    back = retrieval.tfidf_top_k(as_texts(s1_of(rows)), as_texts(pool_of(rows)), 5, retrieval.word_tokens(F.col("text")), reverse=True)
    return retrieval.union_blockers({"a": candidates(spark, sf), "b": gram_candidates(spark, sf), "r": back})


@query
def blocker_union(spark, sf):
    return united(spark, sf)


@query
def extras_antijoin(spark, sf):
    return retrieval.extras(siblings(spark, sf), candidates(spark, sf))


@query
def fill_similarity(spark, sf):
    rows = er(spark, sf)
    pool, own = as_texts(pool_of(rows)), as_texts(s1_of(rows))
    counts = retrieval.token_counts(pool, retrieval.word_tokens(F.col("text")))
    idf = retrieval.idf_table(pool, counts)
    weights = retrieval.tfidf_weights(retrieval.token_counts(own, retrieval.word_tokens(F.col("text"))), idf)
    new = retrieval.extras(siblings(spark, sf), candidates(spark, sf))
    return retrieval.keep_best(retrieval.fill_similarity(new, weights, retrieval.tfidf_weights(counts, idf)), 3)


@query
def recall_at_k(spark, sf):
    return retrieval.recall_at(candidates(spark, sf), records.er_truth(er(spark, sf)), (1, 2, 5, 10))


@query
def recall_by_country(spark, sf):
    rows = er(spark, sf)
    return retrieval.recall_by(candidates(spark, sf), records.er_truth(rows), s1_of(rows).select(F.col("entity_id").alias("s1"), F.col("country").alias("slice")), 5)


@query
def pass_marginal_recall(spark, sf):
    return retrieval.marginal_recall(united(spark, sf), records.er_truth(er(spark, sf)), ("a", "b", "r"))


@query
def orphans(spark, sf):
    return retrieval.orphans(s1_of(er(spark, sf)).select(F.col("entity_id").alias("id")), candidates(spark, sf))


@query
def recall_ceiling(spark, sf):
    rows = retrieval.recall_at(candidates(spark, sf), records.er_truth(er(spark, sf)), (1, 10))
    return rows.select("k", r6(retrieval.ceiling(F.col("recall"))).alias("ceiling"))


@query
def embedding_knn(spark, sf):
    return retrieval.dense_top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, 5)


# ---- pair features --------------------------------------------------------------------------------------------------


def pair_frame(spark, sf):
    rows = text.record_forms(er(spark, sf))
    return candidates(spark, sf).where("rank <= 5").select("s1", "cand", "block_sim"), s1_of(rows), pool_of(rows)


@query
def pair_features_sets(spark, sf):
    out = features.pair_features(*pair_frame(spark, sf), kernels=False).drop("skel_eq", "either_native")
    return out.select("s1", "cand", "block_sim", *[r6(F.col(c)).alias(c) for c in out.columns[3:]])


@query
def pair_features_v1(spark, sf):
    return features.pair_features(*pair_frame(spark, sf))


@query
def levenshtein_feats(spark, sf):
    pairs, s1, pool = pair_frame(spark, sf)
    rows = features.with_records(pairs, s1, pool, ("core_name",))
    a, b = F.col("l_core_name"), F.col("r_core_name")
    longest = F.greatest(F.length(a), F.length(b))
    d = F.levenshtein(a, b)
    return rows.select("s1", "cand", d.cast("long").alias("lev"), r6(F.when(longest == 0, 1.0).otherwise(1 - d / F.when(longest == 0, 1).otherwise(longest))).alias("lev_sim"))


@query
def jaro_winkler(spark, sf):
    pairs, s1, pool = pair_frame(spark, sf)
    rows = features.with_records(pairs, s1, pool, ("acronym",))
    return rows.select("s1", "cand", r6(similarity.kernel("jw")(F.col("l_acronym"), F.col("r_acronym"))).alias("jw"))


@query
def token_sort_ratio(spark, sf):
    pairs, s1, pool = pair_frame(spark, sf)
    rows = features.with_records(pairs, s1, pool, ("core_name",))
    args = (F.col("l_core_name"), F.col("r_core_name"))
    return rows.select("s1", "cand", *[r6(similarity.kernel(k)(*args)).alias(k) for k in ("ratio", "token_sort", "token_set", "partial")])


@query
def set_kernel(spark, sf):
    out = features.set_details(*pair_frame(spark, sf))
    return out.select("s1", "cand", *[F.col(c).cast("long").alias(c) for c in ("inter", "size_a", "size_b")], *[r6(F.col(c)).alias(c) for c in ("jacc", "cont_a", "cont_b")])


@query
def idf_overlap(spark, sf):
    return features.idf_overlap(*pair_frame(spark, sf))


@query
def name_frequency(spark, sf):
    return features.frequency_features(*pair_frame(spark, sf))


@query
def number_features(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("a"), F.col("o_custkey").cast("string").alias("b"))
    return rows.select("o_orderkey", similarity.number_difference(F.col("a"), F.col("b")).alias("d")).select("o_orderkey", r6(F.col("d.log_gap")).alias("log_gap"), r6(F.col("d.relative_gap")).alias("relative_gap"), F.col("d.is_prefix"))


@query
def best_variant(spark, sf):
    rows = er(spark, sf)
    both = lambda r, name: r.select(F.col("entity_id").alias(name), F.explode(F.array_distinct(F.array(text.core_name(F.col("name")), text.core_addr(F.col("addr"))))).alias("variant"))
    jac = lambda a, b: r6(similarity.jaccard(F.array_distinct(text.tokens(a)), F.array_distinct(text.tokens(b))))
    pairs = candidates(spark, sf).where("rank <= 3")
    return features.best_variant(pairs, both(s1_of(rows), "s1"), both(pool_of(rows), "cand"), jac)


@query
def rank_features(spark, sf):
    out = context.rank_features(candidates(spark, sf).select("s1", "cand", "block_sim"), "block_sim")
    return out.select("s1", "cand", "rank_in_entity", "max_in_entity", F.round("gap_to_best", 9).alias("gap_to_best"), "n_candidates", "is_best")


# ---- context --------------------------------------------------------------------------------------------------------


@query
def claims(spark, sf):
    return context.claims(scored(spark, sf).select("s1", "cand", "p")).withColumn("claim_gap", r6(F.col("claim_gap"))).drop("p")


@query
def entity_shape(spark, sf):
    out = context.entity_shape(scored(spark, sf).select("s1", "cand", "p"))
    return out.select("s1", "cand", "p_rank", *[r6(F.col(c)).alias(c) for c in ("p_gap", "sum_p", "p_second", "p_share")], "n_candidates", "n_strong")


@query
def best_other_margin(spark, sf):
    return context.best_other(scored(spark, sf).select("s1", "cand", "p")).select("s1", "cand", r6(F.col("best_other")).alias("best_other"), r6(F.col("margin")).alias("margin"))


@query
def gang(spark, sf):
    pairs = with_record(scored(spark, sf), er(spark, sf)).withColumn("key", F.left("key", F.lit(2)))
    return context.gang(pairs.select("s1", "cand", "p", "key"), "key").select("s1", "cand", "gang_n", r6(F.col("gang_max")).alias("gang_max"))


@query
def twins(spark, sf):
    pairs = with_record(scored(spark, sf), er(spark, sf)).withColumn("key", F.left("key", F.lit(1))).withColumn("house", (number("cand") % 3).cast("string"))
    return context.twins(pairs.select("s1", "cand", "p", "key", "house"), "key", "house").select("s1", "cand", "twin_n", "twin_flag", r6(F.col("twin_gap")).alias("twin_gap"))


@query
def agreement(spark, sf):
    pairs = with_record(scored(spark, sf), er(spark, sf)).withColumn("key", F.left("key", F.lit(1)))
    return context.agreement(pairs.select("s1", "cand", "p", "key"), "key").select("s1", "cand", "n_peers", "n_agree", r6(F.col("best_agree")).alias("best_agree"))


@query
def within_source(spark, sf):
    pairs = with_record(scored(spark, sf), er(spark, sf))
    return context.within_source(pairs.select("s1", "cand", "p", "src")).select("s1", "cand", "src", "n_strong_source", "rank_in_source")


@query
def score_merge(spark, sf):
    pairs = scored(spark, sf).select("s1", "cand", "p")
    half = lambda m: pairs.where((number("s1") + number("cand")) % m != 0)
    merged = context.merge_scores(pairs, {"x": half(2).select("s1", "cand", F.col("p").alias("score")), "y": half(3).select("s1", "cand", (F.lit(1.0) - F.col("p")).alias("score"))})
    return merged.select("s1", "cand", r6(F.col("ce")).alias("ce"), "ce_rank", r6(F.col("ce_gap")).alias("ce_gap"))


@query
def contention_means(spark, sf):
    return context.contention(candidates(spark, sf))


@query
def pseudo_labels(spark, sf):
    return context.pseudo_labels(scored(spark, sf).select("s1", "cand", "p"), high=0.9, low=0.2, margin=0.2, share=0.25)


@query
def slice_pseudo_labels(spark, sf):
    rows = er(spark, sf)
    house = lambda key: rows.select(F.col("entity_id").alias(key), F.left(text.core_name(F.col("name")), F.lit(1)).alias("house1" if key == "s1" else "house2"), "country")
    pairs = scored(spark, sf).select("s1", "cand", F.col("block_sim").alias("p1"), "p").join(house("s1").where("country = 'fr'").drop("country"), "s1").join(house("cand").drop("country"), "cand")
    return context.slice_pseudo_labels(pairs, 0.7, 0.2, 0.05, 0.6, 0.3, (40, 30, 20, 50))


@query
def gather_records(spark, sf):
    rows = er(spark, sf).select(F.col("entity_id").alias("cand"), "name", "addr")
    return records.gather(candidates(spark, sf).select("s1", "cand"), rows, "cand")


@query
def pack_pairs(spark, sf):
    """Texts once and pairs of ids, put together again."""
    rows = as_texts(er(spark, sf))
    side = lambda c: rows.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    found = candidates(spark, sf).select(F.col("s1").alias("a"), F.col("cand").alias("b"), "rank")
    texts, links = records.pack_pairs(found.join(side("a"), "a").join(side("b"), "b"))
    return records.unpack_pairs(texts, links).select("a", "b", "rank", "text_a", "text_b")


@query
def hard_negatives(spark, sf):
    return context.hard_negatives(sampling.label(scored(spark, sf).select("s1", "cand", "p"), records.er_truth(er(spark, sf))))


@query
def score_band(spark, sf):
    return context.score_band(scored(spark, sf).select("s1", "cand", "p"), 0.2, 0.9, 4).select("s1", "cand")


@query
def logit_adjust(spark, sf):
    return scored(spark, sf).select("s1", "cand", r6(context.affine_log_odds(F.col("p"), 1.3, -0.4)).alias("p_adjusted"))


# ---- decisions ------------------------------------------------------------------------------------------------------


@query
def assign_hard(spark, sf):
    return decision.assign(scored(spark, sf).select("s1", "cand", "p"), "hard").select("s1", "cand")


@query
def assign_soft(spark, sf):
    return decision.assign(scored(spark, sf).select("s1", "cand", "p"), "soft").select("s1", "cand", r6(F.col("p")).alias("p"))


@query
def one_to_one_delta(spark, sf):
    return decision.one_to_one(scored(spark, sf).select("s1", "cand", "p"), 0.05).select("s1", "cand")


@query
def select_threshold(spark, sf):
    return decision.select_threshold(scored(spark, sf), 0.75).select("s1", "cand")


@query
def expected_f(spark, sf):
    return decision.expected_f(scored(spark, sf).select("s1", "cand", "p"), 0.1).select("s1", "cand")


@query
def expected_f_exact(spark, sf):
    return decision.expected_f_exact(scored(spark, sf).select("s1", "cand", "p"), 0.1).select("s1", "cand")


@query
def expected_f_joint(spark, sf):
    return decision.expected_f_joint(scored(spark, sf).select("s1", "cand", "p")).select("s1", "cand")


@query
def decide_by_country(spark, sf):
    pairs = with_record(scored(spark, sf), er(spark, sf)).select("s1", "cand", "p", F.col("country").alias("slice"))
    params = spark.createDataFrame([("fr", 0.9, None, 0.1, 0.6), ("de", None, 0.5, None, None)], "slice string, a double, b double, delta double, threshold double")
    return decision.decide_by_slice(pairs, params, {"a": 1.1, "b": -0.2, "delta": 0.0, "threshold": 0.5}).select("s1", "cand", "slice", r6(F.col("p")).alias("p"))


def entities(rows: DataFrame) -> DataFrame:
    return s1_of(rows).select(F.col("entity_id").alias("s1"), F.col("country").alias("slice"))


@query
def decision_grid(spark, sf):
    rows = er(spark, sf)
    return decision.decision_grid(scored(spark, sf).select("s1", "cand", "p"), records.er_truth(rows), entities(rows), ("none", "hard", "soft"), (0.25, 0.5, 0.75, 0.9), (0.0, 0.4))


@query
def tune_table(spark, sf):
    """The reference's whole table: three ways to assign, 91 thresholds and 5 expectations of missed links each."""
    rows = er(spark, sf)
    thresholds = tuple(round(0.05 + 0.01 * i, 2) for i in range(91))
    return decision.decision_grid(scored(spark, sf).select("s1", "cand", "p"), records.er_truth(rows), entities(rows), ("none", "hard", "soft"), thresholds, (0.0, 0.05, 0.1, 0.2, 0.4))


@query
def tune_rules(spark, sf):
    rows = er(spark, sf)
    return decision.tune_rules(scored(spark, sf).select("s1", "cand", "p"), records.er_truth(rows), entities(rows), (0.8, 1.0, 1.25), (-0.5, 0.0, 0.5), (0.3, 0.4, 0.5, 0.6, 0.7), (0.05, 0.1, 0.2))


@query
def redecide(spark, sf):
    pairs = with_record(scored(spark, sf), er(spark, sf)).select("s1", "cand", "p", F.col("country").alias("slice"))
    return decision.redecide(pairs, ("hard:expected_f:0.1", "fr=hard:threshold:0.6", "de=hard:threshold:0.8"))


@query
def output_summary(spark, sf):
    rows, found = er(spark, sf), candidates(spark, sf)
    lists = records.id_lists(s1_of(rows), found.where("block_sim >= 0.6"), "ids").select(F.col("source1_entity_id").alias("s1"), "ids")
    return decision.output_summary(lists, found.where("rank <= 2"))


def chosen(spark, sf):
    rows = er(spark, sf)
    return decision.entity_scores(entities(rows), records.er_truth(rows), candidates(spark, sf).where("block_sim >= 0.6"))


@query
def macro_f05(spark, sf):
    return decision.macro_f(chosen(spark, sf))


@query
def entity_f05(spark, sf):
    return chosen(spark, sf).select("s1", "n_true", "n_pred", "tp", r6(F.col("f")).alias("f"))


@query
def score_breakdown(spark, sf):
    return decision.score_breakdown(chosen(spark, sf))


@query
def rate_stats(spark, sf):
    return decision.rates(entities(er(spark, sf)), candidates(spark, sf).where("block_sim >= 0.6"))


# ---- learning, sampling, diagnostics -------------------------------------------------------------------------------


@query
def hash_folds(spark, sf):
    return sampling.hash_folds(s1_of(er(spark, sf)).select("entity_id"), "entity_id")


@query
def inner_stop_group(spark, sf):
    return s1_of(er(spark, sf)).select("entity_id", sampling.inner_stop_group(F.col("doc_id")).alias("stop"))


@query
def stratified_sample(spark, sf):
    return sampling.stratified_sample(er(spark, sf).select("entity_id", "country"), "country", "entity_id", 20)


@query
def holdout_sample(spark, sf):
    rows = entities(er(spark, sf)).select("s1")
    return sampling.holdout(rows, records.sample_entities(rows.withColumnRenamed("s1", "entity_id"), 50).withColumnRenamed("entity_id", "s1"), 30)


@query
def neg_downsample_weights(spark, sf):
    rows = sampling.label(candidates(spark, sf), records.er_truth(er(spark, sf)))
    return sampling.thin_negatives(rows, 10, 3).select("s1", "cand", "y", "weight")


def with_source(spark, sf):
    rows = er(spark, sf)
    return scored(spark, sf).drop("rank").join(rows.select(F.col("entity_id").alias("cand"), "src"), "cand").select("s1", "cand", "src", "p")


@query
def prune_rule(spark, sf):
    return learned.prune(with_source(spark, sf), 0.1, 4, 3).select("s1", "cand", "rank", "rank_in_source")


@query
def best_s1_addback(spark, sf):
    pairs = with_source(spark, sf)
    return learned.add_back_best(learned.prune(pairs, 0.6, 2, 1), pairs).select("s1", "cand")


@query
def prune_grid(spark, sf):
    truth = records.er_truth(er(spark, sf))
    return learned.prune_grid(sampling.label(scored(spark, sf), truth), truth.count(), (1, 3, 10), (0.0, 0.3, 0.6))


@query
def ensemble_logit(spark, sf):
    rows = scored(spark, sf).withColumn("q", F.col("block_sim"))
    return rows.select("s1", "cand", r6(learned.blend(rows, {"p": 2.0, "q": 1.0})).alias("logit_mean"), r6(learned.blend(rows, {"p": 2.0, "q": 1.0}, "mean")).alias("mean"))


@query
def score_agreement(spark, sf):
    return learned.score_agreement(scored(spark, sf).select("p", F.col("block_sim").alias("q")), "p", "q")


@query
def percentile_profile(spark, sf):
    rows = er(spark, sf)
    q = F.percentile(F.length("name").cast("double"), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = rows.groupBy("country").agg(F.count(F.lit(1)).alias("n"), q.alias("q"), F.count_distinct("name").alias("names"), F.count_if(F.col("addr") == "").alias("empty_addr"))
    return out.select("country", "n", *[r6(F.get("q", i)).alias(c) for i, c in enumerate(("p10", "p50", "p90"))], "names", "empty_addr")


@query
def country_diagnosis(spark, sf):
    """Per country: candidates per entity, similarity of the first, and its lead over the second."""
    rows = candidates(spark, sf).join(entities(er(spark, sf)), "s1")
    per = rows.groupBy("slice", "s1").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("rank") == 1, F.col("block_sim"))).alias("first"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("block_sim"))), F.lit(0.0)).alias("second"))
    return per.groupBy("slice").agg(F.count(F.lit(1)).alias("entities"), r6(F.avg("n")).alias("mean_candidates"), r6(F.avg("first")).alias("mean_first"), r6(F.avg(F.col("first") - F.col("second"))).alias("mean_lead"))


@query
def missed_profile(spark, sf):
    rows = er(spark, sf)
    own = pool_of(rows).select(F.col("entity_id").alias("cand"), "country", "name", "addr")
    return diagnostics.missed_profile(records.er_truth(rows), candidates(spark, sf).where("rank <= 1"), own, F.col("country"))


@query
def prune_losses(spark, sf):
    return diagnostics.prune_losses(sampling.label(with_source(spark, sf), records.er_truth(er(spark, sf))), 0.3, 2, 1)


@query
def prune_pivot(spark, sf):
    return diagnostics.pivot_grid(prune_grid(spark, sf), (0.0, 0.3, 0.6))


@query
def run_ranking(spark, sf):
    rows = [("a", 0.951, 0.962, True), ("b", None, 0.99, True), ("c", 0.96, 0.955, False), ("d", 0.94, None, True), ("e", None, None, True)]
    return diagnostics.rank_runs(spark.createDataFrame(rows, "name string, holdout double, oof double, valid boolean"))


@query
def hardest_negatives(spark, sf):
    return diagnostics.hardest_negatives(sampling.label(candidates(spark, sf), records.er_truth(er(spark, sf))))


@query
def within_columns(spark, sf):
    out = diagnostics.within(scored(spark, sf).select("s1", "cand", "p"))
    return out.select("s1", "cand", "w_rank", "w_crank", "w_n05", "w_cn05", *[F.round(c, 9).alias(c) for c in ("w_gap", "w_sum", "w_share", "w_other", "w_margin")])


@query
def peer_agreement(spark, sf):
    rows = er(spark, sf)
    own = pool_of(rows).select(F.col("entity_id").alias("cand"), "src", F.array_distinct(text.tokens(text.core_addr(F.col("addr")))).alias("addr_tokens"), (F.col("doc_id") % 4).cast("string").alias("house"))
    return diagnostics.peer_agreement(scored(spark, sf), own)


@query
def peer_similarity(spark, sf):
    own = pool_of(er(spark, sf)).select(F.col("entity_id").alias("cand"), text.core_name(F.col("name")).alias("core_name"), text.core_addr(F.col("addr")).alias("core_addr"))
    return diagnostics.peer_similarity(scored(spark, sf).where("rank <= 4"), own)


@query
def group_frequencies(spark, sf):
    rows = er(spark, sf).select(F.col("entity_id").alias("id"), "country", text.core_name(F.col("name")).alias("key"), text.acronym(F.col("name")).alias("acr"))
    return diagnostics.group_frequencies(rows, {"f_name": ("country", "key"), "f_acronym": ("country", "acr"), "f_both": ("country", "key", "acr")})


@query
def state_partition_topk(spark, sf):
    """Names compared within (country, state), with blank states compared with all of the country; the first letter's class stands for a state."""
    state = F.when(F.col("doc_id") % 5 == 0, "").otherwise((F.ascii(F.lower("name")) % 3).cast("string"))
    rows = er(spark, sf).select(F.col("entity_id").alias("id"), F.col("country").alias("part"), F.col("name").alias("text"), state.alias("state"), "src")
    left, right = diagnostics.state_pairs(rows.where("src = 1"), rows.where("src <> 1"))
    pool = rows.where("src <> 1").select("id", "part", "text")
    words = retrieval.word_tokens(F.col("text"))
    idf, mean = retrieval.few_broadcast(retrieval.idf_table(pool, retrieval.token_counts(pool, words)))
    weigh = lambda d: retrieval.tfidf_weights(retrieval.token_counts(d.select("id", "part", "text").dropDuplicates(["id"]), words), idf).drop("part").join(d.select("id", "part"), "id")
    return retrieval.cosine_top_k(weigh(left), weigh(right), 5, left, right, 2 * mean).select(F.col("q").alias("s1"), F.col("c").alias("cand"), F.col("sim").alias("block_sim"), "rank")


@query
def state_fill(spark, sf):
    rows = er(spark, sf).select(F.col("entity_id").alias("id"), "country", F.slice(text.tokens(text.clean(F.col("name"))), 1, 3).alias("locs"), F.when(F.col("doc_id") % 2 == 0, F.left(text.clean(F.col("name")), F.lit(1))).otherwise("").alias("state"))
    return learned.fill_state(rows, learned.state_table(rows, 3, 0.6)).select("id", "state")


@query
def token_dictionary(spark, sf):
    rows = er(spark, sf)
    words = lambda r, a, b: r.select(F.col("entity_id").alias(a), text.tokens(text.clean(F.col("name"))).alias(b))
    pairs = candidates(spark, sf).where("rank = 1").join(words(s1_of(rows), "s1", "target"), "s1").join(words(pool_of(rows), "cand", "source"), "cand")
    return learned.token_dictionary(pairs)


DEVANAGARI = "कखगघङचछजझञटठडढणतथदधनपफबभमय"


def written(rows: DataFrame) -> DataFrame:
    """(id, src, words, addr): records of source 3 spell their names in Devanagari, one letter for each of a to z."""
    own = text.clean(F.col("name"))
    return rows.select(F.col("entity_id").alias("id"), "src", text.tokens(F.when(F.col("src") == 3, F.translate(own, "abcdefghijklmnopqrstuvwxyz", DEVANAGARI)).otherwise(own)).alias("words"), text.clean(F.col("addr")).alias("addr"))


def native_dictionary(spark, sf) -> DataFrame:
    """Learned from the first candidates whose entity id ends in an even digit; the others play the unseen fold."""
    rows = written(er(spark, sf))
    side = lambda src, a, b: rows.where(src).select(F.col("id").alias(a), F.col("words").alias(b))
    pairs = candidates(spark, sf).where((F.col("rank") == 1) & F.right("s1", F.lit(1)).isin(*"02468")).join(side("src = 1", "s1", "target"), "s1").join(side("src = 3", "cand", "source"), "cand")
    return learned.token_dictionary(pairs, 1, 0.0).where(F.col("token").rlike(transliteration.NATIVE))


@query
def transliterate_names(spark, sf):
    own = written(er(spark, sf)).where("src = 3").select("id", F.array_join("words", " ").alias("text"))
    out = transliteration.transliterate(own, native_dictionary(spark, sf))
    return out.withColumn("skel", text.skeleton(F.col("latin")))


def state_pairs(spark, sf) -> DataFrame:
    rows = written(er(spark, sf))
    s1 = rows.where("src = 1").select(F.col("id").alias("s1"), F.element_at("words", -1).alias("state"))
    return candidates(spark, sf).where("rank = 1").join(s1.where("state is not null"), "s1").join(components(rows).select(F.col("id").alias("cand"), F.col("text").alias("address")), "cand")


def components(rows: DataFrame) -> DataFrame:
    return rows.where("src = 3").select("id", F.concat(F.array_join("words", ","), F.lit(","), "addr").alias("text"))


@query
def component_states(spark, sf):
    return transliteration.component_states(state_pairs(spark, sf))


@query
def transliterate_addresses(spark, sf):
    states = transliteration.component_states(state_pairs(spark, sf))
    return transliteration.transliterate_addresses(components(written(er(spark, sf))), states, native_dictionary(spark, sf))


@query
def word_costs(spark, sf):
    rows = s1_of(er(spark, sf)).select(F.explode(text.name_tokens(F.col("name"))).alias("word"))
    return learned.word_costs(rows).select("word", r6(F.col("cost")).alias("cost"))


@query
def segment_domain(spark, sf):
    rows = er(spark, sf)
    costs = learned.word_costs(s1_of(rows).select(F.explode(text.name_tokens(F.col("name"))).alias("word")))
    joined = pool_of(rows).select(F.col("entity_id").alias("id"), F.array_join(text.name_tokens(F.col("name")), "").alias("text"))
    return learned.segment(joined, costs)


@query
def isotonic(spark, sf):
    rows = sampling.label(candidates(spark, sf), records.er_truth(er(spark, sf))).withColumn("fold", (number("s1") % 3).cast("int")).withColumn("p", F.col("block_sim"))
    return learned.crossfit_isotonic(rows.select("s1", "cand", "p", "y", "fold"), 3).select("s1", "cand", "calibrated")


@query
def temperature(spark, sf):
    rows = sampling.label(candidates(spark, sf), records.er_truth(er(spark, sf))).select(F.col("block_sim").alias("p"), "y")
    return spark.createDataFrame([(learned.fit_temperature(rows),)], "temperature double")


@query
def gbt_stage1(spark, sf):
    pairs, s1, pool = pair_frame(spark, sf)
    rows = sampling.label(features.pair_features(pairs, s1, pool, kernels=False), records.er_truth(er(spark, sf)))
    rows = rows.withColumns({"number": number("s1"), "fold": (number("s1") % 2).cast("int")})
    trees = learned.FoldTrees(["block_sim", "core_jaccard", "addr_jaccard", "core_len_diff", "addr_len_diff"], folds=2, rounds=5, depth=3).fit(rows)
    return trees.score(rows).select("s1", "cand", "p")


@query
def link_plan(spark, sf):
    """The whole plan: retrieve, score by similarity, assign records one to one, decide per entity, write lists."""
    from kinloom.plans.linkage import link

    return link(er(spark, sf))
