"""The library's queries in DuckDB's SQL, written apart from the DataFrame code so that each checks the other."""

from __future__ import annotations

import re

from kinloom.address_sql import parse_sql
from kinloom.functions import text as t

ORACLES: dict[str, str] = {}


def lit(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def clean(x: str) -> str:
    own = f"coalesce({x}, '')"
    own = f"CASE WHEN lower({own}) = 'nan' THEN '' ELSE strip_accents(lower({own})) END"
    own = f"replace(regexp_replace({own}, '[''’]s\\b', '', 'g'), '&', ' and ')"
    return f"trim(regexp_replace(regexp_replace({own}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def words(cleaned: str) -> str:
    return f"list_filter(string_split({cleaned}, ' '), lambda w: w <> '')"


def joined(items: str) -> str:
    return f"coalesce(array_to_string({items}, ' '), '')"


def core(cleaned: str, stop) -> str:
    kept = f"list_filter({words(cleaned)}, lambda w: NOT list_contains({lit(stop)}, w))"
    return f"CASE WHEN len({kept}) > 0 THEN {joined(kept)} ELSE {cleaned} END"


def core_name(x: str) -> str:
    return core(clean(x), t.LEGAL_SUFFIXES)


def norm_addr(x: str) -> str:
    table = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in t.ADDRESS_ABBREVIATIONS.items()) + "}"
    return joined(f"list_transform({words(clean(x))}, lambda w: coalesce({table}[w], w))")


def numbers(x: str) -> str:
    return f"list_distinct(regexp_extract_all(coalesce({x}, ''), '\\p{{Nd}}+'))"


# ---- shared tables ----------------------------------------------------------------------------------------------

CTES = {
    "docs": "SELECT doc_id, coalesce(lang, '') AS country, coalesce(text, '') AS body FROM documents",
    "er": """SELECT 'S' || src || '-' || lpad(doc_id::VARCHAR, 8, '0') AS entity_id, * FROM (
  SELECT doc_id, country, body, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY body) AND doc_id % 4 <> 0 THEN 1 ELSE 2 + doc_id % 2 END::INTEGER AS src,
    string_split(body, chr(10))[1] AS name, coalesce(string_split(body, chr(10))[2], '') AS addr FROM docs)""",
    "s1": "SELECT * FROM er WHERE src = 1",
    "pool": "SELECT * FROM er WHERE src <> 1",
    "gt": "SELECT a.entity_id AS s1, b.entity_id AS cand FROM s1 a JOIN pool b ON a.body = b.body",
    "tok": "SELECT entity_id AS id, src, country AS part, unnest(list_filter(string_split(trim(regexp_replace(lower(name || ' ' || addr), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' '), lambda w: w <> '')) AS token FROM er",
    "tf": "SELECT id, src, part, token, count(*) AS tf FROM tok GROUP BY ALL",
    "idf": "SELECT token, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1 AS idf FROM (SELECT token, count(*) AS df FROM tf WHERE src <> 1 GROUP BY token), (SELECT count(*) AS n FROM pool) WHERE df >= 2 AND df <= 0.1::DOUBLE * n",
    "raw": "SELECT id, src, part, token, (1.0::DOUBLE + ln(tf)) * idf AS raw FROM tf JOIN idf USING (token)",
    "w": "SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS w FROM raw",
    "sims": "SELECT a.id AS s1, b.id AS cand, round(sum(a.w * b.w), 9) AS block_sim FROM w a JOIN w b ON a.src = 1 AND b.src <> 1 AND a.part = b.part AND a.token = b.token GROUP BY 1, 2",
    "cands": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY block_sim DESC, cand)::INTEGER AS rank FROM sims) WHERE rank <= 10",
    "back": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY block_sim DESC, s1)::INTEGER AS rank FROM sims) WHERE rank <= 5",
    "gtok": """SELECT id, src, part, unnest(CASE WHEN len(g) <= 3 THEN [g] ELSE list_transform(range(1, len(g) - 1), lambda i: substr(g, i, 3)) END) AS token
  FROM (SELECT entity_id AS id, src, country AS part, unnest(list_transform(list_filter(string_split(trim(regexp_replace(lower(name), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: ' ' || w || ' ')) AS g FROM er)""",
    "gtf": "SELECT id, src, part, token, count(*) AS tf FROM gtok GROUP BY ALL",
    "gidf": "SELECT token, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1 AS idf FROM (SELECT token, count(*) AS df FROM gtf WHERE src <> 1 GROUP BY token), (SELECT count(*) AS n FROM pool) WHERE df >= 2 AND df <= 0.05::DOUBLE * n",
    "graw": "SELECT id, src, part, token, (1.0::DOUBLE + ln(tf)) * idf AS raw FROM gtf JOIN gidf USING (token)",
    "gw": "SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS w FROM graw",
    "grams": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY block_sim DESC, cand)::INTEGER AS rank FROM (SELECT a.id AS s1, b.id AS cand, round(sum(a.w * b.w), 9) AS block_sim FROM gw a JOIN gw b ON a.src = 1 AND b.src <> 1 AND a.part = b.part AND a.token = b.token GROUP BY 1, 2)) WHERE rank <= 5",
    "scored": "SELECT *, ((substr(s1, 4)::BIGINT * 2654435761 + substr(cand, 4)::BIGINT * 40503) % 10007 + 0.5::DOUBLE) / 10007.0::DOUBLE AS p FROM cands",
    "forms": f"SELECT entity_id, doc_id, src, country, name, addr, {core_name('name')} AS core_name, {norm_addr('addr')} AS norm_addr FROM er",
    "forms2": f"SELECT *, {core('norm_addr', t.ADDRESS_STOPWORDS)} AS core_addr, array_to_string(list_transform({words('core_name')}, lambda w: w[1]), '') AS acronym FROM forms",
    "rec": "SELECT *, coalesce(acronym, '') AS acr, list_distinct(list_filter(string_split(core_name, ' '), lambda w: w <> '')) AS ns, list_distinct(list_filter(string_split(core_addr, ' '), lambda w: w <> '')) AS ads FROM forms2",
    "pf": "SELECT s1, cand, block_sim FROM cands WHERE rank <= 5",
    "rich": "SELECT s.s1, s.cand, s.p, s.rank, r.src, r.country, r.core_name AS key, regexp_extract(r.addr, '\\p{Nd}+') AS house FROM scored s JOIN rec r ON s.cand = r.entity_id",
    "sib": """SELECT DISTINCT b.s1, m.id AS cand FROM (SELECT DISTINCT c.s1, k.part, k.key FROM cands c JOIN sk k ON c.cand = k.id WHERE c.rank <= 3 AND k.key <> '') b
  JOIN (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY part, key) AS size FROM sk WHERE key <> '') WHERE size <= 50) m ON b.part = m.part AND b.key = m.key""",
    "keys": "SELECT entity_id AS id, src, country AS part, coalesce(array_to_string(string_split(core_name, ' ')[1:2], ' '), '') AS key FROM rec",
    "sk": "SELECT * FROM keys WHERE src <> 1",
    "united": """SELECT s1, cand, coalesce(max(sim_a), 0) AS sim_a, coalesce(max(sim_b), 0) AS sim_b, coalesce(max(sim_r), 0) AS sim_r, coalesce(min(rank_a), 99)::INTEGER AS rank_a, coalesce(min(rank_b), 99)::INTEGER AS rank_b, coalesce(min(rank_r), 99)::INTEGER AS rank_r,
  ((max(sim_a) IS NOT NULL)::INTEGER + (max(sim_b) IS NOT NULL)::INTEGER + (max(sim_r) IS NOT NULL)::INTEGER)::INTEGER AS n_passes FROM (
    SELECT s1, cand, block_sim AS sim_a, rank AS rank_a, NULL::DOUBLE AS sim_b, NULL::INTEGER AS rank_b, NULL::DOUBLE AS sim_r, NULL::INTEGER AS rank_r FROM cands
    UNION ALL SELECT s1, cand, NULL, NULL, block_sim, rank, NULL, NULL FROM grams UNION ALL SELECT s1, cand, NULL, NULL, NULL, NULL, block_sim, rank FROM back) GROUP BY s1, cand""",
    "pairs2": "SELECT p.s1, p.cand, p.block_sim, l.core_name AS lc, r.core_name AS rc, l.core_addr AS la, r.core_addr AS ra, l.ns AS ln, r.ns AS rn, l.ads AS lad, r.ads AS rad, l.acr AS lacr, r.acr AS racr, l.name AS lname, r.name AS rname, l.addr AS laddr, r.addr AS raddr, l.country AS lco, r.country AS rco FROM pf p JOIN rec l ON p.s1 = l.entity_id JOIN rec r ON p.cand = r.entity_id",
    "labelled": "SELECT c.*, CASE WHEN g.s1 IS NULL THEN 0 ELSE 1 END::INTEGER AS y FROM scored c LEFT JOIN gt g ON c.s1 = g.s1 AND c.cand = g.cand",
    "chosen": """SELECT e.entity_id AS s1, e.country AS slice, coalesce(t.n, 0)::BIGINT AS n_true, coalesce(q.n, 0)::BIGINT AS n_pred, coalesce(q.tp, 0)::BIGINT AS tp,
  CASE WHEN coalesce(t.n, 0) = 0 AND coalesce(q.n, 0) = 0 THEN 1.0::DOUBLE WHEN coalesce(t.n, 0) = 0 OR coalesce(q.n, 0) = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE * q.tp / (0.25::DOUBLE * t.n + q.n) END AS f
  FROM s1 e LEFT JOIN (SELECT s1, count(*) AS n FROM gt GROUP BY s1) t ON e.entity_id = t.s1
  LEFT JOIN (SELECT s1, count(*) AS n, sum(y) AS tp FROM labelled WHERE block_sim >= 0.6 GROUP BY s1) q ON e.entity_id = q.s1""",
    "others": "SELECT *, CASE WHEN rn = 1 THEN coalesce(second, 0) ELSE first END AS best_other FROM (SELECT *, max(CASE WHEN rn = 1 THEN p END) OVER (PARTITION BY cand) AS first, max(CASE WHEN rn = 2 THEN p END) OVER (PARTITION BY cand) AS second, rank() OVER (PARTITION BY cand ORDER BY p DESC) AS claim_rank FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS rn FROM scored))",
    "srcp": "SELECT s.s1, s.cand, s.p, r.src FROM scored s JOIN er r ON s.cand = r.entity_id",
    "hashed": "SELECT s1, cand, p, ('0x' || md5(s1 || '|' || cand)[1:8])::BIGINT AS h FROM scored",
    "ntok": f"SELECT entity_id, src, country, list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(strip_accents(name)), '&', ' and '), '+', ' and '), '[''’`´]', '', 'g'), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '') AS parts FROM er",
    "runs": """SELECT entity_id, src, list_transform(list_filter(string_split(regexp_replace(regexp_replace(' ' || array_to_string(parts, '  ') || ' ', ' (\\p{L}) ', ' \x01\\1\x01 ', 'g'), '\x01  \x01', '', 'g'), ' '), lambda w: w <> ''), lambda w: replace(w, chr(1), '')) AS toks FROM ntok""",
}


def sql(select: str) -> str:
    """The select with the shared tables it needs, in order."""
    need: dict[str, None] = {}

    def visit(body: str, own: str = "") -> None:
        for name in CTES:
            if name != own and name not in need and re.search(rf"(FROM|JOIN|,)\s+\(?{name}\b", body):
                visit(CTES[name], name)
                need[name] = None

    visit(select)
    return ("WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in need) + " " if need else "") + select


def oracle(name: str, select: str) -> None:
    ORACLES[name] = sql(select)


oracle("er_view", "SELECT entity_id, src, country, name, addr FROM er")
oracle("gt_explode", "SELECT s1, cand FROM gt")
oracle("submission_lists", "SELECT e.entity_id AS source1_entity_id, coalesce(string_agg(c.cand, ',' ORDER BY c.cand), '') AS matched_entity_ids FROM s1 e LEFT JOIN cands c ON e.entity_id = c.s1 AND c.rank <= 3 GROUP BY 1")
oracle("sample_nested", "SELECT entity_id FROM s1 ORDER BY md5('42:' || entity_id), entity_id LIMIT 50")
oracle("records_by_id", "SELECT entity_id, src, name FROM er WHERE entity_id IN (SELECT cand FROM cands WHERE rank = 1)")
oracle("clean_text", f"SELECT entity_id, {clean('name')} AS name_clean, {clean('addr')} AS addr_clean FROM er")
oracle("core_tokens", "SELECT entity_id, core_name, norm_addr, core_addr, trim(core_name || ' ' || core_addr) AS blob FROM rec")
oracle("numeric_tokens", f"SELECT doc_id, coalesce(array_to_string(list_sort({numbers('text')}), ','), '') AS numbers, regexp_extract(coalesce(text, ''), '\\p{{Nd}}+') AS first_number FROM documents")
_legal = f"list_has_any(w, {lit(t.PRIVATE_WORDS)}) AND list_has_any(w, {lit(t.LIMITED_WORDS)})"
oracle("legal_form", f"SELECT doc_id, CASE WHEN {_legal} THEN 'PVT_LTD' " + " ".join(f"WHEN list_has_any(w, {lit(k)}) THEN '{c}'" for k, c in t.LEGAL_CLASSES) + f" WHEN list_has_any(w, {lit(t.LIMITED_WORDS)}) THEN 'LTD' ELSE '' END AS legal FROM (SELECT doc_id, {words(clean('text'))} AS w FROM documents) q")
oracle("acronym", "SELECT entity_id, acr AS acronym FROM rec")
_stem = "replace(lower(regexp_extract(trim(strip_accents(x)), '(?i)^\\W*(?:www\\.)?([a-z0-9][a-z0-9\\-]*)\\.(?:com|in|net|org|co|fr|biz|info|us)\\s*$', 1)), '-', '')"
oracle("domain_stem", f"SELECT page_id, {_stem} AS stem FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS x FROM pages)")
oracle("script_class", f"SELECT CASE WHEN trim(x) = '' THEN 'empty' WHEN {_stem} <> '' THEN 'domain' WHEN regexp_matches(x, '[^\\x{{0}}-\\x{{24F}}]') THEN 'other-nonlatin' ELSE 'latin' END AS script, count(*) AS n FROM (SELECT name AS x FROM er) GROUP BY 1")
oracle("collapse_letters", "SELECT entity_id, coalesce(array_to_string(toks, ' '), '') AS words FROM runs")

oracle("token_df", "SELECT part, token, count(DISTINCT id) AS df FROM tok WHERE src <> 1 GROUP BY part, token")
oracle("tfidf_weights", "SELECT id, token, round(w, 9) AS w FROM w WHERE src <> 1")
oracle("tfidf_topk", "SELECT s1, cand, block_sim, rank FROM cands")
oracle("tfidf_reverse_topk", "SELECT s1, cand, block_sim, rank FROM back")
oracle("char_trigram_topk", "SELECT s1, cand, block_sim, rank FROM grams")
_exact = lambda col, bit: f"SELECT a.entity_id AS s1, b.entity_id AS cand, {bit} AS x FROM (SELECT *, count(*) OVER (PARTITION BY country, {col}) AS size FROM rec WHERE src = 1 AND {col} <> '') a JOIN (SELECT *, count(*) OVER (PARTITION BY country, {col}) AS size FROM rec WHERE src <> 1 AND {col} <> '') b ON a.country = b.country AND a.{col} = b.{col} AND a.size <= 3000 AND b.size <= 3000"
oracle("exact_key_block", f"SELECT s1, cand, bit_or(x)::INTEGER AS x FROM ({_exact('core_name', 1)} UNION ALL {_exact('core_addr', 2)} UNION ALL {_exact('acr', 4)}) u GROUP BY s1, cand")
oracle("key_pool_cap", "SELECT p_partkey, p_name AS key, p_brand AS part, pool_size FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, p_name) AS pool_size FROM part) WHERE pool_size <= 4")
oracle("sibling_expand", "SELECT s1, cand FROM sib")
oracle("direct_key_lookup", "SELECT a.id AS s1, m.id AS cand FROM keys a JOIN (SELECT *, count(*) OVER (PARTITION BY part, key) AS size FROM sk WHERE key <> '') m ON a.src = 1 AND a.part = m.part AND a.key = m.key AND m.size <= 50")
oracle("blocker_union", "SELECT * FROM united")
oracle("extras_antijoin", "SELECT s1, cand FROM sib ANTI JOIN cands USING (s1, cand)")
oracle("fill_similarity", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY block_sim DESC, cand)::INTEGER AS rank FROM (SELECT x.s1, x.cand, coalesce(s.block_sim, 0) AS block_sim FROM (SELECT s1, cand FROM sib ANTI JOIN cands USING (s1, cand)) x LEFT JOIN sims s ON x.s1 = s.s1 AND x.cand = s.cand)) WHERE rank <= 3")
_total = "(SELECT count(*) FROM gt)"
oracle("recall_at_k", f"SELECT k, count(*) FILTER (c.rank <= k AND c.y = 1) AS hits, {_total} AS n_truth, round(count(*) FILTER (c.rank <= k AND c.y = 1)::DOUBLE / nullif({_total}, 0), 9) AS recall, count(*) FILTER (c.rank <= k) AS pairs FROM labelled c, (SELECT unnest([1, 2, 5, 10])::INTEGER AS k) GROUP BY k")
oracle("recall_by_country", "SELECT e.country AS slice, count(c.s1) AS hits, count(*) AS n_truth, round(count(c.s1)::DOUBLE / count(*), 9) AS recall FROM gt g JOIN s1 e ON g.s1 = e.entity_id LEFT JOIN cands c ON g.s1 = c.s1 AND g.cand = c.cand AND c.rank <= 5 GROUP BY 1")
oracle(
    "pass_marginal_recall",
    """SELECT pass, hits, cumulative, gain, gain::DOUBLE / n >= 0.002 AS passes_gate FROM (SELECT count(*) AS n, count(*) FILTER (sim_a > 0) AS ha, count(*) FILTER (sim_b > 0) AS hb, count(*) FILTER (sim_r > 0) AS hr, count(*) FILTER (sim_a > 0 OR sim_b > 0) AS cb, count(*) FILTER (sim_a > 0 OR sim_b > 0 OR sim_r > 0) AS cr
  FROM gt g LEFT JOIN united u ON g.s1 = u.s1 AND g.cand = u.cand), LATERAL (SELECT unnest(['a', 'b', 'r']) AS pass, unnest([ha, hb, hr]) AS hits, unnest([ha, cb, cr]) AS cumulative, unnest([ha, cb - ha, cr - cb]) AS gain)""",
)
oracle("orphans", "SELECT entity_id AS id FROM s1 WHERE entity_id NOT IN (SELECT s1 FROM cands)")
oracle("recall_ceiling", f"SELECT k, round(1.25::DOUBLE * r / (0.25::DOUBLE + r), 6) AS ceiling FROM (SELECT k, round(count(*) FILTER (c.rank <= k AND c.y = 1)::DOUBLE / nullif({_total}, 0), 9) AS r FROM labelled c, (SELECT unnest([1, 10])::INTEGER AS k) GROUP BY k)")
oracle(
    "embedding_knn",
    "SELECT query_id, rank, vec_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id)::INTEGER AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])), 6) AS sim FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)) WHERE rank <= 5",
)

_jac = lambda a, b: f"CASE WHEN len(list_distinct({a} || {b})) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct({a} || {b})), 6) END"
_cont = lambda a, b: f"CASE WHEN least(len({a}), len({b})) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect({a}, {b}))::DOUBLE / least(len({a}), len({b})), 6) END"
_agree = lambda a, b: f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE WHEN list_has_any({a}, {b}) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"
_lan, _ran, _lnn, _rnn = numbers("laddr"), numbers("raddr"), numbers("lname"), numbers("rname")
_hl, _hr = "regexp_extract(laddr, '\\p{Nd}+')", "regexp_extract(raddr, '\\p{Nd}+')"


def _form(x: str) -> str:
    w = words(clean(x))
    has = lambda keys: f"list_has_any({w}, {lit(keys)})"
    return f"CASE WHEN {has(t.PRIVATE_WORDS)} AND {has(t.LIMITED_WORDS)} THEN 'PVT_LTD' " + " ".join(f"WHEN {has(k)} THEN '{c}'" for k, c in t.LEGAL_CLASSES) + f" WHEN {has(t.LIMITED_WORDS)} THEN 'LTD' ELSE '' END"


oracle(
    "pair_features_sets",
    f"""SELECT s1, cand, round(block_sim, 9) AS block_sim, {_jac('ln', 'rn')} AS core_jaccard, {_cont('ln', 'rn')} AS core_containment, coalesce((list_min(ln) = list_min(rn))::INTEGER::DOUBLE, 0) AS core_least_token_eq,
  abs(length(lc) - length(rc))::DOUBLE AS core_len_diff, abs(len(ln) - len(rn))::DOUBLE AS core_tok_diff, (lacr = racr)::INTEGER::DOUBLE AS acronym_eq,
  (lacr <> '' AND lacr = coalesce(array_to_string(list_transform(list_sort(rn), lambda w: w[1]), ''), ''))::INTEGER::DOUBLE AS acronym_vs_core,
  {_jac('lad', 'rad')} AS addr_jaccard, {_cont('lad', 'rad')} AS addr_containment, abs(length(la) - length(ra))::DOUBLE AS addr_len_diff,
  {_agree(_lan, _ran)} AS addr_num_agree, {_jac(_lan, _ran)} AS addr_num_jaccard, {_agree(_lnn, _rnn)} AS name_num_agree, (lco = rco)::INTEGER::DOUBLE AS country_eq,
  CASE WHEN {_hl} <> '' AND {_hr} <> '' THEN CASE WHEN {_hl} = {_hr} THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ELSE 0.0::DOUBLE END AS hn_state,
  CASE WHEN {_hl} <> '' AND {_hr} <> '' THEN levenshtein({_hl}, {_hr})::DOUBLE ELSE -1.0::DOUBLE END AS hn_lev,
  ({_hl} <> '' AND {_hr} <> '' AND {_hl} <> {_hr} AND levenshtein({_hl}, {_hr}) <= 1)::INTEGER::DOUBLE AS hn_near,
  CASE WHEN lf = rf THEN 0.0::DOUBLE WHEN lf = '' OR rf = '' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS legal_compat, (trim(laddr) = '' OR trim(raddr) = '')::INTEGER::DOUBLE AS addr_empty_any
  FROM (SELECT *, {_form('lname')} AS lf, {_form('rname')} AS rf FROM pairs2)""",
)
def _bytes(x: str) -> str:
    """DuckDB's edit distances go by bytes; letters outside ASCII become single ones."""
    return f"translate({x}, 'ßœæøđłŋþð', '\x01\x02\x03\x04\x05\x06\x07\x08\x0e')"


oracle("levenshtein_feats", f"SELECT s1, cand, levenshtein({_bytes('lc')}, {_bytes('rc')})::BIGINT AS lev, CASE WHEN greatest(length(lc), length(rc)) = 0 THEN 1.0::DOUBLE ELSE round(1 - levenshtein({_bytes('lc')}, {_bytes('rc')})::DOUBLE / greatest(length(lc), length(rc)), 6) END AS lev_sim FROM pairs2")
oracle("jaro_winkler", f"SELECT s1, cand, round(CASE WHEN lacr = racr THEN 1.0::DOUBLE WHEN lacr = '' OR racr = '' THEN 0.0::DOUBLE ELSE jaro_winkler_similarity({_bytes('lacr')}, {_bytes('racr')}) END, 6) AS jw FROM pairs2")
oracle("set_kernel", "SELECT s1, cand, i::BIGINT AS inter, len(ln)::BIGINT AS size_a, len(rn)::BIGINT AS size_b, round(i::DOUBLE / nullif(len(ln) + len(rn) - i, 0), 6) AS jacc, round(i::DOUBLE / nullif(len(ln), 0), 6) AS cont_a, round(i::DOUBLE / nullif(len(rn), 0), 6) AS cont_b FROM (SELECT *, len(list_intersect(ln, rn)) AS i FROM pairs2)")
oracle(
    "idf_overlap",
    """SELECT p.s1, p.cand, round(shared, 6) AS idf_shared, round(wa + wb - shared, 6) AS idf_union, round(CASE WHEN wa + wb - shared > 0 THEN shared / (wa + wb - shared) ELSE 0 END, 6) AS idf_overlap, round(ua, 6) AS unmatched_s1, round(ub, 6) AS unmatched_cand FROM (
  SELECT s1, cand, coalesce(sum(wt) FILTER (ia AND ib), 0) AS shared, coalesce(sum(wt) FILTER (ia), 0) AS wa, coalesce(sum(wt) FILTER (ib), 0) AS wb, coalesce(max(wt) FILTER (ia AND NOT ib), 0) AS ua, coalesce(max(wt) FILTER (ib AND NOT ia), 0) AS ub FROM (
    SELECT s1, cand, token, ln(((SELECT count(*) FROM s1) + 1)::DOUBLE / (coalesce(df, 0) + 1)) AS wt, list_contains(ln, token) AS ia, list_contains(rn, token) AS ib FROM (SELECT s1, cand, ln, rn, unnest(list_distinct(ln || rn)) AS token FROM pairs2) x
    LEFT JOIN (SELECT token, count(*) AS df FROM (SELECT unnest(ns) AS token FROM rec WHERE src = 1) GROUP BY token) d USING (token)) GROUP BY s1, cand) q RIGHT JOIN pf p ON p.s1 = q.s1 AND p.cand = q.cand""",
)
oracle(
    "name_frequency",
    "SELECT p.s1, p.cand, round(ln(1 + nc * 1e6 / n), 6) AS name_genericity, round(CASE WHEN core_addr <> '' THEN ln(1 + ac * 1e6 / n) ELSE 0 END, 6) AS colocation FROM pf p JOIN (SELECT entity_id, core_addr, count(*) OVER (PARTITION BY core_name) AS nc, count(*) OVER (PARTITION BY core_addr) AS ac, count(*) OVER () AS n FROM rec WHERE src = 1) r ON p.s1 = r.entity_id",
)
oracle("number_features", "SELECT o_orderkey, round(ln(1 + abs(a - b)), 6) AS log_gap, round(abs(a - b) / nullif(greatest(a, b), 0), 6) AS relative_gap, (starts_with(a::BIGINT::VARCHAR, b::BIGINT::VARCHAR) OR starts_with(b::BIGINT::VARCHAR, a::BIGINT::VARCHAR))::INTEGER AS is_prefix FROM (SELECT o_orderkey, o_orderkey::DOUBLE AS a, o_custkey::DOUBLE AS b FROM orders)")
oracle(
    "best_variant",
    f"""SELECT s1, cand, max(sim) AS best FROM (SELECT s1, cand, {_jac('x', 'y')} AS sim FROM (SELECT c.s1, c.cand, list_distinct({words('l.v')}) AS x, list_distinct({words('r.v')}) AS y FROM cands c
  JOIN (SELECT entity_id, unnest([core_name, core_addr]) AS v FROM rec) l ON c.s1 = l.entity_id JOIN (SELECT entity_id, unnest([core_name, core_addr]) AS v FROM rec) r ON c.cand = r.entity_id WHERE c.rank <= 3)) GROUP BY s1, cand""",
)
oracle("rank_features", "SELECT s1, cand, rank AS rank_in_entity, max(block_sim) OVER (PARTITION BY s1) AS max_in_entity, round(max(block_sim) OVER (PARTITION BY s1) - block_sim, 9) AS gap_to_best, count(*) OVER (PARTITION BY s1) AS n_candidates, (rank = 1)::INTEGER AS is_best FROM cands")

oracle("claims", "SELECT s1, cand, rank() OVER (PARTITION BY cand ORDER BY p DESC)::INTEGER AS claim_rank, round(max(p) OVER (PARTITION BY cand) - p, 6) AS claim_gap, count(*) OVER (PARTITION BY cand) AS n_claims, sum((p >= 0.5)::BIGINT) OVER (PARTITION BY cand)::BIGINT AS n_strong_claims FROM scored")
oracle(
    "entity_shape",
    "SELECT s1, cand, p_rank::INTEGER AS p_rank, round(max(p) OVER own - p, 6) AS p_gap, round(sum(p) OVER own, 6) AS sum_p, round(coalesce(max(CASE WHEN p_rank = 2 THEN p END) OVER own, 0), 6) AS p_second, round(p / sum(p) OVER own, 6) AS p_share, count(*) OVER own AS n_candidates, sum((p >= 0.5)::BIGINT) OVER own::BIGINT AS n_strong FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS p_rank FROM scored) WINDOW own AS (PARTITION BY s1)",
)
oracle("best_other_margin", "SELECT s1, cand, round(best_other, 6) AS best_other, round(p - best_other, 6) AS margin FROM others")
oracle(
    "gang",
    "SELECT s1, cand, CASE WHEN key <> '' THEN n ELSE 0 END AS gang_n, round(CASE WHEN key <> '' AND n > 1 THEN CASE WHEN rn = 1 THEN second ELSE first END ELSE -1 END, 6) AS gang_max FROM (SELECT *, count(*) OVER own AS n, max(CASE WHEN rn = 1 THEN p END) OVER own AS first, max(CASE WHEN rn = 2 THEN p END) OVER own AS second FROM (SELECT s1, cand, p, key[1:2] AS key, row_number() OVER (PARTITION BY s1, key[1:2] ORDER BY p DESC, cand) AS rn FROM rich) WINDOW own AS (PARTITION BY s1, key))",
)
oracle(
    "twins",
    "SELECT s1, cand, count(*) OVER own AS twin_n, (max(p) OVER own > p AND house <> first_value(house) OVER (PARTITION BY s1, key ORDER BY p DESC, cand))::INTEGER AS twin_flag, round(max(p) OVER own - p, 6) AS twin_gap FROM (SELECT s1, cand, p, key[1:1] AS key, (substr(cand, 4)::BIGINT % 3)::VARCHAR AS house FROM rich) WINDOW own AS (PARTITION BY s1, key)",
)
oracle(
    "agreement",
    "SELECT a.s1, a.cand, count(b.cand) AS n_peers, count(*) FILTER (a.key = b.key AND a.key <> '') AS n_agree, round(coalesce(max(b.p) FILTER (a.key = b.key AND a.key <> ''), 0), 6) AS best_agree FROM (SELECT s1, cand, p, key[1:1] AS key FROM rich) a LEFT JOIN (SELECT s1, cand, p, key[1:1] AS key, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS rn FROM rich) b ON a.s1 = b.s1 AND a.cand <> b.cand AND b.rn <= 3 GROUP BY 1, 2",
)
oracle("within_source", "SELECT s1, cand, src, sum((p > 0.5)::BIGINT) OVER (PARTITION BY s1, src)::BIGINT AS n_strong_source, row_number() OVER (PARTITION BY s1, src ORDER BY p DESC, cand)::INTEGER AS rank_in_source FROM srcp")
oracle(
    "score_merge",
    "SELECT s1, cand, round(ce, 6) AS ce, CASE WHEN ce IS NOT NULL THEN row_number() OVER (PARTITION BY s1 ORDER BY ce DESC NULLS LAST, cand) END::INTEGER AS ce_rank, round(max(ce) OVER (PARTITION BY s1) - ce, 6) AS ce_gap FROM (SELECT s1, cand, CASE WHEN m2 AND m3 THEN (p + (1 - p)) / 2 WHEN m2 THEN p WHEN m3 THEN 1 - p END AS ce FROM (SELECT *, (substr(s1, 4)::BIGINT + substr(cand, 4)::BIGINT) % 2 <> 0 AS m2, (substr(s1, 4)::BIGINT + substr(cand, 4)::BIGINT) % 3 <> 0 AS m3 FROM scored))",
)
oracle("contention_means", "SELECT sum(n)::BIGINT AS pairs, count(*) AS records, round(avg(n::DOUBLE), 6) AS mean_claims, round(sum(n::DOUBLE * n) / sum(n), 6) AS row_mean_claims FROM (SELECT cand, count(*) AS n FROM cands GROUP BY cand)")
oracle(
    "pseudo_labels",
    "SELECT o.s1, o.cand, (o.p > 0.9)::INTEGER AS y, CASE WHEN o.p > 0.9 THEN 1.0::DOUBLE ELSE 4.0::DOUBLE END AS weight FROM others o JOIN hashed h ON o.s1 = h.s1 AND o.cand = h.cand WHERE (o.p > 0.9 AND o.claim_rank = 1 AND o.p - o.best_other > 0.2) OR (o.p < 0.2 AND h.h < 1073741824)",
)
oracle(
    "hard_negatives",
    "SELECT s1, cand, CASE WHEN hard <= 2 THEN 'hard' ELSE 'random' END AS kind FROM (SELECT l.s1, l.cand, row_number() OVER (PARTITION BY l.s1 ORDER BY l.p DESC, l.cand) AS hard, row_number() OVER (PARTITION BY l.s1 ORDER BY md5(l.s1 || '|' || l.cand), l.cand) AS dice FROM labelled l WHERE y = 0) WHERE hard <= 2 OR dice = 1",
)
oracle("score_band", "SELECT s1, cand FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS rn FROM scored) WHERE p BETWEEN 0.2 AND 0.9 AND rn <= 4")
oracle("logit_adjust", "SELECT s1, cand, round(1 / (1 + exp(-(1.3::DOUBLE * ln(p / (1 - p)) - 0.4::DOUBLE))), 6) AS p_adjusted FROM scored")

oracle("assign_hard", "SELECT s1, cand FROM others WHERE rn = 1")
oracle("assign_soft", "SELECT s1, cand, round(p * p / sum(p) OVER (PARTITION BY cand), 6) AS p FROM scored")
oracle("one_to_one_delta", "SELECT s1, cand FROM others WHERE rn = 1 AND p - coalesce(second, 0) >= 0.05")
oracle("select_threshold", "SELECT s1, cand FROM scored WHERE p >= 0.75")


def _expected(source: str, miss: float) -> str:
    m = f"{miss}::DOUBLE"
    return f"""SELECT s1, cand FROM (SELECT *, min(CASE WHEN v >= best THEN k END) OVER (PARTITION BY s1) AS cut FROM (SELECT *, max(v) OVER (PARTITION BY s1) AS best FROM (
  SELECT *, 1.25::DOUBLE * sum(p) OVER (PARTITION BY s1 ORDER BY k) / (0.25::DOUBLE * (sum(p) OVER (PARTITION BY s1) + {m}) + k) AS v, exp(sum(ln(1 - least(p, 1 - 1e-12))) OVER (PARTITION BY s1) - {m}) AS none FROM (
    SELECT s1, cand, p, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS k FROM {source})))) WHERE k <= cut AND best > none"""


oracle("expected_f", _expected("scored", 0.1))
# the distribution of the true positives among the first k, by recursion over k and the number found
_exact_f = """WITH RECURSIVE {shared}, lst AS (SELECT s1, cand, p, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS k FROM scored),
tot AS (SELECT s1, sum(p) AS total, exp(sum(ln(1 - least(p, 1 - 1e-12))) - 0.1::DOUBLE) AS none, count(*) AS n FROM lst GROUP BY s1),
pmf AS (SELECT s1, 0::BIGINT AS k, [1.0::DOUBLE] AS f, 0.0::DOUBLE AS cum FROM tot
  UNION ALL SELECT m.s1, m.k + 1, list_transform(range(1, len(m.f) + 2), lambda i: coalesce(m.f[i], 0) * (1 - l.p) + CASE WHEN i > 1 THEN m.f[i - 1] * l.p ELSE 0 END), m.cum + l.p FROM pmf m JOIN lst l ON m.s1 = l.s1 AND l.k = m.k + 1),
val AS (SELECT m.s1, m.k, list_sum(list_transform(range(1, len(m.f) + 1), lambda i: m.f[i] * 1.25::DOUBLE * (i - 1) / (0.25::DOUBLE * (i - 1 + t.total + 0.1::DOUBLE - m.cum) + m.k))) AS v, t.none FROM pmf m JOIN tot t ON m.s1 = t.s1 WHERE m.k > 0),
best AS (SELECT s1, min(k) AS n FROM (SELECT *, max(v) OVER (PARTITION BY s1) AS mv FROM val) WHERE v >= mv AND mv > none GROUP BY s1)
SELECT l.s1, l.cand FROM lst l JOIN best b ON l.s1 = b.s1 AND l.k <= b.n"""
ORACLES["expected_f_exact"] = _exact_f.replace("{shared}", sql("SELECT * FROM scored").removeprefix("WITH ").rsplit(" SELECT * FROM scored", 1)[0])
oracle(
    "decide_by_country",
    """SELECT s1, cand, slice, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS rn, nth_value(p, 2) OVER (PARTITION BY cand ORDER BY p DESC, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM (
  SELECT s1, cand, country AS slice, 1 / (1 + exp(-(CASE country WHEN 'fr' THEN 0.9::DOUBLE ELSE 1.1::DOUBLE END * ln(p / (1 - p)) + CASE country WHEN 'de' THEN 0.5::DOUBLE ELSE -0.2::DOUBLE END))) AS p, CASE country WHEN 'fr' THEN 0.1::DOUBLE ELSE 0 END AS delta, CASE country WHEN 'fr' THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS cut FROM rich))
  WHERE rn = 1 AND p - coalesce(second, 0) >= delta AND p >= cut""",
)
def recursive(body: str, tables: str) -> str:
    """A body of recursive tables and a select, after the shared tables that ``tables`` need."""
    tail = "SELECT * FROM " + tables
    return "WITH RECURSIVE " + sql(tail).removeprefix("WITH ").removesuffix(" " + tail) + ", " + body


def _joint(source: str, key: str, most: int = 10) -> str:
    """Tables up to best (key, n): pre and suf are the distributions of the links among the first k and among the others of lst (key, p, k)."""
    same = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in key.split(", "))
    grown = "list_transform(range(1, len(m.f) + 2), lambda i: coalesce(m.f[i], 0) * (1 - l.p) + CASE WHEN i > 1 THEN m.f[i - 1] * l.p ELSE 0 END)"
    cols = lambda a: ", ".join(f"{a}.{c}" for c in key.split(", "))
    return f"""lst AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY p DESC, cand) AS k FROM {source}),
size AS (SELECT {key}, count(*) AS n FROM lst GROUP BY {key}),
pre AS (SELECT {key}, 0::BIGINT AS k, [1.0::DOUBLE] AS f FROM size UNION ALL SELECT {cols('m')}, m.k + 1, {grown} FROM pre m JOIN lst l ON {same('m', 'l')} AND l.k = m.k + 1),
suf AS (SELECT {key}, n AS k, [1.0::DOUBLE] AS f FROM size UNION ALL SELECT {cols('m')}, m.k - 1, {grown} FROM suf m JOIN lst l ON {same('m', 'l')} AND l.k = m.k),
val AS (SELECT {cols('a')}, a.k, list_sum(list_transform(range(1, len(a.f) + 1), lambda i: a.f[i] * list_sum(list_transform(range(1, len(b.f) + 1), lambda j: b.f[j] * 1.25::DOUBLE * (i - 1) / (0.25::DOUBLE * (i + j - 2) + a.k))))) AS v
  FROM pre a JOIN suf b ON {same('a', 'b')} AND a.k = b.k WHERE a.k BETWEEN 1 AND {most}),
best AS (SELECT {cols('v')}, min(v.k) AS n FROM (SELECT *, max(v) OVER (PARTITION BY {key}) AS top FROM val) v JOIN suf z ON {same('v', 'z')} AND z.k = 0 WHERE v.v >= v.top - 1e-12 AND v.top > z.f[1] + 1e-12 GROUP BY {cols('v')})"""


ORACLES["expected_f_joint"] = recursive(_joint("scored", "s1") + " SELECT l.s1, l.cand FROM lst l JOIN best b ON l.s1 = b.s1 AND l.k <= b.n", "scored")
_soft = "(SELECT s1, cand, p * p / sum(p) OVER (PARTITION BY cand) AS p, y FROM labelled)"
_hard = "(SELECT s1, cand, p, y FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS rn FROM labelled) WHERE rn = 1)"
_f = "CASE WHEN coalesce(t.n, 0) = 0 AND coalesce(q.n, 0) = 0 THEN 1.0::DOUBLE WHEN coalesce(t.n, 0) = 0 OR coalesce(q.n, 0) = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE * q.tp / (0.25::DOUBLE * t.n + q.n) END"
_truth = "LEFT JOIN (SELECT s1, count(*) AS n FROM gt GROUP BY s1) t ON e.entity_id = t.s1"
_grid = []
for _mode, _rows in (("none", "labelled"), ("hard", _hard), ("soft", _soft)):
    _grid.append(f"SELECT '{_mode}' AS mode, 'threshold' AS rule, g.value, round(avg({_f}), 6) AS f05 FROM s1 e CROSS JOIN (SELECT unnest([0.25, 0.5, 0.75, 0.9])::DOUBLE AS value) g {_truth} LEFT JOIN (SELECT s1, value, count(*) AS n, sum(y) AS tp FROM {_rows} r, (SELECT unnest([0.25, 0.5, 0.75, 0.9])::DOUBLE AS value) WHERE p >= value GROUP BY s1, value) q ON e.entity_id = q.s1 AND g.value = q.value GROUP BY g.value")
    for _miss in (0.0, 0.4):
        _grid.append(f"SELECT '{_mode}', 'expected_f', {_miss}::DOUBLE, round(avg({_f}), 6) FROM s1 e {_truth} LEFT JOIN (SELECT x.s1, count(*) AS n, sum(l.y) AS tp FROM ({_expected(_rows + ' r', _miss)}) x JOIN labelled l ON x.s1 = l.s1 AND x.cand = l.cand GROUP BY x.s1) q ON e.entity_id = q.s1")
oracle("decision_grid", " UNION ALL ".join(_grid))
_table = []
_cuts = "(SELECT unnest(list_transform(range(91), lambda i: round(0.05::DOUBLE + i * 0.01::DOUBLE, 2))) AS value)"
for _mode, _rows in (("none", "labelled"), ("hard", _hard), ("soft", _soft)):
    _table.append(f"SELECT '{_mode}' AS mode, 'threshold' AS rule, g.value, round(avg({_f}), 6) AS f05 FROM s1 e CROSS JOIN {_cuts} g {_truth} LEFT JOIN (SELECT s1, value, count(*) AS n, sum(y) AS tp FROM {_rows} r, {_cuts} WHERE p >= value GROUP BY s1, value) q ON e.entity_id = q.s1 AND g.value = q.value GROUP BY g.value")
    for _miss in (0.0, 0.05, 0.1, 0.2, 0.4):
        _table.append(f"SELECT '{_mode}', 'expected_f', {_miss}::DOUBLE, round(avg({_f}), 6) FROM s1 e {_truth} LEFT JOIN (SELECT x.s1, count(*) AS n, sum(l.y) AS tp FROM ({_expected(_rows + ' r', _miss)}) x JOIN labelled l ON x.s1 = l.s1 AND x.cand = l.cand GROUP BY x.s1) q ON e.entity_id = q.s1")
oracle("tune_table", " UNION ALL ".join(_table))
_rules = [("ef", a, b, 0.0) for a in (0.8, 1.0, 1.25) for b in (-0.5, 0.0, 0.5)] + [("thr", 1.0, 0.0, t) for t in (0.3, 0.4, 0.5, 0.6, 0.7)]
_adj = lambda p: f"1 / (1 + exp(-(a * ln({p} / (1 - {p})) + b)))"
_won = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS rn, nth_value(p, 2) OVER (PARTITION BY cand ORDER BY p DESC, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM labelled WHERE p >= 0.001) WHERE rn = 1)"
_values = ", ".join(f"({i}, '{m}', {a}::DOUBLE, {b}::DOUBLE, {t}::DOUBLE, {d}::DOUBLE)" for i, (m, a, b, t) in enumerate(_rules) for d in (0, 0.05, 0.1, 0.2))
_tune = f"""rules(rule, method, a, b, t, delta) AS (VALUES {_values}),
adjusted AS (SELECT r.*, w.s1, w.cand, w.y, {_adj('w.p')} AS p, coalesce({_adj('w.second')}, 0) AS q FROM {_won} w, rules r),
led AS (SELECT * FROM adjusted WHERE p - q >= delta),
{_joint("led", "rule, delta, s1")},
counts AS (SELECT l.rule, l.delta, l.s1, count(*) AS n, sum(l.y) AS tp FROM lst l LEFT JOIN best b ON l.rule = b.rule AND l.delta = b.delta AND l.s1 = b.s1 WHERE CASE l.method WHEN 'ef' THEN l.k <= b.n ELSE l.p >= l.t END GROUP BY ALL),
scores AS (SELECT r.rule, r.method, r.a, r.b, r.delta, r.t, round(avg({_f}), 6) AS f05 FROM rules r CROSS JOIN s1 e {_truth} LEFT JOIN counts q ON r.rule = q.rule AND r.delta = q.delta AND e.entity_id = q.s1 GROUP BY ALL)
SELECT method, a, b, delta, t, f05 FROM scores WHERE delta = 0 OR rule = (SELECT rule FROM scores WHERE delta = 0 ORDER BY f05 DESC, rule LIMIT 1)"""
ORACLES["tune_rules"] = recursive(_tune, "labelled, gt")
_own = "(SELECT s1, cand, p, country FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS rn FROM rich) WHERE rn = 1)"
oracle(
    "redecide",
    f"""SELECT s1, cand, country AS slice FROM {_own} WHERE (country = 'fr' AND p >= 0.6) OR (country = 'de' AND p >= 0.8)
UNION ALL SELECT x.s1, x.cand, o.country FROM ({_expected("(SELECT * FROM " + _own + " WHERE country NOT IN ('fr', 'de'))", 0.1)}) x JOIN {_own} o ON x.s1 = o.s1 AND x.cand = o.cand""",
)
oracle("output_summary", "SELECT count(*) AS rows, count(*) FILTER (n > 0) AS with_matches, count(*) FILTER (n = 0) AS singletons, round(avg((n = 0)::INTEGER), 6) AS singleton_rate, round(avg(n), 6) AS mean_matches, count(*) FILTER (far > 0) AS outside FROM (SELECT e.entity_id, count(c.cand) AS n, count(c.cand) FILTER (c.rank > 2) AS far FROM s1 e LEFT JOIN cands c ON e.entity_id = c.s1 AND c.block_sim >= 0.6 GROUP BY 1)")
oracle("macro_f05", "SELECT count(*) AS entities, round(avg(f), 6) AS f05, round(sum(tp)::DOUBLE / nullif(sum(n_pred), 0), 6) AS precision, round(sum(tp)::DOUBLE / nullif(sum(n_true), 0), 6) AS recall FROM chosen")
oracle("entity_f05", "SELECT s1, n_true, n_pred, tp, round(f, 6) AS f FROM chosen")
oracle("score_breakdown", "SELECT CASE WHEN n_true = 0 THEN 'singleton' ELSE 'matched' END AS kind, count(*) AS entities, round(avg(f), 6) AS f05, round(avg(n_true), 6) AS mean_true, round(avg(n_pred), 6) AS mean_pred FROM chosen GROUP BY 1")
oracle("rate_stats", "SELECT slice, count(*) AS entities, round(avg((n_pred = 0)::INTEGER), 6) AS singleton_rate, round(avg(n_pred), 6) AS links_per_entity FROM chosen GROUP BY slice")

_h = lambda *parts: "('0x' || md5(" + " || '|' || ".join(parts) + ")[1:8])::BIGINT"
oracle("hash_folds", f"SELECT entity_id, hidden, CASE WHEN hidden THEN -1 ELSE {_h(chr(39) + 'fold' + chr(39), 'entity_id')} % 5 END::INTEGER AS fold FROM (SELECT entity_id, {_h(chr(39) + 'fold-hidden' + chr(39), 'entity_id')} % 100 < 20 AS hidden FROM s1)")
oracle("inner_stop_group", "SELECT entity_id, (doc_id * 2654435761) % 1000 < 50 AS stop FROM s1")
oracle("stratified_sample", f"SELECT entity_id, country FROM (SELECT entity_id, country, row_number() OVER (PARTITION BY country ORDER BY {_h(chr(39) + 'strata' + chr(39), 'entity_id')}, entity_id) AS rn FROM er) WHERE rn <= 20")
oracle("holdout_sample", f"SELECT entity_id AS s1 FROM s1 WHERE entity_id NOT IN (SELECT entity_id FROM (SELECT entity_id FROM s1 ORDER BY md5('42:' || entity_id), entity_id LIMIT 50)) ORDER BY {_h(chr(39) + 'holdout' + chr(39), 'entity_id')}, entity_id LIMIT 30")
oracle("neg_downsample_weights", f"SELECT s1, cand, y, CASE WHEN y = 1 OR rank <= 3 THEN 1.0::DOUBLE ELSE 10.0::DOUBLE END AS weight FROM labelled WHERE y = 1 OR rank <= 3 OR {_h(chr(39) + 'neg' + chr(39), 's1', 'cand')} % 100 < 10")
_ranks = "(SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand)::INTEGER AS rank, row_number() OVER (PARTITION BY s1, src ORDER BY p DESC, cand)::INTEGER AS rank_in_source FROM srcp)"
oracle("prune_rule", f"SELECT s1, cand, rank, rank_in_source FROM {_ranks} WHERE p >= 0.1 AND (rank <= 4 OR rank_in_source <= 3)")
oracle("best_s1_addback", f"SELECT arg_min(s1, struct_pack(n := -p, s := s1)) AS s1, cand FROM srcp WHERE cand NOT IN (SELECT cand FROM {_ranks} WHERE p >= 0.6 AND (rank <= 2 OR rank_in_source <= 1)) GROUP BY cand HAVING max(p) >= 0.001")
oracle("prune_grid", f"SELECT k, min_p, count(*) FILTER (rank <= k AND p >= min_p) AS pairs, round(count(*) FILTER (rank <= k AND p >= min_p AND y = 1)::DOUBLE / {_total}, 6) AS recall FROM labelled l, (SELECT unnest([1, 3, 10])::INTEGER AS k) a, (SELECT unnest([0.0, 0.3, 0.6])::DOUBLE AS min_p) b GROUP BY k, min_p")
_lo = lambda x: f"ln(least(greatest({x}, 1e-6), 1 - 1e-6) / (1 - least(greatest({x}, 1e-6), 1 - 1e-6)))"
oracle("ensemble_logit", f"SELECT s1, cand, round(1 / (1 + exp(-({_lo('p')} * (2.0::DOUBLE / 3) + {_lo('block_sim')} * (1.0::DOUBLE / 3)))), 6) AS logit_mean, round(p * (2.0::DOUBLE / 3) + block_sim * (1.0::DOUBLE / 3), 6) AS mean FROM scored")
oracle("score_agreement", f"SELECT count(*) AS n, round(corr({_lo('p')}, {_lo('block_sim')}), 6) AS pearson_logit, round(corr(rp, rq), 6) AS spearman FROM (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rp, rank() OVER (ORDER BY block_sim) + (count(*) OVER (PARTITION BY block_sim) - 1) / 2.0::DOUBLE AS rq FROM scored)")
oracle("percentile_profile", "SELECT country, count(*) AS n, round(quantile_cont(length(name)::DOUBLE, 0.1), 6) AS p10, round(quantile_cont(length(name)::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(length(name)::DOUBLE, 0.9), 6) AS p90, count(DISTINCT name) AS names, count(*) FILTER (addr = '') AS empty_addr FROM er GROUP BY country")
oracle("country_diagnosis", "SELECT slice, count(*) AS entities, round(avg(n), 6) AS mean_candidates, round(avg(first), 6) AS mean_first, round(avg(first - second), 6) AS mean_lead FROM (SELECT e.country AS slice, c.s1, count(*) AS n, max(block_sim) FILTER (rank = 1) AS first, coalesce(max(block_sim) FILTER (rank = 2), 0) AS second FROM cands c JOIN s1 e ON c.s1 = e.entity_id GROUP BY 1, 2) GROUP BY slice")
_clean_words = words(clean("name"))
oracle(
    "state_fill",
    f"""SELECT r.id, CASE WHEN r.state <> '' THEN r.state ELSE coalesce(f.filled, '') END AS state FROM (SELECT entity_id AS id, country, CASE WHEN doc_id % 2 = 0 THEN {clean('name')}[1:1] ELSE '' END AS state FROM er) r LEFT JOIN (
  SELECT id, arg_min(st, struct_pack(n := -n, s := st)) AS filled FROM (SELECT entity_id AS id, country, unnest({_clean_words}[1:3]) AS loc FROM er WHERE doc_id % 2 <> 0 OR {clean('name')}[1:1] = '') l JOIN (
    SELECT * FROM (SELECT country, loc, st, count(*) AS n, sum(count(*)) OVER (PARTITION BY country, loc) AS total FROM (SELECT country, unnest({_clean_words}[1:3]) AS loc, {clean('name')}[1:1] AS st FROM er WHERE doc_id % 2 = 0 AND {clean('name')}[1:1] <> '') GROUP BY 1, 2, 3) WHERE n >= 3 AND n::DOUBLE / total >= 0.6) s ON l.country = s.country AND l.loc = s.loc GROUP BY id) f ON r.id = f.id""",
)
oracle(
    "token_dictionary",
    f"""SELECT source AS token, latin, n FROM (SELECT source, arg_min(target, struct_pack(n := -n, s := target)) AS latin, max(n) AS n, sum(n) AS total FROM (SELECT source, target, count(*) AS n FROM (
  SELECT unnest(a) AS target, unnest(b) AS source FROM (SELECT list_filter(string_split({clean('x.name')}, ' '), lambda w: w <> '') AS a, list_filter(string_split({clean('y.name')}, ' '), lambda w: w <> '') AS b FROM cands c JOIN er x ON c.s1 = x.entity_id JOIN er y ON c.cand = y.entity_id WHERE c.rank = 1) WHERE len(a) = len(b)) GROUP BY 1, 2) GROUP BY source) WHERE n >= 2 AND n >= 0.5 * total""",
)
def skel(x: str) -> str:
    """Written without look-around: a letter that a rule only looks at is put back, and rules whose matches may touch run twice."""
    out = f"regexp_replace(lower({x}), '[^a-z ]', '', 'g')"
    for old, new in (("\\by([aeiou])", "\\1"), ("([aeiou])gh", "\\1"), ("ction", "ksn"), ("tion", "sn"), ("ph", "f"), ("th", "t"), ("kh", "k"), ("sh", "s"), ("ch", "s"), ("ck", "k"), ("c([aoukrlt])", "k\\1"), ("c\\b", "k"), ("m([^aeiou ])", "n\\1"), ("m([^aeiou ])", "n\\1")):
        out = f"regexp_replace({out}, '{old}', '{new}', 'g')"
    out = f"trim(regexp_replace(translate({out}, 'gbdvzjcq', 'kptwsssk'), ' +', ' ', 'g'))"
    out = f"regexp_replace({out}, '([a-z])[aeiouy]+', '\\1', 'g')"
    return f"list_transform([{out}], lambda o: array_to_string(list_transform(range(1, len(o) + 1), lambda i: CASE WHEN i > 1 AND o[i] = o[i - 1] THEN '' ELSE o[i] END), ''))[1]"


_stem = f"replace(lower(regexp_extract(trim(strip_accents(coalesce(name, ''))), '{t.DOMAIN}', 1)), '-', '')"
_bare = f"list_filter({words(core_name('name'))}, lambda w: NOT list_contains({lit(t.TRANSLITERATED_LEGAL)}, w))"
oracle("skeleton", f"SELECT entity_id, coalesce({skel('tl')}, '') AS skel FROM (SELECT entity_id, CASE WHEN {_stem} <> '' THEN {_stem} ELSE {joined(_bare)} END AS tl FROM er)")
# The Devanagari letters that stand for a to z in the queries, and how they sound.
_letters = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमय", "ka kha ga gha na cha cha ja jha na ta tha da dha na ta tha da dha na pa pha ba bha ma ya".split(), strict=True))
_sound = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in _letters.items()) + "}"
CTES["native"] = f"SELECT entity_id AS id, src, {clean('addr')} AS addr, list_filter(string_split(CASE WHEN src = 3 THEN translate({clean('name')}, 'abcdefghijklmnopqrstuvwxyz', '{''.join(_letters)}') ELSE {clean('name')} END, ' '), lambda w: w <> '') AS ws FROM er"
_is_native = lambda w: f"regexp_matches({w}, '[\\x{{900}}-\\x{{D7F}}]')"
CTES["ndict"] = f"""SELECT token, arg_min(target, struct_pack(n := -n, s := target)) AS latin FROM (SELECT token, target, count(*) AS n FROM (
  SELECT unnest(y.ws) AS token, unnest(x.ws) AS target FROM cands c JOIN native x ON c.s1 = x.id JOIN native y ON c.cand = y.id WHERE c.rank = 1 AND y.src = 3 AND len(x.ws) = len(y.ws) AND c.s1[-1] IN ('0', '2', '4', '6', '8')) GROUP BY ALL) WHERE {_is_native('token')} GROUP BY token"""
CTES["nsnap"] = f"SELECT skel, arg_min(word, struct_pack(k := -k, w := word)) AS word FROM (SELECT latin AS word, count(*) AS k, {skel('latin')} AS skel FROM ndict GROUP BY latin) GROUP BY skel"
CTES["nvoc"] = f"""SELECT v.word, coalesce(d.latin, s.word, v.spelled) AS latin, d.latin IS NULL AS unknown FROM (SELECT *, {skel('spelled')} AS sk FROM (
  SELECT word, replace(word, '_', '') AS token, array_to_string(list_transform(range(1, len(word) + 1), lambda i: coalesce({_sound}[word[i]], CASE WHEN regexp_matches(word[i], '[a-z0-9]') THEN word[i] ELSE '' END)), '') AS spelled FROM (
    SELECT DISTINCT unnest(ws) AS word FROM native WHERE src = 3) WHERE {_is_native('word')})) v LEFT JOIN ndict d ON v.token = d.token LEFT JOIN nsnap s ON v.sk = s.skel"""
_spelt = "list_transform(range(1, len(ws) + 1), lambda i: struct_pack(i := i, w := ws[i]))"
oracle("transliterate_names", f"""SELECT id, coalesce(latin, '') AS latin, n_native, n_unknown, coalesce({skel("coalesce(latin, '')")}, '') AS skel FROM (
  SELECT n.id, string_agg(coalesce(v.latin, n.w.w), ' ' ORDER BY n.w.i) AS latin, count(v.word) AS n_native, count(*) FILTER (v.unknown) AS n_unknown FROM (SELECT id, unnest({_spelt}) AS w FROM native WHERE src = 3) n LEFT JOIN nvoc v ON n.w.w = v.word GROUP BY n.id
  UNION ALL SELECT id, '', 0, 0 FROM native WHERE src = 3 AND len(ws) = 0)""")
CTES["nstate"] = f"""SELECT component, arg_min(state, struct_pack(n := -n, s := state)) AS state FROM (SELECT component, state, count(*) AS n, sum(count(*)) OVER (PARTITION BY component) AS total FROM (
  SELECT unnest(y.ws) AS component, x.ws[-1] AS state FROM cands c JOIN native x ON c.s1 = x.id JOIN native y ON c.cand = y.id WHERE c.rank = 1 AND y.src = 3 AND len(x.ws) > 0) WHERE {_is_native('component')} GROUP BY 1, 2) GROUP BY component HAVING max(n) >= 0.5 * max(total)"""
oracle("component_states", "SELECT component, state FROM nstate")
_parts = "list_transform(range(1, len(ps) + 1), lambda i: struct_pack(i := i, w := ps[i]))"
oracle("transliterate_addresses", f"""SELECT n.id, string_agg(coalesce(s.state, v.latin, n.w.w), ', ' ORDER BY n.w.i) AS latin FROM (SELECT id, unnest({_parts}) AS w FROM (SELECT id, list_concat(CASE WHEN len(ws) > 0 THEN ws ELSE [''] END, [addr]) AS ps FROM native WHERE src = 3)) n
  LEFT JOIN nstate s ON n.w.w = s.component LEFT JOIN nvoc v ON n.w.w = v.word GROUP BY n.id""")
CTES["french"] = f"SELECT o.*, o.p > 0.7 AND o.claim_rank = 1 AND o.p - o.best_other > 0.05 AND a.core_name[1] = b.core_name[1] AND a.core_name <> '' AS accepted FROM others o JOIN rec a ON o.s1 = a.entity_id JOIN rec b ON o.cand = b.entity_id WHERE a.country = 'fr'"
_drawn = lambda kind, label, test, n: f"(SELECT s1, cand, '{kind}' AS kind, {label}::DOUBLE AS label FROM french f WHERE {test} ORDER BY md5(s1 || '|' || cand), s1, cand LIMIT {n})"
oracle("slice_pseudo_labels", " UNION ALL ".join((_drawn("positive", 1, "accepted", 40), _drawn("plausible", 0, "p < 0.2 AND block_sim >= 0.3", 30), _drawn("implausible", 0, "p < 0.2 AND block_sim < 0.3", 20), _drawn("twin", 0, "p >= 0.2 AND p < 0.6 AND s1 IN (SELECT s1 FROM french WHERE accepted)", 50))))
oracle("gather_records", "SELECT c.s1, c.cand, r.name, r.addr FROM cands c JOIN er r ON c.cand = r.entity_id")
oracle("pack_pairs", "SELECT c.s1 AS a, c.cand AS b, c.rank, x.name || ' ' || x.addr AS text_a, y.name || ' ' || y.addr AS text_b FROM cands c JOIN er x ON c.s1 = x.entity_id JOIN er y ON c.cand = y.entity_id")
oracle("word_costs", "SELECT word, round(-ln(n::DOUBLE / total), 6) AS cost FROM (SELECT word, count(*) AS n, sum(count(*)) OVER () AS total FROM (SELECT unnest(toks) AS word FROM runs WHERE src = 1) WHERE regexp_matches(word, '^\\p{L}+$') GROUP BY word) WHERE (n >= 2 AND length(word) >= 2) OR word = 'a'")
_leet = "CASE WHEN regexp_matches(w, '^\\d+(st|nd|rd|th)$') OR regexp_matches(w, '^\\p{Nd}+$') OR regexp_matches(w, '^\\p{L}+$') THEN w ELSE translate(w, '01568', 'olsgb') END"
_canon = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in t.SUFFIX_CANON.items()) + "}"
_forms = lit(dict.fromkeys(t.SUFFIX_CANON.values()))
oracle(
    "canonical_names",
    f"""SELECT entity_id, {joined('whole')} AS "full", {joined('kept')} AS core, {joined('list_sort(list_distinct(kept))')} AS key, {joined(f'list_sort(list_distinct(list_filter(whole, lambda w: list_contains({_forms}, w))))')} AS legal FROM (
  SELECT *, CASE WHEN len(core) > 0 THEN core WHEN len(bare) > 0 THEN bare ELSE whole END AS kept FROM (SELECT *, list_filter(bare, lambda w: NOT list_contains({_forms}, w)) AS core FROM (SELECT *, list_filter(whole, lambda w: NOT list_contains({lit(t.NAME_STOPWORDS)}, w)) AS bare FROM (
    SELECT entity_id, list_transform(list_transform(toks, lambda w: {_leet}), lambda w: coalesce({_canon}[w], w)) AS whole FROM runs))))""",
)
CTES["nv0"] = """SELECT entity_id AS id, trim(regexp_replace(regexp_replace(trim(x), '^[^\\p{L}\\p{N}]+', ''), '(?i)^\\s*m/s\\.?\\s+', '')) AS txt FROM (
  SELECT entity_id, CASE WHEN src = 1 THEN '* M/s. ' || name WHEN src = 2 AND country = 'fr' THEN word || '-online.com' WHEN src = 2 THEN word || ' Ltd d.b.a. ' || translate(name, 'ol', '01') ELSE name || ' | https://www.' || word || '-shop.com/x' END AS x
  FROM (SELECT *, string_split_regex(lower(name), '[^a-z]+')[1] AS word FROM er))"""
CTES["nv1"] = """SELECT id, txt, latin, list_concat([latin], CASE WHEN len(parts) > 1 THEN parts ELSE [] END, CASE WHEN site <> '' THEN [site || '.com'] ELSE [] END) AS texts, len(parts) > 1 AS aliased FROM (
  SELECT *, list_filter(string_split_regex(latin, '(?i)\\s+(?:d\\.?\\s?b\\.?\\s?a\\.?|a\\.?k\\.?a\\.?|t/a|trading\\s+as)\\s+'), lambda w: trim(w) <> '') AS parts FROM (
    SELECT id, txt, regexp_extract(txt, site, 1) AS site, regexp_replace(txt, site, '') AS latin FROM (SELECT *, '(?i)\\s*\\|\\s*(?:https?://)?(?:www\\.)?([a-z0-9\\-]+)\\.[a-z]{2,4}\\S*\\s*$' AS site FROM nv0)))"""
_letters_joined = "list_transform(list_filter(string_split(regexp_replace(regexp_replace(' ' || coalesce(array_to_string(ps, '  '), '') || ' ', ' (\\p{L}) ', ' \x01\\1\x01 ', 'g'), '\x01  \x01', '', 'g'), ' '), lambda w: w <> ''), lambda w: replace(w, chr(1), ''))"
CTES["nv2"] = f"""SELECT *, {_letters_joined} AS toks FROM (
  SELECT id, i, part, replace(regexp_extract(replace(trim(lower(strip_accents(part))), ' ', ''), '^(?:www\\.)?([a-z0-9\\-]+)\\.com$', 1), '-', '') AS stem,
    list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(strip_accents(part)), '&', ' and '), '+', ' and '), '[''’`´]', '', 'g'), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '') AS ps
  FROM (SELECT id, i, texts[i] AS part FROM (SELECT id, texts, unnest(range(1, len(texts) + 1)) AS i FROM nv1)))"""
_kept = lambda xs, stop: f"list_filter({xs}, lambda w: NOT list_contains({stop}, w))"
_first_full = lambda *xs: "CASE " + " ".join(f"WHEN len({x}) > 0 THEN {x}" for x in xs[:-1]) + f" ELSE {xs[-1]} END"
_stops = lit(t.NAME_STOPWORDS)
CTES["nv3"] = f"""SELECT id, i, whole, core, domain, variant, CASE WHEN NOT domain AND second <> variant THEN second END AS second FROM (
  SELECT *, {joined('core')} AS variant, {joined(_first_full('plain', 'raw'))} AS second FROM (SELECT *, {_first_full(_kept('bare', _forms), 'bare', 'whole')} AS core, {_kept(_kept('raw', _stops), _forms)} AS plain FROM (
    SELECT *, {_kept('whole', _stops)} AS bare FROM (SELECT id, i, stem <> '' AS domain, list_transform(CASE WHEN stem <> '' THEN list_transform([stem], lambda w: {_leet}) ELSE list_transform(toks, lambda w: {_leet}) END, lambda w: coalesce({_canon}[w], w)) AS whole,
      list_transform(toks, lambda w: coalesce({_canon}[w], w)) AS raw FROM nv2))))"""
_in_order = "SELECT id, w, min(pos) AS pos FROM (SELECT id, i * 2 AS pos, variant AS w FROM nv3 UNION ALL SELECT id, i * 2 + 1, second FROM nv3) WHERE w <> '' GROUP BY id, w"
oracle(
    "name_variants",
    f"""SELECT f.id, f.variant AS core, {joined('f.whole')} AS "full", {joined('list_sort(list_distinct(f.core))')} AS key, coalesce(array_to_string(f.core, ''), '') AS squeezed, {joined(f'list_sort(list_distinct(list_filter(f.whole, lambda w: list_contains({_forms}, w))))')} AS legal,
  coalesce(a.alt, '') AS alt, (CASE WHEN f.domain THEN 1 ELSE 0 END + CASE WHEN n.aliased THEN 2 ELSE 0 END + CASE WHEN EXISTS (SELECT 1 FROM nv3 s WHERE s.id = f.id AND s.second IS NOT NULL) THEN 4 ELSE 0 END)::INTEGER AS flags, 0.0::DOUBLE AS oov, len(f.core)::INTEGER AS n_core, lower(strip_accents(n.txt)) AS shown
FROM nv3 f JOIN nv1 n ON f.id = n.id LEFT JOIN (SELECT o.id, string_agg(o.w, '|' ORDER BY o.pos) AS alt FROM ({_in_order}) o JOIN nv3 m ON o.id = m.id AND m.i = 1 WHERE o.w <> m.variant GROUP BY o.id) a ON f.id = a.id WHERE f.i = 1""",
)
CTES["lists"] = """SELECT e.entity_id AS s1, coalesce(string_agg(c.cand, ',' ORDER BY c.cand), '') AS list FROM s1 e LEFT JOIN cands c ON e.entity_id = c.s1 AND c.rank <= 2 GROUP BY 1
  UNION ALL VALUES ('S1-x', 'S2-1,S2-1'), ('S1-x', 'S1-9'), ('S1-y', 'Q-1'), ('', 'S2-00000002')"""
CTES["cells"] = "SELECT * FROM (SELECT s1, unnest(string_split(list, ',')) AS cand FROM lists) WHERE cand <> ''"
oracle(
    "validator_report",
    """SELECT 'malformed_row' AS rule, count(*) AS n FROM lists WHERE s1 = '' OR contains(list, chr(9))
UNION ALL SELECT 'duplicate_entity', count(*) FROM (SELECT s1 FROM lists GROUP BY s1 HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_id_in_list', count(*) FROM (SELECT s1, cand FROM cells GROUP BY s1, cand HAVING count(*) > 1)
UNION ALL SELECT 'self_match', count(*) FROM cells WHERE starts_with(cand, 'S1-')
UNION ALL SELECT 'wrong_prefix', count(*) FROM cells WHERE NOT regexp_matches(cand, '^S[123]-')
UNION ALL SELECT 'missing_entity', count(*) FROM (SELECT entity_id FROM s1 UNION SELECT 'S1-z') WHERE entity_id NOT IN (SELECT s1 FROM lists)
UNION ALL SELECT 'unknown_entity', count(DISTINCT s1) FROM lists WHERE s1 NOT IN (SELECT entity_id FROM s1)
UNION ALL SELECT 'unknown_id', count(*) FROM cells WHERE cand NOT IN (SELECT entity_id FROM pool)
UNION ALL SELECT 'not_a_candidate', count(*) FROM (SELECT DISTINCT s1, cand FROM cells) x ANTI JOIN (SELECT s1, cand FROM cands WHERE rank = 1) y USING (s1, cand)""",
)
CTES["alone"] = "SELECT s1, cand, p FROM (SELECT s1, cand, p, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS rn, nth_value(p, 2) OVER (PARTITION BY cand ORDER BY p DESC, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM (SELECT s1, cand, least(block_sim, 1.0) AS p FROM cands)) WHERE rn = 1 AND p - coalesce(second, 0) >= 0.01"
oracle("link_plan", f"SELECT e.entity_id AS source1_entity_id, coalesce(string_agg(x.cand, ',' ORDER BY x.cand), '') AS matched_entity_ids FROM s1 e LEFT JOIN (SELECT v.s1, v.cand FROM ({_expected('alone', 0.05)}) v JOIN alone a ON v.s1 = a.s1 AND v.cand = a.cand WHERE a.p >= 0.5) x ON e.entity_id = x.s1 GROUP BY 1")
oracle("missed_profile", "SELECT c.s1 IS NOT NULL AS found, e.country AS slice, count(*) AS n, count(*) FILTER (trim(e.addr) = '') AS empty_addr FROM gt g JOIN pool e ON g.cand = e.entity_id LEFT JOIN cands c ON g.s1 = c.s1 AND g.cand = c.cand AND c.rank <= 1 GROUP BY 1, 2")
CTES["srcl"] = "SELECT p.*, CASE WHEN g.s1 IS NULL THEN 0 ELSE 1 END AS y FROM srcp p LEFT JOIN gt g ON p.s1 = g.s1 AND p.cand = g.cand"
oracle(
    "prune_losses",
    "SELECT CASE WHEN p < 0.3 AND low THEN 'low p and low rank' WHEN p < 0.3 THEN 'low p only' WHEN low THEN 'low rank only' ELSE 'kept' END AS reason, CASE WHEN m <= 2 THEN '(-inf, 2]' WHEN m <= 5 THEN '(2, 5]' WHEN m <= 9 THEN '(5, 9]' ELSE '(9, inf]' END AS size_bin, count(*) AS n FROM (SELECT *, rank > 2 AND rank_in_source > 1 AS low FROM (SELECT *, count(*) OVER (PARTITION BY s1) AS m, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS rank, row_number() OVER (PARTITION BY s1, src ORDER BY p DESC, cand) AS rank_in_source FROM srcl)) WHERE y = 1 GROUP BY 1, 2",
)
_cell = lambda p: f"round(count(*) FILTER (rank <= k AND p >= {p} AND y = 1)::DOUBLE / {_total}, 6)"
oracle("prune_pivot", f"SELECT k, {_cell(0.0)} AS recall_0_0, {_cell(0.3)} AS recall_0_3, {_cell(0.6)} AS recall_0_6 FROM labelled l, (SELECT unnest([1, 3, 10])::INTEGER AS k) a GROUP BY k")
oracle("run_ranking", "SELECT *, name = 'a' AS winner FROM (SELECT name, holdout::DOUBLE AS holdout, oof::DOUBLE AS oof, valid, row_number() OVER (ORDER BY holdout IS NULL, coalesce(holdout, oof, 0) DESC, name)::INTEGER AS place FROM (VALUES ('a', 0.951, 0.962, true), ('b', NULL, 0.99, true), ('c', 0.96, 0.955, false), ('d', 0.94, NULL, true), ('e', NULL, NULL, true)) v(name, holdout, oof, valid))")
oracle("hardest_negatives", "SELECT s1, cand, block_sim, y FROM labelled WHERE y = 1 UNION ALL SELECT s1, cand, block_sim, y FROM (SELECT *, row_number() OVER (ORDER BY block_sim DESC, s1, cand) AS rn FROM labelled WHERE y = 0) WHERE rn <= 3 * (SELECT count(*) FROM labelled WHERE y = 1)")
oracle(
    "within_columns",
    "SELECT s1, cand, w_rank, rn::INTEGER AS w_crank, sum((p > 0.5)::BIGINT) OVER own::BIGINT AS w_n05, sum((p > 0.5)::BIGINT) OVER (PARTITION BY cand)::BIGINT AS w_cn05, round(p - max(p) OVER own, 9) AS w_gap, round(sum(p) OVER own, 9) AS w_sum, round(p / sum(p) OVER own, 9) AS w_share, round(best_other, 9) AS w_other, round(p - best_other, 9) AS w_margin FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand)::INTEGER AS w_rank FROM others) WINDOW own AS (PARTITION BY s1)",
)
CTES["peer"] = "SELECT s.s1, s.cand, s.p, r.src, r.ads, (r.doc_id % 4)::VARCHAR AS house, row_number() OVER (PARTITION BY s.s1 ORDER BY s.p DESC, s.cand) AS rn FROM scored s JOIN rec r ON s.cand = r.entity_id"
oracle(
    "peer_agreement",
    """SELECT s1, cand, round(max(pj * t), 6) AS ag_tokens, round(max(pj * h), 6) AS ag_house, round(max(pj * t) FILTER (other), 6) AS ag_other_tokens, round(max(pj * h) FILTER (other), 6) AS ag_other_house, round(avg(t) FILTER (pj > 0.5), 6) AS ag_tokens_mean FROM (
  SELECT a.s1, a.cand, b.p AS pj, a.src <> b.src AS other, (a.house = b.house)::INTEGER::DOUBLE AS h, CASE WHEN b.cand IS NULL THEN NULL WHEN len(list_distinct(a.ads || b.ads)) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a.ads, b.ads))::DOUBLE / len(list_distinct(a.ads || b.ads)) END AS t
  FROM peer a LEFT JOIN peer b ON a.s1 = b.s1 AND a.cand <> b.cand AND b.rn <= 3) GROUP BY s1, cand""",
)
_freq = lambda cols, filled: f"CASE WHEN {filled} THEN round(ln(1 + count(*) OVER (PARTITION BY {cols})), 6) ELSE 0.0::DOUBLE END"
oracle("group_frequencies", f"SELECT entity_id AS id, {_freq('country, core_name', 'core_name <> $$$$')} AS f_name, {_freq('country, acr', 'acr <> $$$$')} AS f_acronym, {_freq('country, core_name, acr', 'core_name <> $$$$ AND acr <> $$$$')} AS f_both FROM rec WHERE country <> ''")
CTES["ntf"] = "SELECT id, src, part, state, token, count(*) AS tf FROM (SELECT entity_id AS id, src, country AS part, CASE WHEN doc_id % 5 = 0 THEN '' ELSE (coalesce(ascii(lower(name)), 0) % 3)::VARCHAR END AS state, unnest(list_filter(string_split(trim(regexp_replace(lower(name), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' '), lambda w: w <> '')) AS token FROM er) GROUP BY ALL"
CTES["nidf"] = "SELECT token, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1 AS idf FROM (SELECT token, count(*) AS df FROM ntf WHERE src <> 1 GROUP BY token), (SELECT count(*) AS n FROM pool) WHERE df >= 2 AND df <= 0.1::DOUBLE * n"
CTES["nw"] = "SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS w FROM (SELECT id, src, part, state, token, (1.0::DOUBLE + ln(tf)) * idf AS raw FROM ntf JOIN nidf USING (token))"
oracle(
    "state_partition_topk",
    "SELECT s1, cand, block_sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY block_sim DESC, cand)::INTEGER AS rank FROM (SELECT a.id AS s1, b.id AS cand, round(sum(a.w * b.w), 9) AS block_sim FROM nw a JOIN nw b ON a.src = 1 AND b.src <> 1 AND a.part = b.part AND a.token = b.token AND (a.state = b.state OR a.state = '' OR b.state = '') GROUP BY 1, 2)) WHERE rank <= 5",
)

_samples = "VALUES (-1::BIGINT, 'No. 12-4, 3rd Main Rd, Near Park, Bangalore, KA 560001', 'India'), (-2, '0045 W Oak St Apt 7B, Springfield, IL 62704', 'US'), (-3, '12 bis r de la Paix, 59000 Lille', 'France')"
oracle("parse_address", parse_sql(f"SELECT doc_id AS id, addr, country FROM er UNION ALL SELECT * FROM ({_samples}) v(id, addr, country)"))
