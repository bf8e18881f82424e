"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import chat_format, embedding_dedup, license_scan, line_dedup, mixing, packing, quality, simhash, suffix_dedup, topk_search
from kinloom.llm.common import table

CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_lines=2, long_words=50)
    return out.select("doc_id", F.col("__line_n").alias("n_lines"), F.col("__line_removed").alias("n_removed"), F.col("__line_runs").alias("n_runs"), "text")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def tokenizer_files() -> dict[str, str]:
    """The public tokenizer that the driver's box offers; another is another path."""
    import public_tokenizers as files

    return {"tokenizer_path": files.path("byte_bpe_50k.json"), "ranks_path": files.path("byte_bpe_50k.tiktoken"), "pattern": files.PATTERN}


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), sequence=1024, end_id=2, **tokenizer_files())


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=50, digest=True)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.train(documents, quality.graded(table(spark, sf_dir, "labels")))
    return quality.score_documents(documents, model)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), words=4, size=1, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("print0")), 16, "0").alias("fingerprint"), "component_id")


def op8_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    weights = documents.groupBy("source").agg(F.sqrt(F.count(F.lit(1))).alias("weight"))  # targets: the square root of each source's documents
    mixed = mixing.poisson_mix(documents, weights)
    return mixed.select("doc_id", "source", "copy_no", "shuffle_key", "text")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = chat_format.read_back(chat_format.format_conversations(chat_format.chain_messages(rows), distinct=True))
    turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
    )


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_topk_search": op3_topk_search,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_hnsw_dedup": op8_hnsw_dedup,
    "op9_poisson_mix": op9_poisson_mix,
    "op10_chat_format": op10_chat_format,
}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    pattern = license_scan.COPYRIGHT_LINE
    out = f"regexp_replace(lower({text}), {_quote(pattern)}, '', 'g')"
    out = f"(' ' || trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')) || ' ')"
    for variant, standard in license_scan.SPELLINGS:
        spaced = [_quote(" " + words.replace(" ", "  ") + " ") for words in (variant, standard)]
        out = f"replace({out}, {spaced[0]}, {spaced[1]})"
    return f"CASE WHEN {out} = '  ' THEN '' ELSE {out} END"


def _license_sql() -> str:
    known = ", ".join(f"({_quote(name)}, {_quote(text)})" for name, text in license_scan.KNOWN)
    return f"""
WITH known AS (SELECT md5({_canonical_sql('text')}) AS digest, min(license) AS license FROM (VALUES {known}) AS k(license, text) GROUP BY 1),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
whole AS (SELECT doc_id, {_canonical_sql('text')} AS form FROM docs),
lines AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)),
forms AS (SELECT doc_id, line, {_canonical_sql('line')} AS form FROM lines),
hits AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS found FROM forms JOIN known ON md5(form) = digest WHERE form <> '' GROUP BY doc_id)
SELECT w.doc_id, md5(form) AS digest, CASE WHEN form <> '' THEN license END AS license, coalesce(n, 0)::BIGINT AS n_license_lines, coalesce(found, '') AS line_licenses
FROM whole w LEFT JOIN known ON md5(form) = known.digest LEFT JOIN hits h ON w.doc_id = h.doc_id
"""


_MIX_SQL = """
WITH RECURSIVE size AS (SELECT source, sum(length(coalesce(text, ''))) AS chars, sqrt(count(*)) AS weight FROM documents GROUP BY source),
total AS (SELECT sum(chars)::DOUBLE AS goal, sum(weight) AS weight FROM size),
rates AS (SELECT source, CASE WHEN chars > 0 THEN size.weight * (goal / total.weight) / chars ELSE 0.0 END AS rate FROM size, total),
parts AS (SELECT source, rate, greatest(ceil(rate / 500), 1)::INTEGER AS draws, rate / greatest(ceil(rate / 500), 1) AS mean FROM rates WHERE rate > 0),
steps AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM parts
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM steps WHERE k < ceil(mean + 12 * sqrt(mean) + 40)
),
drawn AS (SELECT doc_id, d.source, text, unnest(range(1, draws + 1)) AS draw FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source),
hashed AS (SELECT *, (('0x' || md5('mix-1:' || CASE WHEN draw > 1 THEN 'draw:' ELSE '' END || doc_id || CASE WHEN draw > 1 THEN ':' || draw ELSE '' END)[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM drawn),
counted AS (SELECT d.doc_id, d.source, d.text, count(*) AS n FROM hashed d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.c < d.u GROUP BY ALL),
copies AS (SELECT doc_id, source, text, unnest(range(1, n + 1))::INTEGER AS copy_no FROM counted)
SELECT doc_id, source, copy_no, ('0x' || md5('mix-1:order:' || doc_id || ':' || copy_no)[1:13])::BIGINT AS shuffle_key, text FROM copies
"""

_CHAT_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {_quote(CONTROL_TEXT)} UNION ALL SELECT -1, 1, 'assistant', {_quote(CONTROL_TEXT)}
),
sized AS (SELECT *, length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) + length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '<\\n')) + {len(chat_format.START) + 1 + len(chat_format.END)} AS chars FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_LINES_SQL = """
WITH RECURSIVE raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS raw FROM documents),
filled AS (
  SELECT doc_id, line, raw, row_number() OVER (PARTITION BY doc_id ORDER BY raw) - 1 AS pos, length(trim(line)) - length(replace(trim(line), ' ', '')) >= 49 AS long FROM raw WHERE trim(line) <> ''
),
places AS (SELECT *, doc_id * 1048576 + pos AS place FROM filled),
named AS (SELECT *, min(place) OVER (PARTITION BY line) AS name, count(*) OVER (PARTITION BY line) AS n FROM places),
suffixes AS (SELECT doc_id, pos, place, name, long FROM named WHERE n > 1),
runs AS (
  SELECT doc_id, pos, place, 1 AS run, name FROM suffixes
  UNION ALL SELECT doc_id, pos, place, run, name FROM (
    SELECT r.doc_id, r.pos, r.place, r.run + 1 AS run, min(r.place) OVER (PARTITION BY r.name, s.name) AS name, count(*) OVER (PARTITION BY r.name, s.name) AS n
    FROM runs r JOIN suffixes s ON s.doc_id = r.doc_id AND s.pos = r.pos + r.run
  ) WHERE n > 1
),
longest AS (SELECT doc_id, pos, max(run) AS run FROM runs GROUP BY doc_id, pos),
starts AS (
  SELECT l.doc_id, l.pos FROM longest l LEFT JOIN longest b ON b.doc_id = l.doc_id AND b.pos = l.pos - 1
  WHERE coalesce(b.run, 0) <> l.run + 1 AND (l.run >= 2 OR EXISTS (SELECT 1 FROM suffixes s WHERE s.doc_id = l.doc_id AND s.pos = l.pos AND s.long))
),
later AS (SELECT doc_id, pos, name // 1048576 AS first_doc, name % 1048576 AS first_pos FROM runs WHERE run = 2 AND name <> place),
stay AS (SELECT DISTINCT doc_id, unnest([first_pos, first_pos + 1]) AS pos FROM later WHERE first_doc = doc_id),
copies AS (
  SELECT DISTINCT doc_id, unnest([pos, pos + 1]) AS pos FROM later WHERE first_doc <> doc_id
  UNION SELECT doc_id, pos FROM suffixes WHERE long AND name <> place
  UNION SELECT * FROM (SELECT DISTINCT doc_id, unnest([pos, pos + 1]) AS pos FROM later WHERE first_doc = doc_id) o ANTI JOIN stay USING (doc_id, pos)
),
marked AS (SELECT f.*, g.pos IS NOT NULL AS removed, s.pos IS NOT NULL AS begins FROM filled f LEFT JOIN copies g ON f.doc_id = g.doc_id AND f.pos = g.pos LEFT JOIN starts s ON f.doc_id = s.doc_id AND f.pos = s.pos),
opened AS (SELECT *, removed AND (begins OR NOT coalesce(lag(removed) OVER (PARTITION BY doc_id ORDER BY pos), false)) AS opens FROM marked),
counts AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed, count(*) FILTER (opens) AS n_runs FROM opened GROUP BY doc_id),
kept AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.raw) AS text FROM raw r LEFT JOIN marked m ON r.doc_id = m.doc_id AND r.raw = m.raw
  WHERE NOT coalesce(m.removed, false) GROUP BY r.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
  CASE WHEN coalesce(n_removed, 0) = 0 THEN d.text ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN counts c ON d.doc_id = c.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

ORACLES = {"op1_line_dedup": _LINES_SQL, "op3_topk_search": _TOPK_SQL, "op2_license_scan": _license_sql(), "op9_poisson_mix": _MIX_SQL, "op10_chat_format": _CHAT_SQL}
