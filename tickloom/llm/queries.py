"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm import decontam, divergence, hmm, html_text, langid, minhash, packing, quality, secrets, tiff, tokenbin, toolcalls, whitening
from tickloom.llm.common import remainder, small_batches

THRESHOLD = 0.3  # quality scores from here on count as label 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, threshold=0.8)


def quality_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled texts that may be learned from: doc_id, text, label."""
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("label"))
    return docs.where(remainder(F.col("doc_id"), 5) != 0).select("doc_id", "text").join(marked, "doc_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(quality_rows(docs, table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), quality.scorer(spark, model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=1))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 10) == 0)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pages = tiff.read_pages(tiff.store_texts(docs))
    number = lambda c: F.format_string("%.4f", c)
    feature = F.concat_ws(";", F.concat_ws("x", "width", "height"), F.concat(F.lit("compression "), "compression"), F.when(F.col("tiled"), "tiles").otherwise("strips"),
                          F.concat(F.lit("mean "), number("mean")), F.concat(F.lit("deviation "), number("deviation")), F.concat(F.lit("entropy "), number("entropy")))
    pixels = F.col("pixels")
    return pages.select(
        "doc_id", "n_bytes", F.length(pixels).cast("long").alias("payload_bytes"), F.sha2(pixels, 256).alias("payload_sha256"),
        F.crc32(F.substring(pixels, -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"))


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.from_turns(table(spark, sf_dir, "conversations"))
    return toolcalls.link(calls, results, toolcalls.turn_schemas(spark))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    profiles = langid.train_profiles(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), langid.predictor(profiles)("text").alias("language"))
    return found.select("doc_id", "held_out", "language.lang_pred", "language.score")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_near_duplicates, op2_quality, op3_decontamination, op4_packing, op5_language_model, op6_token_files, op7_html_text, op8_tiff, op9_tool_calls, op10_language_id,
           op11_divergence, op12_whitening, op13_secrets]
    return {f.__name__: f for f in own}


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), pairs AS (
  SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM words
), sets AS MATERIALIZED (
  SELECT doc_id, w[i] || ' ' || w[i + 1] AS s FROM pairs
  UNION
  SELECT doc_id, w[1] FROM words WHERE len(w) = 1
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  WHERE 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n)
  GROUP BY x.doc_id, y.doc_id, p.n, q.n
  HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), both_ways AS MATERIALIZED (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a AS doc_id, b AS other FROM both_ways
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON r.other = l.a
), least_of AS (
  SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(m.m, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_of m ON m.doc_id = d.doc_id
"""

OP9_SQL = r"""
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS call_id, CASE role WHEN 'system' THEN 'configure' ELSE 'reply' END AS name, text,
         CASE WHEN length(text) % 11 <> 0 THEN CASE WHEN length(text) % 3 = 0 THEN split_part(text, ' ', 1) ELSE length(text)::VARCHAR END END AS lim,
         substr(md5(turn || ':' || coalesce(text, '')), 1, 1) AS digit
  FROM conversations WHERE role IN ('system', 'user')
), wanted AS (
  SELECT *, CASE WHEN digit IN ('0', '1', '2', '3') AND turn >= 2 THEN turn - 2 WHEN digit IN ('e', 'f') THEN turn + 2 END AS wants FROM calls
), turns AS (
  SELECT DISTINCT conv_id, turn FROM calls
), edges AS (
  SELECT DISTINCT w.conv_id, w.turn, w.wants FROM wanted w JOIN turns t ON t.conv_id = w.conv_id AND t.turn = w.wants
), walk AS (
  SELECT conv_id, turn, turn AS at, 0 AS depth, [turn] AS path, false AS loops FROM turns WHERE conv_id IN (SELECT conv_id FROM edges WHERE wants >= turn)
  UNION ALL
  SELECT w.conv_id, w.turn, e.wants, w.depth + 1, list_append(w.path, e.wants), list_contains(w.path, e.wants)
  FROM walk w JOIN edges e ON e.conv_id = w.conv_id AND e.turn = w.at WHERE NOT w.loops
), levels AS (
  SELECT conv_id, turn, bool_or(loops) AS cyclic, CASE WHEN bool_or(loops) THEN 0 ELSE max(depth) END AS level FROM walk GROUP BY conv_id, turn
), results AS (
  SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, count(*) AS n_results, min(text) AS content
  FROM conversations WHERE role = 'assistant' GROUP BY ALL
), numbered AS (
  SELECT c.*, coalesce(r.n_results, 0) AS n_results, r.content, coalesce(l.cyclic, false) AS cyclic,
         row_number() OVER (PARTITION BY c.conv_id ORDER BY coalesce(l.cyclic, false), coalesce(l.level, 0), c.turn, c.call_id) - 1 AS seq,
         count(*) OVER (PARTITION BY c.conv_id, c.call_id) AS times, c.wants IS NOT NULL AND t.turn IS NULL AS absent
  FROM wanted c LEFT JOIN results r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
  LEFT JOIN levels l ON l.conv_id = c.conv_id AND l.turn = c.turn LEFT JOIN turns t ON t.conv_id = c.conv_id AND t.turn = c.wants
)
SELECT conv_id, call_id, name, turn AS position, seq::BIGINT AS seq, n_results::BIGINT AS n_results,
       concat_ws('; ', CASE WHEN times > 1 THEN 'duplicate id' END, CASE WHEN lim IS NULL AND name = 'reply' THEN 'missing limit' END,
                 CASE WHEN text IS NULL THEN 'missing prompt' END, CASE WHEN NOT regexp_full_match(lim, '-?(0|[1-9][0-9]*)') THEN 'wrong type limit' END,
                 CASE WHEN absent THEN 'no call ' || conv_id || ':' || wants END, CASE WHEN cyclic THEN 'cycle' END,
                 CASE WHEN n_results = 0 THEN 'no result' WHEN n_results > 1 THEN 'several results' END) AS errors,
       '{"arguments":{' || coalesce('"limit":' || to_json(lim)::VARCHAR || ',', '') || coalesce('"prompt":' || to_json(text)::VARCHAR || ',', '')
         || '"turn":"' || turn || '"},"id":"' || call_id || '","name":"' || name || '",'
         || coalesce('"result":' || to_json(content)::VARCHAR || ',', '') || '"seq":' || seq || '}' AS json
FROM numbered
UNION ALL
SELECT e.conv_id, e.call_id, NULL, NULL, NULL, e.n, CASE WHEN t.turn IS NULL THEN 'no call' ELSE 'further result' END,
       '{' || concat_ws(',', '"id":' || to_json(e.call_id)::VARCHAR, '"result":' || to_json(e.content)::VARCHAR) || '}'
FROM (SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, text AS content, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL) e
LEFT JOIN results r ON r.conv_id = e.conv_id AND r.call_id = e.call_id
LEFT JOIN (SELECT DISTINCT conv_id, turn FROM calls) t ON t.conv_id = e.conv_id AND t.conv_id || ':' || t.turn = e.call_id
WHERE t.turn IS NULL OR e.content IS DISTINCT FROM r.content
"""


OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), words AS (
  SELECT lang, source, doc, unnest(w) AS term FROM docs
), kept AS MATERIALIZED (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), counts AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL
), vocabulary AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), totals AS (
  SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL
), whole AS (
  SELECT lang, sum(n) AS n FROM totals GROUP BY lang
), groups AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(t.n, 0)::HUGEINT AS n, coalesce(w.n, 0)::HUGEINT AS lang_n
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN vocabulary USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN whole w ON w.lang = g.lang
), in_lang AS (
  SELECT lang, term, sum(c) AS c FROM counts GROUP BY ALL
), shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (g.n + 5 * g.v) AS p,
         1 + (1000000000::HUGEINT * (l.c + 5)) // (g.lang_n + 5 * g.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN in_lang l ON l.lang = k.lang AND l.term = k.term
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM found
)
SELECT lang, source, part, item, value::BIGINT AS value, r::INTEGER AS rank FROM ranked WHERE part = 'pair' OR r <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_duplicates": OP1_SQL, "op9_tool_calls": OP9_SQL, "op11_divergence": OP11_SQL}
