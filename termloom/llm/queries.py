"""The numbered operators as queries over the driver's tables, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import bpe, hard_negatives, licenses, lsh_forest, metric_join, mixing, sentence_spans, sentencepiece_table, suffix_dedup, token_counts, toxicity, transport_stream, turn_repair
from termloom.llm.common import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


@query("op5_mix_sources", r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '') || '|' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (
  SELECT source, source_size, cap, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(3 * sum(size) AS DOUBLE) AS cap FROM d GROUP BY source)),
l AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER p, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0.0)) AS level
  FROM s WINDOW p AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, k) AS final FROM l WHERE level <= cap / w),
o AS (
  SELECT l.*, max(CAST(level <= cap / w AS INT)) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM l),
t AS (SELECT source, source_size, CASE WHEN open = 1 THEN least(final * w, cap) ELSE cap END AS target FROM o CROSS JOIN f),
g AS (
  SELECT source, source_size, target, CAST(round(target) AS BIGINT) AS goal,
         CASE WHEN source_size > 0 THEN CAST(floor(CAST(round(target) AS DOUBLE) / source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM t)
SELECT d.doc_id, d.size, g.source_size, g.target,
  CAST(g.epochs * d.size + greatest(0, least(d.size, g.goal - g.epochs * g.source_size - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
""")
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


@query("op7_transport_streams")
def op7_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.digest_media(transport_stream.store_texts(documents(spark, sf_dir)))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


@query("op3_embedding_near_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS reached FROM v UNION SELECT l.b, r.reached FROM r JOIN l ON r.node = l.a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(any_value(n.n_links), 0) AS BIGINT) AS n_links, min(r.reached) AS component_id, v.vec_id = min(r.reached) AS kept
FROM v JOIN r ON r.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id GROUP BY v.vec_id
""")
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(documents(spark, sf_dir))
    return found.select("doc_id", "n_licenses", F.concat_ws(",", "licenses").alias("licenses"), F.concat_ws(",", "rules").alias("rules"))


@query("op2_sentence_spans")
def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.scan(documents(spark, sf_dir))


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.scan(documents(spark, sf_dir))


@query("op4_jaccard_join", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE k >= 0.8 * (x.n + y.n - k)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT l.b, r.reached FROM r JOIN l ON r.node = l.a),
d AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT r.node AS doc_id, min(r.reached) AS class_id, CAST(coalesce(any_value(d.n_links), 0) AS BIGINT) AS n_links, r.node = min(r.reached) AS kept FROM r LEFT JOIN d ON d.a = r.node GROUP BY r.node
""")
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.classes(documents(spark, sf_dir))


@query("op11_sentencepiece")
def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_table.encode_decode(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


@query("op12_hard_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank,
  s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


@query("op13_turn_repair", r"""
WITH RECURSIVE
t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
k AS (SELECT DISTINCT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (
  SELECT conv_id, turn, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) % 256 AS INT) + 1])), 4294967295) % 20 AS h
  FROM k, t),
d AS (
  SELECT c.conv_id AS conv, c.turn, CASE WHEN h = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(CASE WHEN h = 0 THEN [] WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM conversations c JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id AND h.turn IS NOT DISTINCT FROM c.turn),
o AS (SELECT *, row_number() OVER w AS p, lag(left(role, 1)) OVER w AS was FROM d WINDOW w AS (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text)),
r AS (
  SELECT conv, turn, role, text, p, left(role, 1) AS i, was, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut,
    CASE WHEN cut = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY p) > 1 THEN 'duplicate' WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM o),
m(s, e, i, s2) AS (VALUES ('', 'K', 's', 's'), ('', 'K', 'u', 'u'), ('s', 'K', 'u', 'u'), ('u', 'K', 'a', 'a'), ('a', 'K', 'u', 'u'), ('', 'R', '', 'u'), ('s', 'R', '', 'u'), ('u', 'R', '', 'a'), ('a', 'R', '', 'u'), ('', 'D', '', ''), ('s', 'D', '', 's'), ('u', 'D', '', 'u'), ('a', 'D', '', 'a')),
n(s, s2, l) AS (VALUES ('', '', ''), ('s', 's', ''), ('u', 'u', ''), ('a', 'a', ''), ('', 'u', 'I'), ('s', 'u', 'I'), ('u', 'a', 'I'), ('a', 'u', 'I'), ('', 'a', 'II'), ('s', 'a', 'II')),
z AS (
  SELECT conv, CAST(0 AS BIGINT) AS p, n.s2 AS s, {'cost': CAST(2 * length(l) AS BIGINT), 'audit': l} AS v FROM (SELECT DISTINCT conv FROM r), n WHERE n.s = ''
  UNION ALL
  SELECT z.conv, r.p, n.s2, min({'cost': CAST(z.v.cost + CASE m.e WHEN 'K' THEN 0 WHEN 'R' THEN 2 ELSE 3 END + CASE WHEN m.e <> 'D' AND r.fault = 'truncated' THEN 1 ELSE 0 END + 2 * length(n.l) AS BIGINT), 'audit': z.v.audit || m.e || n.l})
  FROM z JOIN r ON r.conv IS NOT DISTINCT FROM z.conv AND r.p = z.p + 1
  JOIN m ON m.s = z.s AND (m.e <> 'K' OR m.i = r.i) AND (m.e = 'D' OR r.fault NOT IN ('blank', 'duplicate')) JOIN n ON n.s = m.s2
  GROUP BY ALL),
f AS (SELECT conv, min(v) AS v FROM (SELECT * FROM z QUALIFY p = max(p) OVER (PARTITION BY conv)) WHERE s IN ('', 'a') GROUP BY conv),
l AS (SELECT conv, v.audit AS audit, unnest(range(1, length(v.audit) + 1)) AS k FROM f),
x AS (SELECT conv, k, substr(audit, k, 1) AS e, sum(CASE WHEN substr(audit, k, 1) = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv ORDER BY k) AS p FROM l),
y AS (
  SELECT x.conv, k, e, r.role, r.text, row_number() OVER q AS place, first_value(e = 'K' AND r.i = 's') OVER q AS system
  FROM x LEFT JOIN r ON r.conv IS NOT DISTINCT FROM x.conv AND r.p = x.p AND e <> 'I' WHERE e <> 'D' WINDOW q AS (PARTITION BY x.conv ORDER BY k)),
g AS (
  SELECT conv, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (place - CAST(system AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS sha
  FROM y GROUP BY conv),
c AS (
  SELECT conv, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (p > 1 AND was || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(f.v.cost, 0) AS cost, coalesce(f.v.audit, '') AS audit, coalesce(g.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv IS NOT DISTINCT FROM a.conv_id LEFT JOIN f ON f.conv IS NOT DISTINCT FROM a.conv_id LEFT JOIN g ON g.conv IS NOT DISTINCT FROM a.conv_id
""")
def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turn_repair.repair(turn_repair.damage(turns), turns)
