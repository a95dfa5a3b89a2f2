"""The corpus operators as queries over the whole tables, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from tessella.llm import embedding_join, license_scan, mixing, ngram_join, piecewise, quality_rules, substring_dedup, token_counts, toxicity, warc


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark, sf_dir):
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_license_scan(spark, sf_dir):
    return license_scan.license_scan(_table(spark, sf_dir, "documents")).drop("spans")


def op3_embedding_join(spark, sf_dir):
    return embedding_join.embedding_join(_table(spark, sf_dir, "embeddings"))


def op4_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op5_mixing(spark, sf_dir):
    return mixing.mix_to_targets(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_toxicity(spark, sf_dir):
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_warc(spark, sf_dir):
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op8_piecewise(spark, sf_dir):
    return piecewise.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_license_scan, op3_embedding_join, op4_ngram_join, op5_mixing, op6_toxicity, op7_warc, op8_piecewise, op9_quality_rules, op10_substring_dedup)}

_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
_STOPS = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)

_COMPONENTS = """
reach(id, root) AS (
  SELECT a, a FROM links UNION SELECT b, b FROM links UNION
  SELECT l.b, r.root FROM reach r JOIN both_ways l ON l.a = r.id WHERE r.root < l.b),
comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
"""

ORACLE_SQL = {
    "op3_embedding_join": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS s FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id < b.vec_id
  WHERE a.s > 0 AND b.s > 0 AND list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.93),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
{_COMPONENTS},
deg AS (SELECT a AS id, count(*) AS c FROM both_ways GROUP BY a)
SELECT v.vec_id, coalesce(deg.c, 0) AS n_links, coalesce(comp.root, v.vec_id) AS component_id,
       v.vec_id = coalesce(comp.root, v.vec_id) AS kept
FROM v LEFT JOIN deg ON deg.id = v.vec_id LEFT JOIN comp ON comp.id = v.vec_id
""",
    "op4_ngram_join": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, {_WORDS} AS ws FROM d),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM g GROUP BY doc_id),
same AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM same JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.c + y.c - o)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
{_COMPONENTS}
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, coalesce(comp.root, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.id = d.doc_id
""",
    "op7_warc": """
WITH d AS (SELECT page_id, url, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, octet_length(encode(t)) AS n, min(page_id) OVER (PARTITION BY t) AS origin FROM d),
r AS (SELECT *, page_id = origin AND row_number() OVER (PARTITION BY page_id, t ORDER BY url NULLS FIRST) = 1 AS is_first FROM f)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((('0x' || substr(h, CAST(1 + 5 * (k // 4) AS BIGINT), 5))::BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NULL OR is_first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NULL OR is_first THEN NULL ELSE origin END AS refers_to
FROM r
""",
    "op9_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS} AS ws FROM d),
g AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS lines,
         len(list_filter(ws, lambda x: x IN ({_STOPS}))) AS stops
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id),
r AS (
  SELECT *, CASE WHEN n_words = 0 THEN 0.0 ELSE CAST(word_chars AS DOUBLE) / n_words END AS a,
         CASE WHEN word_chars = 0 THEN 0.0 ELSE CAST(n_symbols AS DOUBLE) / word_chars END AS b,
         CASE WHEN n_words = 0 THEN 0.0 ELSE CAST(stops AS DOUBLE) / n_words END AS c,
         CASE WHEN lines = 0 THEN 0.0 ELSE CAST(n_dup_lines AS DOUBLE) / lines END AS e,
         CASE WHEN n_words = 0 THEN 0.0 ELSE CAST(n_repeat_words AS DOUBLE) / n_words END AS f,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(f"{dict(mean_word_chars='a', symbol_ratio='b', stop_ratio='c', dup_line_ratio='e', repeat_ratio='f')[m]} {op} {v}" for m, low, high in quality_rules.THRESHOLDS for op, v in ((">=", low), ("<=", high)) if v is not None)} AS kept,
       round(a, 6) AS mean_word_chars, round(b, 6) AS symbol_ratio, round(c, 6) AS stop_ratio,
       round(e, 6) AS dup_line_ratio, round(f, 6) AS repeat_ratio
FROM r
""",
    "op10_substring_dedup": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, {_WORDS} AS ws FROM d),
g AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM g) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM again),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS k
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) x
  LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p WHERE gone.p IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(cut.n, 0) AS n_removed, sha256(coalesce(kept.k, '')) AS kept_sha256
FROM w LEFT JOIN cut ON cut.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
""",
}
