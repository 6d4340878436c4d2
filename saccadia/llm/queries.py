"""The operators as queries over the test tables, and their SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from saccadia.llm import conversations, embed_dedup, interactions, language, licenses, linededup, lm, mixing, packing, quality, simhash, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_read(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(_read(spark, sf_dir, "embeddings"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_bitmaps(_read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.apply_rules(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(rows), rows)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_read(spark, sf_dir, "pages"))


def op13_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit_filters(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_packing, op3_mixing, op4_lm, op5_language, op6_embeddings, op7_lines, op8_toxicity, op9_licenses, op10_quality, op11_conversations, op12_warc, op13_interactions)}


_LINES = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.*, f.first IS NOT NULL AND k.doc_id <> f.first AS gone FROM keyed k LEFT JOIN firsts f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_QUALITY = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(len(ws) - 2)) AS i, ws FROM w WHERE len(ws) >= 3),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) AS n FROM g),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n >= 2) GROUP BY doc_id),
f AS (
  SELECT doc_id, text, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words
            OR 2 * n_dup_lines > len(string_split(text, chr(10))) OR word_chars > 15 * n_words OR word_chars < 2 * n_words
            OR length(regexp_replace(text, '[^\p{L}]', '', 'g')) * 2 < word_chars) AS kept
FROM f
"""


_CONVERSATIONS = r"""
WITH RECURSIVE bits AS (
  -- each character's code, then eight steps (-1) of the CRC
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         flatten(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                                lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS steps FROM conversations),
drawn AS (
  SELECT conv_id, turn, role, text,
         xor(4294967295, list_reduce(list_concat([4294967295], steps),
             lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) % 20 AS d FROM bits),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE d WHEN 3 THEN [1, 2] WHEN 0 THEN [] ELSE [1] END) AS copy FROM drawn),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS k,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare, left(role, 1) AS initial FROM damaged),
flagged AS (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd'
                 WHEN NOT right(bare, 1) IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair FROM placed),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1, 0) - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (NOT pair IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM flagged GROUP BY conv_id),
-- a state: (cost, audit, repaired); opened: with what may be inserted before the next turn
fold AS (
  SELECT conv_id, n, CAST(0 AS BIGINT) AS k, {'c': CAST(0 AS BIGINT), 'a': '', 'r': ''} AS e, {'c': CAST(1000000000 AS BIGINT), 'a': '', 'r': ''} AS s,
         {'c': CAST(3 AS BIGINT), 'a': 'I', 'r': chr(10) || 'user:'} AS u, {'c': CAST(6 AS BIGINT), 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'} AS a
  FROM facts
  UNION ALL
  SELECT conv_id, n, k, e, s, u, least(a, {'c': u.c + 3, 'a': u.a || 'I', 'r': u.r || chr(10) || 'assistant:'}) FROM (
   SELECT conv_id, n, k, e, s, least(u, {'c': v.c + 3, 'a': v.a || 'I', 'r': v.r || chr(10) || 'user:'}) AS u, a FROM (
    SELECT conv_id, n, k, e, s, u, a, least(e, s, a) AS v FROM (
     SELECT f.conv_id, f.n, t.k, {'c': e.c + 4, 'a': e.a || 'D', 'r': e.r} AS e,
            CASE WHEN stays AND initial = 's' THEN least({'c': s.c + 4, 'a': s.a || 'D', 'r': s.r}, {'c': e.c + late, 'a': e.a || 'K', 'r': e.r || line}) ELSE {'c': s.c + 4, 'a': s.a || 'D', 'r': s.r} END AS s,
            CASE WHEN NOT stays THEN {'c': u.c + 4, 'a': u.a || 'D', 'r': u.r}
                 WHEN initial = 'u' THEN least({'c': u.c + 4, 'a': u.a || 'D', 'r': u.r}, {'c': v.c + late, 'a': v.a || 'K', 'r': v.r || line})
                 ELSE least({'c': u.c + 4, 'a': u.a || 'D', 'r': u.r}, {'c': v.c + late + 3, 'a': v.a || 'R', 'r': v.r || chr(10) || 'user:' || text}) END AS u,
            CASE WHEN NOT stays THEN {'c': a.c + 4, 'a': a.a || 'D', 'r': a.r}
                 WHEN initial = 'a' THEN least({'c': a.c + 4, 'a': a.a || 'D', 'r': a.r}, {'c': u.c + late, 'a': u.a || 'K', 'r': u.r || line})
                 ELSE least({'c': a.c + 4, 'a': a.a || 'D', 'r': a.r}, {'c': u.c + late + 3, 'a': u.a || 'R', 'r': u.r || chr(10) || 'assistant:' || text}) END AS a
     FROM (SELECT *, least(e, s, a) AS v FROM fold) f
     JOIN (SELECT *, NOT fault IN ('b', 'd') AS stays, CASE fault WHEN 't' THEN 3 ELSE 0 END AS late, chr(10) || role || ':' || text AS line FROM flagged) t
       ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.k = f.k + 1)))),
ended AS (
  SELECT conv_id, least(e, a, {'c': s.c + 6, 'a': s.a || 'II', 'r': s.r || chr(10) || 'user:' || chr(10) || 'assistant:'},
                        {'c': u.c + 3, 'a': u.a || 'I', 'r': u.r || chr(10) || 'assistant:'}) AS best FROM fold WHERE k = n)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN ended x ON x.conv_id IS NOT DISTINCT FROM i.conv_id
"""


_WARC = r"""
WITH p AS (
  SELECT page_id, url, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
r AS (
  SELECT *, row_number() OVER w AS n, first_value(page_id) OVER w AS first FROM p
  WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN n > 1 AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND payload_bytes >= 100 THEN first END AS refers_to FROM r
"""


_INTERACTIONS = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT w.doc_id, part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
         {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws),
          'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
          'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)} AS f
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
cells AS (
  SELECT part, [x.filter FOR x IN [{'filter': 'A', 'is': f.A}, {'filter': 'B', 'is': f.B}, {'filter': 'C', 'is': f.C}, {'filter': 'D', 'is': f.D}, {'filter': 'E', 'is': f.E}] IF x.is] AS mask,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, s AS step, filter_order[s] AS filter, string_split(left(filter_order, s - 1), '') AS before FROM orders, unnest([1, 2, 3, 4, 5]) t(s)),
done AS (
  SELECT part, filter_order, step, filter, sum(n) AS total,
         sum(n) FILTER (list_has_any(mask, list_append(before, filter))) AS gone, sum(n) FILTER (list_contains(mask, filter)) AS failing,
         sum(n) FILTER (list_contains(mask, filter) AND NOT list_has_any(mask, before)) AS removed, sum(n) FILTER (mask = [filter]) AS alone,
         sum(good) FILTER (list_contains(mask, filter) AND NOT list_has_any(mask, before)) AS good_lost,
         sum(toxic) FILTER (list_contains(mask, filter) AND NOT list_has_any(mask, before)) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(total - coalesce(gone, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(failing, 0) - coalesce(removed, 0) AS BIGINT) AS redundant, CAST(coalesce(alone, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM done
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_interactions": _INTERACTIONS, "op12_warc": _WARC, "op11_conversations": _CONVERSATIONS, "op7_lines": _LINES, "op10_quality": _QUALITY}


__all__ = ["oracle_sql", "queries"]
