"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiwave.llm import (
    bpe, chat_format, conversation_repair, embedding_dedup, html_extract, license_scan, line_dedup, ngram_join, packing, quality, quality_qda,
    url_filter, whitening,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_compression_bands(spark, sf_dir):
    return quality.quality_table(table(spark, sf_dir, "documents"))


def op4_trie_bpe(spark, sf_dir):
    return bpe.encode_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)


def op9_template_slots(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages")).drop("blocks")


def op10_url_regression(spark, sf_dir):
    model = url_filter.train_url_model(url_filter.labelled_urls(spark))
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), model)


def op1_viterbi_roles(spark, sf_dir):
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op2_vector_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_epsilon_grid_join(spark, sf_dir):
    return embedding_dedup.embedding_links(table(spark, sf_dir, "embeddings"))


def op6_template_automata(spark, sf_dir):
    return license_scan.scan_table(table(spark, sf_dir, "documents")).drop("spans")


def op7_vertical_jaccard(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), ngram_join.JaccardJoin(words=3, percent=90))


def op8_levelled_line_runs(spark, sf_dir):
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_target_alignment(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_digest(conversation_repair.damaged(turns), turns)


def op12_quadratic_discriminant(spark, sf_dir):
    return quality_qda.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_incremental_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def base_quality_counts(spark, sf_dir):
    """What SQL can say of op3: the base counts."""
    return op3_compression_bands(spark, sf_dir).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )


def base_licence_places(spark, sf_dir):
    """What SQL can say of op6: the places of the base phrases."""
    return op6_template_automata(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def ruled_urls(spark, sf_dir):
    """What SQL can say of op10: parts of URLs, their rules, and the verdicts of these."""
    judged = op10_url_regression(spark, sf_dir)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


QUERIES = {f.__name__: f for f in (
    op1_viterbi_roles, op2_vector_packing, op3_compression_bands, op4_trie_bpe, op5_epsilon_grid_join, op6_template_automata,
    op7_vertical_jaccard, op8_levelled_line_runs, op9_template_slots, op10_url_regression, op11_target_alignment,
    op12_quadratic_discriminant, op13_incremental_whitening, base_quality_counts, base_licence_places, ruled_urls,
)}


ORACLES: dict[str, str] = {
    "op8_levelled_line_runs": r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id < c.last_doc AS gone FROM keyed k LEFT JOIN common c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op5_epsilon_grid_join": """
WITH RECURSIVE l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93
), r(vec_id, c) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.c
)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id) m USING (vec_id)
""",
    "op7_vertical_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
""",
}

ORACLES["op11_target_alignment"] = r"""
WITH RECURSIVE bits AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c
    FROM range(256) r(b))
), marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
           lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295), 4294967295) % 20 AS k
  FROM conversations, bits
), dam AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM marked WHERE k <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM dam
), faulty AS (
  SELECT conv_id, turn, role, text, p, left(role, 1) AS i, CASE WHEN body = '' THEN 'blank'
           WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate'
           WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS f,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS before
  FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'blank') AS blank,
         count(*) FILTER (f = 'duplicate') AS duplicate, count(*) FILTER (f = 'truncated') AS truncated,
         count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(p) AS n
  FROM faulty GROUP BY conv_id
), steps AS (
  -- The best (cost, audit) of each state of the grammar after p turns: n nothing, s system, u user, a assistant.
  SELECT conv_id, 0::BIGINT AS p, {'c': 0::BIGINT, 'a': ''} AS n, {'c': 1000000::BIGINT, 'a': ''} AS s,
         {'c': 3::BIGINT, 'a': 'I'} AS u, {'c': 6::BIGINT, 'a': 'II'} AS a FROM counts
  UNION ALL
  SELECT conv_id, p, n, s, list_min([u, {'c': n.c + 3, 'a': n.a || 'I'}, {'c': s.c + 3, 'a': s.a || 'I'}, {'c': a.c + 3, 'a': a.a || 'I'}]),
         list_min([a, {'c': u.c + 3, 'a': u.a || 'I'}, {'c': n.c + 6, 'a': n.a || 'II'}, {'c': s.c + 6, 'a': s.a || 'II'}])
  FROM (
    SELECT t.conv_id, t.p + 1 AS p, {'c': t.n.c + 4, 'a': t.n.a || 'D'} AS n,
           list_min([{'c': t.s.c + 4, 'a': t.s.a || 'D'}, {'c': CASE WHEN gone OR i <> 's' THEN 1000000 ELSE t.n.c + x END, 'a': t.n.a || 'K'}]) AS s,
           list_min([{'c': t.u.c + 4, 'a': t.u.a || 'D'}, {'c': t.n.c + tou, 'a': t.n.a || eu}, {'c': t.s.c + tou, 'a': t.s.a || eu}, {'c': t.a.c + tou, 'a': t.a.a || eu}]) AS u,
           list_min([{'c': t.a.c + 4, 'a': t.a.a || 'D'}, {'c': t.u.c + toa, 'a': t.u.a || ea}]) AS a
    FROM steps t JOIN (
      SELECT conv_id, p, i, f IN ('blank', 'duplicate') AS gone, CASE WHEN f = 'truncated' THEN 3 ELSE 0 END AS x,
             CASE WHEN f IN ('blank', 'duplicate') THEN 1000000 WHEN i = 'u' THEN x ELSE 3 + x END AS tou, CASE WHEN i = 'u' THEN 'K' ELSE 'R' END AS eu,
             CASE WHEN f IN ('blank', 'duplicate') THEN 1000000 WHEN i = 'a' THEN x ELSE 3 + x END AS toa, CASE WHEN i = 'a' THEN 'K' ELSE 'R' END AS ea
      FROM faulty) r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.p = t.p + 1)
), best AS (
  SELECT t.conv_id, list_min([t.n, t.a]) AS b FROM steps t JOIN counts c ON c.conv_id IS NOT DISTINCT FROM t.conv_id AND c.n = t.p
), edits AS (
  SELECT conv_id, b.c AS cost, b.a AS audit, unnest(string_split(b.a, '')) AS e, generate_subscripts(string_split(b.a, ''), 1) AS q FROM best
), walked AS (
  -- The k-th edit that is no insertion meets the k-th turn; the made turns alternate after a kept system turn.
  SELECT e.*, count(*) FILTER (e <> 'I') OVER w AS p, count(*) FILTER (e <> 'D') OVER w AS m FROM edits e WINDOW w AS (PARTITION BY conv_id ORDER BY q)
), said AS (
  SELECT w.conv_id, w.q, w.m, w.e, f.role, f.text, max(CASE WHEN w.m = 1 AND w.e = 'K' AND f.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY w.conv_id) AS lead
  FROM walked w LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.p = w.p AND w.e <> 'I' WHERE w.e <> 'D'
), repaired AS (
  SELECT conv_id, sha256(string_agg((CASE WHEN e = 'K' THEN role WHEN (m - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || coalesce(text, ''), chr(10) ORDER BY q)) AS h
  FROM said GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(b.b.c, 0) AS cost, coalesce(b.b.a, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""

ORACLES["base_quality_counts"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), g AS (
  SELECT doc_id, i, hash(w[i:i + 7]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), again AS (
  SELECT doc_id, h FROM g GROUP BY doc_id, h HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest(range(g.i, g.i + 8)) AS p FROM g JOIN again USING (doc_id, h)) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
       length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
       coalesce(n, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(n, 0) > 30 * len(w) AS base_failed
FROM d LEFT JOIN covered USING (doc_id)
"""

ORACLES["base_licence_places"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), found AS (
  SELECT doc_id, p[1] AS label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + len(p) - 2] = p[2:])) AS i
  FROM d, (VALUES (['cc-by', 'cc', 'by']), (['gpl', 'general', 'public', 'license']), (['reserved', 'all', 'rights', 'reserved'])) AS v(p)
), places AS (
  SELECT doc_id, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM found GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(labels, '') AS base_labels
FROM d LEFT JOIN places USING (doc_id)
"""

ORACLES["ruled_urls"] = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages
), r(h, p, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
)
SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, host, path
"""

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
