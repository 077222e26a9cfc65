"""The registered queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricerank.llm import decontaminate, fingerprint, grid_join, lm_score, mixing, near_dup, preference, quality, runs, search, substring, token_counts, toxicity
from pricerank.llm.common import read


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("epochs")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS key FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM s0
), s2 AS (
  SELECT *, row_number() OVER o AS pos,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s1 WINDOW o AS (ORDER BY cap / w, source NULLS LAST)
), f AS (
  SELECT pos AS first_pos, level AS first_level FROM s2 WHERE level <= cap / w ORDER BY pos LIMIT 1
), s AS (
  SELECT source, source_size, CASE WHEN first_pos IS NULL OR pos < first_pos THEN cap ELSE first_level * w END AS target FROM s2 LEFT JOIN f ON true
), p AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS BIGINT) AS before
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(epochs * size + least(greatest(CAST(floor(target - epochs * source_size) AS BIGINT) - before, 0), size) AS BIGINT) AS taken FROM p
"""


def op2_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(read(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS ws FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)
), late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY ws ORDER BY doc_id, i) AS k FROM win) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def op4_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.report(read(spark, sf_dir, "conversations"))


OP4_SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), ends AS (
  SELECT conv_id, max(turn) AS e FROM t WHERE role = 'assistant' GROUP BY conv_id
), replies AS (
  SELECT t.conv_id, e, max(text) AS reply FROM t JOIN ends ON t.conv_id = ends.conv_id AND turn = e AND role = 'assistant' GROUP BY t.conv_id, e
), p AS (
  SELECT a.conv_id AS pair_id, a.e, b.reply AS other FROM replies a JOIN replies b ON b.conv_id = xor(a.conv_id, 1)
), c AS (
  SELECT pair_id, turn, role, text, CASE WHEN turn = e AND role = 'assistant' THEN other ELSE text END AS rtext FROM t JOIN p ON conv_id = pair_id WHERE turn <= e
), d AS (
  SELECT pair_id, min(turn) FILTER (WHERE text <> rtext) AS d FROM c GROUP BY pair_id
), m AS (
  SELECT c.*, d IS NULL OR turn < d AS common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS said, '<|' || role || '|>' || chr(10) || rtext || '<|end|>' || chr(10) AS rsaid FROM c JOIN d USING (pair_id)
)
SELECT pair_id, CAST(0 AS BIGINT) AS chunk, count(*) FILTER (WHERE common) AS n_prompt_turns,
  sha256(coalesce(string_agg(said, '' ORDER BY turn, role, text) FILTER (WHERE common), '')) AS prompt_sha256,
  sha256(coalesce(string_agg(said, '' ORDER BY turn, role, text) FILTER (WHERE NOT common), '')) AS chosen_sha256,
  sha256(coalesce(string_agg(rsaid, '' ORDER BY turn, role, rtext) FILTER (WHERE NOT common), '')) AS rejected_sha256,
  CAST(coalesce(sum(length(text) + 8) FILTER (WHERE NOT common AND role = 'assistant'), 0) AS BIGINT) AS chosen_trained,
  CAST(coalesce(sum(length(rtext) + 8) FILTER (WHERE NOT common AND role = 'assistant'), 0) AS BIGINT) AS rejected_trained
FROM m GROUP BY ALL
"""


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.components(read(spark, sf_dir, "documents"), n=2)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, w[i] || ' ' || w[i + 1] AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w) UNION ALL SELECT doc_id, w[1] FROM w WHERE len(w) = 1)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * k >= 80 * (p.n + q.n - k)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op6_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.components(read(spark, sf_dir, "embeddings"))


OP6_SQL = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL
), f AS (
  SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM f x JOIN f y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.93
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, w[i : i + least(10, len(w)) - 1] AS ws, least(10, len(w)) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
), occ AS (
  SELECT DISTINCT d.doc_id, d.i, win.n, win.item_id FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i, m.n FROM dw, (SELECT DISTINCT n FROM win) m) d JOIN win ON win.n = d.n AND d.i + d.n - 1 <= len(d.w) AND d.w[d.i : d.i + d.n - 1] = win.ws
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""

def op9_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.histogram(read(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.report(read(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(runs.with_periodic_tails(read(spark, sf_dir, "documents")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), d AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id
), g AS (
  SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, g GROUP BY term, big_n
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d USING (doc_id), g GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_hmm_score": op2_hmm_score,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_preference_pairs": op4_preference_pairs,
    "op5_near_dup": op5_near_dup,
    "op6_embedding_near_dup": op6_embedding_near_dup,
    "op7_quality": op7_quality,
    "op8_decontaminate": op8_decontaminate,
    "op9_token_lengths": op9_token_lengths,
    "op10_toxicity": op10_toxicity,
    "op11_fingerprints": op11_fingerprints,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": OP1_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op4_preference_pairs": OP4_SQL,
    "op5_near_dup": OP5_SQL,
    "op6_embedding_near_dup": OP6_SQL,
    "op8_decontaminate": OP8_SQL,
    "op13_ranked_search": OP13_SQL,
}
