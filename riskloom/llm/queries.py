"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import (
    decontaminate, exact_dedup, graph_search, language_id, minhash, mixing, sharding, suffix_dedup, token_pack, toxicity,
    url_filter, vector_codes, whitening,
)
from riskloom.llm.common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_digest(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.even_tree(16)
    return sharding.sharded(table(spark, sf_dir, "documents"), tree, sharding.grown(tree, 16))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op7_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_pack.token_digests(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op11_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.neighbours(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening(table(spark, sf_dir, "embeddings"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_url_filter, op2_language_id, op3_decontaminate, op4_toxicity, op5_sharding, op6_mixing, op7_token_pack,
        op8_suffix_dedup, op9_exact_dedup, op10_minhash, op11_graph_search, op12_vector_codes, op13_whitening,
    )
    return {f.__name__: f for f in found}


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
    substr(md5(concat('mix', doc_id)), 1, 16) AS k
  FROM documents
), sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM sums
), ordered AS (
  SELECT *, source_size / w AS r,
    (1.5 * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM ranked
), targets AS (
  SELECT source, source_size, CASE WHEN level * w >= 2 * source_size THEN 2.0 * source_size
    ELSE w * (SELECT arg_min(level, r) FROM ordered WHERE level * w < 2 * source_size) END AS target
  FROM ordered
), placed AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized
)
SELECT p.doc_id, p.size::BIGINT AS size, t.source_size, t.target::DOUBLE AS target,
  CAST(CASE WHEN t.source_size = 0 THEN 0 ELSE floor(floor(t.target) / t.source_size) * p.size
    + greatest(0, least(p.size, floor(t.target) - floor(floor(t.target) / t.source_size) * t.source_size - p.before)) END AS BIGINT) AS taken
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
"""

OP9_SQL = r"""
WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM norm WINDOW w AS (PARTITION BY t)
"""

OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
least_of AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN least_of l ON l.x = s.doc_id
"""

OP12_SQL = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS p FROM kept, range(16) r(part)
), book0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, p AS c FROM parts QUALIFY e < 64),
near0 AS (
  SELECT vec_id, part, any_value(p) AS p, min(CAST(list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 64 + e) AS k
  FROM parts JOIN book0 USING (part) GROUP BY vec_id, part
), flat0 AS (SELECT part, k % 64 AS e, unnest(p) AS x, unnest(range(len(p))) AS i FROM near0),
mean0 AS (SELECT part, e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM flat0 GROUP BY part, e, i),
move0 AS (SELECT part, e, list(m ORDER BY i) AS c FROM mean0 GROUP BY part, e),
book1 AS (SELECT part, e, coalesce(m.c, b.c) AS c FROM book0 b LEFT JOIN move0 m USING (part, e)),
near1 AS (
  SELECT vec_id, part, any_value(p) AS p, min(CAST(list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 64 + e) AS k
  FROM parts JOIN book1 USING (part) GROUP BY vec_id, part
), flat1 AS (SELECT part, k % 64 AS e, unnest(p) AS x, unnest(range(len(p))) AS i FROM near1),
mean1 AS (SELECT part, e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM flat1 GROUP BY part, e, i),
move1 AS (SELECT part, e, list(m ORDER BY i) AS c FROM mean1 GROUP BY part, e),
book2 AS (SELECT part, e, coalesce(m.c, b.c) AS c FROM book1 b LEFT JOIN move1 m USING (part, e)),
near2 AS (
  SELECT vec_id, part, min(CAST(list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 64 + e) AS k
  FROM parts JOIN book2 USING (part) GROUP BY vec_id, part
), coded AS (
  SELECT vec_id, string_agg(printf('%02x', k % 64), '' ORDER BY part) AS code, CAST(sum(k // 64) AS BIGINT) AS error FROM near2 GROUP BY vec_id
), books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS h FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded JOIN kept USING (vec_id), books
"""


def all_sql() -> dict[str, str]:
    return {"op6_mixing": OP6_SQL, "op9_exact_dedup": OP9_SQL, "op10_minhash": OP10_SQL, "op12_vector_codes": OP12_SQL}
