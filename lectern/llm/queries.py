"""The ten operators applied to their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import share_code
from . import ann, html_extract, jaccard_join, langid, licenses, mixing, packing, quality, suffix_dedup, toxicity

from .license_templates import TEMPLATES


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return share_code(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.ngram_jaccard_join(_read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_read(spark, sf_dir, "embeddings"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_cascade(_read(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_language_id": op3_language_id,
    "op4_packing": op4_packing,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_mixing": op6_mixing,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_quality_rules": op8_quality_rules,
    "op9_html_extraction": op9_html_extraction,
    "op10_license_scans": op10_license_scans,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS c FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM p JOIN n m ON m.doc_id = x JOIN n k ON k.doc_id = y
  WHERE CAST(shared AS DOUBLE) / CAST(m.c + k.c - shared AS DOUBLE) >= 0.5
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS c, x AS y FROM e UNION SELECT r.c, e.y FROM r JOIN e ON e.x = r.y WHERE r.c < e.y),
c AS (SELECT y, min(c) AS class_id FROM r GROUP BY 1),
k AS (SELECT x, count(*) AS links FROM e GROUP BY 1)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(k.links, 0) AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN c ON c.y = d.doc_id LEFT JOIN k ON k.x = d.doc_id
""",
    "op5_suffix_array_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), g AS (
  SELECT doc_id, i - 1 AS pos, md5(array_to_string(ws[i : i + 49], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), m AS (
  SELECT doc_id, pos, first_value(doc_id) OVER o AS f, first_value(pos) OVER o AS p
  FROM g WINDOW o AS (PARTITION BY k ORDER BY doc_id, pos)
), l AS (
  SELECT *, CASE WHEN lag(pos) OVER d = pos - 1 AND lag(f) OVER d = f AND lag(p) OVER d = p - 1 THEN 0 ELSE 1 END AS fresh
  FROM m WHERE doc_id <> f OR pos <> p WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM l)
SELECT doc_id, CAST(min(pos) AS BIGINT) AS start_word, CAST(max(pos) + 50 AS BIGINT) AS end_word, min(f) AS first_doc_id, CAST(min(p) AS BIGINT) AS first_start_word
FROM s GROUP BY doc_id, span
""",
    "op8_quality_rules": r"""
WITH t AS (
  SELECT doc_id, text, length(text) AS n,
    list_filter(string_split_regex(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l,
    2 * length(text) - length(replace(text, ' ', '')) - length(replace(text, chr(10), '')) AS g
  FROM documents
)
SELECT doc_id, coalesce(NOT (
  trim(text) = ''
  OR length(regexp_replace(text, '[^#*&%$|~^<>{}=+\\]+', '', 'g')) > 0.05 * n
  OR n - length(replace(text, '!', '')) > 0.05 * n
  OR length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) > 0.4 * n
  OR length(regexp_replace(text, '[^0-9]+', '', 'g')) > 0.3 * n
  OR n - length(replace(text, chr(65533), '')) > 0.01 * n
  OR n - g NOT BETWEEN 1.5 * (g + 1) AND 25 * (g + 1)
  OR len(string_split_regex(text, '(\.\.\.|…)\n')) - 1 > 0.3 * len(string_split(text, chr(10)))
  OR len(string_split_regex(text, '\n[ \t]*[-*•]')) - 1 > 0.9 * len(string_split(text, chr(10)))
  OR (len(l) >= 4 AND len(list_distinct(l)) < 0.5 * len(l))
  OR (len(w) >= 20 AND len(list_distinct(w)) < 0.3 * least(len(w), sqrt(1000 * len(w))))
  OR (len(w) >= 5 AND len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) > 0.3 * len(w))
), false) AS keep
FROM t
""",
    "op10_license_scans": r"""
WITH t(i, license, body) AS (VALUES @@TEMPLATES@@),
s AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS body FROM documents
  UNION ALL SELECT doc_id, unnest(string_split_regex(text, '\n\s*\n')) FROM documents
  UNION ALL SELECT doc_id, text FROM documents
), w AS (
  SELECT row_number() OVER () AS k, doc_id, '' AS license, list_filter(string_split_regex(lower(body), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS v FROM s
  UNION ALL SELECT -i, NULL, license, list_filter(string_split_regex(lower(body), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: x <> '') FROM t
), b AS (SELECT DISTINCT k, doc_id, license, v[i] || ' ' || v[i + 1] AS g FROM (SELECT *, unnest(range(1, len(v))) AS i FROM w)),
n AS (SELECT k, count(*) AS c FROM b GROUP BY 1),
d AS (
  SELECT x.k, x.doc_id, y.license, 2 * count(*) / CAST(any_value(m.c) + any_value(o.c) AS DOUBLE) AS dice
  FROM b x JOIN b y ON x.g = y.g AND x.k > 0 AND y.k < 0 JOIN n m ON m.k = x.k JOIN n o ON o.k = y.k GROUP BY x.k, x.doc_id, y.k, y.license
), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY dice DESC, license) AS r FROM d)
SELECT doc_id, license, max(dice) AS dice FROM f WHERE r = 1 AND dice >= 0.8 GROUP BY doc_id, license
""".replace("@@TEMPLATES@@", ", ".join(f"({i}, '{n}', '{t.replace(chr(39), chr(39) * 2)}')" for i, (n, t) in enumerate(TEMPLATES, 1))),
    "op6_mixing": r"""
WITH base AS (
  SELECT doc_id, coalesce('d' || CAST(TRY_CAST(regexp_extract(source, '[0-9]+') AS BIGINT) % 4 AS VARCHAR), 'other') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len(list_filter(string_split_regex(text, '[ \t\n\v\f\r]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens
  FROM documents
), leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS t, CAST(2 * sum(n_tokens) AS DOUBLE) AS cap FROM base GROUP BY ALL),
dom AS (SELECT domain, sum(cap) AS cap, CASE domain WHEN 'd0' THEN 0.4::DOUBLE WHEN 'd1' THEN 0.3 WHEN 'd2' THEN 0.2 ELSE 0.1 END AS w FROM leaf GROUP BY 1),
lng AS (SELECT domain, lang, sum(cap) AS cap, CASE lang WHEN 'en' THEN 0.5::DOUBLE WHEN 'de' THEN 0.2 WHEN 'fr' THEN 0.2 WHEN 'es' THEN 0.1 ELSE 1 END AS w FROM leaf GROUP BY 1, 2),
b0 AS (SELECT least(sum(cap), sum(cap) / 2) AS b FROM leaf),
d1 AS (SELECT dom.*, b, coalesce(sum(cap) OVER p, 0) AS filled, sum(w) OVER q AS open FROM dom, b0
       WINDOW p AS (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
d2 AS (SELECT *, (SELECT (b - filled) / open FROM d1 x WHERE (b - filled) / open <= cap / w ORDER BY cap / w, domain LIMIT 1) AS level FROM d1),
qd AS (SELECT domain, least(cap, coalesce(level * w, cap)) AS b FROM d2),
l1 AS (SELECT lng.*, qd.b, coalesce(sum(cap) OVER p, 0) AS filled, sum(w) OVER q AS open FROM lng JOIN qd USING (domain)
       WINDOW p AS (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l2 AS (SELECT domain, arg_min((b - filled) / open, (b - filled) / open) FILTER ((b - filled) / open <= cap / w) AS _, min_by((b - filled) / open, filled) FILTER ((b - filled) / open <= cap / w) AS level FROM l1 GROUP BY 1),
ql AS (SELECT domain, lang, least(cap, coalesce(level * w, cap)) AS b FROM lng JOIN l2 USING (domain)),
s1 AS (SELECT leaf.*, ql.b, coalesce(sum(cap) OVER p, 0) AS filled, count(*) OVER q AS open FROM leaf JOIN ql USING (domain, lang)
       WINDOW p AS (PARTITION BY domain, lang ORDER BY cap, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY domain, lang ORDER BY cap, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
s2 AS (SELECT domain, lang, min_by((b - filled) / open, filled) FILTER ((b - filled) / open <= cap) AS level FROM s1 GROUP BY 1, 2),
qs AS (SELECT domain, lang, source, t, CAST(floor(least(cap, coalesce(level, cap)) + 1e-6) AS BIGINT) AS quota FROM leaf JOIN s2 USING (domain, lang)),
f AS (SELECT *, CASE WHEN t > 0 THEN quota // t ELSE 0 END AS full_epochs, CASE WHEN t > 0 THEN quota % t ELSE 0 END AS rest FROM qs),
k AS (SELECT base.*, full_epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || full_epochs || ':' || doc_id)) AS upto FROM base JOIN f USING (domain, lang, source)),
c AS (SELECT *, full_epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS copies FROM k)
SELECT doc_id, domain, lang, source, CAST(unnest(range(0, copies)) AS INTEGER) AS epoch, n_tokens FROM c
""",
}
