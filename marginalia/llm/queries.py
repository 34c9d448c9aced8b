"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import decontam, lang_id, mixing, near_dup, pii, quality_model, quality_rules, secrets, sstable, url_rules
from marginalia.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op2_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.language_report(table(spark, sf_dir, "documents"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(table(spark, sf_dir, "documents"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.url_verdicts(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_output(table(spark, sf_dir, "documents"))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_lang_id": op2_lang_id,
    "op3_near_dup": op3_near_dup,
    "op4_secrets": op4_secrets,
    "op5_url_rules": op5_url_rules,
    "op6_decontam": op6_decontam,
    "op7_mixing": op7_mixing,
    "op8_token_shards": op8_token_shards,
    "op9_quality_model": op9_quality_model,
    "op10_quality_rules": op10_quality_rules,
}
#: The same counts, sketches, thresholds and verdicts in SQL.
QUALITY_SQL = r"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY doc_id),
f AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
m AS (SELECT doc_id, lang, source, base_failed, unnest(['word_len', 'symbols', 'dup_lines', 'repeats']) AS metric,
    unnest([word_chars * 1000 // greatest(n_words, 1), (n_symbols + 1) * 1000000 // (word_chars + 2), (n_dup_lines + 1) * 1000000 // (n_lines + 2), (n_repeat_words + 1) * 1000000 // (n_words + 2)]) AS v FROM b),
k AS (SELECT *, (v >> e) + 64 * e AS bk FROM (SELECT *, greatest(length(bin(v)) - 7, 0) AS e FROM m)),
h AS (SELECT lang, source, metric, bk, count(*) AS n FROM k WHERE NOT base_failed GROUP BY ALL),
lv AS (SELECT 2 AS lev, lang, source, metric, bk, n FROM h UNION ALL SELECT 1, lang, NULL, metric, bk, n FROM h UNION ALL SELECT 0, NULL, NULL, metric, bk, n FROM h),
s AS (SELECT lev, lang, source, metric, bk, sum(n) AS n FROM lv GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY lev, lang, source, metric ORDER BY bk) AS upto, sum(n) OVER (PARTITION BY lev, lang, source, metric) AS total FROM s),
q AS (SELECT lev, lang, source, metric, CAST(max(total) AS BIGINT) AS n, 1000 * min(bk) FILTER (upto * 100 >= total * (100 - UPPER)) AS a,
    1000 * min(bk) FILTER (upto * 100 >= total * 50) AS b, 1000 * min(bk) FILTER (upto * 100 >= total * UPPER) AS c FROM c GROUP BY ALL),
p AS (SELECT x.lang, x.metric, (x.n * x.a + PRIOR * y.a) // (x.n + PRIOR) AS a, (x.n * x.b + PRIOR * y.b) // (x.n + PRIOR) AS b, (x.n * x.c + PRIOR * y.c) // (x.n + PRIOR) AS c
    FROM q x JOIN q y ON y.lev = 0 AND x.metric = y.metric WHERE x.lev = 1),
z AS (SELECT x.lang, x.source, x.metric, (x.n * x.a + PRIOR * y.a) // (x.n + PRIOR) AS a, (x.n * x.b + PRIOR * y.b) // (x.n + PRIOR) AS b, (x.n * x.c + PRIOR * y.c) // (x.n + PRIOR) AS c
    FROM q x JOIN p y ON x.metric = y.metric AND x.lang IS NOT DISTINCT FROM y.lang WHERE x.lev = 2),
x AS (SELECT lang, source, metric, c + REACH * greatest(c - b, 1000) AS hi, CASE WHEN metric = 'word_len' THEN a - REACH * greatest(b - a, 1000) ELSE -1 END AS lo FROM z),
j AS (SELECT doc_id, k.bk * 1000 BETWEEN lo AND hi AS ok FROM k LEFT JOIN x ON x.metric = k.metric AND x.lang IS NOT DISTINCT FROM k.lang AND x.source IS NOT DISTINCT FROM k.source),
o AS (SELECT doc_id, bool_and(coalesce(ok, true)) AS ok FROM j GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept FROM b JOIN o USING (doc_id)
"""


def _quality_sql() -> str:
    out = QUALITY_SQL
    for name in ("UPPER", "PRIOR", "REACH"):
        out = out.replace(name, str(getattr(quality_rules, name)))
    return out


ORACLE_SQL: dict[str, str] = {"op10_quality_rules": _quality_sql()}
