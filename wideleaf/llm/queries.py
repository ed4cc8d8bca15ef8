"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wideleaf.llm import bpe, decontaminate, licenses, lm, quality, secrets, shards, similar, warc, wrappers
from wideleaf.llm.common import read

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.report(read(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.report(read(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(read(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(read(spark, sf_dir, "pages"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and callable(f)}


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f"""

#: Fences of op4 as quality.METRICS has them.
OP4_SQL = r"""
WITH t AS (SELECT doc_id, coalesce('=' || lang, 'null') AS lang, coalesce('=' || source, 'null') AS source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT r, i, concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS k FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
dup AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM dup) GROUP BY r),
m AS (SELECT doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN rep USING (r)),
x AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * word_chars // greatest(n_words, 1) AS word_centi, 1000 * n_symbols // greatest(word_chars, 1) AS symbol_milli,
  1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_milli, 1000 * n_repeat_words // greatest(n_words, 1) AS repeat_milli FROM m),
l AS (UNPIVOT (SELECT lang, source, word_centi, symbol_milli, dup_line_milli, repeat_milli FROM x WHERE NOT base_failed) ON word_centi, symbol_milli, dup_line_milli, repeat_milli INTO NAME metric VALUE v),
b AS (SELECT lang, source, metric, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS b FROM l),
q AS (SELECT lang, source, metric, count(*) AS n, list(b ORDER BY b) AS s FROM b GROUP BY GROUPING SETS ((lang, source, metric), (lang, metric), (metric))),
c AS (SELECT lang, source, metric, n, [s[(h * n + 99) // 100] FOR h IN [1, 25, 75, 85, 99]] AS v FROM q),
best AS (SELECT f.lang, f.source, f.metric, CASE WHEN f.n >= 100 THEN f.v WHEN k.n >= 100 THEN k.v ELSE a.v END AS v
  FROM c f JOIN c k ON k.lang = f.lang AND k.source IS NULL AND k.metric = f.metric JOIN c a ON a.lang IS NULL AND a.metric = f.metric WHERE f.source IS NOT NULL),
fence AS (SELECT lang, source, max(CASE WHEN metric = 'word_centi' THEN least(v[1], v[2] - 3 * (v[3] - v[2])) END) AS w0, max(CASE WHEN metric = 'word_centi' THEN greatest(v[5], v[3] + 3 * (v[3] - v[2])) END) AS w1,
  max(CASE WHEN metric = 'symbol_milli' THEN greatest(v[4], v[3] + 3 * (v[3] - v[2])) END) AS s1, max(CASE WHEN metric = 'dup_line_milli' THEN greatest(v[5], v[3] + 3 * (v[3] - v[2])) END) AS d1,
  max(CASE WHEN metric = 'repeat_milli' THEN greatest(v[5], v[3] + 3 * (v[3] - v[2])) END) AS r1 FROM best GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(NOT base_failed AND word_centi BETWEEN w0 AND w1 AND symbol_milli <= s1 AND dup_line_milli <= d1 AND repeat_milli <= r1, false) AS kept
FROM x LEFT JOIN fence USING (lang, source)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op4_quality_rules": OP4_SQL}
