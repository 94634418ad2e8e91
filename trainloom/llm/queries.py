"""The queries of the training-data operators, by name, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trainloom.llm import byte_bpe, exact_dedup, html_text, license_scan, line_dedup, ngram_join, packing, quality_model, quality_rules, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.report(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_model": op1_quality_model,
    "op2_packing": op2_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_ngram_join": op5_ngram_join,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_line_dedup": op7_line_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_html_text": op10_html_text,
}

WORDS4 = ", ".join(f"'{w}'" for w in url_filter.BAD_WORDS)
RULES4 = " UNION ALL ".join(f"SELECT '{v}' AS verdict, '{r}' AS rule, '{r.partition('/')[0]}' AS rule_host, '/{r.partition('/')[2]}' AS rule_path" for v, r in url_filter.RULES)




def license_sql() -> str:
    """The license scan by plain counting: every block of every text against every template."""
    places = " UNION ALL ".join(f"SELECT rid, '{label}' AS label, unnest(list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))})) - 1 AS spot FROM d" for phrase, label in license_scan.PHRASES.items())
    templates = ", ".join(f"('{label}', {sorted(set(t.split()))}, {license_scan.SPAN * len(t.split())}, {license_scan.need(len(set(t.split())), license_scan.THRESHOLD)})" for label, t in license_scan.TEMPLATES)
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                          list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{license_scan.APART}'), lambda x: x <> '') AS w FROM documents),
        places AS ({places}),
        base AS (SELECT rid, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY rid),
        templates AS (SELECT * FROM (VALUES {templates}) AS v(label, words, span, least)),
        held AS (SELECT rid, label, len(words) AS n, least, list_max(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains(words, w[i])), lambda i: len(list_intersect(w[i:i + span - 1], words)))) AS best FROM d CROSS JOIN templates),
        found AS (SELECT rid, list(DISTINCT label) AS labels, max(best / n::DOUBLE) AS most FROM held WHERE best >= least GROUP BY rid)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
               coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
               greatest(CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, coalesce(most, 0.0::DOUBLE)) AS score
        FROM d LEFT JOIN base USING (rid) LEFT JOIN found USING (rid)"""


ORACLE: dict[str, str] = {
    "op8_license_scan": license_sql(),
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               row_number() OVER w = 1 AS kept, h AS text_sha256
        FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST)""",
    "op4_url_filter": rf"""
        WITH rules AS ({RULES4}),
        parts AS (SELECT page_id, coalesce(url, '') AS u, instr(coalesce(url, ''), '://') AS spot FROM pages),
        rest AS (SELECT page_id, CASE WHEN spot > 0 THEN substr(u, spot + 3) ELSE '' END AS r FROM parts),
        hp AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        best AS (SELECT page_id, host, path, rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC) AS k
                 FROM (SELECT DISTINCT * FROM hp) JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT hp.page_id, hp.host, hp.path, best.rule,
               CASE WHEN best.rule IS NOT NULL THEN best.verdict
                    WHEN list_has_any(string_split_regex(hp.host, '[.-]'), [{WORDS4}]) THEN 'block' ELSE 'allow' END AS verdict
        FROM hp LEFT JOIN best ON hp.page_id IS NOT DISTINCT FROM best.page_id AND hp.host = best.host AND hp.path = best.path AND best.k = 1""",
}
