"""Queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import canonical, components, leaks, mixture, reading, survivor, variants
from keelson.tables import table


def _countries(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The listed countries, and the names of all countries."""
    return [table(spark, sf_dir, "country_reference").selectExpr("country_code as code", "country_name as name"), canonical.country_names(spark)]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    vendors = table(spark, sf_dir, "legacy_vendors")
    mapped = canonical.canonical_column(vendors, "legacy_vendor_id", "country", *_countries(spark, sf_dir))
    return mapped.withColumnRenamed("code", "country_code")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    vendors = table(spark, sf_dir, "legacy_vendors")
    return canonical.value_report(vendors, "legacy_vendor_id", "country", *_countries(spark, sf_dir))


def _members(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, name) for name in ("vendor_duplicate_groups", "legacy_vendors", "source_systems")]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.winners(survivor.golden_records(*_members(spark, sf_dir), votes="rank"))


def p3_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = survivor.golden_records(*_members(spark, sf_dir))
    return golden.select("group_id", *(F.col(f"{f}.value").alias(f) for f in survivor.FIELDS))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_passages(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixture_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture_report(p9_mixture(spark, sf_dir), table(spark, sf_dir, "mixture_targets"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.name_variants(table(spark, sf_dir, "legacy_vendors").where("load_no between 3 and 6"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.vendor_groups(table(spark, sf_dir, "vendor_match_pairs"), table(spark, sf_dir, "legacy_vendors"))


QUERIES = {
    "p1_found": p1_found, "p1_report": p1_report,
    "p3_found": p3_found, "p3_golden": p3_golden,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p8_found": p8_found, "p8_passages": p8_passages,
    "p10_found": p10_found,
    "p9_mixture": p9_mixture, "p9_shares": p9_shares,
}

def _usable_sql() -> str:
    """The CTE k of all usable member values."""
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in [*survivor.STAND_INS, *survivor.LABELS])
    long = " UNION ALL ".join(
        f"SELECT group_id, legacy_vendor_id, trust_rank, changed_at, '{f}' AS field_name, {f} AS v FROM j" for f in survivor.FIELDS
    )
    return rf"""m AS (SELECT DISTINCT group_id, legacy_vendor_id FROM vendor_duplicate_groups WHERE group_id IS NOT NULL),
d AS (SELECT DISTINCT legacy_vendor_id, source_system, changed_at, {", ".join(survivor.FIELDS)} FROM legacy_vendors),
j AS (SELECT m.group_id, d.*, coalesce(trust_rank, 2147483647) AS trust_rank FROM m JOIN d USING (legacy_vendor_id) LEFT JOIN source_systems USING (source_system)),
l AS ({long}),
t AS (SELECT *, lower(regexp_replace(v, '\s+', '', 'g')) AS t, regexp_replace(v, '[^0-9]', '', 'g') AS n,
  length(regexp_replace(v, '[^\p{{L}}]', '', 'g')) AS letters FROM l WHERE v IS NOT NULL),
u AS (SELECT *, regexp_replace(t, '[.:;,!]+$', '') AS bare, len(list_distinct(string_split(n, ''))) > 1 AS varied FROM t),
k AS (SELECT * FROM u WHERE bare <> '' AND bare NOT IN ({words}) AND CASE field_name
  WHEN 'postal_code' THEN length(n) >= 3 AND length(t) <= 10 AND varied
  WHEN 'tax_number' THEN length(n) >= 5 AND varied AND NOT starts_with(t, 'xx')
  WHEN 'email' THEN regexp_matches(t, '^[^@\s]+@[^@\s]+\.[^@\s]{{2,}}$')
  WHEN 'phone' THEN length(n) >= 7 AND varied AND letters = 0
  WHEN 'street' THEN letters >= 3 AND n <> ''
  ELSE letters >= 2 END)"""


_P3_FOUND = f"""
WITH {_usable_sql()}
SELECT group_id, field_name, legacy_vendor_id FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY trust_rank, changed_at DESC NULLS LAST, legacy_vendor_id) AS r FROM k) WHERE r = 1"""
_P3_GOLDEN = rf"""
WITH {_usable_sql()},
x AS (SELECT *, lower(regexp_replace(v, '[\s\x{{a0}}]+', ' ', 'g')) AS text, (SELECT max(changed_at) FROM legacy_vendors) AS newest FROM k),
w AS (SELECT *, power(0.5, least(trust_rank, 30) - 1) * power(0.5, coalesce(date_diff('day', CAST(changed_at AS DATE), CAST(newest AS DATE)), 7300) / {survivor.HALF_LIFE_DAYS}) AS weight,
  CASE WHEN field_name IN ('postal_code', 'tax_number') THEN regexp_replace(text, '[^a-z0-9]', '', 'g') WHEN field_name = 'phone' THEN regexp_replace(n, '^00', '')
  WHEN field_name = 'email' THEN regexp_replace(text, '[<> ]', '', 'g') ELSE trim(text) END AS norm FROM x),
b AS (SELECT *, row_number() OVER (PARTITION BY group_id, field_name, norm ORDER BY trust_rank, changed_at DESC NULLS LAST, legacy_vendor_id) AS r,
  round(sum(weight) OVER (PARTITION BY group_id, field_name, norm), 9) AS vote FROM w),
e AS (SELECT group_id, field_name, v FROM (SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY vote DESC, trust_rank, changed_at DESC NULLS LAST, legacy_vendor_id) AS p FROM b WHERE r = 1) WHERE p = 1)
SELECT group_id, {", ".join(f"max(v) FILTER (field_name = '{f}') AS {f}" for f in survivor.FIELDS)} FROM (SELECT DISTINCT group_id FROM m) LEFT JOIN e USING (group_id) GROUP BY group_id"""

ORACLE = {
    "p3_found": _P3_FOUND,
    "p3_golden": _P3_GOLDEN,
    "p7_found": """
WITH RECURSIVE known AS (SELECT DISTINCT upper(trim(legacy_vendor_id)) AS id FROM legacy_vendors),
pairs AS (
  SELECT DISTINCT upper(trim(unique_id_l)) AS a, upper(trim(unique_id_r)) AS b FROM vendor_match_pairs
  WHERE match_probability >= 0.95),
links AS (
  SELECT a, b FROM pairs WHERE a <> b AND a IN (FROM known) AND b IN (FROM known)
  UNION SELECT b, a FROM pairs WHERE a <> b AND a IN (FROM known) AND b IN (FROM known)),
reach AS (
  SELECT a AS id, a AS other FROM links
  UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT id AS legacy_vendor_id, min(other) AS group_id FROM reach GROUP BY id
""",
}
