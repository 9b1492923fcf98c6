"""Queries of the general training-data problems (2, 4, 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.operators import cdc, csv_records, drift
from keelson.storage import durable
from keelson.tables import table


#: The twelve supplier columns in their order.
SUPPLIER_COLUMNS = [
    "old_vendor_number", "vendor_legal_name", "partner_type", "vendor_country", "preferred_language", "vat_number",
    "company_assignment_key", "company_vendor_reference", "legal_entity_code", "recon_gl_account", "payment_condition",
    "legacy_created_by",
]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changed_columns(table(spark, sf_dir, "source_supplier"), "load_no", SUPPLIER_COLUMNS)


def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.column_profile(table(spark, sf_dir, "source_supplier"), "load_no", SUPPLIER_COLUMNS)


def p2_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.load_tests(table(spark, sf_dir, "source_supplier"), "load_no", SUPPLIER_COLUMNS)


def p2_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of p2_profile that SQL has as well."""
    left_out = ["n_patterns", "main_pattern", "nonconforming_rows"]
    return p2_profile(spark, sf_dir).drop(*left_out).withColumn("top_share", F.round("top_share", 6))


def p2_mix_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tests of p2_tests that need no patterns, so that SQL has them as well."""
    return p2_tests(spark, sf_dir).where("facet <> 'pattern'").withColumn("z", F.round("z", 5))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all texts, cut once and written."""
    payloads = table(spark, sf_dir, "mapping_job_payloads")
    return durable(csv_records.split_records(payloads, "job_id", "csv_text", mark="LC-").drop("raw"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_rejects(spark, sf_dir).drop("details")


def p4_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found with what is wrong with which column."""
    return csv_records.faulty_records(_records(spark, sf_dir), "job_id")


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = csv_records.loadable_records(_records(spark, sf_dir), "job_id")
    return record.select(
        "job_id", "line_no", F.map_values("record").getItem(0).alias("legacy_client_id"), F.to_json("record").alias("record")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.replay(table(spark, sf_dir, "cutover_plan_items"), table(spark, sf_dir, "cutover_status_updates"))


QUERIES = {
    "p2_found": p2_found, "p2_profile": p2_profile, "p2_tests": p2_tests, "p2_standard": p2_standard, "p2_mix_tests": p2_mix_tests,
    "p4_found": p4_found, "p4_rejects": p4_rejects, "p4_loaded": p4_loaded,
    "p5_found": p5_found,
}

_P5_STATE = r"""
WITH feed AS (
  SELECT upper(trim(entity_id)) AS entity_id, sequence,
         max(CASE WHEN lower(trim(change_type)) IN ('i','ins','insert') THEN 'I'
                  WHEN lower(trim(change_type)) IN ('u','upd','update') THEN 'U'
                  WHEN lower(trim(change_type)) IN ('d','del','delete') THEN 'D' END) AS kind,
         max(nullif(trim(new_status), '')) AS st, max(nullif(trim(effective_offset), '')) AS o
  FROM cutover_status_updates
  WHERE sequence IS NOT NULL AND nullif(trim(entity_id), '') IS NOT NULL
  GROUP BY 1, 2),
base AS (SELECT upper(trim(entity_id)) AS entity_id, status, effective_offset, applied_sequence FROM cutover_plan_items),
live AS (
  SELECT f.* FROM feed f LEFT JOIN base b USING (entity_id)
  WHERE b.entity_id IS NULL OR b.applied_sequence IS NULL OR f.sequence > b.applied_sequence),
cuts AS (SELECT entity_id, max(sequence) AS d FROM live WHERE kind = 'D' GROUP BY 1),
starts AS (
  SELECT l.entity_id, min(l.sequence) AS i FROM live l LEFT JOIN cuts c USING (entity_id)
  WHERE l.kind = 'I' AND l.sequence > coalesce(c.d, -1) GROUP BY 1),
ids AS (
  SELECT b.entity_id, NULL AS i, b.status AS st0, b.effective_offset AS o0 FROM base b
  WHERE b.entity_id NOT IN (SELECT entity_id FROM cuts)
  UNION ALL
  SELECT s.entity_id, s.i, NULL, NULL FROM starts s
  WHERE s.entity_id NOT IN (SELECT entity_id FROM base WHERE entity_id NOT IN (SELECT entity_id FROM cuts)))
SELECT ids.entity_id,
       coalesce(arg_max(l.st, l.sequence) FILTER (l.st IS NOT NULL), any_value(ids.st0)) AS current_status,
       coalesce(arg_max(l.o, l.sequence) FILTER (l.o IS NOT NULL), any_value(ids.o0)) AS current_offset
FROM ids LEFT JOIN live l ON l.entity_id = ids.entity_id AND l.kind <> 'D' AND (ids.i IS NULL OR l.sequence >= ids.i)
GROUP BY ids.entity_id
"""

_FIELD = r'(?:"[^"]*(?:""[^"]*)*"|[^",\r\n]*)'
_RECORDS = rf"""
t AS (SELECT job_id, string_split(replace(csv_text, chr(65279), ''), chr(10)) AS lines FROM mapping_job_payloads WHERE csv_text IS NOT NULL),
s AS (SELECT job_id, lines, rtrim(lines[1], chr(13)) AS head, list_filter(range(2, len(lines) + 1), lambda i: starts_with(lines[i], 'LC-')) AS starts FROM t),
p AS (SELECT job_id, head, starts[k] AS line_no, array_to_string(lines[starts[k] : coalesce(starts[k + 1] - 1, len(lines))], chr(10)) AS raw
  FROM s, unnest(range(1, len(starts) + 1)) AS u(k)),
f AS (SELECT job_id, line_no, string_split(head, ',') AS header, regexp_matches(raw, '^{_FIELD}(?:,{_FIELD})*(?:\r?\n|\r?\z)') AS whole,
  regexp_extract_all(',' || regexp_extract(raw, '^({_FIELD}(?:,{_FIELD})*)(?:\r?\n|\r?\z)', 1), ',({_FIELD})', 1) AS quoted FROM p),
r AS (SELECT job_id, line_no, header, whole, list_transform(quoted, lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS fields FROM f),
c AS (SELECT *, fields[list_position(header, 'contact_email')] AS email, fields[list_position(header, 'nation')] AS nation,
  fields[list_position(header, 'account_currency')] AS currency, fields[list_position(header, 'marketing_opt_in')] AS opt_in, fields[list_position(header, 'client_name')] AS name FROM r),
w AS (SELECT job_id, line_no, header, fields, CASE WHEN NOT whole THEN 'quoting' WHEN len(fields) <> len(header) THEN 'column_count'
  WHEN (email <> '' AND NOT regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$')) OR NOT regexp_matches(nation, '^[A-Z]{{2}}\z') OR NOT regexp_matches(currency, '^[A-Z]{{3}}\z')
  OR (opt_in <> '' AND lower(opt_in) NOT IN ('true', 'false', 'yes', 'no', 'y', 'n', '0', '1'))
  OR regexp_matches(name, '[\x00-\x09\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}\x{{fffd}}]') THEN 'invalid_value' END AS reason FROM c)"""

_LONG = " UNION ALL ".join(f"SELECT load_no, '{c}' AS column_name, nullif(trim({c}), '') AS value FROM source_supplier" for c in SUPPLIER_COLUMNS)
_COUNTS = f"""v AS (SELECT CAST(load_no AS BIGINT) AS load_no, column_name, value, count(*) AS n FROM ({_LONG}) GROUP BY ALL)"""
_P2_STANDARD = f"""
WITH {_COUNTS}, top AS (SELECT load_no, column_name, arg_max(value, row(n, value)) AS top_value, max(n) AS top_n FROM v WHERE value IS NOT NULL GROUP BY ALL)
SELECT load_no, column_name, CAST(sum(n) AS BIGINT) AS rows, coalesce(sum(n) FILTER (value IS NULL), 0) / sum(n) AS missing_ratio, count(value) AS distinct_count,
  CAST(max(length(value)) AS INT) AS observed_max_length, min(value) AS lowest_value, max(value) AS highest_value, any_value(top_value) AS top_value,
  round(any_value(top_n) / sum(n), 6) AS top_share
FROM v LEFT JOIN top USING (load_no, column_name) GROUP BY ALL"""
_P2_MIX = f"""
WITH {_COUNTS}, f AS (
  SELECT load_no, column_name, 'missing' AS facet, CAST(value IS NULL AS VARCHAR) AS c, sum(n) AS n FROM v GROUP BY ALL
  UNION ALL SELECT load_no, column_name, 'value', value, n FROM v WHERE value IS NOT NULL
  UNION ALL SELECT load_no, column_name, 'length', CAST(length(value) AS VARCHAR), sum(n) FROM v WHERE value IS NOT NULL GROUP BY ALL),
o AS (SELECT load_no, lag(load_no) OVER (ORDER BY load_no) AS before FROM (SELECT DISTINCT load_no FROM v WHERE load_no IS NOT NULL)),
b AS (SELECT load_no, column_name, facet, c, n AS cur, 0 AS prev FROM f JOIN o USING (load_no) WHERE before IS NOT NULL
  UNION ALL SELECT o.load_no, column_name, facet, c, 0, n FROM f JOIN o ON f.load_no = o.before),
p AS (SELECT load_no, column_name, facet, c, sum(cur) AS cur, sum(prev) AS prev FROM b GROUP BY ALL),
q AS (SELECT load_no, column_name, facet, CASE WHEN cur + prev >= 10 THEN c END AS c, sum(cur) AS cur, sum(prev) AS prev FROM p GROUP BY ALL),
t AS (SELECT *, sum(cur) OVER w AS n1, sum(prev) OVER w AS n0, count(*) OVER w - 1 AS df FROM q WINDOW w AS (PARTITION BY load_no, column_name, facet)),
x AS (SELECT load_no, column_name, facet, df, sum(power(cur * sqrt(n0 / n1) - prev * sqrt(n1 / n0), 2) / (cur + prev)) AS x FROM t WHERE n1 > 0 AND n0 > 0 AND df > 0 GROUP BY ALL),
e AS (SELECT load_no, column_name, sum(n) AS rows, count(*) AS d, greatest(1, least(count(*) FILTER (n = 1), sum(n) - count(*))) AS v FROM v WHERE value IS NOT NULL GROUP BY ALL)
SELECT load_no, column_name, facet, round((cbrt(x / df) - (1 - 2 / (9 * df))) / sqrt(2 / (9 * df)), 5) AS z FROM x
UNION ALL SELECT e.load_no, e.column_name, 'distinct', round(least(abs(e.d / e.rows - g.d / g.rows) / sqrt(e.v / e.rows ** 2 + g.v / g.rows ** 2), abs(e.d - g.d) / sqrt(e.v + g.v)), 5)
FROM e JOIN o USING (load_no) JOIN e g ON g.load_no = o.before AND g.column_name = e.column_name"""

ORACLE = {
    "p2_standard": _P2_STANDARD, "p2_mix_tests": _P2_MIX,
    "p4_found": f"WITH {_RECORDS} SELECT job_id, line_no, reason FROM w WHERE reason IS NOT NULL",
    "p4_loaded": f"""WITH {_RECORDS} SELECT job_id, line_no, fields[1] AS legacy_client_id, CAST(to_json(map_from_entries(list_zip(header, fields))) AS VARCHAR) AS record
FROM w WHERE reason IS NULL""",
    "p5_found": _P5_STATE,
}
