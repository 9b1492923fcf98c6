"""Queries of contracts, checks before loading, and decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.operators import contracts, decisions, preload
from keelson.operators.preload import Mapped
from keelson.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return keep


_DOCUMENT = {
    "name": "shop", "resources": [
        {"name": "customer", "schema": {"primaryKey": "c_custkey", "fields": [
            {"name": "c_custkey", "type": "integer", "constraints": {"required": True}}, {"name": "c_acctbal", "type": "number", "constraints": {"minimum": 0}},
            {"name": "c_mktsegment", "constraints": {"enum": ["BUILDING", "MACHINERY", "HOUSEHOLD"]}}, {"name": "c_fax"}]}},
        {"name": "country_reference", "schema": {"primaryKey": ["country_code"], "fields": [{"name": "country_code"}, {"name": "country_name"}]}},
        {"name": "source_supplier", "schema": {"primaryKey": ["old_vendor_number", "load_no"], "fields": [
            {"name": "old_vendor_number", "constraints": {"required": True, "pattern": r"V-[0-9]{8}"}}, {"name": "load_no", "type": "integer"},
            {"name": "vendor_legal_name", "constraints": {"required": True, "maxLength": 14}}, {"name": "vendor_country", "constraints": {"pattern": "[A-Z]{2}"}},
            {"name": "recon_gl_account", "type": "integer", "constraints": {"minimum": 160000}}, {"name": "payment_condition", "type": "integer"},
            {"name": "company_assignment_key", "constraints": {"unique": True}}],
            "foreignKeys": [{"fields": "vendor_country", "reference": {"resource": "country_reference", "fields": "country_code"}}]}},
    ]}
_KEYS = {"customer": "c_custkey", "country_reference": "country_code", "source_supplier": "row_id"}


def _violations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, contracts.Contract]:
    contract = contracts.parse_contract(_DOCUMENT)
    return contracts.validate_contract({r.name: table(spark, sf_dir, r.name) for r in contract.resources}, contract, _KEYS), contract


_PRESENT = lambda c: f"regexp_matches(coalesce({c}, ''), '[^\\s]')"
_CELL = lambda resource, key, field, category, fault: (
    f"SELECT '{resource}' AS resource, '{field}' AS field, '{category}' AS category, CAST({key} AS VARCHAR) AS row_key, CAST({field} AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS first_row FROM {resource} WHERE {fault}"
)
_S = "source_supplier"
_CELLS = [
    _CELL("customer", "c_custkey", "c_acctbal", "constraint", "c_acctbal < 0"),
    _CELL("customer", "c_custkey", "c_mktsegment", "enum", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')"),
    "SELECT 'customer', 'c_fax', 'schema', NULL, NULL, NULL",
    _CELL(_S, "row_id", "old_vendor_number", "required", f"NOT {_PRESENT('old_vendor_number')}"),
    _CELL(_S, "row_id", "old_vendor_number", "pattern", f"{_PRESENT('old_vendor_number')} AND NOT regexp_full_match(old_vendor_number, 'V-[0-9]{{8}}')"),
    _CELL(_S, "row_id", "vendor_legal_name", "required", f"NOT {_PRESENT('vendor_legal_name')}"),
    _CELL(_S, "row_id", "vendor_legal_name", "max_length", f"{_PRESENT('vendor_legal_name')} AND length(vendor_legal_name) > 14"),
    _CELL(_S, "row_id", "vendor_country", "pattern", f"{_PRESENT('vendor_country')} AND NOT regexp_full_match(vendor_country, '[A-Z]{{2}}')"),
    _CELL(_S, "row_id", "recon_gl_account", "type", f"{_PRESENT('recon_gl_account')} AND NOT regexp_full_match(trim(recon_gl_account), '[+-]?[0-9]+')"),
    _CELL(_S, "row_id", "recon_gl_account", "constraint", "TRY_CAST(recon_gl_account AS DOUBLE) < 160000"),
    _CELL(_S, "row_id", "payment_condition", "type", f"{_PRESENT('payment_condition')} AND NOT regexp_full_match(trim(payment_condition), '[+-]?[0-9]+')"),
    _CELL(_S, "row_id", "vendor_country", "foreign_key", f"{_PRESENT('vendor_country')} AND vendor_country NOT IN (SELECT country_code FROM country_reference)"),
]
_LATER = lambda columns, category: (
    f"SELECT '{_S}', '{', '.join(columns)}', '{category}', CAST(row_id AS VARCHAR), concat_ws(', ', {', '.join(columns)}), CAST(f AS VARCHAR) FROM "
    f"(SELECT *, min(row_id) OVER (PARTITION BY {', '.join(columns)}) AS f FROM {_S} WHERE {' AND '.join(_PRESENT(f'CAST({c} AS VARCHAR)') for c in columns)}) WHERE row_id > f"
)
_VIOLATIONS = f"v AS ({' UNION ALL '.join([*_CELLS, _LATER(['old_vendor_number', 'load_no'], 'primary_key'), _LATER(['company_assignment_key'], 'unique')])})"
_SEVERITY = "CASE WHEN category IN ('required', 'primary_key', 'foreign_key', 'unique') THEN 'high' WHEN category = 'schema' THEN 'low' ELSE 'medium' END"


@query(f"WITH {_VIOLATIONS} SELECT resource, field, category, {_SEVERITY} AS severity, row_key, value, first_row FROM v")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir)[0]


@query(f"""
WITH {_VIOLATIONS}, r AS (SELECT unnest(['customer', 'country_reference', 'source_supplier']) AS resource), c AS (SELECT unnest({contracts.CATEGORIES}) AS category),
n AS (SELECT resource, category, count(*) AS findings FROM v GROUP BY ALL)
SELECT resource, category, coalesce(findings, 0) AS findings FROM r CROSS JOIN c LEFT JOIN n USING (resource, category)""")
def contract_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.category_counts(*_violations(spark, sf_dir))


@query(f"""
WITH {_VIOLATIONS} SELECT resource, row_key, field, category, CAST(row_number() OVER (ORDER BY resource, coalesce(TRY_CAST(row_key AS BIGINT), -1), coalesce(row_key, ''), coalesce(field, ''), category, value) AS INT) AS place
FROM v QUALIFY place <= 50""")
def contract_report_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 findings in the order of a report."""
    found = _violations(spark, sf_dir)[0]
    head = found.orderBy(*contracts.report_order(found), "value").limit(50)
    listed = head.agg(F.array_sort(F.collect_list(F.struct(*(c.alias(f"_{i}") for i, c in enumerate([*contracts.report_order(found), F.col("value")])), "row_key"))).alias("rows"))
    placed = listed.select(F.posexplode("rows").alias("i", "r"))
    return placed.select(F.col("r._0").alias("resource"), F.col("r.row_key").alias("row_key"), F.col("r._3").alias("field"), F.col("r._4").alias("category"), (F.col("i") + 1).alias("place"))


_MAPPED = [
    Mapped("old_vendor_number", "Supplier.Supplier", key=True, nullable=False, max_length=10),
    Mapped("vendor_legal_name", "Supplier.Name", nullable=False, max_length=12), Mapped("vendor_country", "Supplier.Country", max_length=2, verified=False),
    Mapped("preferred_language", "Supplier.Language", status="needs_review", max_length=2, allowed=("DE", "EN", "FR", "IT", "ES")),
    Mapped("recon_gl_account", "Company.Account", kind="integer", creatable=False, updatable=False), Mapped("payment_condition", "Company.Terms", status="possible_false_friend", kind="integer"),
    Mapped("legacy_created_by", None, status="no_confident_target"),
]
_TARGET_KEYS = ["Supplier.Supplier", "Company.Company"]
_ISSUE = lambda source, target, issue, fault, value, unverified="false": (
    f"SELECT CAST(row_id AS VARCHAR) AS record_id, '{source}' AS source, '{target}' AS target, '{issue}' AS issue, 'high' AS severity, {value} AS value, {unverified} AS unverified FROM {_S} WHERE {fault}"
)
_PARTS = [
    *(_ISSUE(s, t, "required_field_missing", f"NOT {_PRESENT(s)}", "CAST(NULL AS VARCHAR)") for s, t in (("old_vendor_number", "Supplier.Supplier"), ("vendor_legal_name", "Supplier.Name"))),
    *(
        _ISSUE(s, t, "max_length_overflow", f"{_PRESENT(s)} AND length({s}) > {n}", s, u)
        for s, t, n, u in (("old_vendor_number", "Supplier.Supplier", 10, "false"), ("vendor_legal_name", "Supplier.Name", 12, "false"), ("vendor_country", "Supplier.Country", 2, "true"), ("preferred_language", "Supplier.Language", 2, "false"))
    ),
    *(_ISSUE(s, t, "type_not_parseable", f"{_PRESENT(s)} AND NOT regexp_full_match(trim({s}), '[+-]?[0-9]+')", s) for s, t in (("recon_gl_account", "Company.Account"), ("payment_condition", "Company.Terms"))),
    _ISSUE("preferred_language", "Supplier.Language", "value_not_in_allowed_values", f"{_PRESENT('preferred_language')} AND preferred_language NOT IN ('DE', 'EN', 'FR', 'IT', 'ES')", "preferred_language"),
    _ISSUE("old_vendor_number", "Supplier.Supplier", "duplicate_primary_key", f"{_PRESENT('old_vendor_number')} AND old_vendor_number IN (SELECT old_vendor_number FROM {_S} GROUP BY 1 HAVING count(*) > 1)", "old_vendor_number"),
]
_ISSUES = f"i AS ({' UNION ALL '.join(_PARTS)})"
_CODED = f"""c AS (SELECT 'vendor_country' AS source, 'Supplier.Country' AS target WHERE EXISTS (SELECT 1 FROM {_S} WHERE {_PRESENT('vendor_country')} AND NOT regexp_full_match(vendor_country, '[A-Z]{{2}}'))
UNION ALL SELECT 'preferred_language', 'Supplier.Language' WHERE EXISTS (SELECT 1 FROM {_S} WHERE {_PRESENT('preferred_language')} AND NOT regexp_full_match(preferred_language, '[A-Z]{{2}}')))"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preload.record_issues(table(spark, sf_dir, _S), "row_id", _MAPPED)


@query(f"WITH {_ISSUES} SELECT * FROM i")
def preload_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir)


@query(f"WITH {_ISSUES} SELECT record_id, count(*) AS issues, 0 AS worst, string_agg(DISTINCT source || ': ' || issue, '; ' ORDER BY source || ': ' || issue) AS summary FROM i GROUP BY 1")
def record_issue_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preload.record_view(_issues(spark, sf_dir))


@query(f"""
WITH {_ISSUES}, {_CODED}, g AS (SELECT i.source, i.target, CASE WHEN c.source IS NOT NULL AND issue = 'max_length_overflow' THEN 'normalization_required' ELSE issue END AS root_cause, record_id, unverified
  FROM i LEFT JOIN c ON i.source = c.source AND i.target = c.target),
s AS (SELECT source, target, root_cause, string_agg(record_id, ',' ORDER BY record_id) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY source, target, root_cause ORDER BY record_id) AS r
  FROM (SELECT DISTINCT source, target, root_cause, record_id FROM g)) WHERE r <= 10 GROUP BY ALL)
SELECT source, target, root_cause, 'high' AS severity, count(DISTINCT record_id) AS records, bool_or(unverified) AS unverified, any_value(sample) AS sample FROM g JOIN s USING (source, target, root_cause) GROUP BY ALL""")
def root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = preload.field_issues(table(spark, sf_dir, _S), _MAPPED, _TARGET_KEYS).where("issue = 'normalization_required'")
    return preload.root_causes(_issues(spark, sf_dir), coded)


@query(f"""
WITH {_CODED} SELECT source, target, 'normalization_required' AS issue, 'medium' AS severity FROM c
UNION ALL SELECT * FROM (VALUES ('preferred_language', 'Supplier.Language', 'mapping_needs_review', 'low'), ('recon_gl_account', 'Company.Account', 'target_not_writable', 'high'),
  ('payment_condition', 'Company.Terms', 'possible_false_friend_target', 'medium'), ('legacy_created_by', NULL, 'no_target_in_schema', 'high'), (NULL, 'Company.Company', 'unmapped_target_key', 'high'))""")
def preload_field_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preload.field_issues(table(spark, sf_dir, _S), _MAPPED, _TARGET_KEYS)


@query("""
SELECT * FROM (VALUES ('old_vendor_number', 'Supplier.Supplier', 'suggested', true, true, 'loadable_ok'), ('vendor_legal_name', 'Supplier.Name', 'suggested', true, true, 'loadable_ok'),
 ('vendor_country', 'Supplier.Country', 'suggested', true, true, 'loadable_ok'), ('preferred_language', 'Supplier.Language', 'needs_review', NULL, true, 'needs_human_decision'),
 ('recon_gl_account', 'Company.Account', 'suggested', true, false, 'mapping_ok_but_not_loadable'), ('payment_condition', 'Company.Terms', 'possible_false_friend', false, true, 'needs_human_decision'),
 ('legacy_created_by', NULL, 'no_confident_target', false, NULL, 'no_target')) t(source, target, status, means_the_same, loadable, verdict)""")
def mapping_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preload.field_view(spark, _MAPPED)


_DECIDED = "SELECT entity_id AS source, owner_role AS target, CASE status WHEN 'Completed' THEN 'approved' WHEN 'Open' THEN 'approved' WHEN 'Cancelled' THEN 'rejected' WHEN 'Blocked' THEN 'deferred' ELSE status END AS decision, CASE WHEN applied_sequence % 3 = 0 THEN 'copy' ELSE 'guess' END AS transformation FROM cutover_plan_items"
_SAID = f"""d AS ({_DECIDED} UNION ALL SELECT entity_id, owner_role, 'rejected', 'copy' FROM cutover_plan_items WHERE status = 'Completed' UNION ALL SELECT ' ', owner_role, 'approved', 'copy' FROM cutover_plan_items WHERE status = 'Open')"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions derived from the plan items: some unknown, some conflicting, some without a source."""
    items = table(spark, sf_dir, "cutover_plan_items")
    decision = F.when(F.col("status").isin("Completed", "Open"), "approved").when(F.col("status") == "Cancelled", "rejected").when(F.col("status") == "Blocked", "deferred").otherwise(F.col("status"))
    kind = F.when(F.col("applied_sequence") % 3 == 0, "copy").otherwise("guess")
    base = items.select(F.col("entity_id").alias("source"), F.col("owner_role").alias("target"), decision.alias("decision"), kind.alias("transformation"))
    again = items.where("status = 'Completed'").selectExpr("entity_id as source", "owner_role as target", "'rejected' as decision", "'copy' as transformation")
    blank = items.where("status = 'Open'").selectExpr("' ' as source", "owner_role as target", "'approved' as decision", "'copy' as transformation")
    return base.unionByName(again).unionByName(blank)


@query(f"""
WITH {_SAID}, w AS (SELECT * FROM d WHERE trim(source) <> '' AND trim(target) <> ''), a AS (SELECT * FROM w WHERE decision = 'approved'),
n AS (SELECT source, target, count(*) AS n, count(DISTINCT decision) AS kinds FROM w GROUP BY ALL),
known AS (SELECT DISTINCT upper(trim(entity_id)) AS source FROM cutover_status_updates WHERE entity_id IS NOT NULL),
proposed AS (SELECT entity_id AS source, owner_role AS target FROM cutover_plan_items WHERE entity_type = 'Activity')
SELECT DISTINCT 'missing_part' AS rule, source, target FROM d WHERE coalesce(trim(source), '') = '' OR coalesce(trim(target), '') = ''
UNION ALL SELECT DISTINCT 'unknown_decision', source, target FROM w WHERE coalesce(decision NOT IN ('approved', 'rejected', 'deferred'), true)
UNION ALL SELECT DISTINCT 'unknown_transformation', source, target FROM a WHERE transformation <> 'copy'
UNION ALL SELECT DISTINCT 'unknown_source', source, target FROM w WHERE source NOT IN (SELECT source FROM known)
UNION ALL SELECT DISTINCT 'unknown_target', source, target FROM w WHERE target NOT IN (SELECT owner_role FROM cutover_plan_items WHERE status = 'Not Started' AND owner_role IS NOT NULL)
UNION ALL SELECT DISTINCT 'not_proposed', source, target FROM a ANTI JOIN proposed USING (source, target)
UNION ALL SELECT 'repeated_link', source, target FROM n WHERE n > 1 AND kinds <= 1
UNION ALL SELECT 'conflicting', source, target FROM n WHERE kinds > 1
UNION ALL SELECT DISTINCT 'repeated_target', source, target FROM a WHERE target IN (SELECT target FROM (SELECT DISTINCT source, target FROM a) GROUP BY 1 HAVING count(*) > 1)""")
def decision_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "cutover_plan_items")
    known = table(spark, sf_dir, "cutover_status_updates").select(F.upper(F.trim("entity_id")).alias("source")).where("source is not null")
    targets = items.where("status = 'Not Started'").select(F.col("owner_role").alias("target")).where("target is not null")
    proposed = items.where("entity_type = 'Activity'").selectExpr("entity_id as source", "owner_role as target")
    return decisions.faults(_decided(spark, sf_dir), known, targets, proposed)


@query(f"""
WITH {_SAID}, l AS (SELECT DISTINCT source, target, decision FROM d),
e AS (SELECT source, count(*) FILTER (decision = 'approved') AS a, count(*) FILTER (decision = 'rejected') AS r, count(*) FILTER (decision = 'deferred') AS f FROM l GROUP BY 1)
SELECT sum(a)::BIGINT AS approved_links, sum(r)::BIGINT AS rejected_links, sum(f)::BIGINT AS deferred_links, count(*) FILTER (a = 1) AS unique_sources, count(*) FILTER (a > 1) AS multi_target_sources,
  sum(f) = 0 AND sum(a) > 0 AS export_ready FROM e""")
def decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.summary(_decided(spark, sf_dir))
