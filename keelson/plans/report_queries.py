"""Queries of standard findings and of report building blocks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import text
from keelson.operators import csv_records, evaluate, findings, mapping, preload, reports, validate
from keelson.plans import contract_queries, linkage_queries
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


def _standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of three builders: contract violations, mappings, and groups of duplicates."""
    no, yes = F.lit(False), F.lit(True)
    broken = contract_queries.contract_violations(spark, sf_dir)
    built = findings.standard(
        broken, "MIG-GEN-001", "generated_validation", [F.lit("generated_validation"), F.col("resource"), F.col("field"), F.col("category")],
        F.col("category"), F.col("severity"), no, F.col("row_key"), F.lit(1), resource=F.col("resource"), category=F.col("category"),
    )
    fields = preload.rated(preload.field_view(spark, contract_queries._MAPPED).withColumn("issue", F.create_map(*(F.lit(x) for p in preload.STATUS_ISSUES.items() for x in p))[F.col("status")]))
    mapped = findings.standard(
        fields.where("issue is not null"), "MIG-MAP-001", "field_mapping", [F.lit("mapping"), F.col("source"), F.col("status")], F.col("issue"), F.col("severity"), yes, F.col("source"), F.lit(1), target=F.col("target")
    )
    groups = linkage_queries.group_review(spark, sf_dir).where("needs_review")
    doubled = findings.standard(
        groups, "MIG-DUP-001", "duplicates", [F.lit("duplicate"), F.when(F.col("conflicts") != "", "conflict").when(F.col("weak"), "weak").otherwise("transitive")],
        F.lit("duplicate_group"), F.when(F.col("conflicts") != "", "medium").otherwise("low"), yes, F.col("group_id"), F.col("size"), conflicts=F.nullif(F.col("conflicts"), F.lit("")),
    )
    return built.unionByName(mapped).unionByName(doubled)


_MERGED = f"""{contract_queries._VIOLATIONS}, q AS ({linkage_queries.ORACLE["group_review"].strip()}),
f AS (SELECT 'MIG-GEN-001' AS rule_id, lower('generated_validation|' || resource || '|' || field || '|' || category) AS dedupe_key, category AS issue, 'Issue' AS raid_type, {contract_queries._SEVERITY} AS severity,
    false AS review_required, category IN ('required', 'primary_key', 'foreign_key', 'unique') AS gate_blocker, 'generated_validation' AS source, 1 AS rows FROM v
  UNION ALL SELECT 'MIG-MAP-001', 'mapping|preferred_language|needs_review', 'mapping_needs_review', 'Dependency', 'low', true, false, 'field_mapping', 1
  UNION ALL SELECT 'MIG-MAP-001', 'mapping|payment_condition|possible_false_friend', 'possible_false_friend_target', 'Risk', 'medium', true, false, 'field_mapping', 1
  UNION ALL SELECT 'MIG-DUP-001', 'duplicate|' || CASE WHEN conflicts <> '' THEN 'conflict' WHEN weak THEN 'weak' ELSE 'transitive' END, 'duplicate_group', 'Issue', CASE WHEN conflicts <> '' THEN 'medium' ELSE 'low' END, true, false, 'duplicates', size FROM q WHERE needs_review),
m AS (SELECT 'MIG-' || upper(substr(sha256('v1|' || rule_id || '|' || dedupe_key), 1, 12)) AS finding_id, rule_id, dedupe_key, min(issue) AS issue, min(raid_type) AS raid_type,
  CASE min(CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, bool_or(review_required) AS review_required, bool_or(gate_blocker) AS gate_blocker,
  string_agg(DISTINCT source, ',') AS sources, sum(rows)::BIGINT AS rows FROM f GROUP BY rule_id, dedupe_key)"""


@query(f"WITH {_MERGED} SELECT * FROM m")
def standard_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.merge_standard(_standard(spark, sf_dir)).drop("evidence")


@query(f"WITH {_MERGED} SELECT raid_type, severity, count(*) AS findings, count(*) FILTER (review_required) AS to_review, count(*) FILTER (gate_blocker) AS blockers FROM m GROUP BY CUBE (raid_type, severity)")
def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.summary(findings.merge_standard(_standard(spark, sf_dir)))


_STATES = ["Not Started", "In Progress", "Blocked", "Completed", "Cancelled", "Open"]
_TYPES = ["Activity", "RAID", "ApprovalGate", "Decision"]


@query(f"""
SELECT entity_type, status, count(i.entity_id) AS n FROM (SELECT unnest({_TYPES}) AS entity_type) CROSS JOIN (SELECT unnest({_STATES}) AS status) LEFT JOIN cutover_plan_items i USING (entity_type, status) GROUP BY ALL""")
def status_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.zero_filled(table(spark, sf_dir, "cutover_plan_items"), {"entity_type": _TYPES, "status": _STATES})


@query("""
SELECT count(*) AS items, count(*) FILTER (status = 'Not Started') AS not_started, count(*) FILTER (status = 'In Progress') AS in_progress, count(*) FILTER (status = 'Blocked') AS blocked, count(*) FILTER (status = 'Completed') AS completed,
 round(100 * count(*) FILTER (status = 'Completed') / count(*), 1) AS percent_done FROM cutover_plan_items WHERE entity_type = 'Activity'""")
def plan_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "cutover_plan_items").where("entity_type = 'Activity'")
    return reports.headline(rows, "status", "Completed", _STATES[:4])


@query("""
WITH m AS (SELECT *, (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS matched FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey, o_totalprice, total, matched, least(matched, 40) AS returned FROM m ORDER BY o_totalprice DESC, o_orderkey LIMIT 40""")
def order_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return reports.preview(rows, F.col("o_orderstatus") == "F", [F.desc("o_totalprice"), F.col("o_orderkey")], 40).drop("o_orderstatus")


@query("""
WITH d AS (SELECT entity_id, TRY_CAST(regexp_extract(effective_offset, '^T([+-]?[0-9]+)$', 1) AS INT) AS due FROM cutover_plan_items WHERE entity_type = 'ApprovalGate' AND status <> 'Approved')
SELECT entity_id, due FROM d WHERE due >= -40 ORDER BY due, entity_id LIMIT 1""")
def next_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = table(spark, sf_dir, "cutover_plan_items").where("entity_type = 'ApprovalGate' and status <> 'Approved'")
    return reports.next_due(gates, "entity_id", text.offset_value(F.col("effective_offset")), -40)


@query("""
WITH p AS (SELECT entity_id, 1 AS priority FROM cutover_plan_items WHERE status = 'Blocked' UNION ALL SELECT entity_id, 2 FROM cutover_plan_items WHERE entity_type = 'RAID' AND status IN ('Open', 'Mitigating')
 UNION ALL SELECT entity_id, 3 FROM cutover_plan_items WHERE owner_role = 'Test Lead' AND status <> 'Completed')
SELECT entity_id, min(priority)::INT AS priority FROM p GROUP BY 1""")
def action_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "cutover_plan_items")
    parts = [items.where("status = 'Blocked'"), items.where("entity_type = 'RAID' and status in ('Open', 'Mitigating')"), items.where("owner_role = 'Test Lead' and status <> 'Completed'")]
    return reports.by_priority(parts, "entity_id")


_PHASES = ["DESIGN", "BUILD", "TEST", "DEPLOY"]
_PACKAGES = "p AS (SELECT entity_id, regexp_replace(entity_id, '-[A-Z]+$', '') AS package, regexp_extract(entity_id, '-([A-Z]+)$', 1) AS phase FROM cutover_plan_items WHERE entity_type = 'Activity')"


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "cutover_plan_items").where("entity_type = 'Activity'")
    return rows.select("entity_id", F.regexp_replace("entity_id", "-[A-Z]+$", "").alias("package"), F.regexp_extract("entity_id", "-([A-Z]+)$", 1).alias("phase"))


@query(f"""
WITH {_PACKAGES}, s AS (SELECT package, list_distinct(list(phase)) AS phases FROM p GROUP BY 1)
SELECT package, array_to_string(list_filter({_PHASES}, lambda x: NOT list_contains(phases, x)), ',') AS missing, array_to_string(list_sort(list_filter(phases, lambda x: NOT list_contains({_PHASES}, x))), ',') AS unexpected FROM s
WHERE len(list_filter({_PHASES}, lambda x: NOT list_contains(phases, x))) > 0 OR len(list_filter(phases, lambda x: NOT list_contains({_PHASES}, x))) > 0""")
def incomplete_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.set_differences(_packages(spark, sf_dir), "package", "phase", _PHASES)


@query(f"""
WITH {_PACKAGES} SELECT package, entity_id, lag(entity_id) OVER (PARTITION BY package ORDER BY list_position({_PHASES}, phase), entity_id) AS previous FROM p WHERE phase IN ('DESIGN', 'BUILD', 'TEST', 'DEPLOY')""")
def package_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.previous_in_order(_packages(spark, sf_dir), "package", "entity_id", "phase", _PHASES)


@query("""
SELECT CASE WHEN regexp_full_match(country, '[A-Z]{2}') THEN 'code' WHEN length(country) <= 7 THEN 'fits' ELSE 'too_long' END AS legality, count(*) AS n FROM legacy_vendors WHERE regexp_matches(coalesce(country, ''), '[^\\s]') GROUP BY 1""")
def country_legality(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = text.code_legality(F.col("country"), r"^[A-Z]{2}\z", 7)
    return table(spark, sf_dir, "legacy_vendors").groupBy(kind.alias("legality")).agg(F.count(F.lit(1)).alias("n")).where("legality is not null")


_MARKS = ["cutover", "freeze", "ledger", "legacy", "postal code", "review"]


@query(f"""
SELECT mark, count(*) AS documents FROM (SELECT unnest(list_filter({_MARKS}, lambda m: contains(lower(text), m))) AS mark FROM documents) GROUP BY 1""")
def marker_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "documents").select(F.explode(text.found_keywords(F.col("text"), _MARKS)).alias("mark"))
    return marks.groupBy("mark").agg(F.count(F.lit(1)).alias("documents"))


_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_WORDS = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z]+'), lambda t: length(t) > 2 AND NOT list_contains({_STOP}, t)))"


@query(f"""
WITH w AS (SELECT item_id, suite, {_WORDS("item_text")} AS words FROM eval_items)
SELECT x.item_id AS a, y.item_id AS b, len(list_intersect(x.words, y.words)) / len(list_distinct(list_concat(x.words, y.words))) AS jaccard FROM w x JOIN w y ON x.suite = y.suite AND x.item_id < y.item_id
WHERE len(list_intersect(x.words, y.words)) / len(list_distinct(list_concat(x.words, y.words))) >= 0.18""")
def similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of test items of one suite whose words overlap: a fixed list of 140."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "suite", text.content_words(F.col("item_text")).alias("words"))
    left, right = (items.select("suite", F.col("item_id").alias(n), F.col("words").alias(f"w{n}")) for n in ("a", "b"))
    pairs = left.join(right, "suite").where("a < b")
    return pairs.select("a", "b", text.jaccard(F.col("wa"), F.col("wb")).alias("jaccard")).where("jaccard >= 0.18")


@query("""
WITH r AS (SELECT event_id, sha256('["' || event_type || '","' || user_id || '"]') AS f FROM events), c AS (SELECT DISTINCT sha256('["' || event_type || '","' || user_id || '"]') AS f FROM events WHERE value > 90)
SELECT event_id, CASE WHEN c.f IS NOT NULL THEN 'known' END AS answer FROM r LEFT JOIN c USING (f)""")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    asked = reports.cached(events.where("value > 90"), spark.createDataFrame([], "fingerprint string, answer string"), ["event_type", "user_id"])
    cache = asked.select("fingerprint", F.lit("known").alias("answer")).distinct()
    return reports.cached(events, cache, ["event_type", "user_id"]).select("event_id", "answer")


@query(r"""
WITH t AS (SELECT job_id, csv_text, list_filter(string_split(replace(csv_text, chr(65279), ''), chr(10)), lambda x: trim(rtrim(x, chr(13))) <> '') AS lines FROM mapping_job_payloads),
h AS (SELECT *, coalesce(len(lines), 0) = 0 AS blank, list_transform(string_split(rtrim(lines[1], chr(13)), ','), lambda c: lower(trim(c))) AS header FROM t)
SELECT job_id, 'empty' AS fault FROM h WHERE blank UNION ALL SELECT job_id, 'too_large' FROM h WHERE strlen(csv_text) > 3000 UNION ALL SELECT job_id, 'too_many_rows' FROM h WHERE NOT blank AND len(lines) - 1 > 25
UNION ALL SELECT job_id, 'too_many_columns' FROM h WHERE NOT blank AND len(header) > 11 UNION ALL SELECT job_id, 'unnamed_column' FROM h WHERE NOT blank AND list_contains(header, '')
UNION ALL SELECT job_id, 'repeated_column' FROM h WHERE NOT blank AND len(list_distinct(header)) < len(header)""")
def upload_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which payloads break limits, with limits low enough for some to do so."""
    return csv_records.upload_faults(table(spark, sf_dir, "mapping_job_payloads"), "job_id", "csv_text", 3000, 25, 11)


@query("""
WITH t AS (SELECT DISTINCT legacy_vendor_id AS id FROM vendor_duplicate_groups), r AS (SELECT legacy_vendor_id AS id, max(source_system) AS system, max(tax_number) AS tax FROM legacy_vendors GROUP BY 1)
SELECT system, count(*) AS cases, avg(coalesce(regexp_full_match(tax, '[A-Z]{2}[0-9]{9}'), false)::INT) AS recall FROM t JOIN r USING (id) GROUP BY 1""")
def recall_by_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of group members with a well-formed tax number, by source system."""
    records = table(spark, sf_dir, "legacy_vendors").groupBy(F.col("legacy_vendor_id").alias("id")).agg(F.max("source_system").alias("system"), F.max("tax_number").alias("tax"))
    members = table(spark, sf_dir, "vendor_duplicate_groups").select(F.col("legacy_vendor_id").alias("id")).distinct().join(records, "id")
    return evaluate.recall_by_level(members, members.where(F.col("tax").rlike(r"^[A-Z]{2}[0-9]{9}\z")), ["id"], "system")


@query("""
SELECT DISTINCT upper(trim(entity_id)) AS entity_id FROM cutover_status_updates WHERE trim(entity_id) <> '' AND upper(trim(entity_id)) NOT IN (SELECT upper(trim(entity_id)) FROM cutover_plan_items)""")
def dangling_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that changes refer to and the plan does not hold."""
    key = F.nullif(F.upper(F.trim("entity_id")), F.lit(""))
    updates = table(spark, sf_dir, "cutover_status_updates").select(key.alias("entity_id")).where("entity_id is not null").distinct()
    return validate.orphans(updates, table(spark, sf_dir, "cutover_plan_items").select(key.alias("id")), {"entity_id": "id"})


@query(f"""
WITH {contract_queries._SAID} SELECT DISTINCT owner_role AS target FROM cutover_plan_items WHERE owner_role IS NOT NULL AND owner_role NOT IN (SELECT target FROM d WHERE decision = 'approved' AND source LIKE 'RAID%')""")
def unmapped_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "cutover_plan_items").select(F.col("owner_role").alias("target")).where("target is not null").distinct()
    return mapping.unmapped(targets, contract_queries._decided(spark, sf_dir).where("source like 'RAID%'"))


_CUT = "lower(regexp_replace(regexp_replace(regexp_replace(v, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'))"


@query(f"""
WITH d AS (SELECT DISTINCT v FROM (SELECT company_assignment_key AS v FROM source_supplier UNION ALL SELECT payment_condition FROM source_supplier UNION ALL SELECT legacy_created_by FROM source_supplier) WHERE v IS NOT NULL)
SELECT v, trim(regexp_replace({_CUT}, '[^a-z0-9]+', ' ', 'g')) AS words, trim(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g')) AS plain, trim(upper(regexp_replace(v, '[^A-Za-z0-9]+', '-', 'g')), '-') AS slug,
 regexp_matches(v, '[\\x{{4e00}}-\\x{{9fff}}]') AS cjk, regexp_matches(v, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]') AS control FROM d""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of three columns as words, plain text and slug."""
    columns = ["company_assignment_key", "payment_condition", "legacy_created_by"]
    values = table(spark, sf_dir, "source_supplier").select(*columns).unpivot([], columns, "c", "v").select("v").where("v is not null").distinct()
    v = F.col("v")
    return values.select("v", text.split_identifier(v).alias("words"), text.normalize_text(v).alias("plain"), text.slug_id(v).alias("slug"), text.has_cjk(v).alias("cjk"), text.has_control_characters(v).alias("control"))


_LEGAL = "|".join(sorted(text.LEGAL_FORMS, key=lambda f: -len(f)))
_FORMS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.LEGAL_FORMS.items()) + "}"


@query(rf"""
WITH d AS (SELECT DISTINCT vendor_name AS name FROM legacy_vendors WHERE vendor_name IS NOT NULL),
b AS (SELECT name, regexp_replace(trim(regexp_replace(replace(translate(lower(name), 'áàâäãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), '\bund\b', 'and', 'g') AS basic FROM d)
SELECT name, basic, ({_FORMS})[nullif(regexp_extract(basic, '(?:^| )({_LEGAL})$', 1), '')] AS form, regexp_replace(basic, ' (?:{_LEGAL})$', '') AS core, nullif(substr(regexp_replace(basic, ' (?:{_LEGAL})$', ''), 1, 4), '') AS prefix FROM b""")
def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name in basic form, with its legal form, its core and the prefix that blocks by."""
    names = table(spark, sf_dir, "legacy_vendors").select(F.col("vendor_name").alias("name")).where("name is not null").distinct()
    basic = names.withColumn("basic", text.basic_name(F.col("name")))
    core = text.name_core(F.col("basic"))
    return basic.select("name", "basic", text.legal_form(F.col("basic")).alias("form"), core.alias("core"), text.prefix_key(core).alias("prefix"))


@query("""
SELECT p_partkey, CASE WHEN p_retailprice * 123.456 = 0 THEN 0 ELSE round(p_retailprice * 123.456, 3 - CAST(floor(log10(p_retailprice * 123.456)) AS INT) - 1) END AS rounded FROM part""")
def significant_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.significant(F.col("p_retailprice") * 123.456, 3).alias("rounded"))
