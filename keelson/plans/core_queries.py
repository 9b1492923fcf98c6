"""Queries of the operators over the shared tables, each over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import similarity, text
from keelson.operators import dedupe, evaluate, events, findings, graph, package, profile, rank, retrieval, validate
from keelson.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return keep


def _profile_sql(name: str, columns: list[str]) -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS v FROM {name}" for c in columns)
    return f"""
WITH long AS ({parts}),
f AS (SELECT field, count(*) AS records, count(*) FILTER (coalesce(trim(v), '') = '') AS missing,
  count(DISTINCT v) FILTER (coalesce(trim(v), '') <> '') AS distinct_values,
  CAST(max(length(v)) FILTER (coalesce(trim(v), '') <> '') AS INT) AS longest,
  coalesce(avg(length(v)) FILTER (coalesce(trim(v), '') <> ''), 0) AS average_length FROM long GROUP BY field)
SELECT field, records, missing, distinct_values, missing / records AS missing_ratio,
  CASE WHEN records > missing THEN distinct_values / (records - missing) ELSE 0.0 END AS distinct_ratio,
  average_length, longest FROM f"""


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
_SUPPLIER = ["vendor_legal_name", "partner_type", "vendor_country", "preferred_language", "vat_number", "legal_entity_code"]


@query(_profile_sql("orders", _ORDERS))
def profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(table(spark, sf_dir, "orders"), _ORDERS)


@query(_profile_sql("customer", _CUSTOMER))
def profile_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(table(spark, sf_dir, "customer"), _CUSTOMER)


@query(_profile_sql("source_supplier", _SUPPLIER))
def profile_supplier_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(table(spark, sf_dir, "source_supplier"), _SUPPLIER)


@query("""
SELECT 'o_orderpriority' AS field, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2""")
def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_distribution(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus", "o_orderkey"])


@query(r"""
WITH v AS (SELECT 'c_name' AS field, c_name AS value FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer),
s AS (SELECT field, value, string_split(regexp_replace(regexp_replace(value, '[A-Za-z]+', 'A', 'g'), '[0-9]+', 'D', 'g'), '') AS c FROM v),
q AS (SELECT field, value, array_to_string(list_filter(c, lambda x, i: i = 1 OR x <> c[i - 1]), '') AS signature FROM s),
g AS (SELECT field, signature, count(*) AS n, min(value) AS example FROM q GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY field ORDER BY n DESC, signature) AS INT) AS position FROM g)
SELECT * FROM r WHERE position <= 6""")
def signature_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.signature_histogram(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])


_FLAGGED = ["preferred_language", "vat_number", "vendor_legal_name", "payment_condition", "recon_gl_account", "partner_type"]
_FLAG_LONG = " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS v FROM source_supplier" for c in _FLAGGED)


@query(rf"""
WITH l AS ({_FLAG_LONG}), f AS (SELECT field, count(*) AS n, count(*) FILTER (coalesce(trim(v), '') <> '') AS present, count(DISTINCT v) FILTER (coalesce(trim(v), '') <> '') AS d FROM l GROUP BY 1),
c AS (SELECT field, string_split(regexp_replace(regexp_replace(v, '\p{{L}}+', 'A', 'g'), '\p{{Nd}}+', 'D', 'g'), '') AS c FROM l WHERE trim(v) <> ''),
g AS (SELECT field, least(count(DISTINCT array_to_string(list_filter(c, lambda x, i: i = 1 OR x <> c[i - 1]), '')), 6) AS formats FROM c GROUP BY 1)
SELECT field, 'missing_values' AS issue, CASE WHEN (n - present) / n > 0.25 THEN 'high' ELSE 'medium' END AS severity FROM f WHERE (n - present) / n > 0.1
UNION ALL SELECT field, 'mixed_formats', CASE WHEN formats > 5 THEN 'high' ELSE 'medium' END FROM f JOIN g USING (field) WHERE d / present <= 0.98 AND formats > 1""")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "source_supplier")
    return profile.quality_flags(profile.profile(rows, _FLAGGED), profile.signature_histogram(rows, _FLAGGED))


@query("SELECT * FROM (VALUES ('event_id', 'integer'), ('user_id', 'integer'), ('value', 'number'), ('event_type', 'string')) t(field, kind)")
def kind_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("value", F.format_string("%.4f", "value"))
    return profile.kind(rows, ["event_id", "user_id", "value", "event_type"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def pk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
SELECT user_id, event_type, event_id, position, first_row FROM (
  SELECT *, CAST(row_number() OVER w AS INT) AS position, min(event_id) OVER (PARTITION BY user_id, event_type) AS first_row
  FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)) WHERE position > 1""")
def later_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return validate.later_duplicates(rows, ["user_id", "event_type"], ["event_id"])


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL
AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return validate.orphans(table(spark, sf_dir, "orders"), parents, {"o_custkey": "c_custkey"}).select("o_orderkey", "o_custkey")


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, part, supplier = (table(spark, sf_dir, n) for n in ("customer", "part", "source_supplier"))
    checks = [
        validate.broken_rule(customer, "customer", "c_mktsegment", "enum", F.col("c_custkey"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY")),
        validate.broken_rule(part, "part", "p_brand", "pattern", F.col("p_partkey"), F.col("p_brand").rlike(r"^Brand#[1-3]\d?$")),
        validate.broken_rule(part, "part", "p_name", "max_length", F.col("p_partkey"), F.length("p_name") <= 10),
        validate.missing_required(supplier, "source_supplier", "vat_number", F.col("row_id")),
    ]
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


_VIOLATIONS = """
v AS (
  SELECT 'customer' AS resource, 'c_mktsegment' AS field, 'enum' AS category, CAST(c_custkey AS VARCHAR) AS row_key, c_mktsegment AS value
  FROM customer WHERE trim(c_mktsegment) <> '' AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
  UNION ALL SELECT 'part', 'p_brand', 'pattern', CAST(p_partkey AS VARCHAR), p_brand FROM part
  WHERE trim(p_brand) <> '' AND NOT regexp_matches(p_brand, '^Brand#[1-3][0-9]?$')
  UNION ALL SELECT 'part', 'p_name', 'max_length', CAST(p_partkey AS VARCHAR), p_name FROM part WHERE length(p_name) > 10 AND trim(p_name) <> ''
  UNION ALL SELECT 'source_supplier', 'vat_number', 'required', CAST(row_id AS VARCHAR), vat_number FROM source_supplier
  WHERE coalesce(trim(vat_number), '') = '')"""


@query(f"WITH {_VIOLATIONS} SELECT * FROM v")
def enum_pattern_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir)


@query(f"""
WITH {_VIOLATIONS}, r AS (SELECT *, CASE WHEN category = 'required' THEN 'high' ELSE 'medium' END AS severity FROM v)
SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(resource) = 0 THEN 'resource' WHEN grouping(severity) = 0 THEN 'severity' ELSE 'all' END AS level,
  coalesce(category, resource, severity, 'all') AS name, count(*) AS findings
FROM r GROUP BY GROUPING SETS ((category), (resource), (severity), ())""")
def violations_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.rollup(_violations(spark, sf_dir))


@query(f"""
WITH {_VIOLATIONS}, f AS (SELECT 'R-' || category AS rule_id, resource || '|' || field AS dedupe_key,
  CASE WHEN category = 'required' THEN 'high' ELSE 'medium' END AS severity, resource AS source, row_key FROM v),
s AS (SELECT rule_id, dedupe_key, string_agg(row_key, ',' ORDER BY row_key) AS sample_keys FROM (
  SELECT *, row_number() OVER (PARTITION BY rule_id, dedupe_key ORDER BY row_key) AS n FROM (SELECT DISTINCT rule_id, dedupe_key, row_key FROM f)) WHERE n <= 10 GROUP BY 1, 2)
SELECT 'MIG-' || upper(substr(sha256('v1|' || rule_id || '|' || dedupe_key), 1, 12)) AS finding_id, rule_id, dedupe_key,
  min(severity) AS severity, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS rows, any_value(sample_keys) AS sample_keys
FROM f JOIN s USING (rule_id, dedupe_key) GROUP BY 2, 3""")
def findings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _violations(spark, sf_dir).select(
        F.concat(F.lit("R-"), "category").alias("rule_id"), F.concat_ws("|", "resource", "field").alias("dedupe_key"),
        validate.severity(F.col("category")).alias("severity"), F.col("resource").alias("source"), "row_key",
    )
    return findings.merge(found)


@query("SELECT lang AS value, count(*) AS n FROM documents WHERE trim(lang) <> '' AND NOT regexp_matches(lang, '^[a-z]{2}$') GROUP BY 1")
def normalization_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = table(spark, sf_dir, "documents").where(~text.is_missing(F.col("lang")) & ~F.col("lang").rlike(r"^[a-z]{2}\z"))
    return bad.groupBy(F.col("lang").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT count(*) FILTER (try_cast(created_date AS BIGINT) IS NOT NULL) AS integers, count(*) FILTER (try_cast(created_date AS DOUBLE) IS NOT NULL) AS numbers,
  count(*) FILTER (length(created_date) = 8 AND try_strptime(created_date, '%Y%m%d') IS NOT NULL) AS dates FROM legacy_vendors""")
def parseability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "legacy_vendors")
    kinds = {"integers": "integer", "numbers": "number", "dates": "date"}
    return rows.agg(*(F.count_if(validate.parses_as(F.col("created_date"), k)).alias(n) for n, k in kinds.items()))


@query("""
SELECT p_brand, p_partkey, p_retailprice, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INT) AS rank FROM part)
WHERE rank <= 3""")
def top3_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    return rank.top_per_group(rows, ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3)


@query("""
SELECT p_brand, best, round(margin, 4) AS margin FROM (SELECT p_brand, p_retailprice AS best, p_retailprice - lead(p_retailprice) OVER w AS margin, row_number() OVER w AS r FROM part
WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)) WHERE r = 1""")
def lead_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rank.margin_to_next(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_partkey")
    return found.withColumn("margin", F.round("margin", 4))


@query("""
SELECT event_id, round((coalesce(sum(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) + coalesce(sum(value) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0))
 / nullif(count(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) + count(value) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0), 6) AS near
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def neighbour_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = rank.neighbours(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return near.select("event_id", F.round("near", 6).alias("near"))


@query("SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_seen_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.first_per_group(table(spark, sf_dir, "events").select("event_type", "user_id", "event_id"), ["event_type", "user_id"], ["event_id"])


@query("""
SELECT group_id, legacy_vendor_id, filled FROM (SELECT group_id, v.*, row_number() OVER (PARTITION BY group_id ORDER BY filled DESC, legacy_vendor_id) AS r FROM
 (SELECT DISTINCT group_id, legacy_vendor_id FROM vendor_duplicate_groups) JOIN (
 SELECT legacy_vendor_id, max((trim(coalesce(city, '')) <> '')::INT + (trim(coalesce(street, '')) <> '')::INT + (trim(coalesce(email, '')) <> '')::INT) AS filled
 FROM legacy_vendors GROUP BY 1) v USING (legacy_vendor_id)) WHERE r = 1""")
def canonical_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "vendor_duplicate_groups").select("group_id", "legacy_vendor_id").distinct()
    rows = members.join(table(spark, sf_dir, "legacy_vendors"), "legacy_vendor_id")
    return dedupe.canonical(rows, "group_id", "legacy_vendor_id", ["city", "street", "email"])


_STEPS = {"view": ["click", "purchase"], "click": ["purchase"]}


@query("""
WITH m AS (SELECT event_id, event_type, lag(event_type, 1, 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
SELECT event_id, previous, event_type = previous OR (previous = 'view' AND event_type IN ('click', 'purchase')) OR (previous = 'click' AND event_type = 'purchase') AS legal FROM m""")
def status_transition_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = events.transitions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", _STEPS, "view")
    return moved.select("event_id", "previous", "legal")


@query("SELECT user_id, arg_max(event_type, row(ts, event_id)) AS event_type, count(*) AS changes FROM events WHERE value >= 50 GROUP BY 1")
def asof_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.state_as_of(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", F.col("value") >= 50)


@query(r"""
WITH o AS (SELECT TRY_CAST(nullif(regexp_extract(effective_offset, '^T([+-]?[0-9]+)$', 1), '') AS INT) AS due FROM cutover_plan_items)
SELECT CASE WHEN due = -30 THEN 'due_now' WHEN due < -30 THEN 'overdue' WHEN due <= 0 THEN 'due_next' ELSE 'later' END AS bucket, count(*) AS items FROM o GROUP BY 1""")
def due_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = events.due_bucket(text.offset_value(F.col("effective_offset")), -30)
    return table(spark, sf_dir, "cutover_plan_items").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("items"))


_PACKAGE = "regexp_replace(entity_id, '-[A-Z]+$', '')"


@query(f"""
SELECT {_PACKAGE} AS package, CASE WHEN bool_and(status = 'Cancelled') THEN 'Cancelled' WHEN bool_and(status = 'Completed') THEN 'Completed'
 WHEN bool_or(status = 'Blocked') THEN 'Blocked' WHEN bool_or(status <> 'Not Started') THEN 'In Progress' ELSE 'Not Started' END AS package_status,
 avg(applied_sequence) AS progress FROM cutover_plan_items WHERE entity_type = 'Activity' GROUP BY 1""")
def workpackage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "cutover_plan_items").where("entity_type = 'Activity'").withColumn("package", F.expr(_PACKAGE))
    return events.package_status(rows, "package", "status", "applied_sequence")


@query("""
SELECT owner_role, CASE WHEN bool_or(status = 'Blocked') THEN 'Red' WHEN bool_or(status = 'In Progress') THEN 'Amber' ELSE 'Green' END AS rag
FROM cutover_plan_items GROUP BY 1""")
def rag_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "cutover_plan_items").groupBy("owner_role")
    return rows.agg(events.rag(F.bool_or(F.col("status") == "Blocked"), F.bool_or(F.col("status") == "In Progress")).alias("rag"))


_LEVEL = "CASE WHEN length(text) < 800 THEN 1 WHEN length(text) < 2000 THEN 2 ELSE 3 END"


@query(f"""
SELECT reading_level AS expected, count(*) FILTER (p = 1) AS as_1, count(*) FILTER (p = 2) AS as_2, count(*) FILTER (p = 3) AS as_3
FROM (SELECT reading_level, {_LEVEL} AS p FROM reading_labels JOIN documents USING (doc_id)) GROUP BY 1""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "reading_labels").join(table(spark, sf_dir, "documents"), "doc_id").withColumn("p", F.expr(_LEVEL))
    return evaluate.confusion(rows, "reading_level", "p", [1, 2, 3])


_PAIR = "least(upper(trim(unique_id_l)), upper(trim(unique_id_r))) AS a, greatest(upper(trim(unique_id_l)), upper(trim(unique_id_r))) AS b"


def _pairs(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    rows = table(spark, sf_dir, "vendor_match_pairs").where(F.col("match_probability") >= least).selectExpr(*_PAIR.replace(" AS a,", " AS a;").split("; "))
    return rows.where("a < b").distinct()


@query(f"""
WITH p AS (SELECT DISTINCT {_PAIR} FROM vendor_match_pairs WHERE match_probability >= 0.9 AND unique_id_l IS NOT NULL AND unique_id_r IS NOT NULL AND upper(trim(unique_id_l)) <> upper(trim(unique_id_r))),
t AS (SELECT DISTINCT {_PAIR} FROM vendor_match_pairs WHERE match_probability >= 0.97 AND unique_id_l IS NOT NULL AND unique_id_r IS NOT NULL AND upper(trim(unique_id_l)) <> upper(trim(unique_id_r))),
c AS (SELECT count(*) FILTER (p.a IS NOT NULL AND t.a IS NOT NULL) AS tp, count(*) FILTER (t.a IS NULL) AS fp, count(*) FILTER (p.a IS NULL) AS fn FROM p FULL JOIN t USING (a, b))
SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c""")
def prf_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.set_scores(_pairs(spark, sf_dir, 0.9), _pairs(spark, sf_dir, 0.97), ["a", "b"])


_USABLE = {
    "tax": "CASE WHEN length(regexp_replace(tax_number, '[^0-9]', '')) = 9 THEN regexp_replace(tax_number, '[^0-9]', '') END",
    "email": "CASE WHEN email LIKE '%@%.%' THEN lower(trim(email)) END",
}


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members of groups; the rules decide by themselves which values are usable."""
    rows = table(spark, sf_dir, "vendor_duplicate_groups").select("legacy_vendor_id").distinct()
    keyed = table(spark, sf_dir, "legacy_vendors").join(rows, "legacy_vendor_id", "left_semi")
    return keyed.select("legacy_vendor_id", "tax_number", "email").distinct()


_BLOCKED = r"""
d AS (SELECT legacy_vendor_id AS id, regexp_replace(tax_number, '[^0-9]', '', 'g') AS digits, email AS mail FROM legacy_vendors
  WHERE legacy_vendor_id IN (SELECT legacy_vendor_id FROM vendor_duplicate_groups)),
t AS (SELECT DISTINCT id, digits AS v FROM d WHERE length(digits) = 9), e AS (SELECT DISTINCT id, lower(trim(mail)) AS v FROM d WHERE mail LIKE '%@%.%'),
pairs AS (SELECT x.id AS a, y.id AS b FROM t x JOIN t y ON x.v = y.v AND x.id < y.id
  UNION SELECT x.id, y.id FROM e x JOIN e y ON x.v = y.v AND x.id < y.id)"""


@query(f"WITH {_BLOCKED} SELECT a, b FROM pairs")
def blocking_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.blocking_pairs(_members(spark, sf_dir), "legacy_vendor_id", {n: F.expr(e) for n, e in _USABLE.items()})


@query(f"""
WITH {_BLOCKED}, truth AS (SELECT DISTINCT x.legacy_vendor_id AS a, y.legacy_vendor_id AS b FROM vendor_duplicate_groups x
  JOIN vendor_duplicate_groups y ON x.group_id = y.group_id AND x.legacy_vendor_id < y.legacy_vendor_id)
SELECT count(*) AS true_pairs, count(p.a) AS covered, count(p.a) / count(*) AS recall_ceiling FROM truth LEFT JOIN pairs p USING (a, b)""")
def blocking_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "vendor_duplicate_groups").select("group_id", "legacy_vendor_id").distinct()
    left, right = groups.withColumnRenamed("legacy_vendor_id", "a"), groups.withColumnRenamed("legacy_vendor_id", "b")
    truth = left.join(right, "group_id").where("a < b").select("a", "b")
    return dedupe.coverage(blocking_pairs(spark, sf_dir), truth)


def _rounded_jaro_winklers(pairs: similarity.Compared):
    return similarity.rounded(similarity.jaro_winklers(pairs), 6)


@query("""
SELECT s1.s_suppkey AS a, s2.s_suppkey AS b, round(jaro_winkler_similarity(s1.s_name, s2.s_name), 6) AS similarity, CAST(levenshtein(s1.s_name, s2.s_name) AS INT) AS edits
FROM supplier s1 JOIN supplier s2 ON s1.s_nationkey = s2.s_nationkey AND s1.s_suppkey < s2.s_suppkey""")
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = {"similarity": (_rounded_jaro_winklers, "double"), "edits": (similarity.edits, "int")}
    return dedupe.compared_pairs(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", "s_name", measures)


@query()
def token_sort_ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = {"ratio": (similarity.indel_ratios, "double")}
    return dedupe.compared_pairs(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", "s_name", measures, similarity.sorted_words)


@query("SELECT size, count(*) AS groups FROM (SELECT sha256(text) AS h, count(*) AS size FROM documents WHERE text IS NOT NULL GROUP BY 1) GROUP BY 1")
def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


@query("""
WITH g AS (SELECT DISTINCT group_id, legacy_vendor_id FROM vendor_duplicate_groups), s AS (SELECT group_id, count(*) AS size FROM g GROUP BY 1),
e AS (SELECT least(unique_id_l, unique_id_r) AS a, greatest(unique_id_l, unique_id_r) AS b, max(match_probability) AS score FROM vendor_match_pairs WHERE unique_id_l <> unique_id_r GROUP BY 1, 2),
i AS (SELECT x.group_id, count(*) AS direct, min(score) AS weakest, round(avg(score), 6) AS mean FROM e JOIN g x ON e.a = x.legacy_vendor_id JOIN g y ON e.b = y.legacy_vendor_id AND x.group_id = y.group_id GROUP BY 1)
SELECT group_id, size, coalesce(direct, 0) AS direct, (size * (size - 1) / 2)::BIGINT AS possible, weakest, mean FROM s LEFT JOIN i USING (group_id)""")
def group_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "vendor_duplicate_groups").select("group_id", F.col("legacy_vendor_id").alias("id")).distinct()
    pairs = table(spark, sf_dir, "vendor_match_pairs").where("unique_id_l <> unique_id_r")
    edges = pairs.groupBy(F.least("unique_id_l", "unique_id_r").alias("a"), F.greatest("unique_id_l", "unique_id_r").alias("b")).agg(
        F.max("match_probability").alias("score")
    )
    return dedupe.group_figures(groups, edges).withColumn("mean", F.round("mean", 6))


@query("""
WITH g AS (SELECT DISTINCT group_id, legacy_vendor_id FROM vendor_duplicate_groups), l AS (
 SELECT 'currency' AS field, group_id, currency AS v FROM g JOIN legacy_vendors USING (legacy_vendor_id) UNION ALL SELECT 'city', group_id, city FROM g JOIN legacy_vendors USING (legacy_vendor_id)),
e AS (SELECT field, group_id, min(v) = max(v) AS same FROM l WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT field, count(*) AS groups, count(*) FILTER (same) AS agreeing, count(*) FILTER (same) / count(*) AS rate FROM e GROUP BY 1""")
def field_agreement_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "vendor_duplicate_groups").select("group_id", "legacy_vendor_id").distinct()
    return dedupe.agreement(members.join(table(spark, sf_dir, "legacy_vendors"), "legacy_vendor_id"), ["currency", "city"])


_MAPPINGS = [
    package.FieldMapping("order_id", "o_orderkey", required=True),
    package.FieldMapping("status", "o_orderstatus", kind="value_map", values={"F": "finished", "O": "open"}),
    package.FieldMapping("origin", "o_orderkey", kind="constant", value="legacy"),
]


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS record_id, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'value_map_missing:status' END AS reject_reason,
 CAST(o_orderkey AS VARCHAR) AS order_id, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE '' END AS status, 'legacy' AS origin FROM orders""")
def package_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package.build(table(spark, sf_dir, "orders"), "o_orderkey", _MAPPINGS)


@query("""
WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT k AS record_id, 'order_id' AS target, 'o_orderkey' AS source, 'copy' AS transformation, sha256(k) AS source_sha256 FROM o
UNION ALL SELECT k, 'status', 'o_orderstatus', 'value_map', sha256(s) FROM o
UNION ALL SELECT k, 'origin', 'o_orderkey', 'constant', sha256(k) FROM o""")
def lineage_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package.lineage(table(spark, sf_dir, "orders"), "o_orderkey", _MAPPINGS)


@query(r"SELECT p_partkey, CASE WHEN regexp_matches('=' || p_name, '^[=+\-@]') THEN '''=' || p_name END AS safe FROM part")
def review_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.csv_safe(F.concat(F.lit("="), "p_name")).alias("safe"))


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation needs its region, and each region the one before it."""
    nation = table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) as node", "concat('r', n_regionkey) as needs")
    region = table(spark, sf_dir, "region").where("r_regionkey > 0").selectExpr("concat('r', r_regionkey) as node", "concat('r', r_regionkey - 1) as needs")
    return nation.unionByName(region)


@query("""
WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS needs FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || (r_regionkey - 1) FROM region WHERE r_regionkey > 0),
a AS (SELECT 'n' || max(n_nationkey) AS node, 0 AS depth FROM nation UNION SELECT e.needs, depth + 1 FROM a JOIN e USING (node))
SELECT node, min(depth) AS depth FROM a GROUP BY 1""")
def critical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "nation").agg(F.concat(F.lit("n"), F.max("n_nationkey")).alias("node"))
    return graph.ancestors(_chain(spark, sf_dir), start)


@query("SELECT 'r' || r_regionkey AS node FROM region WHERE r_regionkey >= 1")
def dag_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = table(spark, sf_dir, "region").agg(F.lit("r1").alias("node"), F.concat(F.lit("r"), F.max("r_regionkey")).alias("needs"))
    return graph.on_cycles(_chain(spark, sf_dir).unionByName(back))


@query("""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label = q.label AS same,
  greatest(0, least(1, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]))) AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM s) WHERE rank <= 5""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = retrieval.top_k(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)
    return found.withColumn("score", F.round("score", 6))


@query("""
WITH s AS (SELECT q.vec_id AS query_id, q.label, e.vec_id AS id, e.label AS found,
  greatest(0, least(1, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]))) AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s),
c AS (SELECT query_id, label, min(rank) FILTER (found = label AND rank <= 5) AS rank FROM r GROUP BY 1, 2)
SELECT label, count(*) AS cases, round(avg(coalesce((rank = 1)::INT, 0)), 6) AS top1, round(avg(coalesce((rank <= 3)::INT, 0)), 6) AS top3, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM c GROUP BY ROLLUP (label)""")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 20 = 0")
    found = retrieval.top_k(rows, queries, "vec_id", "embedding", 5).join(rows.select(F.col("vec_id").alias("id"), F.col("label").alias("found")), "id")
    asked = queries.select(F.col("vec_id").alias("query_id"), "label")
    cases = asked.join(found, "query_id", "left").groupBy("query_id", "label").agg(F.min(F.when(F.col("found") == F.col("label"), F.col("rank"))).alias("rank"))
    scored = evaluate.ranking_scores(cases, ["label"])
    return scored.select("label", "cases", *(F.round(c, 6).alias(c) for c in ("top1", "top3", "mrr")))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))


@query(r"SELECT tag, count(*) AS n FROM (SELECT unnest(evidence) AS tag FROM cutover_status_updates) GROUP BY 1")
def tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "cutover_status_updates").select(F.explode("evidence").alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT entity_id, status, owner_role FROM cutover_plan_items WHERE entity_type = 'Activity' AND status IN ('Blocked', 'In Progress') AND contains(lower(concat_ws(' ', entity_id, title, owner_role)), 'lead')""")
def filter_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "cutover_plan_items").where(F.col("entity_type") == "Activity").where(F.col("status").isin("Blocked", "In Progress"))
    return rows.where(F.lower(F.concat_ws(" ", "entity_id", "title", "owner_role")).contains("lead")).select("entity_id", "status", "owner_role")


@query("""
SELECT entity_type, status, count(*) AS items FROM cutover_plan_items GROUP BY CUBE (entity_type, status)""")
def raid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cutover_plan_items").cube("entity_type", "status").agg(F.count(F.lit(1)).alias("items"))
