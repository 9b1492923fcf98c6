"""Queries of schema matching and of its benchmarks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.operators import contracts, mapping, matching, profile, retrieval
from keelson.plans.p_queries import SUPPLIER_COLUMNS
from keelson.storage import durable
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


def _field(name: str, meaning: str, description: str, aliases: list[str] = (), **constraints: object) -> dict:
    return {"name": name, "semanticType": meaning, "description": description, "aliases": list(aliases), "constraints": constraints}


_TARGET = {
    "name": "partners", "resources": [
        {"name": "supplier", "schema": {"primaryKey": "supplier_number", "fields": [
            _field("supplier_number", "identifier", "number of the supplier", ["old vendor number"], required=True), _field("company_name", "organization_name", "registered name of the company"),
            _field("country", "country_code", "country of the supplier", pattern="[A-Z]{2}"), _field("language", "language_code", "language for letters", enum=["DE", "EN", "FR", "IT", "ES", "JA"]),
            _field("tax_number", "tax_number", "tax registration number"), _field("category", "category_code", "category of partner", enum=["1", "2", "3"])]}},
        {"name": "company_data", "schema": {"fields": [
            _field("company_code", "company_code", "company that the record belongs to", ["legal entity code"]), _field("reconciliation_account", "account", "general ledger account", pattern="[0-9]{6}"),
            _field("payment_terms", "payment_terms", "terms of payment"), _field("bank_country", "country_code", "country of the bank"), _field("created_by", "user", "who created the record")]}},
    ]}


def _targets(spark: SparkSession) -> DataFrame:
    return contracts.contract_fields(spark, contracts.parse_contract(_TARGET))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "source_supplier")
    kinds = profile.kind(rows, SUPPLIER_COLUMNS).withColumnRenamed("field", "source")
    return durable(matching.source_profiles(rows, SUPPLIER_COLUMNS, "row_id").join(kinds, "source"))


@query()
def mapping_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages: names and types, evidence of values, neighbours in the file, concepts, and the locked first rank."""
    sources, targets = _sources(spark, sf_dir), _targets(spark)
    scored = durable(matching.candidates(sources, targets))
    bare = scored.drop("resource", "support", "evidence")
    resources = targets.select("target", "resource")
    support = durable(mapping.resource_support(bare, sources.select("source", "position"), resources))
    near = mapping.with_resource_context(bare, support, resources)
    final = durable(mapping.tier_locked(mapping.with_concepts(durable(near))))
    found = matching.suggestions(final)
    return found.select("source", "best", "score", "margin", "basis", "status", "band", F.array_join("reasons", ",").alias("reasons"), F.array_join("targets", ",").alias("targets"))


_VALUES = " UNION ALL ".join(f"SELECT row_id, '{c}' AS source, trim({c}) AS value FROM source_supplier" for c in SUPPLIER_COLUMNS)
_DISTINCT = f"d AS (SELECT source, value, count(*) AS n, min(row_id) AS f FROM ({_VALUES}) WHERE value <> '' GROUP BY ALL), s AS (SELECT source, list(value ORDER BY f) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY f) AS r FROM d) WHERE r <= 5 GROUP BY 1)"


@query(f"""
WITH {_DISTINCT} SELECT source, sum(n)::BIGINT AS present, count(*) / sum(n) AS distinct_ratio, max(length(value))::INT AS longest, any_value(array_to_string(samples, '|')) AS samples FROM d JOIN s USING (source) GROUP BY 1""")
def source_column_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.source_profiles(table(spark, sf_dir, "source_supplier"), SUPPLIER_COLUMNS, "row_id")
    return found.select("source", "present", "distinct_ratio", "longest", F.array_join("samples", "|").alias("samples"))


_SHAPES = {"enum": "list_contains(['DE', 'EN', 'FR', 'IT', 'ES', 'JA'], v)", "six": "regexp_full_match(v, '[0-9]{6}')", "two": "regexp_full_match(v, '[A-Z]{2}')"}
_HELD = {
    "supplier.country": ["contract_regex_match:two:1.0", "uppercase_alpha_code_2:two:0.85"], "supplier.language": ["contract_enum_match:enum:1.0"],
    "company_data.reconciliation_account": ["contract_regex_match:six:1.0"], "company_data.bank_country": ["uppercase_alpha_code_2:two:0.85"],
}
_FORMS = " UNION ALL ".join(
    "SELECT source, '{0}' AS target, '{1}' AS name, {3} AS strength, round(len(list_filter(samples, lambda v: {2})) / len(samples), 4) AS support FROM s".format(target, part.split(":")[0], _SHAPES[part.split(":")[1]], part.split(":")[2])
    for target, parts in _HELD.items() for part in parts
)


@query(f"""
WITH {_DISTINCT}, e AS ({_FORMS})
SELECT source, target, max(strength)::DOUBLE AS score, max(support) AS support, string_agg(name, ',' ORDER BY name) AS evidence FROM e WHERE support >= 0.8 GROUP BY ALL""")
def value_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns hold values as the target asks for them, of the columns and targets that hold some."""
    pairs = _sources(spark, sf_dir).crossJoin(F.broadcast(_targets(spark).withColumnRenamed("kind", "target_kind").where("target not in ('supplier.category')")))
    seen = matching.value_evidence(*(F.col(c) for c in ("kind", "samples", "target_kind", "semantic_type", "enum_values", "pattern")))
    found = pairs.select("source", "target", seen.alias("e")).where("e.score > 0")
    return found.select("source", "target", "e.score", "e.support", F.array_join("e.evidence", ",").alias("evidence"))


_GRID = """
FROM (VALUES ('string'), ('integer'), ('number'), ('boolean'), ('date'), ('datetime')) k(kind), (VALUES ('string'), ('date'), ('number')) t(target_kind),
 (VALUES ('identifier'), ('email'), ('phone'), ('organization_name'), ('category_code'), (NULL)) s(semantic), (VALUES (0.2), (0.7), (0.95)) r(ratio), (VALUES (10), (30), (50)) l(longest)"""


@query(f"""
WITH g AS (SELECT *, coalesce(semantic, '') AS m {_GRID}), a AS (SELECT *, CASE WHEN kind IN ('date', 'datetime') AND target_kind <> 'date' THEN 0.82 ELSE 1.0 END AS g1,
 (kind = 'boolean' AND m <> 'category_code') OR (kind IN ('integer', 'number') AND m IN ('organization_name', 'email', 'phone')) AS cut FROM g),
b AS (SELECT *, CASE WHEN cut THEN least(g1, 0.6) ELSE g1 END AS g2 FROM a), c AS (SELECT *, CASE WHEN m = 'identifier' AND ratio >= 0.9 AND longest <= 24 THEN greatest(g2, 1.0) ELSE g2 END AS g3 FROM b)
SELECT kind, target_kind, semantic, ratio::DOUBLE AS ratio, longest, (CASE WHEN m = 'identifier' AND ratio < 0.5 AND longest > 40 THEN least(g3, 0.75) ELSE g3 END)::DOUBLE AS gate FROM c""")
def type_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate for every combination of kinds, meanings and profiles that its rules tell apart."""
    parts = {
        "kind": ["string", "integer", "number", "boolean", "date", "datetime"], "target_kind": ["string", "date", "number"],
        "semantic": ["identifier", "email", "phone", "organization_name", "category_code", None], "ratio": [0.2, 0.7, 0.95], "longest": [10, 30, 50],
    }
    grid = spark.range(1)
    for name, values in parts.items():
        grid = grid.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    grid = grid.drop("id")
    return grid.withColumn("gate", matching.gate(*(F.col(c) for c in ("kind", "target_kind", "semantic", "ratio", "longest")))[0])


_NAMES = ", ".join(f"('{c}')" for c in SUPPLIER_COLUMNS)
_ABOUT = ", ".join(
    f"('{r['name']}.{f['name']}', '{' '.join([f['name'], f['description'], f['semanticType']])}')" for r in _TARGET["resources"] for f in r["schema"]["fields"]
)
_MEANT = "MAP {" + ", ".join(f"'{k}': {v.split(' ')}" for k, v in matching.SYNONYMS.items()) + "}"
_EXPAND = lambda c: f"list_distinct(flatten(list_transform(string_split(lower(replace({c}, '_', ' ')), ' '), lambda w: list_concat([w], coalesce(({_MEANT})[w], [])))))"


@query(f"""
WITH s AS (SELECT source, {_EXPAND("source")} AS a FROM (VALUES {_NAMES}) v(source)), t AS (SELECT target, {_EXPAND("about")} AS b FROM (VALUES {_ABOUT}) w(target, about))
SELECT source, target, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS lexical FROM s CROSS JOIN t""")
def lexical_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = spark.createDataFrame([(c,) for c in SUPPLIER_COLUMNS], "source string")
    about = F.concat_ws(" ", "name", "description", "semantic_type")
    pairs = sources.crossJoin(F.broadcast(_targets(spark).select("target", about.alias("about"))))
    return pairs.select("source", "target", matching.lexical_overlap(matching.expanded(F.col("source")), matching.expanded(F.col("about"))).alias("lexical"))


_OLD = """SELECT 'group_' || (s_nationkey % 5) || CASE WHEN s_nationkey % 2 = 0 THEN '_name' ELSE '_key' END AS source, 'T' || (s_suppkey % 7) || '.' || CASE WHEN s_suppkey % 3 = 0 THEN 'FieldName' ELSE 'Part' END || (s_suppkey % 4) AS target,
 (s_suppkey % 100) / 100.0 AS semantic, (s_suppkey * 7 % 100) / 100.0 AS fuzzy, (s_suppkey % 10) / 10.0 AS fit, s_suppkey % 13 = 0 AS alias, s_suppkey % 11 = 0 AS computed FROM supplier"""


@query(f"""
WITH p AS ({_OLD}), o AS (SELECT *, ((semantic * 0.55 + fuzzy * 0.20) / 0.75) * (0.6 + 0.4 * fit) AS x FROM p),
f AS (SELECT *, round((CASE WHEN alias THEN greatest(x, 0.9) ELSE x END) * (CASE WHEN computed THEN 0.85 ELSE 1 END), 4) AS score, (ends_with(source, '_name') AND contains(target, 'Name')) OR regexp_extract(source, '_([0-9])_', 1) = target[-1] AS shared FROM o),
u AS (SELECT *, row_number() OVER (PARTITION BY source, split_part(target, '.', 2) ORDER BY score DESC, target) AS i FROM f), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS INT) AS rank FROM u WHERE i = 1)
SELECT source, rank, target, score::DOUBLE AS score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS band,
 CASE WHEN score < 0.4 THEN 'no_confident_target' WHEN NOT alias AND NOT shared THEN 'possible_false_friend' WHEN score < 0.7 THEN 'needs_review' ELSE 'suggested' END AS status FROM r WHERE rank <= 3""")
def old_mapping_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older scorer over pairs whose signals are drawn from the suppliers' numbers."""
    supplier = table(spark, sf_dir, "supplier")
    pairs = supplier.selectExpr(
        "concat('group_', s_nationkey % 5, CASE WHEN s_nationkey % 2 = 0 THEN '_name' ELSE '_key' END) as source",
        "concat('T', s_suppkey % 7, '.', CASE WHEN s_suppkey % 3 = 0 THEN 'FieldName' ELSE 'Part' END, s_suppkey % 4) as target",
        "(s_suppkey % 100) / 100D as semantic", "(s_suppkey * 7 % 100) / 100D as fuzzy", "(s_suppkey % 10) / 10D as fit", "s_suppkey % 13 = 0 as alias", "s_suppkey % 11 = 0 as computed",
    )
    # Exact ties of equal pairs are one pair.
    return matching.old_suggestions(pairs.distinct())


_CASES = """
c AS (SELECT vec_id AS case_id, label AS scenario, CASE WHEN vec_id % 7 = 0 THEN []::INT[] WHEN vec_id % 3 = 0 THEN [label, (label + 1) % 10] ELSE [label] END AS expected FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS case_id, e.label AS target, max(greatest(0, least(1, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])))) AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id
  WHERE q.vec_id % 20 = 0 GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, target) AS rank FROM s),
r AS (SELECT case_id, target AS recommended FROM f WHERE rank = 1 AND score >= 0.5), a AS (SELECT * FROM c LEFT JOIN r USING (case_id)),
p AS (SELECT a.case_id, scenario, len(expected) AS links, recommended IS NULL AS silent, count(rank) FILTER (rank = 1) AS at1, count(rank) FILTER (rank <= 3) AS at3, coalesce(sum(1 / rank) FILTER (rank <= 3), 0) AS points,
  min(rank) FILTER (rank <= 3) AS best FROM a LEFT JOIN f ON f.case_id = a.case_id AND list_contains(expected, f.target) GROUP BY ALL)"""


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each query vector is a case, labels are targets: no, one or two of them right; found by their nearest vector."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 20 = 0")
    best = retrieval.best_per_group(rows, queries, "vec_id", "embedding", "label")
    found = matching.top_per_group(best, ["query_id"], [F.desc(F.round("score", 9)), F.col("label")], 3).select(F.col("query_id").alias("case_id"), F.col("label").alias("target"), "rank", "score")
    found = durable(found)
    expected = F.when(F.col("vec_id") % 7 == 0, F.array().cast("array<int>")).when(F.col("vec_id") % 3 == 0, F.array("label", (F.col("label") + 1) % 10)).otherwise(F.array("label"))
    recommended = found.where("rank = 1 and score >= 0.5").select("case_id", F.col("target").alias("recommended"))
    cases = queries.select(F.col("vec_id").alias("case_id"), F.col("label").alias("scenario"), expected.alias("expected")).join(recommended, "case_id", "left")
    return cases, found.drop("score")


@query(f"""
WITH {_CASES} SELECT scenario, count(*) AS cases, sum(links)::BIGINT AS links, round(count(*) FILTER (links = 1 AND at1 = 1) / nullif(count(*) FILTER (links = 1), 0), 4) AS top1,
 round(sum(at1) / nullif(sum(links), 0), 4) AS recall_at_1, round(sum(at3) / nullif(sum(links), 0), 4) AS recall_at_3, round(sum(points) / nullif(sum(links), 0), 4) AS mrr,
 round(count(*) FILTER (links = 0 AND silent) / nullif(count(*) FILTER (links = 0), 0), 4) AS no_target, round(count(*) FILTER (links > 1 AND at3 = links) / nullif(count(*) FILTER (links > 1), 0), 4) AS full_coverage
FROM p GROUP BY ROLLUP (scenario)""")
def matching_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.benchmark(*_cases(spark, sf_dir), "scenario")


@query(f"""
WITH {_CASES} SELECT case_id, CASE WHEN links = 0 THEN CASE WHEN silent THEN 'correct_no_target' ELSE 'false_positive_for_no_target' END WHEN links > 1 AND at3 = links THEN 'multi_target_fully_covered'
 WHEN links > 1 AND at3 > 0 THEN 'multi_target_partially_covered' WHEN links > 1 THEN 'multi_target_missing' WHEN best = 1 THEN 'correct_top1' WHEN best <= 3 THEN 'correct_but_ranked_2_or_3' ELSE 'expected_target_missing_from_top3' END AS verdict FROM p""")
def matching_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.case_verdicts(*_cases(spark, sf_dir))


@query("""
SELECT DISTINCT regexp_replace(lower(alias), '[^a-z]', '', 'g') AS token, target, origin FROM (
 SELECT n_name AS alias, 'nation' AS target, 'name' AS origin FROM nation UNION ALL SELECT r_name, 'region', 'name' FROM region UNION ALL SELECT country_name, country_code, 'list' FROM country_reference)
WHERE regexp_replace(lower(alias), '[^a-z]', '', 'g') <> ''""")
def alias_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings = [
        table(spark, sf_dir, "nation").selectExpr("n_name as alias", "'nation' as target", "'name' as origin"), table(spark, sf_dir, "region").selectExpr("r_name as alias", "'region' as target", "'name' as origin"),
        table(spark, sf_dir, "country_reference").selectExpr("country_name as alias", "country_code as target", "'list' as origin"),
    ]
    return matching.alias_index(listings)
