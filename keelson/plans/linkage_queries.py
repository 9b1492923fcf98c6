"""Queries of linkage and of judging groups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import text
from keelson.operators import clusters, dedupe, linkage
from keelson.operators.linkage import Comparison
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


def _shapes(every: str) -> dict[str, str]:
    """Normal forms of the compared fields as SQL; ``every`` is what makes regexp_replace replace all matches."""
    clean = lambda c: f"nullif(trim(regexp_replace(lower({c}), '[^a-z0-9 ]', ''{every})), '')"
    digits = lambda c: f"regexp_replace({c}, '[^0-9]', ''{every})"
    return {
        "name": clean("vendor_name"), "city": clean("city"), "street": clean("street"), "postal": clean("postal_code"),
        "tax": f"CASE WHEN length({digits('tax_number')}) = 9 THEN {digits('tax_number')} END", "email": "CASE WHEN email LIKE '%@%.%' THEN lower(trim(email)) END",
        "phone": f"CASE WHEN length({digits('phone')}) >= 9 THEN right({digits('phone')}, 7) END", "created": "created_date", "currency": "nullif(trim(currency), '')",
    }


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vendor once, in normal form; of repeated deliveries the largest of each value."""
    shaped = table(spark, sf_dir, "legacy_vendors").selectExpr("legacy_vendor_id as id", *(f"{e} as {n}" for n, e in _shapes("").items()))
    return shaped.where("id is not null").groupBy("id").agg(*(F.max(n).alias(n) for n in _shapes("")))


_COLUMNS = ", ".join(f"max({e}) AS {n}" for n, e in _shapes(", 'g'").items())
_RECORDS = f"r AS (SELECT legacy_vendor_id AS id, {_COLUMNS} FROM legacy_vendors WHERE legacy_vendor_id IS NOT NULL GROUP BY 1)"
_COMPARISONS = [
    Comparison("name", "jaro_winkler", (0.95, 0.88, 0.80)), Comparison("postal"), Comparison("city"), Comparison("street", "edits", (2,)), Comparison("tax"),
    Comparison("email"), Comparison("phone"), Comparison("created"), Comparison("currency"),
]
_RULES = ["tax", "email", "phone"]
_USABLE = lambda c: F.when(~F.col(c).rlike(r"^(\d)\1*$"), F.col(c))
_PAIRED = "p AS (" + " UNION ".join(
    f"SELECT x.id AS a, y.id AS b FROM r x JOIN r y ON x.{c} = y.{c} AND x.id < y.id" + (f" WHERE len(list_distinct(string_split(x.{c}, ''))) > 1" if c != "email" else "") for c in _RULES
) + ")"
_LEVEL = {
    "name": "CASE WHEN x.name IS NULL OR y.name IS NULL THEN -1 WHEN x.name = y.name THEN 4 WHEN jaro_winkler_similarity(x.name, y.name) >= 0.95 THEN 3 WHEN jaro_winkler_similarity(x.name, y.name) >= 0.88 THEN 2 WHEN jaro_winkler_similarity(x.name, y.name) >= 0.80 THEN 1 ELSE 0 END",
    "street": "CASE WHEN x.street IS NULL OR y.street IS NULL THEN -1 WHEN x.street = y.street THEN 2 WHEN levenshtein(x.street, y.street) <= 2 THEN 1 ELSE 0 END",
}
_LEVELS = ", ".join(f"CAST({_LEVEL.get(c.field, f'CASE WHEN x.{c.field} IS NULL OR y.{c.field} IS NULL THEN -1 ELSE (x.{c.field} = y.{c.field})::INT END')} AS INT) AS {c.field}" for c in _COMPARISONS)


def _blocks() -> dict:
    return {c: F.col(c) if c == "email" else _USABLE(c) for c in _RULES}


@query(f"WITH {_RECORDS}, {_PAIRED} SELECT a, b, {_LEVELS} FROM p JOIN r x ON x.id = a JOIN r y ON y.id = b")
def linkage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = durable(_records(spark, sf_dir))
    return linkage.compare_levels(rows, dedupe.blocking_pairs(rows, "id", _blocks()), "id", _COMPARISONS)


@query()
def vendor_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = durable(_records(spark, sf_dir))
    blocks = _blocks()
    return linkage.link_by_levels(rows, "id", blocks, _COMPARISONS, {c: blocks[c] for c in ("tax", "email")}, {c: blocks[c] for c in ("tax", "phone")})


_TRUTH = "t AS (SELECT DISTINCT legacy_vendor_id AS id, group_id AS entity FROM vendor_duplicate_groups WHERE legacy_vendor_id IS NOT NULL AND group_id IS NOT NULL)"
_GROUPED = f"g AS (SELECT r.id, CASE WHEN tax IS NULL THEN 'record ' || id ELSE 'value ' || tax END AS cluster FROM r SEMI JOIN t USING (id))"


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "vendor_duplicate_groups").selectExpr("legacy_vendor_id as id", "group_id as entity")
    return rows.where("id is not null and entity is not null").distinct()


def _overlap(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    truth = _truth(spark, sf_dir)
    members = _records(spark, sf_dir).join(truth.select("id"), "id", "left_semi")
    return clusters.overlaps(clusters.by_key(members, "id", F.col(field)), truth)


# The SQL compares whole sets of members and real pairs, the operator only counts.
_SETS = f"""{_RECORDS}, {_TRUTH}, {_GROUPED},
ps AS (SELECT list_sort(list(id)) AS m, count(*) AS n FROM g GROUP BY cluster), ts AS (SELECT list_sort(list(id)) AS m, count(*) AS n FROM t WHERE id IN (SELECT id FROM r) GROUP BY entity),
pp AS (SELECT x.id AS a, y.id AS b FROM g x JOIN g y ON x.cluster = y.cluster AND x.id < y.id), tp AS (SELECT x.id AS a, y.id AS b FROM t x JOIN t y ON x.entity = y.entity AND x.id < y.id),
c AS (SELECT 'all' AS level, (SELECT count(*) FROM ps WHERE m IN (SELECT m FROM ts)) AS tp, (SELECT count(*) FROM ps) AS p, (SELECT count(*) FROM ts) AS t
  UNION ALL SELECT 'groups', (SELECT count(*) FROM ps WHERE n > 1 AND m IN (SELECT m FROM ts)), (SELECT count(*) FROM ps WHERE n > 1), (SELECT count(*) FROM ts WHERE n > 1)
  UNION ALL SELECT 'pairs', (SELECT count(*) FROM pp SEMI JOIN tp USING (a, b)), (SELECT count(*) FROM pp), (SELECT count(*) FROM tp))"""


@query(f"WITH {_SETS} SELECT level, tp, p - tp AS fp, t - tp AS fn, coalesce(tp / nullif(p, 0), 0) AS precision, coalesce(tp / nullif(t, 0), 0) AS recall, coalesce(2 * tp / nullif(p + t, 0), 0) AS f1 FROM c")
def cluster_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.scores(_overlap(spark, sf_dir, "tax"))


@query(f"""
WITH {_RECORDS}, {_TRUTH}, {_GROUPED}, e AS (SELECT entity, list_sort(list(id)) AS m FROM t GROUP BY 1),
v AS (SELECT cluster, list_sort(list(id)) AS m, count(DISTINCT entity) AS entities, any_value(entity) AS entity FROM g JOIN t USING (id) GROUP BY 1)
SELECT CASE WHEN entities > 1 THEN 'merged' WHEN v.m = e.m THEN 'exact' ELSE 'split' END AS verdict, count(*) AS groups FROM v JOIN e USING (entity) GROUP BY 1""")
def cluster_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.verdicts(_overlap(spark, sf_dir, "tax")).groupBy("verdict").agg(F.count(F.lit(1)).alias("groups"))


_BASELINES = ["tax", "email", "name"]


def _baseline_sql(field: str) -> str:
    return f"""SELECT '{field}' AS name, coalesce(2 * (SELECT count(*) FROM (SELECT list_sort(list(id)) AS m FROM k WHERE field = '{field}' GROUP BY cluster HAVING count(*) > 1) WHERE m IN (SELECT m FROM ts)) /
nullif((SELECT count(*) FROM (SELECT 1 FROM k WHERE field = '{field}' GROUP BY cluster HAVING count(*) > 1)) + (SELECT count(*) FROM ts WHERE n > 1), 0), 0) AS f1"""


@query(f"""
WITH {_RECORDS}, {_TRUTH}, ts AS (SELECT list_sort(list(id)) AS m, count(*) AS n FROM t GROUP BY entity),
k AS ({" UNION ALL ".join(f"SELECT '{f}' AS field, id, coalesce('value ' || {f}, 'record ' || id) AS cluster FROM r SEMI JOIN t USING (id)" for f in _BASELINES)}),
b AS ({" UNION ALL ".join(_baseline_sql(f) for f in _BASELINES)}) SELECT name, f1, f1 >= 0.99 AS leak FROM b""")
def trivial_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in _BASELINES:
        scored = clusters.scores(_overlap(spark, sf_dir, name)).where("level = 'groups'").select(F.lit(name).alias("name"), "f1")
        out = scored if out is None else out.unionByName(scored)
    return clusters.validity(out)


@query(f"""
WITH {_RECORDS}, {_TRUTH}, l AS ({" UNION ALL ".join(f"SELECT '{f}' AS field, entity, id, {f} AS v FROM t JOIN r USING (id)" for f in ("city", "tax", "currency"))})
SELECT x.field, count(*) AS pairs, count(*) FILTER (x.v = y.v) AS same, count(*) FILTER (x.v = y.v) / count(*) AS rate FROM l x JOIN l y ON x.field = y.field AND x.entity = y.entity AND x.id < y.id GROUP BY 1""")
def true_pair_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _truth(spark, sf_dir).join(_records(spark, sf_dir), "id")
    return clusters.pair_agreement(members, ["city", "tax", "currency"])


@query(f"""
WITH {_RECORDS}, {_TRUTH}, n AS (SELECT entity, count(*) AS size FROM t GROUP BY 1),
e AS (SELECT least(unique_id_l, unique_id_r) AS a, greatest(unique_id_l, unique_id_r) AS b, max(match_probability) AS score FROM vendor_match_pairs WHERE unique_id_l <> unique_id_r GROUP BY ALL),
i AS (SELECT x.entity, count(*) AS direct, min(score) AS weakest FROM e JOIN t x ON e.a = x.id JOIN t y ON e.b = y.id AND x.entity = y.entity GROUP BY 1),
c AS (SELECT entity, string_agg(f, ',' ORDER BY f) AS conflicts FROM (SELECT entity, f FROM (SELECT entity, 'email' AS f, email AS v FROM t JOIN r USING (id) UNION ALL SELECT entity, 'tax', tax FROM t JOIN r USING (id))
  GROUP BY ALL HAVING count(DISTINCT v) > 1) GROUP BY 1)
SELECT entity AS group_id, size, coalesce(conflicts, '') AS conflicts, coalesce(weakest < 0.99, false) AS weak, coalesce(direct, 0) < size * (size - 1) / 2 AS transitive,
  coalesce(weakest < 0.99, false) OR coalesce(direct, 0) < size * (size - 1) / 2 OR conflicts IS NOT NULL AS needs_review FROM n LEFT JOIN i USING (entity) LEFT JOIN c USING (entity) WHERE size > 1""")
def group_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _truth(spark, sf_dir).withColumnRenamed("entity", "group_id")
    pairs = table(spark, sf_dir, "vendor_match_pairs").where("unique_id_l <> unique_id_r")
    edges = pairs.groupBy(F.least("unique_id_l", "unique_id_r").alias("a"), F.greatest("unique_id_l", "unique_id_r").alias("b")).agg(F.max("match_probability").alias("score"))
    return clusters.review_groups(groups, dedupe.group_figures(groups, edges), _records(spark, sf_dir), {"tax": F.col("tax"), "email": F.col("email")}, dedupe.REVIEW)


@query(f"""
WITH e AS (SELECT upper(trim(unique_id_l)) AS a, upper(trim(unique_id_r)) AS b, max(match_probability) AS score FROM vendor_match_pairs WHERE unique_id_l <> unique_id_r GROUP BY ALL),
k AS (SELECT legacy_vendor_id AS id, max(load_no) AS load_no, max(source_system) AS system FROM legacy_vendors GROUP BY 1),
x AS (SELECT a, b, score FROM e JOIN k x ON e.a = x.id JOIN k y ON e.b = y.id WHERE score < 0.95 AND score >= 0.3 AND coalesce(x.system, 'record ' || a) <> coalesce(y.system, 'record ' || b))
SELECT * FROM x ORDER BY score DESC, a, b LIMIT 25""")
def borderline_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best scored pairs that were not matched, of records from different systems: a report of 25."""
    ids = [F.upper(F.trim(c)) for c in ("unique_id_l", "unique_id_r")]
    edges = table(spark, sf_dir, "vendor_match_pairs").where("unique_id_l <> unique_id_r").groupBy(ids[0].alias("a"), ids[1].alias("b")).agg(F.max("match_probability").alias("score"))
    known = table(spark, sf_dir, "legacy_vendors").groupBy(F.col("legacy_vendor_id").alias("id")).agg(F.max("source_system").alias("group_id"))
    inside = edges.join(known.select(F.col("id").alias("a")), "a", "left_semi").join(known.select(F.col("id").alias("b")), "b", "left_semi")
    return dedupe.borderline_pairs(inside, known)


@query(r"""
WITH l AS (SELECT group_id, count(*) AS members, count(DISTINCT regexp_replace(upper(tax_number), '[^A-Z0-9]', '', 'g')) AS taxes FROM vendor_duplicate_groups JOIN legacy_vendors USING (legacy_vendor_id) GROUP BY 1)
SELECT 'members' AS figure, sum(members)::BIGINT AS n FROM l UNION ALL SELECT 'taxes', sum(taxes)::BIGINT FROM l""")
def identifier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "vendor_duplicate_groups").join(table(spark, sf_dir, "legacy_vendors"), "legacy_vendor_id")
    tax = F.regexp_replace(F.upper("tax_number"), r"[^A-Z0-9]", "")
    each = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"), F.count_distinct(tax).alias("taxes"))
    return each.agg(F.sum("members").alias("members"), F.sum("taxes").alias("taxes")).unpivot([], ["members", "taxes"], "figure", "n")


@query()
def name_difference_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the names of each duplicate group differ from the group's first member, tag by tag."""
    members = table(spark, sf_dir, "vendor_duplicate_groups").select("group_id", "legacy_vendor_id").distinct()
    names = table(spark, sf_dir, "legacy_vendors").where("vendor_name is not null").groupBy("legacy_vendor_id").agg(F.max("vendor_name").alias("name"))
    named = members.join(names, "legacy_vendor_id")
    first = named.groupBy("group_id").agg(F.min_by("name", "legacy_vendor_id").alias("first"))
    tagged = named.join(first, "group_id").select(F.explode(text.difference_tags(F.col("first"), F.col("name"))).alias("tag"))
    return tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
