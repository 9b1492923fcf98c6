"""Further queries: linkage, mapping, alignment, numbering, retrieval rules, reviews and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.operators import mapping, order, profile, rank, retrieval
from keelson.streaming.changes import counts_per_window
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


@query("SELECT 'EX-' || printf('%06d', row_number() OVER (ORDER BY o_totalprice, o_orderkey)) AS id, o_orderkey FROM orders WHERE o_orderstatus <> 'P'")
def sequence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_totalprice", "o_orderkey")
    numbered = order.global_row_number(kept, ["o_totalprice", "o_orderkey"])
    return numbered.select(F.format_string("EX-%06d", "row_number").alias("id"), "o_orderkey")


@query("""
WITH RECURSIVE best AS (SELECT unique_id_l AS l, unique_id_r AS r, max(match_probability) AS p FROM vendor_match_pairs
  WHERE unique_id_l <> unique_id_r AND match_probability IS NOT NULL GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (ORDER BY p DESC, l, r) AS i FROM best),
g AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS l, NULL::VARCHAR AS r, NULL::DOUBLE AS p, false AS taken, []::VARCHAR[] AS lefts, []::VARCHAR[] AS rights
  UNION ALL SELECT i, l, r, p, fresh, CASE WHEN fresh THEN list_append(lefts, l) ELSE lefts END, CASE WHEN fresh THEN list_append(rights, r) ELSE rights END FROM (
    SELECT n.*, g.lefts, g.rights, NOT list_contains(g.lefts, n.l) AND NOT list_contains(g.rights, n.r) AS fresh FROM g JOIN n ON n.i = g.i + 1))
SELECT l AS unique_id_l, r AS unique_id_r, p AS match_probability FROM g WHERE taken""")
def greedy_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "vendor_match_pairs").where("unique_id_l <> unique_id_r")
    return order.greedy_alignment(pairs, "unique_id_l", "unique_id_r", "match_probability")


@query(r"""
SELECT doc_id, i AS chunk_no, parts[i] AS chunk FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS parts FROM documents WHERE text IS NOT NULL), generate_series(1, len(parts)) AS g(i)
WHERE trim(parts[i], ' ' || chr(10) || chr(9)) <> ''""")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    parts = docs.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("i", "chunk"))
    return parts.where(~F.col("chunk").rlike(r"^[ \n\t]*$")).select("doc_id", (F.col("i") + 1).cast("bigint").alias("chunk_no"), "chunk")


@query("""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label AS found,
  greatest(0, least(1, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]))) AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s),
a AS (SELECT query_id, max(score) AS best, max(found) FILTER (rank = 1) AS first, count(DISTINCT found) AS labels FROM r WHERE rank <= 3 GROUP BY 1)
SELECT query_id, CASE WHEN best < 0.2 THEN 'none' WHEN labels = 1 THEN 'standard' WHEN best >= 0.5 THEN 'configuration' ELSE 'review' END AS verdict, first FROM a""")
def retrieval_rule_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    top = retrieval.top_k(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 3).join(
        rows.select(F.col("vec_id").alias("id"), F.col("label").alias("found")), "id"
    )
    each = top.groupBy("query_id").agg(
        F.max("score").alias("best"), F.max(F.when(F.col("rank") == 1, F.col("found"))).alias("first"), F.count_distinct("found").alias("labels")
    )
    verdict = F.when(F.col("best") < 0.2, "none").when(F.col("labels") == 1, "standard").when(F.col("best") >= 0.5, "configuration").otherwise("review")
    return each.select("query_id", verdict.alias("verdict"), "first")


@query("""
SELECT tax_number, count(DISTINCT legacy_vendor_id) AS sources FROM legacy_vendors WHERE regexp_matches(tax_number, '^[A-Z]{2}[0-9]{9}$') GROUP BY 1 HAVING count(DISTINCT legacy_vendor_id) > 1""")
def review_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "legacy_vendors").where(F.col("tax_number").rlike(r"^[A-Z]{2}[0-9]{9}\z"))
    return rows.groupBy("tax_number").agg(F.count_distinct("legacy_vendor_id").alias("sources")).where("sources > 1")


@query("""
SELECT field, value_share FROM (
 SELECT 'currency' AS field, avg(regexp_matches(currency, '^[A-Z]{3}$')::INT) AS value_share FROM legacy_vendors WHERE trim(coalesce(currency, '')) <> ''
 UNION ALL SELECT 'country', avg(regexp_matches(country, '^[A-Z]{2}$')::INT) FROM legacy_vendors WHERE trim(coalesce(country, '')) <> '')""")
def pattern_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = profile.value_counts(table(spark, sf_dir, "legacy_vendors"), ["currency", "country"]).where(F.trim("value") != "")
    fits = F.when(F.col("field") == "currency", F.col("value").rlike(r"^[A-Z]{3}\z")).otherwise(F.col("value").rlike(r"^[A-Z]{2}\z"))
    return long.groupBy("field").agg((F.sum(F.when(fits, F.col("n")).otherwise(0)) / F.sum("n")).alias("value_share"))


@query("""
WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), b AS (SELECT doc_id, sha256(coalesce(trim(text), '')) AS h FROM documents WHERE lang = 'en')
SELECT CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS state, count(*) AS documents FROM a LEFT JOIN b USING (doc_id) GROUP BY 1""")
def hash_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    now = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    then = docs.where("lang = 'en'").select("doc_id", F.sha2(F.coalesce(F.trim("text"), F.lit("")), 256).alias("expected"))
    state = F.when(F.col("expected").isNull(), "missing").when(F.col("h") == F.col("expected"), "same").otherwise("changed")
    return now.join(then, "doc_id", "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("documents"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_per_window(table(spark, sf_dir, "events"), "ts", "event_type")


@query("""
SELECT event_id, len(list_filter(evidence, lambda x: NOT contains(lower(x), 'record'))) AS unsupported FROM cutover_status_updates WHERE evidence IS NOT NULL AND event_id IS NOT NULL""")
def unsupported_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "cutover_status_updates").where("evidence is not null and event_id is not null")
    return rows.select("event_id", F.size(F.filter("evidence", lambda x: ~F.lower(x).contains("record"))).cast("bigint").alias("unsupported"))


@query("""
WITH n AS (SELECT DISTINCT legacy_vendor_id, vendor_name FROM legacy_vendors WHERE vendor_name IS NOT NULL)
SELECT legacy_vendor_id, vendor_name <> lower(vendor_name) AS has_case, contains(vendor_name, '&') AS has_ampersand, regexp_matches(vendor_name, '[.,()-]') AS has_punctuation, contains(vendor_name, '  ') AS has_spaces FROM n""")
def name_writing_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("vendor_name")
    rows = table(spark, sf_dir, "legacy_vendors").where("vendor_name is not null").select("legacy_vendor_id", "vendor_name").distinct()
    return rows.select(
        "legacy_vendor_id", (name != F.lower(name)).alias("has_case"), name.contains("&").alias("has_ampersand"),
        name.rlike(r"[.,()\-]").alias("has_punctuation"), name.contains("  ").alias("has_spaces"),
    )


@query("""
SELECT source, doc_id, n_words FROM (SELECT source, doc_id, length(text) AS n_words, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r <= 4""")
def longest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text is not null").select("source", "doc_id", F.length("text").cast("bigint").alias("n_words"))
    return rank.top_per_group(rows, ["source"], [F.desc("n_words"), F.col("doc_id")], 4).drop("rank")
