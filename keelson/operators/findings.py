"""Merging findings of several checks under stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.text import stable_id
from keelson.operators.rank import top_per_group

SAMPLE = 10
# Rank of severities, most severe first.
RANKS = {"high": 0, "medium": 1, "low": 2}


def severity_rank(c: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair))[F.lower(c)], F.lit(3))


def merge(findings: DataFrame) -> DataFrame:
    """(finding_id, rule_id, dedupe_key, severity, sources, rows, sample_keys) from (rule_id, dedupe_key, severity,
    source, row_key): equal findings become one with the highest severity, their sources and the ten smallest keys.

    The sample of keys is a top-k by counting distinct keys first, so a finding may have any number of rows.
    """
    names = F.create_map(*(F.lit(x) for name, rank in RANKS.items() for x in (rank, name)))
    by = ["rule_id", "dedupe_key"]
    summary = findings.groupBy(*by).agg(
        F.min(severity_rank(F.col("severity"))).alias("rank"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.count(F.lit(1)).alias("rows"),
    )
    first = top_per_group(findings.select(*by, "row_key").distinct(), by, [F.col("row_key")], SAMPLE)
    sample = first.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("row_key")), ",").alias("sample_keys"))
    return summary.join(sample, by, "left").select(
        stable_id("MIG-", F.lit("v1"), *(F.col(c) for c in by)).alias("finding_id"), *by, names[F.col("rank")].alias("severity"),
        "sources", "rows", "sample_keys",
    )


# What kind of risk item an issue becomes; all others are issues.
DEPENDENCIES = ["mapping_needs_review", "no_target_in_schema", "target_not_writable", "unmapped_target_key"]
RISKS = ["possible_false_friend_target"]
# Issues that block a gate if they are certain and of high severity.
BLOCKING = [
    "duplicate_primary_key", "foreign_key", "max_length_overflow", "normalization_required", "primary_key", "required", "required_field_missing",
    "type_not_parseable", "unique", "value_not_in_allowed_values",
]
STANDARD = ["rule_id", "dedupe_key", "issue", "raid_type", "severity", "review_required", "gate_blocker", "source", "row_key", "rows", "evidence"]


def raid_type(issue: Column) -> Column:
    return F.when(issue.isin(DEPENDENCIES), "Dependency").when(issue.isin(RISKS), "Risk").otherwise("Issue")


def blocks_gate(issue: Column, severity: Column, review_required: Column) -> Column:
    return (severity == "high") & ~review_required & issue.isin(BLOCKING)


def standard(rows: DataFrame, rule_id: str, source: str, key: list[Column], issue: Column, severity: Column, review: Column, row_key: Column, count: Column, **evidence: Column) -> DataFrame:
    """Rows of some check as findings with the columns ``STANDARD``; ``key`` are the parts that make findings the same,
    ``evidence`` goes into a map of texts."""
    pairs = F.map_filter(F.map_from_arrays(F.array(*(F.lit(n) for n in evidence)), F.array(*(c.cast("string") for c in evidence.values()))), lambda _, v: v.isNotNull())
    shaped = rows.select(
        F.lit(rule_id).alias("rule_id"), F.concat_ws("|", *(F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("none")))) for c in key)).alias("dedupe_key"),
        issue.alias("issue"), severity.alias("severity"), review.alias("review_required"), F.lit(source).alias("source"), row_key.cast("string").alias("row_key"),
        count.cast("bigint").alias("rows"), pairs.alias("evidence"),
    )
    return shaped.withColumn("raid_type", raid_type(F.col("issue"))).withColumn("gate_blocker", blocks_gate(F.col("issue"), F.col("severity"), F.col("review_required"))).select(*STANDARD)


def merge_standard(findings: DataFrame) -> DataFrame:
    """(finding_id, rule_id, dedupe_key, issue, raid_type, severity, review_required, gate_blocker, sources, rows,
    evidence): equal findings as one, with the highest severity, flags that any of them has, and all their evidence (of
    several values for one name the largest)."""
    by = ["rule_id", "dedupe_key"]
    names = F.create_map(*(F.lit(x) for name, rank in RANKS.items() for x in (rank, name)))
    figures = findings.groupBy(*by).agg(
        F.min("issue").alias("issue"), F.min("raid_type").alias("raid_type"), F.min(severity_rank(F.col("severity"))).alias("_rank"), F.bool_or("review_required").alias("review_required"),
        F.bool_or("gate_blocker").alias("gate_blocker"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.sum("rows").alias("rows"),
    )
    said = findings.select(*by, F.explode("evidence").alias("k", "v")).groupBy(*by, "k").agg(F.max("v").alias("v"))
    maps = said.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("evidence"))
    return figures.join(maps, by, "left").select(
        stable_id("MIG-", F.lit("v1"), *(F.col(c) for c in by)).alias("finding_id"), *by, "issue", "raid_type", names[F.col("_rank")].alias("severity"), "review_required", "gate_blocker",
        "sources", "rows", "evidence",
    )


def report_order() -> list[Column]:
    """Columns that order merged findings: blockers first, then severity, kind, rule, key and id."""
    return [F.desc("gate_blocker"), severity_rank(F.col("severity")).asc(), F.col("raid_type"), F.col("rule_id"), F.col("dedupe_key"), F.col("finding_id")]


def summary(merged: DataFrame) -> DataFrame:
    """(raid_type, severity, findings, to_review, blockers) for each pair, each kind, each severity and all."""
    count = lambda c: F.sum(F.col(c).cast("bigint"))
    return merged.cube("raid_type", "severity").agg(F.count(F.lit(1)).alias("findings"), count("review_required").alias("to_review"), count("gate_blocker").alias("blockers"))
