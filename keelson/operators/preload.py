"""Checks of records before they are loaded into target fields: issues of mappings, issues of records, verdicts, and
the root causes that many issues of records have in common.

The mappings are a short list made by hand; each turns into expressions, so all records are read in one scan. Repeated
keys are counted first and joined back, as in :mod:`keelson.operators.contracts`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.text import is_missing
from keelson.operators.findings import SAMPLE, severity_rank
from keelson.operators.rank import top_per_group
from keelson.operators.validate import parses_as
from keelson.skew import join_by_value, observed

# Severity of each issue.
ISSUE_SEVERITY = {
    "target_not_writable": "high", "unmapped_target_key": "high", "required_field_missing": "high", "duplicate_primary_key": "high",
    "max_length_overflow": "high", "type_not_parseable": "high", "value_not_in_allowed_values": "high", "no_target_in_schema": "high",
    "normalization_required": "medium", "possible_false_friend_target": "medium", "mapping_needs_review": "low",
}
# Code forms by a part of the field's name; the first in this order holds.
CODE_FORMS = {"country": r"^[A-Z]{2}\z", "currency": r"^[A-Z]{3}\z", "language": r"^[A-Z]{2}\z", "unit": r"^[A-Z0-9]{1,3}\z"}
# Whether a mapping of this status means what the target means; NULL is unsure.
MEANS_THE_SAME = {"suggested": True, "needs_review": None, "possible_false_friend": False, "no_confident_target": False}
STATUS_ISSUES = {"possible_false_friend": "possible_false_friend_target", "needs_review": "mapping_needs_review"}


@dataclass(frozen=True)
class Mapped:
    """A source field, the target field it goes to (None if there is none), and what that target asks for."""

    source: str
    target: str | None
    status: str = "suggested"
    kind: str = "string"
    key: bool = False
    nullable: bool = True
    creatable: bool = True
    updatable: bool = True
    max_length: int | None = None
    allowed: tuple[str, ...] = ()
    verified: bool = True


def code_form(field: str) -> str | None:
    """The form that codes of a field must have, told by its name."""
    return next((CODE_FORMS[part] for part in sorted(CODE_FORMS) if part in field.lower()), None)


def verdict(means_the_same: Column, loadable: Column) -> Column:
    """What both judgements, each possibly NULL, say together about a mapping."""
    return (
        F.when(loadable.isNull(), "no_target").when(means_the_same & ~loadable, "mapping_ok_but_not_loadable")
        .when(means_the_same & loadable, "loadable_ok").otherwise("needs_human_decision")
    )


def field_view(spark: SparkSession, mappings: list[Mapped]) -> DataFrame:
    """(source, target, status, means_the_same, loadable, verdict) of each mapping."""
    rows = [(m.source, m.target, m.status, MEANS_THE_SAME.get(m.status), (m.creatable or m.updatable) if m.target else None) for m in mappings]
    frame = spark.createDataFrame(rows, "source string, target string, status string, means_the_same boolean, loadable boolean")
    return frame.withColumn("verdict", verdict(F.col("means_the_same"), F.col("loadable")))


def offenders(rows: DataFrame, mappings: list[Mapped]) -> DataFrame:
    """(source, value, n): present values of code fields that are no codes, with their rows."""
    forms = {m.source: code_form(m.source) for m in mappings if code_form(m.source)}
    if not forms:
        return rows.sparkSession.createDataFrame([], "source string, value string, n bigint")
    pairs = [F.struct(F.lit(s).alias("source"), F.col(s).cast("string").alias("value"), F.col(s).cast("string").rlike(f).alias("fits")) for s, f in forms.items()]
    long = rows.select(F.inline(F.array(*pairs))).where(~is_missing(F.col("value")) & ~F.col("fits"))
    return long.groupBy("source", "value").agg(F.count(F.lit(1)).alias("n"))


def field_issues(rows: DataFrame, mappings: list[Mapped], target_keys: list[str]) -> DataFrame:
    """(source, target, issue, severity): issues of the mappings themselves. ``target_keys`` are the key fields of the
    targets touched, each of which some source field must reach."""
    spark = rows.sparkSession
    found = []
    for m in mappings:
        if m.target is None:
            found.append((m.source, None, "no_target_in_schema"))
        elif not (m.creatable or m.updatable):
            found.append((m.source, m.target, "target_not_writable"))
        if m.status in STATUS_ISSUES:
            found.append((m.source, m.target, STATUS_ISSUES[m.status]))
    reached = {m.target for m in mappings}
    found += [(None, key, "unmapped_target_key") for key in sorted(target_keys) if key not in reached]
    listed = spark.createDataFrame(found, "source string, target string, issue string")
    targets = spark.createDataFrame([(m.source, m.target) for m in mappings], "source string, target string")
    unfit = offenders(rows, mappings).select("source").distinct().join(targets, "source").select("source", "target", F.lit("normalization_required").alias("issue"))
    return rated(listed.unionByName(unfit))


def rated(issues: DataFrame) -> DataFrame:
    table = F.create_map(*(F.lit(x) for pair in ISSUE_SEVERITY.items() for x in pair))
    return issues.withColumn("severity", table[F.col("issue")])


def record_issues(rows: DataFrame, key: str, mappings: list[Mapped]) -> DataFrame:
    """(record_id, source, target, issue, severity, value, unverified) of every record and mapped field."""
    none = F.lit(None).cast("string")
    issue = lambda m, name, value: F.struct(
        F.col(key).cast("string").alias("record_id"), F.lit(m.source).alias("source"), F.lit(m.target).alias("target"), F.lit(name).alias("issue"),
        value.alias("value"), F.lit(not m.verified).alias("unverified"),
    )
    faults = []
    targeted = [m for m in mappings if m.target]
    for m in targeted:
        value = F.col(m.source).cast("string")
        missing = is_missing(value)
        if m.key or not m.nullable:
            faults.append(F.when(missing, issue(m, "required_field_missing", none)))
        if m.max_length is not None:
            faults.append(F.when(~missing & (F.length(value) > m.max_length), issue(m, "max_length_overflow", value)))
        if m.kind != "string":
            faults.append(F.when(~missing & ~F.coalesce(parses_as(value, m.kind), F.lit(False)), issue(m, "type_not_parseable", value)))
        if m.allowed:
            faults.append(F.when(~missing & ~value.isin(*m.allowed), issue(m, "value_not_in_allowed_values", value)))
    found = rows.select(F.inline(F.array_compact(F.array(*faults)))) if faults else None
    for m in targeted:
        if m.key:
            present = rows.select(F.col(key).cast("string").alias("record_id"), F.col(m.source).cast("string").alias("value")).where(~is_missing(F.col("value")))
            repeated, facts = observed(present.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "n")
            copies = join_by_value(present, repeated, ["value"], "n", facts=facts).select(
                "record_id", F.lit(m.source).alias("source"), F.lit(m.target).alias("target"), F.lit("duplicate_primary_key").alias("issue"), "value",
                F.lit(not m.verified).alias("unverified"),
            )
            found = copies if found is None else found.unionByName(copies)
    return rated(found)


def record_view(issues: DataFrame) -> DataFrame:
    """(record_id, issues, worst, summary): the issues of each record as sorted texts ``source: issue``. A record has at
    most a few issues for each mapped field, so the list is bounded by the mappings."""
    return issues.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("issues"), F.min(severity_rank(F.col("severity"))).alias("worst"),
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(": ", "source", "issue"))), "; ").alias("summary"),
    )


def root_causes(issues: DataFrame, normalization: DataFrame) -> DataFrame:
    """(source, target, root_cause, severity, records, unverified, sample): the issues of records by what causes them.

    Values that are too long because they are no codes are a matter of normalisation: ``normalization`` has the
    (source, target) with that issue, at most one row per mapping. The sample holds the smallest record ids.
    """
    coded = normalization.select("source", "target", F.lit(True).alias("coded")).distinct()
    causes = issues.join(F.broadcast(coded), ["source", "target"], "left")
    cause = F.when(F.col("coded") & (F.col("issue") == "max_length_overflow"), "normalization_required").otherwise(F.col("issue"))
    causes = causes.withColumn("root_cause", cause)
    by = ["source", "target", "root_cause"]
    figures = causes.groupBy(*by).agg(
        F.min(severity_rank(F.col("severity"))).alias("_rank"), F.count_distinct("record_id").alias("records"), F.bool_or("unverified").alias("unverified")
    )
    first = top_per_group(causes.select(*by, "record_id").distinct(), by, [F.col("record_id")], SAMPLE)
    sample = first.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("record_id")), ",").alias("sample"))
    names = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("_rank") + 1)
    return figures.join(sample, by).select(*by, names.alias("severity"), "records", "unverified", "sample")
