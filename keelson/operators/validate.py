"""Constraint checks. Each check yields violations (resource, field, category, row_key, value); they are united and
rolled up by grouping sets. A check that needs other rows uses one aggregation or an anti-join, never a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.text import is_missing

# Severity of each category.
SEVERITY = {
    "required": "high", "primary_key": "high", "foreign_key": "high", "unique": "high",
    "enum": "medium", "max_length": "medium", "pattern": "medium", "type": "medium", "constraint": "medium",
    "schema": "low", "other": "low",
}


def severity(category: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))[category]


def violation(resource: str, field: str, category: str, key: Column, value: Column) -> list[Column]:
    return [
        F.lit(resource).alias("resource"), F.lit(field).alias("field"), F.lit(category).alias("category"),
        key.cast("string").alias("row_key"), value.cast("string").alias("value"),
    ]


def broken_rule(rows: DataFrame, resource: str, field: str, category: str, key: Column, rule: Column) -> DataFrame:
    """Rows with a present value for which ``rule`` does not hold."""
    value = F.col(field).cast("string")
    return rows.where(~is_missing(value) & ~F.coalesce(rule, F.lit(False))).select(*violation(resource, field, category, key, value))


def missing_required(rows: DataFrame, resource: str, field: str, key: Column) -> DataFrame:
    return rows.where(is_missing(F.col(field).cast("string"))).select(*violation(resource, field, "required", key, F.col(field)))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., rows): keys that occur more than once, counted with map-side combination."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def later_duplicates(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The second and later rows of each key with the order value of the first (``first_row``)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    first = F.first(order[0]).over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("position", F.row_number().over(window)).withColumn("first_row", first).where("position > 1")


def orphans(child: DataFrame, parent: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Child rows whose present key has no parent row; rows with a NULL in the key are not orphans."""
    keys = parent.select(*(F.col(p).alias(c) for c, p in pairs.items())).distinct()
    present = child
    for column in pairs:
        present = present.where(F.col(column).isNotNull())
    return present.join(keys, list(pairs), "left_anti")


def rollup(violations: DataFrame) -> DataFrame:
    """(level, name, findings): counts by category, resource, severity and in all, in one pass."""
    rated = violations.withColumn("severity", severity(F.col("category")))
    counted = rated.groupBy("category", "resource", "severity").agg(F.count(F.lit(1)).alias("n"))
    levels = F.array(
        *(F.struct(F.lit(c).alias("level"), F.col(c).alias("name")) for c in ("category", "resource", "severity")),
        F.struct(F.lit("all").alias("level"), F.lit("all").alias("name")),
    )
    return counted.select(F.inline(levels), "n").groupBy("level", "name").agg(F.sum("n").alias("findings"))


def parses_as(value: Column, kind: str) -> Column:
    """Whether a text can be read as boolean, integer, number, date or uuid (dates in four notations)."""
    if kind == "date":
        return F.coalesce(*(F.try_to_date(value, f) for f in ("yyyy-MM-dd", "yyyyMMdd", "dd.MM.yyyy", "MM/dd/yyyy"))).isNotNull()
    if kind == "uuid":
        return value.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    if kind == "boolean":
        return F.lower(value).isin("true", "false")
    return value.try_cast({"integer": "bigint", "number": "double"}[kind]).isNotNull()
