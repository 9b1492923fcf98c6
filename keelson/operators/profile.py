"""Column profiles, value distributions, format signatures and quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.text import format_signature, is_missing

IDENTIFIER_RATIO, MISSING_FLAG, MISSING_HIGH = 0.98, 0.10, 0.25
MOST_DISTRIBUTED, MOST_SIGNATURES = 20, 6


def long_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value): the columns as text, in one pass over the table."""
    return rows.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "field", "value")


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n): the one shuffle that all profile figures share."""
    return long_values(rows, columns).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, records, missing, distinct_values, missing_ratio, distinct_ratio, average_length, longest): ratios of
    distinct values are over present ones, 0 where nothing is present."""
    missing = is_missing(F.col("value"))
    figures = value_counts(rows, columns).groupBy("field").agg(
        F.sum("n").alias("records"),
        F.sum(F.when(missing, F.col("n")).otherwise(0)).alias("missing"),
        F.sum(F.when(~missing, 1).otherwise(0)).alias("distinct_values"),
        F.sum(F.when(~missing, F.col("n") * F.length("value"))).alias("_length"),
        F.max(F.when(~missing, F.length("value"))).alias("longest"),
    )
    present = F.col("records") - F.col("missing")
    return figures.select(
        "field", "records", "missing", "distinct_values", (F.col("missing") / F.col("records")).alias("missing_ratio"),
        F.when(present > 0, F.col("distinct_values") / present).otherwise(0.0).alias("distinct_ratio"),
        F.when(present > 0, F.col("_length") / present).otherwise(0.0).alias("average_length"), "longest",
    )


def value_distribution(rows: DataFrame, columns: list[str], most: int = MOST_DISTRIBUTED) -> DataFrame:
    """(field, value, n) of the fields with at most ``most`` distinct present values."""
    counts = value_counts(rows, columns).where(~is_missing(F.col("value")))
    few = counts.groupBy("field").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") <= most).select("field")
    return counts.join(F.broadcast(few), "field", "left_semi")


def signature_histogram(rows: DataFrame, columns: list[str], most: int = MOST_SIGNATURES) -> DataFrame:
    """(field, signature, n, example, position): the most frequent formats per field, ties by signature."""
    counts = value_counts(rows, columns).where(~is_missing(F.col("value")))
    found = counts.groupBy("field", format_signature(F.col("value")).alias("signature")).agg(
        F.sum("n").alias("n"), F.min("value").alias("example")
    )
    order = Window.partitionBy("field").orderBy(F.desc("n"), "signature")
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)


def quality_flags(profiled: DataFrame, signatures: DataFrame) -> DataFrame:
    """(field, issue, severity) for missing values and for several formats in a column that is no identifier."""
    missing = profiled.where(F.col("missing_ratio") > MISSING_FLAG).select(
        "field", F.lit("missing_values").alias("issue"), F.when(F.col("missing_ratio") > MISSING_HIGH, "high").otherwise("medium").alias("severity")
    )
    formats = signatures.groupBy("field").agg(F.count(F.lit(1)).alias("formats"))
    mixed = profiled.where(F.col("distinct_ratio") <= IDENTIFIER_RATIO).join(formats, "field").where("formats > 1").select(
        "field", F.lit("mixed_formats").alias("issue"), F.when(F.col("formats") > 5, "high").otherwise("medium").alias("severity")
    )
    return missing.unionByName(mixed)


def kind(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, kind): the narrowest of boolean, integer, number, date, datetime, string that all present values fit."""
    value = F.trim("value")
    tests: dict[str, Column] = {
        "boolean": F.lower(value).isin("true", "false", "yes", "no", "y", "n", "0", "1"),
        "integer": value.rlike(r"^[+-]?\d+$"),
        "number": value.rlike(r"^[+-]?\d+(\.\d+)?$"),
        "date": value.rlike(r"^\d{4}-\d{2}-\d{2}$"),
        "datetime": value.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"),
    }
    present = value_counts(rows, columns).where(~is_missing(F.col("value")))
    fits = present.groupBy("field").agg(*(F.bool_and(test).alias(name) for name, test in tests.items()))
    chain = F.lit("string")
    for name in reversed(tests):
        chain = F.when(F.col(name), name).otherwise(chain)
    return fits.select("field", chain.alias("kind"))
