"""Scores of predictions against truth, each as one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """NULL for an empty denominator."""
    return F.when(b > 0, a / b)


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1; 0 where nothing was predicted or nothing is true."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [
        zero(ratio(tp, tp + fp)).alias("precision"), zero(ratio(tp, tp + fn)).alias("recall"),
        zero(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"),
    ]


def set_scores(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of two sets of rows."""
    both = predicted.select(*keys, F.lit(1).alias("p")).distinct().join(truth.select(*keys, F.lit(1).alias("t")).distinct(), keys, "full")
    counts = both.agg(
        F.sum(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("t").isNull(), 1).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("p").isNull(), 1).otherwise(0)).alias("fn"),
    ).na.fill(0)
    return counts.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def confusion(rows: DataFrame, expected: str, predicted: str, labels: list) -> DataFrame:
    """One row per expected label with a zero-filled count column for each predicted one."""
    counts = [F.sum(F.when(F.col(predicted) == x, 1).otherwise(0)).alias(f"as_{x}") for x in labels]
    return rows.groupBy(F.col(expected).alias("expected")).agg(*counts)


def ranking_scores(cases: DataFrame, by: list[str]) -> DataFrame:
    """Cases (by..., rank of the first right answer or NULL) as hits and mean reciprocal rank, by group and over all.

    The overall row has NULL in ``by``."""
    first = (F.col("rank") == 1).cast("int")
    third = (F.col("rank") <= 3).cast("int")
    return cases.rollup(*by).agg(
        F.count(F.lit(1)).alias("cases"),
        F.avg(F.coalesce(first, F.lit(0))).alias("top1"),
        F.avg(F.coalesce(third, F.lit(0))).alias("top3"),
        F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"),
    )


def recall_by_level(truth: DataFrame, found: DataFrame, keys: list[str], level: str) -> DataFrame:
    """(level, cases, recall): the share of true rows that were found, by a column of the truth."""
    marked = truth.join(found.select(*keys, F.lit(1).alias("_hit")).distinct(), keys, "left")
    return marked.groupBy(level).agg(F.count(F.lit(1)).alias("cases"), F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))
