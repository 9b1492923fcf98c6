"""Ranking, neighbours and first rows per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], most: int, rank: str = "rank") -> DataFrame:
    """The first ``most`` rows of each group; Spark limits groups before the shuffle."""
    window = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= most)


def margin_to_next(rows: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """(by..., best, margin): the best score of a group and its lead over the second; NULL without a second."""
    window = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return rows.withColumn("_r", F.row_number().over(window)).withColumn("_n", F.lead(score).over(window)).where("_r = 1").select(
        *by, F.col(score).alias("best"), (F.col(score) - F.col("_n")).alias("margin")
    )


def neighbours(rows: DataFrame, by: list[str], order: list[str], value: str, reach: int = 2) -> DataFrame:
    """Adds ``near``: the mean of ``value`` over the rows within ``reach`` before and after, without the row itself."""
    window = Window.partitionBy(*by).orderBy(*order)
    before, after = window.rowsBetween(-reach, -1), window.rowsBetween(1, reach)
    total = F.coalesce(F.sum(value).over(before), F.lit(0.0)) + F.coalesce(F.sum(value).over(after), F.lit(0.0))
    count = F.count(value).over(before) + F.count(value).over(after)
    return rows.withColumn("near", F.when(count > 0, total / count))


def first_per_group(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row per group, the smallest in ``order``, by an aggregation that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in by and c not in order]
    return rows.groupBy(*by).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(*by, "_r.*")
