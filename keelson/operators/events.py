"""Ordered status events: transitions, state as of a point, due buckets and work-package roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transitions(events: DataFrame, entity: str, order: list[str], status: str, allowed: dict[str, list[str]], initial: str) -> DataFrame:
    """Adds ``previous`` and ``legal``: whether the step from the previous status is allowed; staying is always legal."""
    window = Window.partitionBy(entity).orderBy(*order)
    moved = events.withColumn("previous", F.lag(status, 1, initial).over(window))
    legal = F.col(status) == F.col("previous")
    for before, after in allowed.items():
        legal = legal | ((F.col("previous") == before) & F.col(status).isin(after))
    return moved.withColumn("legal", legal)


def state_as_of(events: DataFrame, entity: str, order: list[str], status: str, until: Column) -> DataFrame:
    """(entity, status, changes): the latest status among the events for which ``until`` holds; no sort, any skew."""
    return events.where(until).groupBy(entity).agg(
        F.max_by(status, F.struct(*order)).alias(status), F.count(F.lit(1)).alias("changes")
    )


def due_bucket(end: Column, as_of: int) -> Column:
    return F.when(end == as_of, "due_now").when(end < as_of, "overdue").when(end <= 0, "due_next").otherwise("later")


def package_status(rows: DataFrame, package: str, status: str, progress: str) -> DataFrame:
    """(package, status, progress): all cancelled, all completed, any blocked, any started, else not started."""
    every = lambda s: F.bool_and(F.col(status) == s)
    some = lambda c: F.bool_or(c)
    return rows.groupBy(package).agg(
        F.when(every("Cancelled"), "Cancelled").when(every("Completed"), "Completed").when(some(F.col(status) == "Blocked"), "Blocked")
        .when(some(F.col(status) != "Not Started"), "In Progress").otherwise("Not Started").alias("package_status"),
        F.avg(progress).alias("progress"),
    )


def rag(critical: Column, warning: Column) -> Column:
    return F.when(critical, "Red").when(warning, "Amber").otherwise("Green")
