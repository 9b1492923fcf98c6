"""Small building blocks of reports over plans, statuses and lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zero_filled(rows: DataFrame, domains: dict[str, list[str]], name: str = "n") -> DataFrame:
    """Counts of every combination of the listed values, 0 where there is no row. The lists are fixed and short; rows with
    other values are not counted."""
    grid = rows.sparkSession.range(1)
    for column, values in domains.items():
        grid = grid.withColumn(column, F.explode(F.array(*(F.lit(v) for v in values))))
    counts = rows.groupBy(*domains).agg(F.count(F.lit(1)).alias(name))
    return grid.drop("id").join(F.broadcast(counts.where(reduce(lambda a, b: a & b, (F.col(c).isin(v) for c, v in domains.items())))), list(domains), "left").na.fill(0, [name])


def checked_value(rows: DataFrame, column: str, value: str | None) -> str | None:
    """``value`` if the column holds it (None asks for nothing). Raises ValueError with the allowed values otherwise; the
    column is one of few values, such as a status."""
    if value is None or not rows.where(F.col(column) == value).isEmpty():
        return value
    allowed = sorted(r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().limit(100).collect())
    raise ValueError(f"{column} must be one of {', '.join(map(str, allowed))}")


def preview(rows: DataFrame, wanted: Column, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` matching rows with ``total``, ``matched`` and ``returned`` beside them: a paged view, whose limit
    is its feature. Without a match there is no row."""
    if not 1 <= most <= 500:
        raise ValueError("between 1 and 500 rows can be shown")
    counts = rows.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.coalesce(wanted, F.lit(False)).cast("bigint")), F.lit(0)).alias("matched"))
    shown = rows.where(wanted).orderBy(*order).limit(most).crossJoin(F.broadcast(counts))
    return shown.withColumn("returned", F.least("matched", F.lit(most).cast("bigint")))


def next_due(rows: DataFrame, key: str, due: Column, as_of: int) -> DataFrame:
    """One row (key, due): what is due next, at ``as_of`` or later, ties by key; none if nothing is."""
    best = rows.select(F.col(key), due.alias("due")).where(F.col("due") >= as_of).agg(F.min(F.struct("due", key)).alias("b"))
    return best.where("b is not null").select(f"b.{key}", "b.due")


def by_priority(parts: list[DataFrame], key: str) -> DataFrame:
    """(key, priority): every id once, with the place (from 1) of the first list that names it."""
    listed = [part.select(key, F.lit(i).alias("priority")) for i, part in enumerate(parts, 1)]
    return reduce(DataFrame.unionByName, listed).where(F.col(key).isNotNull()).groupBy(key).agg(F.min("priority").alias("priority"))


def set_differences(rows: DataFrame, group: str, value: str, expected: list[str]) -> DataFrame:
    """(group, missing, unexpected) of the groups whose set of values is not the expected one, as sorted texts; what is
    expected is a fixed list, and distinct values are counted with map-side combination."""
    distinct = rows.select(group, value).where(F.col(group).isNotNull()).distinct()
    known = [F.max((F.col(value) == v).cast("int")).alias(f"_{i}") for i, v in enumerate(expected)]
    odd = F.array_join(F.array_sort(F.collect_set(F.when(~F.col(value).isin(expected), F.col(value)))), ",").alias("unexpected")
    found = distinct.groupBy(group).agg(*known, odd)
    missing = F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(F.col(f"_{i}"), F.lit(0)) == 0, v) for i, v in enumerate(sorted(expected, key=expected.index))))), ",")
    return found.select(group, missing.alias("missing"), "unexpected").where("missing <> '' or unexpected <> ''")


def previous_in_order(rows: DataFrame, group: str, key: str, stage: str, stages: list[str]) -> DataFrame:
    """(group, key, previous): the member of the group that stands before in the order of stages. A group has a member or
    few for each stage of a fixed list, so its window is short."""
    place = F.array_position(F.array(*(F.lit(s) for s in stages)), F.col(stage))
    staged = rows.where(F.col(stage).isin(stages))
    return staged.select(group, key, F.lag(key).over(Window.partitionBy(group).orderBy(place, key)).alias("previous"))


def headline(rows: DataFrame, status: str, done: str, names: list[str]) -> DataFrame:
    """One row: items, a count for each status, and the percentage done (NULL without items)."""
    counts = [F.coalesce(F.sum((F.col(status) == n).cast("bigint")), F.lit(0)).alias(n.lower().replace(" ", "_")) for n in names]
    column = done.lower().replace(" ", "_")
    figures = rows.agg(F.count(F.lit(1)).alias("items"), *counts)
    return figures.withColumn("percent_done", F.when(F.col("items") > 0, F.round(100 * F.col(column) / F.col("items"), 1)))


def only_keys(items: Column, keys: list[str]) -> Column:
    """An array of structs with nothing but the listed fields."""
    return F.transform(items, lambda x: F.struct(*(x[k].alias(k) for k in keys)))


def cached(requests: DataFrame, cache: DataFrame, parts: list[str]) -> DataFrame:
    """The requests with the answer that a cache (fingerprint, answer) has for them, NULL where it has none; the
    fingerprint is a hash of the parts that make requests the same."""
    print_ = F.sha2(F.to_json(F.array(*(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))), 256)
    return requests.withColumn("fingerprint", print_).join(cache.select("fingerprint", "answer").dropDuplicates(["fingerprint"]), "fingerprint", "left")
