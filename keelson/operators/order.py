"""Numbering and one-to-one alignment without a single-task sort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.storage import durable


def global_row_number(rows: DataFrame, order: list[str], name: str = "row_number", parts: int | None = None) -> DataFrame:
    """Adds 1, 2, 3 ... in the order of columns that tell all rows apart.

    The rows are range-partitioned and sorted; each task numbers its own rows, and the offsets of the partitions (one
    number per partition) are added from a small table. The sorted rows are written first, since the numbers need the
    same partitions twice.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    )
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for part in sorted(sizes):
        offsets.append((part, total))
        total += sizes[part]
    table = spark.createDataFrame(offsets, "_part int, _offset bigint")
    return placed.join(F.broadcast(table), "_part").withColumn(name, F.col("_offset") + F.col("_place") + 1).drop("_part", "_place", "_offset")


def greedy_alignment(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """The one-to-one pairs that taking the best pair again and again would give (order: score descending, left,
    right).

    A pair scored repeatedly counts with its highest score; pairs without score or without an end are left out. In
    each round all pairs that are the best of both their ends are taken at once, which gives the same result; the
    pairs of the ends taken are dropped, until none is left. Scores that fall along a chain of pairs need a round for
    every second pair of it. No pairs give no rows.
    """
    scored = pairs.where(F.col(score).isNotNull() & F.col(left).isNotNull() & F.col(right).isNotNull())
    open_pairs = durable(scored.groupBy(left, right).agg(F.max(score).alias(score)))
    taken: list[DataFrame] = []
    order = F.struct((-F.col(score)).alias("s"), F.col(left).alias("l"), F.col(right).alias("r"))
    while not open_pairs.isEmpty():
        ends = [open_pairs.groupBy(end).agg(F.min(order).alias("b")).select("b.l", "b.r") for end in (left, right)]
        both = ends[0].join(ends[1], ["l", "r"], "left_semi").select(F.col("l").alias(left), F.col("r").alias(right))
        new = durable(open_pairs.join(both, [left, right], "left_semi"))
        taken.append(new)
        open_pairs = durable(
            open_pairs.join(new.select(left), left, "left_anti").join(new.select(right), right, "left_anti")
        )
    return reduce(DataFrame.unionByName, taken, open_pairs).select(left, right, score)
