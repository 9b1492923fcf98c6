"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from keelson.storage import durable

#: A key is hot when it holds at least this fraction of all rows, so there are at most 1 / HOT_FRACTION hot keys.
HOT_FRACTION = 0.001
#: Parts that the rows of a hot key are spread over.
SALTS = 64
#: Most rows and most bytes of a lookup that is broadcast as a whole; both are counted first.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 32 * 2**20


def row_bytes(rows: DataFrame) -> Column:
    """About how many bytes a row takes: the text columns as they are, 8 for any other."""
    kinds = dict(rows.dtypes)
    sizes = [F.coalesce(F.octet_length(F.to_json(F.struct(F.col(c))) if k.startswith(("array", "map", "struct")) else F.col(c).cast("string")), F.lit(0)) for c, k in kinds.items()]
    return sum(sizes, F.lit(8 * len(sizes)))


class Facts(NamedTuple):
    """What is known of a lookup: its rows, the sum of its count column, its bytes."""

    rows: int
    total: int
    bytes: int


def _figures(lookup: DataFrame, count_column: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.sum(count_column).alias("total"), F.sum(row_bytes(lookup)).alias("bytes")]


def observed(lookup: DataFrame, count_column: str) -> tuple[DataFrame, Facts]:
    """The lookup as a written table, and its facts, counted while it is written."""
    watch = Observation()
    written = durable(lookup.observe(watch, *_figures(lookup, count_column)))
    return written, Facts(*(watch.get.get(name) or 0 for name in Facts._fields))


def join_by_value(
    rows: DataFrame, lookup: DataFrame, keys: list[str], count_column: str, how: str = "inner", facts: Facts | None = None
) -> DataFrame:
    """Join ``rows`` with ``lookup`` (unique on ``keys``), whose ``count_column`` says how many rows have that key.

    ``lookup`` is read several times, so it should be a written table. If it has at most ``BROADCAST_ROWS`` rows and
    ``BROADCAST_BYTES`` bytes it is broadcast. Otherwise both sides are shuffled once, and the rows of hot keys are
    spread over ``SALTS`` parts. Of the hot keys, at most ``1 / HOT_FRACTION`` whatever the size of the data, only a
    hash of 8 bytes is broadcast; a key that shares the hash of a hot one is spread as well, on both sides alike.
    ``how`` is ``inner``, ``left`` or ``left_semi``. NULL keys match nothing. ``facts``, where the caller has them
    (:func:`observed`, of the lookup or of a table with the same keys, counts and no narrower rows), save a count.
    """
    if facts is None:
        facts = Facts(*(value or 0 for value in lookup.agg(*_figures(lookup, count_column)).first()))
    if facts.rows <= BROADCAST_ROWS and facts.bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(lookup.drop(count_column)), keys, how)
    mark = F.xxhash64(*keys).alias("_mark")
    hot = lookup.where(F.col(count_column) >= F.lit(facts.total * HOT_FRACTION)).select(mark, F.lit(True).alias("_hot")).distinct()
    marked = lambda df: df.withColumn("_mark", mark).join(F.broadcast(hot), "_mark", "left").drop("_mark")
    spread = F.pmod(F.xxhash64(*(F.col(c) for c in rows.columns)), F.lit(SALTS)).cast("int")
    salted = marked(rows).withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0))).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread_lookup = marked(lookup).withColumn("_salt", F.explode(copies)).drop("_hot", count_column)
    return salted.join(spread_lookup, [*keys, "_salt"], how).drop("_salt")


def blank_to_null(column: Column) -> Column:
    """NULL for values of white space only (no-break spaces included)."""
    return F.when(column.rlike(r"[^\s   　]"), column)
