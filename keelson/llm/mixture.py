"""Mixing sources to target shares by Poisson replication.

Every document draws its number of copies from a Poisson distribution, cut off at the source's cap, by inverting the
distribution at a number hashed from its id and the seed. The draw is thus repeatable, needs no state and is made where
the document lies. For a fixed hash the number of copies only grows with the mean, so the mean of each source is
calibrated on the driver until the source's tokens meet the target, from the tokens per hash interval and their mean
hash (a table of a fixed number of rows). A document alone in its interval is thereby placed exactly. The copies are
exploded and shuffled globally by another hash, which is the only shuffle of texts.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.tokens import VOCABULARY, token_count
from keelson.storage import durable

#: Hash intervals of a source, and of all sources together.
INTERVALS, MOST_INTERVALS = 4096, 400_000


def _thresholds(mean: float, cap: int) -> list[float]:
    """Cumulative probabilities of 0 .. cap - 1 copies; a hash at or above the k-th gives more than k copies."""
    total, term, out = 0.0, math.exp(-mean), []
    for k in range(cap):
        total += term
        out.append(min(total, 1.0))
        term *= mean / (k + 1)
    return out


class _Held:
    """The tokens of a source by the hash at which they lie."""

    def __init__(self, places: list[tuple[float, int]]):
        places.sort()
        self.at = np.array([at for at, _ in places])
        self.below = np.concatenate([[0], np.cumsum([n for _, n in places])])
        self.total = int(self.below[-1])

    def used(self, mean: float, cap: int) -> float:
        """Tokens that the source contributes at this mean."""
        return float(sum(self.total - self.below[np.searchsorted(self.at, t)] for t in _thresholds(mean, cap)))

    def mean_for(self, wanted: float, cap: int) -> float:
        """The mean whose tokens come closest to ``wanted``: those just below and just above are compared."""
        low, high = 0.0, 1.0
        while self.used(high, cap) < wanted and high < 700:
            high *= 2
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if self.used(middle, cap) < wanted else (low, middle)
        return min((low, high), key=lambda mean: abs(self.used(mean, cap) - wanted))


def plan_mixture(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7) -> dict[str, list[float]]:
    """For each source that contributes the thresholds of its copies (see :func:`_thresholds`).

    ``sizes``: (doc_id, source, tokens). Sources that have a target but no tokens contribute nothing, and the other
    targets are scaled up to 1; they stay in the report. Without ``total_tokens`` the mixture is as large as the caps
    allow with exact shares; a larger wish is cut to that size. ``targets`` is a list made by hand: a row per source.
    """
    wish = {r["source"]: (r["target_share"], r["max_repeats"]) for r in _listed(targets).collect()}
    intervals = max(16, min(INTERVALS, MOST_INTERVALS // max(1, len(wish))))
    bins = (
        sizes.where("tokens > 0").join(F.broadcast(_listed(targets).select("source")), "source")
        .withColumn("u", _unit(seed))
        .groupBy("source", F.floor(F.col("u") * intervals).alias("i"))
        .agg(F.sum("tokens").alias("tokens"), (F.sum(F.col("u") * F.col("tokens")) / F.sum("tokens")).alias("at"))
        .collect()
    )
    places: dict[str, list[tuple[float, int]]] = {}
    for row in bins:
        places.setdefault(row["source"], []).append((row["at"], row["tokens"]))
    held = {source: _Held(rows) for source, rows in places.items()}
    share_held = sum(wish[s][0] for s in held) or 1.0
    most = min((wish[s][1] * h.total / (wish[s][0] / share_held) for s, h in held.items()), default=0.0)
    total = min(total_tokens, most) if total_tokens else most
    return {s: _thresholds(h.mean_for(total * wish[s][0] / share_held, wish[s][1]), wish[s][1]) for s, h in held.items()}


def _listed(targets: DataFrame) -> DataFrame:
    return targets.select("source", "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0")


def _unit(seed: int) -> Column:
    """The hash of a document in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(2**40)) / F.lit(float(2**40))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7, vocabulary: str = VOCABULARY) -> DataFrame:
    """(position_key, doc_id, source, copy_no, tokens, text): the mixture, globally shuffled.

    Documents without source, of sources without a target and without any token are left out. No document appears
    more than max_repeats times. The order is that of a hash of document, copy and seed.
    """
    spark = documents.sparkSession
    wanted = documents.select("doc_id", "source", "text").join(F.broadcast(_listed(targets).select("source")), "source")
    # The filter comes after the write, since before it the tokens would be counted twice.
    counted = durable(wanted.select("doc_id", "source", token_count(F.col("text"), vocabulary).alias("tokens"), "text")).where("tokens > 0")
    steps = plan_mixture(counted, targets, total_tokens, seed)
    table = spark.createDataFrame(list(steps.items()), "source string, steps array<double>")
    copies = F.size(F.filter("steps", lambda t: t <= F.col("u")))
    drawn = counted.withColumn("u", _unit(seed)).join(F.broadcast(table), "source").withColumn("copies", copies).where("copies > 0")
    full = drawn.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "tokens", "text")
    key = F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("copy_no")).alias("position_key")
    return full.select(key, "*").orderBy("position_key", "doc_id", "copy_no")


def mixture_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_repeats): the shares of a mixture, source by source."""
    got = mixture.groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.count_distinct("doc_id").alias("documents"), F.max("copy_no").alias("most_repeats")
    )
    total = got.agg(F.sum("tokens").alias("total"))
    joined = targets.where("source is not null").select("source", "target_share").join(got, "source", "left").crossJoin(F.broadcast(total))
    return joined.select(
        "source", "target_share", F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
