"""Probabilistic record linkage from end to end: block, compare, fit, score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.similarity import jaro_winkler
from keelson.operators.dedupe import BORDERLINE, blocking_pairs, fit_weights, match_probability
from keelson.storage import durable


def chance_agreement(rows: DataFrame, fields: list[str]) -> dict[str, float]:
    """For each field the probability that two random records agree, from value counts instead of sampled pairs."""
    long = rows.select(*(F.col(f).cast("string").alias(f) for f in fields)).unpivot([], fields, "field", "value").where("value is not null")
    counts = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy("field").agg(F.sum(F.pow("n", F.lit(2))).alias("same"), F.sum("n").alias("all"))
    found = {r["field"]: r["same"] / (r["all"] * r["all"]) for r in sums.collect()}
    return {f: min(max(found.get(f, 1e-6), 1e-6), 0.999) for f in fields}


def compare(rows: DataFrame, pairs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(a, b, levels...): 1 for equal, 0 for different, -1 where a value is missing."""
    kept = rows.select(key, *fields)
    left = kept.select(F.col(key).alias("a"), *(F.col(f).alias(f"{f}_a") for f in fields))
    right = kept.select(F.col(key).alias("b"), *(F.col(f).alias(f"{f}_b") for f in fields))
    level = lambda f: F.coalesce((F.col(f"{f}_a") == F.col(f"{f}_b")).cast("int"), F.lit(-1)).alias(f)
    return pairs.join(left, "a").join(right, "b").select("a", "b", *(level(f) for f in fields))


def link(rows: DataFrame, key: str, rules: dict[str, Column], fields: list[str], least: float = BORDERLINE) -> DataFrame:
    """(a, b, probability) of candidate pairs with a posterior of at least ``least``; ``rows`` is unique on ``key``."""
    levels = durable(compare(rows, blocking_pairs(rows, key, rules), key, fields))
    # At most three levels per field, so the patterns are bounded by the number of fields.
    patterns = [(tuple(r[f] for f in fields), r["n"]) for r in levels.groupBy(*fields).agg(F.count(F.lit(1)).alias("n")).collect()]
    chance = chance_agreement(rows, fields)
    u = [[1 - chance[f], chance[f]] for f in fields]
    share, m = fit_weights(patterns, u, start=0.5)
    probability = match_probability([F.col(f) for f in fields], share, m, u)
    return levels.select("a", "b", probability.alias("probability")).where(F.col("probability") >= least)


@dataclass(frozen=True)
class Comparison:
    """How a field is compared: ``exact``, or by levels of likeness, best first: Jaro-Winkler similarities from
    ``thresholds`` on (``jaro_winkler``), or at most so many edits (``edits``). Equal values are the highest level."""

    field: str
    kind: str = "exact"
    thresholds: tuple[float, ...] = ()

    @property
    def levels(self) -> int:
        return 2 + len(self.thresholds)

    def level(self, a: Column, b: Column) -> Column:
        """-1 where a value is missing, 0 for different values, up to ``levels`` - 1 for equal ones."""
        found = F.lit(0)
        likeness = jaro_winkler(a, b) if self.kind == "jaro_winkler" else None
        for rank, threshold in enumerate(reversed(self.thresholds), 1):
            near = likeness >= threshold if likeness is not None else F.levenshtein(a, b) <= int(threshold)
            found = F.when(near, rank).otherwise(found)
        return F.when(a.isNull() | b.isNull(), -1).when(a == b, self.levels - 1).otherwise(found).cast("int")


#: Records paired at random for the chance of each level; the bound of what is sampled for it.
CHANCE_RECORDS = 20_000
#: The share of matches that the deterministic rules are taken to find.
RULE_RECALL = 0.8


def compare_levels(rows: DataFrame, pairs: DataFrame, key: str, comparisons: list[Comparison]) -> DataFrame:
    """(a, b, a level for each field) of the pairs of records."""
    fields = [c.field for c in comparisons]
    left = rows.select(F.col(key).alias("a"), *(F.col(f).alias(f"{f}_a") for f in fields))
    right = rows.select(F.col(key).alias("b"), *(F.col(f).alias(f"{f}_b") for f in fields))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.select("a", "b", *(c.level(F.col(f"{c.field}_a"), F.col(f"{c.field}_b")).alias(c.field) for c in comparisons))


def chance_levels(rows: DataFrame, key: str, comparisons: list[Comparison]) -> list[list[float]]:
    """For each field how often two records reach each level by chance: records in the order of a hash of their key,
    at most ``CHANCE_RECORDS`` of them, are compared with the next two."""
    drawn = durable(rows.select(key, *(c.field for c in comparisons)).orderBy(F.xxhash64(F.col(key)), key).limit(CHANCE_RECORDS))
    line = Window.orderBy(F.xxhash64(F.col(key)), key)
    beside = drawn.select(F.col(key).alias("a"), F.array(F.lead(key, 1).over(line), F.lead(key, 2).over(line)).alias("b"))
    pairs = beside.select("a", F.explode(F.array_compact("b")).alias("b"))
    levels = compare_levels(drawn, pairs, key, comparisons)
    long = levels.unpivot([], [c.field for c in comparisons], "field", "level").where("level >= 0")
    counts = {(r["field"], r["level"]): r["n"] for r in long.groupBy("field", "level").agg(F.count(F.lit(1)).alias("n")).collect()}
    # One is added to each count, so that a level never seen by chance is rare rather than impossible.
    table = [[1 + counts.get((c.field, k), 0) for k in range(c.levels)] for c in comparisons]
    return [[n / sum(row) for n in row] for row in table]


def link_by_levels(
    rows: DataFrame, key: str, rules: dict[str, Column], comparisons: list[Comparison], deterministic: dict[str, Column],
    training: dict[str, Column], least: float = BORDERLINE,
) -> DataFrame:
    """(a, b, probability) of the candidate pairs of ``rules`` with a posterior of at least ``least``.

    The share of matches among all pairs comes from the pairs that agree on a ``deterministic`` rule, divided by
    ``RULE_RECALL``; the chance of each level from :func:`chance_levels`; how often matches reach it from one
    expectation-maximisation for each ``training`` block, in which the fields of the block are left out, as the mean
    over the blocks. ``rows`` is unique on ``key``. Fewer than two records give no pairs.
    """
    n = rows.count()
    if n < 2:
        return rows.sparkSession.createDataFrame([], f"a {dict(rows.dtypes)[key]}, b {dict(rows.dtypes)[key]}, probability double")
    fields = [c.field for c in comparisons]
    sure = blocking_pairs(rows, key, deterministic).count()
    prior = min(max(sure / RULE_RECALL / (n * (n - 1) / 2), 1e-9), 0.5)
    u = chance_levels(rows, key, comparisons)
    learned: list[list[list[float]]] = [[] for _ in fields]
    for name, block in training.items():
        levels = compare_levels(rows, blocking_pairs(rows, key, {name: block}), key, comparisons)
        counted = levels.groupBy(*fields).agg(F.count(F.lit(1)).alias("n")).collect()
        used = [i for i, f in enumerate(fields) if f != name]
        if counted:
            _, m = fit_weights([(tuple(r[fields[i]] for i in used), r["n"]) for r in counted], [u[i] for i in used], start=0.5)
            for i, row in zip(used, m, strict=True):
                learned[i].append(row)
    mean = lambda many, i: [sum(x) / len(many) for x in zip(*many, strict=True)] if many else [1 - u[i][-1], *[u[i][-1]] * (len(u[i]) - 1)]
    m = [mean(many, i) for i, many in enumerate(learned)]
    levels = compare_levels(rows, blocking_pairs(rows, key, rules), key, comparisons)
    scored = levels.select("a", "b", match_probability([F.col(f) for f in fields], prior, m, u).alias("probability"))
    return scored.where(F.col("probability") >= least)


def weights(fields: list[str], m: list[list[float]], u: list[list[float]], veto: float = -20.0) -> list[dict]:
    """The evidence of each level in bits, with a mark for levels that alone rule a match out."""
    import math

    out = []
    for name, mine, chance in zip(fields, m, u, strict=True):
        for level, (p, q) in enumerate(zip(mine, chance, strict=True)):
            bits = math.log2(p / q) if p > 0 and q > 0 else None
            out.append({"field": name, "level": level, "bits": bits, "veto": bits is not None and bits < veto, "unexpected": level > 0 and bits is not None and bits < 0})
    return out
