"""Candidate pairs by blocking, Fellegi-Sunter scoring and the figures of duplicate groups."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions import similarity
from keelson.skew import join_by_value, observed
from keelson.storage import durable

MATCH, REVIEW, BORDERLINE = 0.95, 0.99, 0.30
#: Members of a block that one task pairs with all others of it.
MEMBERS_AT_ONCE = 2_000
#: Members of a block whose texts are compared with as many others in one step, and pairs that a task is to have.
TEXTS_AT_ONCE, PAIRS_AT_ONCE = 512, 2_000_000


def blocking_pairs(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Distinct unordered pairs (a, b) of ids that agree on at least one rule's key; NULL keys never match.

    All rules go through one shuffle: the keys are exploded with their rule's name. The pairs of a block are the
    operator's result, so a rule must be selective; :func:`block_sizes` tells beforehand what a rule costs. The members
    of a large block are dealt out over as many tasks as its pairs need.
    """
    keyed = durable(_keys(rows, key, rules))
    sizes, facts = observed(
        keyed.groupBy("rule", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / MEMBERS_AT_ONCE).cast("int")), "n"
    )
    placed = durable(join_by_value(keyed, sizes, ["rule", "block"], "n", facts=facts))
    left = placed.select("rule", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col(key).alias("a"))
    right = placed.select("rule", "block", F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("part"), F.col(key).alias("b"))
    return left.join(right, ["rule", "block", "part"]).where("a < b").select("a", "b").distinct()


def _keys(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    named = F.array(*(F.struct(F.lit(name).alias("rule"), value.cast("string").alias("block")) for name, value in rules.items()))
    return rows.select(key, F.inline(named)).where("block is not null")


def compared_pairs(
    rows: DataFrame, block: str, key: str, text: str, measures: dict[str, tuple[Callable, str]], prepare: Callable[[str], str] | None = None
) -> DataFrame:
    """(a, b, one column per measure) of all pairs a < b of keys that share a block; a missing text has no measures.

    ``measures`` holds kernels of :mod:`keelson.functions.similarity` and the types of their columns; ``prepare`` is applied
    to every text first. A block's members are numbered by their keys and cut into runs of ``TEXTS_AT_ONCE``; every two runs are
    a tile, and only the texts of a tile travel to Python, not those of its pairs. Equal texts of a tile are compared once.
    """
    kept = rows.select(F.col(block).alias("block"), F.col(key).alias("key"), F.col(text).alias("text")).where("block is not null and key is not null")
    pairs = kept.groupBy("block").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    whole = Window.partitionBy("block")
    run = lambda n: F.floor(n / TEXTS_AT_ONCE).cast("int")
    placed = kept.select(
        "*",
        F.rank().over(whole.orderBy("key")).alias("rank"),
        run(F.row_number().over(whole.orderBy("key")) - 1).alias("run"),
        run(F.count(F.lit(1)).over(whole) - 1).alias("last"),
    )
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), "last"))).select(
        "block", F.least("run", "other").alias("i"), F.greatest("run", "other").alias("j"), "run", "rank", "key", "text"
    )
    kind = rows.schema[key].dataType.simpleString()
    spread = tiles.repartition(math.ceil((pairs or 0) / PAIRS_AT_ONCE) or 1, "block", "i", "j")
    schema = ", ".join([f"a {kind}", f"b {kind}", *(f"`{name}` {t}" for name, (_, t) in measures.items())])
    return spread.groupBy("block", "i", "j").applyInArrow(_tile(measures, prepare), schema)


_ARROW = {"double": pa.float64(), "int": pa.int32()}


class _Side:
    """One run of a tile: where its rows lie, their ranks, its different texts and the rows of each."""

    def __init__(self, tile: pa.Table, run: int):
        self.rows = np.nonzero(tile["run"].to_numpy() == run)[0]
        self.rank = tile["rank"].to_numpy()[self.rows]
        texts = tile["text"].take(pa.array(self.rows)).to_pylist()
        number = {t: n for n, t in enumerate(dict.fromkeys(texts))}
        own = np.array([number[t] for t in texts])
        self.texts, self.order = [*number], np.argsort(own, kind="stable")
        self.ends = np.searchsorted(own[self.order], np.arange(len(number) + 1))
        self.lowest, self.highest = np.minimum.reduceat(self.rank[self.order], self.ends[:-1]), np.maximum.reduceat(self.rank[self.order], self.ends[:-1])

    def members(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places here of all rows with these texts, and which of the texts each has."""
        spans = [self.order[self.ends[t] : self.ends[t + 1]] for t in texts] if len(self.texts) < len(self.rows) else [self.order[self.ends[texts]]]
        return np.concatenate(spans), np.repeat(np.arange(len(texts)), self.ends[texts + 1] - self.ends[texts])


def _tile(measures: dict[str, tuple[Callable, str]], prepare: Callable[[str], str] | None) -> Callable[[pa.Table], pa.Table]:
    kernels = [kernel for kernel, _ in measures.values()]

    def compared(tile: pa.Table) -> pa.Table:
        keys = tile["key"].combine_chunks()
        left, right = _Side(tile, tile["i"][0].as_py()), _Side(tile, tile["j"][0].as_py())
        missing = [np.array([t is None for t in side.texts]) for side in (left, right)]
        texts = [["" if t is None else prepare(t) if prepare else t for t in side.texts] for side in (left, right)]
        schema = pa.schema([("a", keys.type), ("b", keys.type), *((name, _ARROW[t]) for name, (_, t) in measures.items())])
        parts = []
        for x, y, found in similarity.compare(*texts, kernels, lambda x, y: left.lowest[x].min() < right.highest[y].max()):
            (a, of_a), (b, of_b) = left.members(x), right.members(y)
            p, q = np.nonzero(left.rank[a][:, None] < right.rank[b])
            cells = (of_a[p], of_b[q])
            absent = missing[0][x][cells[0]] | missing[1][y][cells[1]]
            ends = [keys.take(pa.array(side.rows[places])) for side, places in ((left, a[p]), (right, b[q]))]
            values = [pa.array(f[cells], field.type, mask=absent) for f, field in zip(found, [*schema][2:], strict=True)]
            parts.append(pa.record_batch([*ends, *values], schema=schema))
        return pa.Table.from_batches(parts, schema)

    return compared


def block_sizes(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, blocks, largest, pairs): what each rule would produce, from counts alone."""
    sizes = _keys(rows, key, rules).groupBy("rule", "block").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("rule").agg(
        F.count(F.lit(1)).alias("blocks"), F.max("n").alias("largest"), F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("bigint")).alias("pairs")
    )


def coverage(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """(true_pairs, covered, recall_ceiling) of candidate pairs (a, b) against true ones."""
    marked = truth.select("a", "b").distinct().join(pairs.select("a", "b", F.lit(1).alias("hit")).distinct(), ["a", "b"], "left")
    counts = marked.agg(F.count(F.lit(1)).alias("true_pairs"), F.count("hit").alias("covered"))
    return counts.select("true_pairs", "covered", F.when(F.col("true_pairs") > 0, F.col("covered") / F.col("true_pairs")).alias("recall_ceiling"))


def fit_weights(patterns: list[tuple[tuple[int, ...], int]], u: list[list[float]], rounds: int = 25, start: float = 0.1) -> tuple[float, list[list[float]]]:
    """Expectation-maximisation over counted comparison patterns: (share of matches, m probabilities by field and level).

    ``patterns`` holds the agreement level of each field and the number of pairs; there are at most as many patterns
    as combinations of levels, so the loop runs on the driver. A level of -1 means that the field says nothing.
    """
    share = start
    m = [[0.1 + 0.9 * level / max(1, len(row) - 1) for level in range(len(row))] for row in u]
    m = [[x / sum(row) for x in row] for row in m]
    for _ in range(rounds):
        hits, total = 0.0, 0.0
        sums = [[1e-6] * len(row) for row in u]
        for levels, n in patterns:
            p, q = share, 1 - share
            for f, level in enumerate(levels):
                if level >= 0:
                    p, q = p * m[f][level], q * max(u[f][level], 1e-9)
            weight = n * p / (p + q) if p + q > 0 else 0.0
            hits, total = hits + weight, total + n
            for f, level in enumerate(levels):
                if level >= 0:
                    sums[f][level] += weight
        share = min(max(hits / total if total else start, 1e-9), 1 - 1e-9)
        m = [[x / sum(row) for x in row] for row in sums]
    return share, m


def match_probability(levels: list[Column], share: float, m: list[list[float]], u: list[list[float]]) -> Column:
    """The posterior of a pair from its levels, as one expression."""
    weight = F.lit(math.log2(share / (1 - share)))
    for f, level in enumerate(levels):
        term = F.lit(0.0)
        for k in range(len(m[f])):
            term = F.when(level == k, math.log2(max(m[f][k], 1e-9) / max(u[f][k], 1e-9))).otherwise(term)
        weight = weight + term
    return 1 / (1 + F.pow(F.lit(2.0), -weight))


def group_figures(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """(group_id, size, direct, possible, weakest, mean): members and the scored links inside each group.

    ``groups``: (group_id, id); ``edges``: (a, b, score)."""
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    inside = (
        edges.join(groups.select(F.col("id").alias("a"), "group_id"), "a")
        .join(groups.select(F.col("id").alias("b"), "group_id"), ["b", "group_id"])
        .groupBy("group_id").agg(F.count(F.lit(1)).alias("direct"), F.min("score").alias("weakest"), F.avg("score").alias("mean"))
    )
    possible = (F.col("size") * (F.col("size") - 1) / 2).cast("bigint")
    return sizes.join(inside, "group_id", "left").select(
        "group_id", "size", F.coalesce("direct", F.lit(0)).alias("direct"), possible.alias("possible"), "weakest", "mean"
    )


def agreement(groups: DataFrame, fields: list[str]) -> DataFrame:
    """(field, groups, agreeing, rate): in how many groups all present values of a field are equal."""
    long = groups.select("group_id", *(F.col(f).cast("string").alias(f) for f in fields)).unpivot(["group_id"], fields, "field", "value")
    each = long.where("value is not null").groupBy("field", "group_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return each.groupBy("field").agg(
        F.count(F.lit(1)).alias("groups"), F.sum((F.col("lo") == F.col("hi")).cast("bigint")).alias("agreeing")
    ).withColumn("rate", F.col("agreeing") / F.col("groups"))


def canonical(rows: DataFrame, group: str, key: str, fields: list[str]) -> DataFrame:
    """(group, key, filled): the member with the most filled fields, ties by the smallest key."""
    filled = sum((F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != "")).cast("int") for f in fields)
    best = F.min(F.struct((-filled).alias("minus"), F.col(key)))
    return rows.groupBy(group).agg(best.alias("b")).select(group, f"b.{key}", (-F.col("b.minus")).alias("filled"))


def borderline_pairs(edges: DataFrame, groups: DataFrame, most: int = 25) -> DataFrame:
    """(a, b, score) of the best scored pairs below the match threshold whose ends lie in different groups; records
    without a group are groups of their own. A top-k report."""
    left = groups.select(F.col("id").alias("a"), F.col("group_id").alias("ga"))
    right = groups.select(F.col("id").alias("b"), F.col("group_id").alias("gb"))
    apart = edges.where((F.col("score") < MATCH) & (F.col("score") >= BORDERLINE)).join(left, "a", "left").join(right, "b", "left")
    # A record without a group is marked so that its id cannot be taken for a group's.
    name = lambda group, ident: F.coalesce(F.col(group).cast("string"), F.concat(F.lit("record "), F.col(ident)))
    other = name("ga", "a") != name("gb", "b")
    return apart.where(other).select("a", "b", "score").orderBy(F.desc("score"), "a", "b").limit(most)
