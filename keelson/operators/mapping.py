"""Ranking target fields for source fields by name, alias, type and value patterns.

The pairs of source and target fields are few (the product of two lists of columns), whatever the tables hold; the
larger list is broadcast only below ``MOST_FIELDS`` columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.similarity import cosine, token_sort_ratio
from keelson.functions.text import confidence_band, jaccard, split_identifier

MOST_FIELDS = 10_000
DIMENSIONS = 64
WEIGHTS = {"semantic": 0.58, "fuzzy": 0.27, "lexical": 0.15}
ALIAS_FLOOR, GATE_FLOOR, NO_MATCH, PATTERN_BONUS = 0.90, 0.60, 0.40, 0.20


def hashed_vector(text: Column) -> Column:
    """Counts of hashed character trigrams: an embedding that needs no model and never changes."""
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.pmod(F.xxhash64(F.substring(padded, i, F.lit(3))), F.lit(DIMENSIONS)))
    return F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda d: F.size(F.filter(grams, lambda g: g == d)).cast("double"))


def type_gate(source_kind: Column, target_kind: Column) -> Column:
    """How far the kinds of two fields fit: 1, less for dates against others, least for booleans against others."""
    differs = source_kind != target_kind
    return F.when(differs & (source_kind == "boolean"), GATE_FLOOR).when(differs & source_kind.isin("date", "datetime"), 0.82).otherwise(1.0)


def score(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """All candidates (source, target, semantic, fuzzy, lexical, alias, gate, score) of sources (source, kind) and
    targets (target, kind, aliases array)."""
    if targets.count() > MOST_FIELDS:
        raise ValueError("too many target fields for one pass")
    words = lambda c: F.split(split_identifier(F.col(c)), " ")
    left = sources.select("source", F.col("kind").alias("source_kind"), split_identifier(F.col("source")).alias("s"), words("source").alias("sw"))
    names = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), split_identifier)
    right = targets.select("target", F.col("kind").alias("target_kind"), split_identifier(F.col("target")).alias("t"), words("target").alias("tw"), names.alias("names"))
    pairs = left.withColumn("sv", hashed_vector(F.col("s"))).crossJoin(F.broadcast(right.withColumn("tv", hashed_vector(F.col("t")))))
    parts = pairs.select(
        "source", "target",
        cosine(F.col("sv"), F.col("tv")).alias("semantic"),
        (token_sort_ratio(F.col("s"), F.col("t")) / 100).alias("fuzzy"),
        jaccard(F.array_distinct("sw"), F.array_distinct("tw")).alias("lexical"),
        F.array_contains("names", F.col("s")).alias("alias"),
        type_gate(F.col("source_kind"), F.col("target_kind")).alias("gate"),
    )
    blend = sum(F.col(name) * weight for name, weight in WEIGHTS.items())
    floored = F.when(F.col("alias"), F.greatest(blend, F.lit(ALIAS_FLOOR))).otherwise(blend)
    return parts.withColumn("score", F.round(F.least(F.lit(1.0), floored * F.col("gate")), 4))


def with_patterns(candidates: DataFrame, support: DataFrame) -> DataFrame:
    """Raise scores by the share of source values that fit the target's pattern: (source, target, support)."""
    joined = candidates.join(support, ["source", "target"], "left")
    bonus = PATTERN_BONUS * F.coalesce("support", F.lit(0.0)) * (1 - F.col("score"))
    return joined.withColumn("score", F.round(F.least(F.lit(1.0), F.col("score") + bonus), 4)).drop("support")


def suggest(candidates: DataFrame, most: int = 3) -> DataFrame:
    """The best targets of each source with rank, margin to the next, band and status."""
    order = Window.partitionBy("source").orderBy(F.desc("score"), "target")
    ranked = candidates.withColumn("rank", F.row_number().over(order)).withColumn("margin", F.col("score") - F.lead("score").over(order))
    false_friend = (F.col("score") >= 0.45) & ~F.col("alias") & (F.col("lexical") == 0) & (F.col("gate") <= GATE_FLOOR)
    status = (
        F.when(F.col("score") < NO_MATCH, "no_confident_target").when(false_friend, "possible_false_friend")
        .when(F.col("score") >= 0.70, "suggested").when(F.col("score") >= 0.45, "needs_review").otherwise("no_confident_target")
    )
    return ranked.where(F.col("rank") <= most).select("source", "target", "rank", "score", "margin", confidence_band(F.col("score")).alias("band"), status.alias("status"))


def unmapped(targets: DataFrame, decisions: DataFrame) -> DataFrame:
    """Targets without an approved decision (source, target, decision)."""
    return targets.join(decisions.where("decision = 'approved'").select("target").distinct(), "target", "left_anti")


# Reach and weights of the neighbour window, and what makes an anchor and a supported resource.
NEIGHBOUR_WEIGHTS = {1: 1.0, 2: 0.5}
ANCHOR_SCORE, ANCHOR_MARGIN, LEAST_ANCHORS, LEAST_SUPPORT, CONTEXT_BONUS = 0.45, 0.05, 2, 0.60, 0.10
# Words of field names that stand for a concept.
CONCEPTS = {
    "routing": ["clearing", "routing", "sort", "transit"], "institution": ["bank", "institution"],
    "identifier": ["id", "identifier", "key", "ref", "reference"],
}
CHANNEL_BONUS = 0.10


def resource_support(candidates: DataFrame, positions: DataFrame, resources: DataFrame) -> DataFrame:
    """(source, resource, support): how much of the weight of a field's sure neighbours points to one resource.

    ``positions``: (source, position) in the file; ``resources``: (target, resource). Neighbours are up to two places
    away, and sure if their best target scores well and leads clearly. With fewer than two there is no support.
    """
    best = suggest(candidates, 1).where((F.col("score") >= ANCHOR_SCORE) & (F.coalesce("margin", F.col("score")) >= ANCHOR_MARGIN))
    anchors = best.join(positions, "source").join(resources, "target").select(F.col("position").alias("at"), "resource")
    steps = F.array(*(F.struct(F.lit(d * sign).alias("step"), F.lit(w).alias("weight")) for d, w in NEIGHBOUR_WEIGHTS.items() for sign in (1, -1)))
    around = positions.select("source", "position", F.inline(steps)).withColumn("at", F.col("position") + F.col("step"))
    near = around.join(anchors, "at").groupBy("source", "resource").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"))
    window = Window.partitionBy("source")
    found = near.withColumn("support", F.col("w") / F.sum("w").over(window)).withColumn("anchors", F.sum("n").over(window))
    return found.where((F.col("anchors") >= LEAST_ANCHORS) & (F.col("support") >= LEAST_SUPPORT)).select("source", "resource", "support")


def with_resource_context(candidates: DataFrame, support: DataFrame, resources: DataFrame) -> DataFrame:
    """Raise the scores of targets in a supported resource, within what their type gate leaves."""
    joined = candidates.join(resources, "target", "left").join(support, ["source", "resource"], "left")
    bonus = CONTEXT_BONUS * F.coalesce("support", F.lit(0.0)) * F.col("gate") * (1 - F.col("score"))
    return joined.withColumn("score", F.round(F.least(F.lit(1.0), F.col("score") + bonus), 4)).drop("support", "resource")


def _has(words: Column, concept: str) -> Column:
    return F.arrays_overlap(words, F.array(*(F.lit(w) for w in CONCEPTS[concept])))


def with_concepts(candidates: DataFrame) -> DataFrame:
    """Raise scores where both names are about routing (``diagnostic``), or both about keys of institutions."""
    s, t = F.split(split_identifier(F.col("source")), " "), F.split(split_identifier(F.col("target")), " ")
    routing = _has(s, "routing") & _has(t, "routing")
    keys = _has(s, "identifier") & _has(s, "institution") & _has(t, "identifier") & _has(t, "institution")
    active = routing.cast("int") + keys.cast("int")
    raised = F.least(F.lit(1.0), F.col("score") + CHANNEL_BONUS * (1 - F.col("score")) * active)
    return candidates.withColumn("base_score", F.col("score")).withColumn("score", F.round(raised, 4)).withColumn("diagnostic", routing)


def tier_locked(candidates: DataFrame, most: int = 3) -> DataFrame:
    """Rank by ``score``, but the best by ``base_score`` stays first unless a diagnostic candidate scores strictly more."""
    by = Window.partitionBy("source")
    base_first = F.row_number().over(by.orderBy(F.desc("base_score"), "target")) == 1
    held = candidates.withColumn("_first", base_first)
    held = held.withColumn("_bar", F.max(F.when(F.col("_first"), F.col("score"))).over(by))
    challenger = F.col("diagnostic") & (F.col("score") > F.col("_bar"))
    order = by.orderBy(F.when(challenger, 0).when(F.col("_first"), 1).otherwise(2), F.desc("score"), "target")
    return held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("_first", "_bar")
