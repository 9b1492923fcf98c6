"""Judging groups of records against true entities, from counts alone.

How many records a group and an entity share says everything: a group is right if it shares all of its and all of the
entity's records, and pairs follow from sizes as n * (n - 1) / 2. No set is collected and no pair is made, so a group
may hold any share of the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.operators.evaluate import prf

#: Scores from which on a trivial baseline says that the truth can be read off its key.
LEAK_F1 = 0.99


def _pairs(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("bigint")


def overlaps(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(cluster, entity, shared, cluster_size, entity_size) of groups (id, cluster) and entities (id, entity).

    Repeated rows count once; records that only one side has make sizes, but no overlap (the other side is NULL)."""
    p, t = predicted.select("id", "cluster").distinct(), truth.select("id", "entity").distinct()
    shared = p.join(t, "id", "full").groupBy("cluster", "entity").agg(F.count(F.lit(1)).alias("shared"))
    sizes = p.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    entities = t.groupBy("entity").agg(F.count(F.lit(1)).alias("entity_size"))
    return shared.join(sizes, "cluster", "left").join(entities, "entity", "left")


def verdicts(overlap: DataFrame) -> DataFrame:
    """(cluster, size, entities, verdict): ``merged`` if a group holds records of several entities, ``exact`` if it
    holds all records of one and no other, else ``split``. Groups without any known record are ``unknown``."""
    exact = (F.col("shared") == F.col("cluster_size")) & (F.col("shared") == F.col("entity_size"))
    each = overlap.where("cluster is not null").groupBy("cluster").agg(
        F.max("cluster_size").alias("size"), F.count("entity").alias("entities"), F.bool_or(F.coalesce(exact, F.lit(False))).alias("_exact")
    )
    verdict = F.when(F.col("entities") == 0, "unknown").when(F.col("entities") > 1, "merged").when(F.col("_exact"), "exact").otherwise("split")
    return each.select("cluster", "size", "entities", verdict.alias("verdict"))


def scores(overlap: DataFrame) -> DataFrame:
    """(level, tp, fp, fn, precision, recall, f1) for ``groups`` (of two and more records), ``all`` groups, and
    ``pairs`` of records."""
    exact = F.coalesce((F.col("shared") == F.col("cluster_size")) & (F.col("shared") == F.col("entity_size")), F.lit(False))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    part = lambda name, size: overlap.where(f"{name} is not null").groupBy(name).agg(F.max(size).alias("n"))
    clusters, entities = part("cluster", "cluster_size"), part("entity", "entity_size")
    sides = [
        rows.agg(F.count(F.lit(1)).alias(f"{side}_all"), total((F.col("n") > 1).cast("int")).alias(f"{side}_groups"), total(_pairs(F.col("n"))).alias(f"{side}_pairs"))
        for side, rows in (("p", clusters), ("t", entities))
    ]
    hits = overlap.agg(
        total(exact.cast("int")).alias("h_all"), total((exact & (F.col("shared") > 1)).cast("int")).alias("h_groups"),
        total(F.when(F.col("cluster").isNotNull() & F.col("entity").isNotNull(), _pairs(F.col("shared")))).alias("h_pairs"),
    )
    # One row each.
    one = hits.crossJoin(sides[0]).crossJoin(sides[1])
    levels = F.array(
        *(
            F.struct(F.lit(x).alias("level"), F.col(f"h_{x}").alias("tp"), (F.col(f"p_{x}") - F.col(f"h_{x}")).alias("fp"), (F.col(f"t_{x}") - F.col(f"h_{x}")).alias("fn"))
            for x in ("groups", "all", "pairs")
        )
    )
    return one.select(F.inline(levels)).select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def by_key(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """(id, cluster): the trivial grouping by equal values; a record without a value is a group of its own."""
    own = F.concat(F.lit("record "), F.col(key).cast("string"))
    return rows.select(F.col(key).alias("id"), F.coalesce(F.concat(F.lit("value "), value.cast("string")), own).alias("cluster")).distinct()


def validity(baselines: DataFrame) -> DataFrame:
    """Adds ``leak``: whether a baseline (name, f1) reaches what no grouping by one key should."""
    return baselines.withColumn("leak", F.col("f1") >= LEAK_F1)


def pair_agreement(members: DataFrame, fields: list[str]) -> DataFrame:
    """(field, pairs, same, rate): in how many of all pairs of records within an entity both have the same value.

    ``members``: (entity, fields...), one row per record. Missing values agree with nothing."""
    pairs = members.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0)).alias("pairs"))
    long = members.select("entity", *(F.col(f).cast("string").alias(f) for f in fields)).unpivot(["entity"], fields, "field", "value")
    each = long.groupBy("field", "entity", "value").agg(F.count(F.lit(1)).alias("n"))
    same = each.groupBy("field").agg(F.coalesce(F.sum(F.when(F.col("value").isNotNull(), _pairs(F.col("n")))), F.lit(0)).alias("same"))
    return same.crossJoin(F.broadcast(pairs)).select("field", "pairs", "same", F.when(F.col("pairs") > 0, F.col("same") / F.col("pairs")).alias("rate"))


def review_groups(groups: DataFrame, figures: DataFrame, records: DataFrame, critical: dict[str, Column], weakest: float) -> DataFrame:
    """(group_id, size, conflicts, weak, transitive, needs_review): what speaks for looking at a group by hand.

    ``groups``: (group_id, id); ``figures`` of :func:`keelson.operators.dedupe.group_figures`; ``records`` (id, ...) with
    one row each; ``critical`` are normal forms of which a group should hold one. ``conflicts`` lists the fields with
    several, ``weak`` is a weakest link below ``weakest``, ``transitive`` a group without all its direct links."""
    named = F.array(*(F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in critical.items()))
    values = groups.join(records, "id").select("group_id", F.inline(named)).where("value is not null")
    several = (
        values.groupBy("group_id", "field").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi")
        .groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_list("field")), ",").alias("conflicts"))
    )
    joined = figures.where("size > 1").join(several, "group_id", "left")
    weak = F.coalesce(F.col("weakest") < weakest, F.lit(False))
    apart = F.col("direct") < F.col("possible")
    return joined.select(
        "group_id", "size", F.coalesce("conflicts", F.lit("")).alias("conflicts"), weak.alias("weak"), apart.alias("transitive"),
        (weak | apart | F.col("conflicts").isNotNull()).alias("needs_review"),
    )
