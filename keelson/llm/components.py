"""Consolidating pairwise links into groups.

Each round shrinks the graph and notes for every removed vertex the neighbour it hangs on:

* vertices with one link are stripped;
* of the vertices with two links an independent set (local minima of a hash, as in list ranking) is cut out and its
  two links are joined into one, so a chain of any length vanishes in a logarithmic number of rounds;
* where neither removes much, the rest is a core: every vertex is merged into its smallest neighbour, after pointer
  jumping, which at least halves the number of vertices with links;
* a rest of at most ``CORE_LINKS`` links, counted first, is solved by one task.

When no link is left, the removed vertices form a forest of at most as many levels as rounds; doubling its pointers
gives every vertex the root it hangs on. A round is three written tables: the degrees, what happens to each vertex, and
the links that stay; their counts are observed while they are written. Only counters reach the driver. A vertex may
have any share of the links: degrees are aggregated before the shuffle and every join by vertex goes through
:func:`keelson.skew.join_by_value`, which knows the degrees.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.skew import Facts, join_by_value, observed
from keelson.storage import durable

#: A round that removes less than this share of the vertices shows that a core is left.
CORE_SHARE = 0.35
#: Links of a core that one task solves. The first round always strips and cuts, whatever the size.
CORE_LINKS = 10_000
MOST_ROUNDS = 200


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(
        links.select(F.col("b").alias("v"), F.col("a").alias("w"))
    )


def canonical_links(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct links (a, b) with a < b; links of a vertex with itself and with NULL are left out."""
    return (
        pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(a).alias("_x"), F.col(b).alias("_y"))
        .where("_x is not null and _y is not null and a < b")
        .select("a", "b")
        .distinct()
    )


def _degrees(links: DataFrame) -> DataFrame:
    """(v, n, lo, hi): number of links, smallest and largest neighbour."""
    return _both_ways(links).groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("lo"), F.max("w").alias("hi"))


def _prune(state: DataFrame, facts: Facts) -> DataFrame:
    """(v, n, parent, hi) of a stripping and chain-cutting round; ``parent`` is NULL for vertices that stay, ``hi`` is
    set for those whose links are joined."""
    few = state.where("n <= 2")
    sides = few.select("v", F.col("n").alias("own"), F.explode(F.array_distinct(F.array("lo", "hi"))).alias("w"))
    near = join_by_value(sides, state.select(F.col("v").alias("w"), F.col("n").alias("deg"), "n"), ["w"], "n", facts=facts)
    rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
    # One leaf of a lone pair stays; a vertex of a chain goes if it comes first among its neighbours of the same kind
    # and no leaf hangs on it.
    stays = (
        F.when(F.col("own") == 1, (F.col("deg") == 1) & (F.col("v") < F.col("w")))
        .when(F.col("deg") == 1, True)
        .otherwise((F.col("deg") == 2) & (rank("w") < rank("v")))
    )
    going = near.groupBy("v").agg(F.bool_or(stays).alias("stays")).where("not stays").select("v", F.lit(True).alias("goes"))
    marked = state.join(going, "v", "left")
    return marked.select(
        "v", "n", F.when(F.col("goes"), F.col("lo")).alias("parent"), F.when(F.col("goes") & (F.col("n") == 2), F.col("hi")).alias("hi")
    )


def _merge_core(state: DataFrame) -> DataFrame:
    """(v, n, parent, hi): each vertex with a smaller neighbour points to the smallest vertex reached by such steps."""
    points = _doubled(durable(state.select("v", F.least("v", "lo").alias("parent")).where("parent < v")))
    merged = state.select("v", "n").join(points, "v", "left")
    return merged.select("v", "n", "parent", F.lit(None).cast("string").alias("hi"))


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(v, parent) of the vertices of a bounded core: each hangs on the smallest of its group."""
    above: dict[str, str] = {}

    def root(v: str) -> str:
        while above.setdefault(v, v) != v:
            above[v] = v = above[above[v]]
        return v

    for batch in batches:
        for a, b in zip(batch["a"], batch["b"], strict=True):
            low, high = sorted((root(a), root(b)))
            above[high] = low
    rows = [(v, root(v)) for v in list(above) if root(v) != v]
    yield pd.DataFrame(rows, columns=["v", "parent"], dtype="object")


def _doubled(forest: DataFrame) -> DataFrame:
    """A written forest (v, parent) with every vertex pointing to its root. Each step at least halves the depth."""
    while True:
        fans = forest.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
        above = forest.select(F.col("v").alias("parent"), F.col("parent").alias("above"))
        # Fans and forest are keyed by different vertices; a vertex has one row on each side.
        lookup, facts = observed(fans.join(above, "parent"), "n")
        if not facts.rows:
            return forest
        stepped = join_by_value(forest, lookup, ["parent"], "n", "left", facts)
        forest = durable(stepped.select("v", F.coalesce("above", "parent").alias("parent")))


def _relink(links: DataFrame, moved: DataFrame, facts: Facts, core: bool) -> DataFrame:
    """The links among the vertices that stay."""
    for end in ("a", "b"):
        lookup = moved.select(F.col("v").alias(end), F.col("parent").alias(f"{end}p"), "n")
        links = join_by_value(links, lookup, [end], "n", facts=facts)
    if core:
        return canonical_links(links.select(F.coalesce("ap", "a").alias("a"), F.coalesce("bp", "b").alias("b")), "a", "b")
    kept = links.where("ap is null and bp is null").select("a", "b")
    joined = moved.where("hi is not null").select(F.col("parent").alias("a"), F.col("hi").alias("b"))
    return canonical_links(kept.unionByName(joined), "a", "b")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, group_id) for every vertex that is linked to another one; group_id is the smallest id of the group.

    Ids are strings. Links may be repeated, reversed, or join a vertex with itself (without effect); NULL ids link
    nothing. No links give no rows.
    """
    links = durable(canonical_links(links, a, b))
    removed: list[DataFrame] = []
    core, before = False, 0
    for _ in range(MOST_ROUNDS):
        state, facts = observed(_degrees(links), "n")
        if not facts.rows:
            break
        if removed and facts.total <= 2 * CORE_LINKS:
            removed.append(durable(links.repartition(1).mapInPandas(_solve, "v string, parent string")))
            break
        # What the last round removed decides whether only a core is left.
        core = core or facts.rows > (1 - CORE_SHARE) * before > 0
        before = facts.rows
        moved, _ = observed(_merge_core(state) if core else _prune(state, facts), "n")
        removed.append(moved.where("parent is not null").select("v", "parent"))
        links = durable(_relink(links, moved, facts, core))
    else:
        raise RuntimeError("the links did not shrink")
    if not removed:
        return links.select(F.col("a").alias("id"), F.col("b").alias("group_id"))
    forest = _doubled(durable(reduce(DataFrame.unionByName, removed)))
    names, facts = observed(
        forest.groupBy("parent").agg(F.least("parent", F.min("v")).alias("group_id"), F.count(F.lit(1)).alias("n")), "n"
    )
    return join_by_value(forest, names, ["parent"], "n", facts=facts).select(F.col("v").alias("id"), "group_id").unionByName(
        names.select(F.col("parent").alias("id"), "group_id")
    )


def vendor_groups(pairs: DataFrame, vendors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(legacy_vendor_id, group_id) from scored pairs (unique_id_l, unique_id_r, match_probability).

    Ids are compared in upper case without surrounding blanks. Pairs without a score or an id, below the threshold,
    or with an id that ``vendors`` (legacy_vendor_id) does not hold link nothing.
    """
    key = lambda c: F.upper(F.regexp_replace(F.col(c), r"^[\s ]+|[\s ]+$", ""))
    scored = pairs.where(F.col("match_probability") >= threshold).select(key("unique_id_l").alias("a"), key("unique_id_r").alias("b"))
    links = durable(canonical_links(scored, "a", "b"))
    known = vendors.select(key("legacy_vendor_id").alias("v")).where("v is not null").distinct()
    ends, facts = observed(_degrees(links).select("v", "n").join(known.withColumn("known", F.lit(True)), "v", "left"), "n")
    for end in ("a", "b"):
        links = join_by_value(links, ends.select(F.col("v").alias(end), F.col("known").alias(f"{end}_known"), "n"), [end], "n", facts=facts)
    valid = links.where("a_known and b_known").select("a", "b")
    return connected_components(valid).select(F.col("id").alias("legacy_vendor_id"), "group_id")
