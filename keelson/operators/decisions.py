"""Reading decisions on mappings, with the checks that reject them, and what follows from the sound ones."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.text import is_missing

# What can be decided and how values are carried over.
DECISIONS = ["approved", "rejected", "deferred"]
TRANSFORMATIONS = ["copy", "constant", "value_map"]


def faults(decisions: DataFrame, sources: DataFrame, targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """(rule, source, target) for every decision that a check rejects.

    ``decisions``: (source, target, decision, transformation); ``sources``: (source); ``targets``: (target);
    ``candidates``: (source, target), the targets that were proposed. Rules: missing_part, unknown_decision,
    unknown_transformation, unknown_source, unknown_target, not_proposed, repeated_link, repeated_target (approved for
    several sources), conflicting (one link decided differently). An empty list of decisions has no faults.
    """
    d = decisions.select("source", "target", "decision", "transformation")
    whole = d.where(~is_missing(F.col("source")) & ~is_missing(F.col("target")))
    link = ["source", "target"]
    approved = whole.where("decision = 'approved'")
    counted = whole.groupBy(*link).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("decision").alias("kinds"))
    shared = approved.select(*link).distinct().groupBy("target").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = {
        "missing_part": d.where(is_missing(F.col("source")) | is_missing(F.col("target"))),
        "unknown_decision": whole.where(~F.coalesce(F.col("decision").isin(DECISIONS), F.lit(False))),
        "unknown_transformation": approved.where(~F.coalesce(F.col("transformation").isin(TRANSFORMATIONS), F.lit(False))),
        "unknown_source": whole.join(sources.select("source").distinct(), "source", "left_anti"),
        "unknown_target": whole.join(targets.select("target").distinct(), "target", "left_anti"),
        "not_proposed": approved.join(candidates.select(*link).distinct(), link, "left_anti"),
        "repeated_link": counted.where("n > 1 and kinds <= 1"),
        "conflicting": counted.where("kinds > 1"),
        "repeated_target": approved.join(shared, "target", "left_semi"),
    }
    out = None
    for rule, rows in parts.items():
        found = rows.select(F.lit(rule).alias("rule"), *link).distinct()
        out = found if out is None else out.unionByName(found)
    return out


def summary(decisions: DataFrame) -> DataFrame:
    """One row: approved_links, rejected_links, deferred_links, unique_sources (approved, with one target),
    multi_target_sources, export_ready (nothing deferred and something approved)."""
    links = decisions.select("source", "target", "decision").distinct()
    approved = F.sum(F.when(F.col("decision") == "approved", 1).otherwise(0))
    each = links.groupBy("source").agg(
        approved.alias("approved"), *(F.sum(F.when(F.col("decision") == name, 1).otherwise(0)).alias(name + "_n") for name in DECISIONS[1:])
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    figures = each.agg(
        total("approved").alias("approved_links"), total("rejected_n").alias("rejected_links"), total("deferred_n").alias("deferred_links"),
        total((F.col("approved") == 1).cast("int")).alias("unique_sources"), total((F.col("approved") > 1).cast("int")).alias("multi_target_sources"),
    )
    return figures.withColumn("export_ready", (F.col("deferred_links") == 0) & (F.col("approved_links") > 0))


def canonical_json(document: object) -> str:
    """A document as text that does not depend on the order of its keys; run details are left out."""
    bare = {k: v for k, v in document.items() if k != "_run_info"} if isinstance(document, dict) else document
    return json.dumps(bare, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def manifest(contract: str, source: DataFrame, resources: dict[str, DataFrame], lineage: DataFrame, rejected: DataFrame, inputs: dict[str, str]) -> dict:
    """What a package holds: counts and content hashes of source, resources and lineage, and the hashes of its inputs.

    ``content_sha256`` covers everything else in it, so equal packages have equal manifests."""
    from keelson.sources.files import content_hash

    part = lambda rows: {"rows": rows.count(), "sha256": content_hash(rows)}
    body = {
        "contract": contract, "source": part(source), "resources": {name: part(rows) for name, rows in sorted(resources.items())},
        "lineage": part(lineage), "rejected_rows": rejected.count(), "inputs": dict(sorted(inputs.items())),
    }
    return body | {"content_sha256": hashlib.sha256(canonical_json(body).encode()).hexdigest()}
