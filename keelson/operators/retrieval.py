"""Nearest entries: exact top-k by cosine for a stated query set, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one pass over the entries answers; more queries take several passes.
QUERIES_PER_PASS = 2_000


def top_k(entries: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` nearest other entries of each query, ties by id.

    ``queries`` is a stated set: its vectors go to the executors in blocks of ``QUERIES_PER_PASS``. Each batch of
    entries keeps its own k best per query, so the shuffle holds k rows per query and batch, whatever the entries.
    """
    spark = entries.sparkSession
    passes = -(-queries.count() // QUERIES_PER_PASS) or 1
    part = F.pmod(F.xxhash64(key), F.lit(passes))
    best = None
    for number in range(passes):
        block = queries.where(part == number).select(key, vector).where(F.col(vector).isNotNull()).collect()
        shared = spark.sparkContext.broadcast(([r[0] for r in block], np.array([r[1] for r in block], dtype="float64")))

        def nearest(batches, shared=shared):
            ids, wanted = shared.value
            for batch in batches:
                batch = batch[batch[vector].notna()]
                if not len(batch) or not ids:
                    continue
                scores = _cosines(wanted, batch[vector])
                own = batch[key].to_numpy()
                rows = []
                for i, query in enumerate(ids):
                    order = [j for j in np.lexsort((own, -scores[i]))[: k + 1] if own[j] != query][:k]
                    rows.append((np.full(len(order), query), own[order], scores[i][order]))
                yield pd.DataFrame(dict(zip(("query_id", "id", "score"), map(np.concatenate, zip(*rows, strict=True)), strict=True)))

        found = entries.select(key, vector).mapInPandas(nearest, "query_id bigint, id bigint, score double")
        best = found if best is None else best.unionByName(found)
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def best_per_group(entries: DataFrame, queries: DataFrame, key: str, vector: str, group: str) -> DataFrame:
    """(query_id, group, score): for each query the best score of every group of other entries, for a stated query set.

    Each batch of entries keeps one score for each query and group that it holds, so the shuffle has no row per entry."""
    spark = entries.sparkSession
    passes = -(-queries.count() // QUERIES_PER_PASS) or 1
    part = F.pmod(F.xxhash64(key), F.lit(passes))
    kind = dict(entries.dtypes)
    best = None
    for number in range(passes):
        block = queries.where(part == number).select(key, vector).where(F.col(vector).isNotNull()).collect()
        shared = spark.sparkContext.broadcast(([r[0] for r in block], np.array([r[1] for r in block], dtype="float64")))

        def strongest(batches, shared=shared):
            ids, wanted = shared.value
            for batch in batches:
                batch = batch[batch[vector].notna()]
                if not len(batch) or not ids:
                    continue
                scores = _cosines(wanted, batch[vector])
                own = batch[key].to_numpy()
                scores[np.asarray(ids)[:, None] == own[None, :]] = -1.0
                groups, places = np.unique(batch[group].to_numpy(), return_inverse=True)
                top = np.full((len(ids), len(groups)), -1.0)
                np.maximum.at(top, (slice(None), places), scores)
                at_query, at_group = np.nonzero(top >= 0)
                yield pd.DataFrame({"query_id": np.asarray(ids)[at_query], group: groups[at_group], "score": top[at_query, at_group]})

        found = entries.where(F.col(group).isNotNull()).select(key, vector, group).mapInPandas(strongest, f"query_id {kind[key]}, {group} {kind[group]}, score double")
        best = found if best is None else best.unionByName(found)
    return best.groupBy("query_id", group).agg(F.max("score").alias("score"))


def _cosines(wanted: np.ndarray, vectors: pd.Series) -> np.ndarray:
    have = np.stack(vectors.to_numpy()).astype("float64")
    norms = np.linalg.norm(wanted, axis=1)[:, None] * np.linalg.norm(have, axis=1)[None, :]
    return np.divide(wanted @ have.T, norms, out=np.zeros_like(norms), where=norms > 0).clip(0, 1)
