"""Similarities of all pairs of a block, against the same measures of single pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from keelson.functions import similarity
from keelson.operators import dedupe
from keelson.plans import core_queries


def names(many, seed=5):
    """Texts of the lengths at which the width of the numbers changes, and beyond, with characters outside of ASCII."""
    rnd = random.Random(seed)
    return ["".join(rnd.choice("ab cé𝄞") for _ in range(rnd.choice([0, 1, 2, 5, 13, 18, 31, 32, 33, 63, 64, 65, 130]))) for _ in range(many)]


def suppliers(spark, path, many):
    rows = spark.range(many).select(
        F.col("id").alias("s_suppkey"), F.format_string("Supplier#%09d", "id").alias("s_name"), F.lit(3).alias("s_nationkey"), F.lit(0.0).alias("s_acctbal")
    )
    rows.coalesce(1).write.parquet(f"{path}/supplier.parquet")
    return str(path)


def test_jaro_winkler_of_many_equals_that_of_one():
    left, right, seen = names(90), names(120, 6), set()
    for xs, ys, (found,) in similarity.compare(left, right, [similarity.jaro_winklers], lambda x, y: True):
        for i, x in enumerate(xs):
            for j, y in enumerate(ys):
                seen.add((x, y))
                assert found[i, j] == similarity._jaro_winkler(left[x], right[y])
    assert len(seen) == 90 * 120


def test_rounding_is_that_of_spark(spark):
    import numpy as np

    values = [0.0000005, 0.1234565, 0.9611115, 0.0078125, 1 / 3, 1.0, 0.9999995]
    expected = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6)).collect()]
    assert similarity.rounded(np.array([values]), 6)[0].tolist() == expected


@pytest.fixture
def odd_rows(spark):
    """Blocks of different sizes, with missing names, keys and blocks, repeated names and repeated keys."""
    texts = names(40) * 2 + [None, None, "b a", "a b"]
    rows = [(i % 5 % 3, i * 7 % 80, t) for i, t in enumerate(texts)] + [(None, 1, "a"), (1, None, "a"), (9, 1, "alone")]
    return spark.createDataFrame(rows, "block int, key bigint, name string")


def joined(rows, *measures):
    left, right = rows.toDF("block", "a", "x"), rows.toDF("block", "b", "y")
    return left.join(right, "block").where("a < b").select("a", "b", *measures)


def ordered(frame):
    return sorted(([tuple(r) for r in frame.collect()]), key=str)


@pytest.mark.parametrize("run", [512, 7])
def test_pairs_of_tiles_equal_a_join(spark, odd_rows, monkeypatch, run):
    monkeypatch.setattr(dedupe, "TEXTS_AT_ONCE", run)
    monkeypatch.setattr(dedupe, "PAIRS_AT_ONCE", 300)
    measures = {"similarity": (core_queries._rounded_jaro_winklers, "double"), "edits": (similarity.edits, "int")}
    expected = joined(odd_rows, F.round(similarity.jaro_winkler(F.col("x"), F.col("y")), 6).alias("similarity"), F.levenshtein("x", "y").alias("edits"))
    found = dedupe.compared_pairs(odd_rows, "block", "key", "name", measures)
    assert found.dtypes == expected.dtypes and ordered(found) == ordered(expected)
    assert dedupe.compared_pairs(odd_rows.limit(0), "block", "key", "name", measures).count() == 0


def test_name_similarity_of_one_large_nation_ends(spark, tmp_path):
    """4.5 million pairs of one nation; compared one by one in a single task they took minutes."""
    path, began = suppliers(spark, tmp_path, 3000), time.time()
    rows = core_queries.name_similarity(spark, path).agg(F.count(F.lit(1)), F.min("edits"), F.max("edits"), F.count("similarity")).first()
    assert tuple(rows) == (3000 * 2999 // 2, 1, 4, 3000 * 2999 // 2) and time.time() - began < 60


def test_token_sort_ratio_of_many_equals_that_of_one(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(dedupe, "TEXTS_AT_ONCE", 7)
    expected = joined(odd_rows, similarity.token_sort_ratio(F.col("x"), F.col("y")).alias("ratio"))
    found = dedupe.compared_pairs(odd_rows, "block", "key", "name", {"ratio": (similarity.indel_ratios, "double")}, similarity.sorted_words)
    assert found.dtypes == expected.dtypes and ordered(found) == ordered(expected)


def test_token_sort_ratio_of_one_large_nation_ends(spark, tmp_path):
    path, began = suppliers(spark, tmp_path, 3000), time.time()
    rows = core_queries.token_sort_ratio_pairs(spark, path).agg(F.count("ratio"), F.max("ratio")).first()
    assert rows[0] == 3000 * 2999 // 2 and rows[1] == 200 * 17 / 36 and time.time() - began < 60
