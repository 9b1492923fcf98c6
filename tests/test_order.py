import random

from keelson.operators import linkage, order
from pyspark.sql import functions as F


def test_global_row_number(spark):
    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("k")).repartition(7)
    got = {r["k"]: r["n"] for r in order.global_row_number(rows, ["k"], "n", 5).collect()}
    assert got == {k: k + 1 for k in range(500)}
    assert order.global_row_number(rows.limit(0), ["k"]).count() == 0


def test_greedy_alignment_equals_one_by_one(spark):
    draw = random.Random(8)
    pairs = list({(f"p{draw.randrange(25)}", f"t{draw.randrange(25)}"): draw.randrange(6) / 5 for _ in range(200)}.items())
    rows = [(a, b, s) for (a, b), s in pairs]
    left, right, expected = set(), set(), set()
    for a, b, s in sorted(rows, key=lambda x: (-x[2], x[0], x[1])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            expected.add((a, b, s))
    worse = [(a, b, s - 0.01) for a, b, s in rows[:20]]
    frame = spark.createDataFrame([*rows, *worse, rows[0], ("p1", "t1", None), (None, "t1", 1.0)], "l string, r string, s double")
    assert {tuple(x) for x in order.greedy_alignment(frame, "l", "r", "s").collect()} == expected
    assert order.greedy_alignment(frame.limit(0), "l", "r", "s").count() == 0


def test_linkage_orders_pairs_by_evidence(spark):
    rows = [(f"{i}", f"t{i // 2}", f"c{i // 2}" if i < 60 else f"c{i}", f"d{i % 3}") for i in range(120)]
    frame = spark.createDataFrame(rows, "id string, tax string, city string, day string")
    found = {(r["a"], r["b"]): r["probability"] for r in linkage.link(frame, "id", {"tax": F.col("tax")}, ["city", "day"], 0.0).collect()}
    assert len(found) == 60 and min(p for (a, _), p in found.items() if int(a) < 60) > max(p for (a, _), p in found.items() if int(a) >= 60)
    table = linkage.weights(["x"], [[0.1, 0.9]], [[0.9, 0.1]])
    assert table[1]["bits"] > 3 and not table[0]["veto"]
