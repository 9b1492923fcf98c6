import pytest

from keelson import skew
from pyspark.sql import functions as F


@pytest.mark.parametrize("limit", [20_000, 0])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_join_by_value(spark, monkeypatch, limit, how):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
    rows = [(i, "hot" if i % 3 else f"k{i % 50}") for i in range(900)] + [(1000, None), (1001, "absent")]
    frame = spark.createDataFrame(rows, "i int, k string")
    lookup = frame.where("k is not null and k <> 'absent'").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("x", F.concat(F.lit("x"), "k"))
    plain = frame.join(lookup.drop("n"), "k", how)
    for facts in (None, skew.observed(lookup, "n")[1]):
        got = skew.join_by_value(frame, lookup, ["k"], "n", how, facts)
        assert sorted(got.columns) == sorted(plain.columns)
        assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_facts_of_a_lookup(spark, monkeypatch):
    lookup = spark.createDataFrame([("a", 2), ("bcd", 5)], "k string, n bigint")
    written, facts = skew.observed(lookup, "n")
    assert (facts.rows, facts.total) == (2, 7) and facts.bytes >= 4 and written.count() == 2
    assert skew.observed(lookup.limit(0), "n")[1] == (0, 0, 0)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 3)
    plan = skew.join_by_value(lookup.select("k"), lookup, ["k"], "n")._jdf.queryExecution().toString()
    assert "_salt" in plan
