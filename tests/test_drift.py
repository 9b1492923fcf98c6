import random

from keelson.operators import drift
from pyspark.sql import functions as F

SCHEMA = "load_no int, code string, ident string, extra string"


def table(spark, change):
    draw = random.Random(3)
    out = []
    for load in (1, 2, 3):
        for i in range(3000):
            code = draw.choice(["DE", "US", "FR", None])
            ident = f"V-{load}{i:06d}"
            if load == 3:
                code, ident = change(draw, code, ident)
            out.append((load, code, ident, "n"))
    return spark.createDataFrame(out, SCHEMA)


def changed(spark, change):
    found = drift.changed_columns(table(spark, change), "load_no", ["code", "ident"])
    return {(r["load_no"], r["column_name"]) for r in found.collect()}


def test_chance_and_new_identifiers_are_no_change(spark):
    assert changed(spark, lambda draw, c, i: (c, i)) == set()


def test_planted_changes(spark):
    assert changed(spark, lambda draw, c, i: (c and c.lower(), i)) == {(3, "code")}
    assert changed(spark, lambda draw, c, i: (c if draw.random() > 0.2 else "  ", i)) == {(3, "code")}
    assert changed(spark, lambda draw, c, i: (c, i.replace("-", "_"))) == {(3, "ident")}
    assert changed(spark, lambda draw, c, i: (c, i[:6])) == {(3, "ident")}


def test_profile_figures_and_patterns(spark):
    rows = [(1, "DE", f"V-{i:04d}", "") for i in range(200)] + [(1, " ", "odd!", ""), (1, None, "V-0001", ""), (None, "DE", "V-1", "")]
    got = {(r["load_no"], r["column_name"]): r for r in drift.column_profile(spark.createDataFrame(rows, SCHEMA), "load_no", ["code", "ident"]).collect()}
    code, ident = got[1, "code"], got[1, "ident"]
    assert (code["rows"], round(code["missing_ratio"] * 202), code["distinct_count"], code["observed_max_length"]) == (202, 2, 1, 2)
    assert ident["distinct_count"] == 201 and ident["nonconforming_rows"] == 1 and ident["main_pattern"] == r"^\p{Lu}-\d\d\d\d$"


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert drift.column_profile(empty, "load_no", ["code"]).count() == 0
    assert drift.changed_columns(empty, "load_no", ["code"]).count() == 0


def test_every_pattern_matches_its_own_values(spark):
    odd = ["a+b", "A++", "+49 1", "x.y*z", "日本語", "ǅ1", "٣٤", "a|b", "(c)", "[d]", "e\\f", "$1^", "{2}", "w9a A", "Ünal-Öz", "naïve café"]
    rows = [(1, value * (1 + i % 3), f"{value} {i:03d}", "") for i in range(400) for value in odd]
    values = drift.value_counts(spark.createDataFrame(rows, SCHEMA), "load_no", ["code", "ident"])
    patterns = drift.patterned_shapes(values).select("column_name", "s1", "pattern").where("pattern is not null")
    checked = values.withColumn("s1", drift.shape(F.col("value"))).join(patterns, ["column_name", "s1"])
    assert checked.count() > 500
    assert checked.where(~F.expr("value rlike pattern")).select("value", "pattern").collect() == []
