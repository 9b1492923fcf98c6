import random

import pytest
from keelson.llm import components


def groups(spark, links):
    frame = spark.createDataFrame(links, "a string, b string")
    return {r["id"]: r["group_id"] for r in components.connected_components(frame).collect()}


def brute(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a and b and a != b:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("core", [10_000, 60, 0])
def test_shapes(spark, monkeypatch, core):
    monkeypatch.setattr(components, "CORE_LINKS", core)
    draw = random.Random(2)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    star = [("hub", f"s{i:03d}") for i in range(80)]
    ring = [(f"r{i:02d}", f"r{(i + 1) % 20:02d}") for i in range(20)]
    clump = [(f"x{draw.randrange(40)}", f"x{draw.randrange(40)}") for _ in range(120)]
    links = chain + star + ring + clump + [(b, a) for a, b in chain[:9]] + [("p", "q"), ("p", "p"), ("z", "z"), (None, "p"), ("p", None)]
    draw.shuffle(links)
    assert groups(spark, links) == brute(links)


def test_no_links(spark):
    assert groups(spark, []) == {} and groups(spark, [("a", "a"), (None, "b")]) == {}


def test_vendor_ids(spark):
    pairs = [(" v1 ", "V2", 0.95), ("V2", "V3", None), ("V2", "V4", 0.94), ("V2", "V9", 0.99), (None, "V1", 1.0), ("V3", "v4", 1.0), ("V3", "V3", 1.0)]
    frame = spark.createDataFrame(pairs, "unique_id_l string, unique_id_r string, match_probability double")
    vendors = spark.createDataFrame([(f"V{i}", "x") for i in range(1, 6)], "legacy_vendor_id string, a string")
    got = {r["legacy_vendor_id"]: r["group_id"] for r in components.vendor_groups(frame, vendors).collect()}
    assert got == {"V1": "V1", "V2": "V1", "V3": "V3", "V4": "V3"}
