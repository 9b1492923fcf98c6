import random

from keelson.operators import cdc

BASE = "entity_id string, status string, effective_offset string, applied_sequence bigint, title string"
FEED = "entity_id string, sequence bigint, change_type string, new_status string, effective_offset string, status string"


def rows(df):
    return {r["entity_id"]: (r["current_status"], r["current_offset"]) for r in df.collect()}


def fold(base, feed):
    state = {e: [s, o, q] for e, s, o, q, _ in base}
    once = {}
    for e, q, kind, s, o, _ in feed:
        if e and e.strip() and q is not None:
            key = (e.strip().upper(), q)
            k, s0, o0 = once.get(key, (None, None, None))
            once[key] = (k or kind, s0 or s, o0 or o)
    for (e, q), (kind, s, o) in sorted(once.items(), key=lambda x: x[0][1]):
        now = state.get(e)
        if now and now[2] is not None and q <= now[2]:
            continue
        kind = kind[0].upper()
        live = now is not None and now[0] != "GONE"
        if kind == "D":
            state[e] = ["GONE", None, now[2] if now else None]
        elif live:
            state[e] = [s or now[0], o or now[1], now[2]]
        elif kind == "I":
            state[e] = [s, o, now[2] if now else None]
    return {e: (s, o) for e, (s, o, _) in state.items() if s != "GONE"}


def test_random_feeds_equal_a_sequential_fold(spark):
    draw = random.Random(5)
    ids = [f"A{i}" for i in range(12)] + ["HOT"] * 6
    base = [(f"A{i}", "Open", "T-5", draw.choice([None, 10, 20_000]), "x") for i in range(6)]
    feed = []
    for q in range(1, 40_000, 7):
        kind = draw.choice(["I", "update", "U", "upd", "D", "ins"])
        feed.append((draw.choice(ids), q, kind, draw.choice(["a", "b", None]), draw.choice(["T1", None]), "clash"))
    feed += [(f" {e.lower()} ", q, k, None, None, None) for e, q, k, *_ in draw.sample(feed, 500)]
    draw.shuffle(feed)
    got = rows(cdc.replay(spark.createDataFrame(base, BASE), spark.createDataFrame(feed, FEED)))
    assert got == fold(base, feed)


def test_nulls_empty_tables_and_unknown_kinds(spark):
    base = spark.createDataFrame([("A", "Open", "T0", None, "t"), (None, "Open", "T0", 1, "t"), ("A", "Open", "T0", None, "t")], BASE)
    feed = spark.createDataFrame([(None, 1, "U", "x", "T1", ""), ("A", None, "U", "x", "T1", ""), ("A", 3, "zap", "x", "T1", ""), ("B", 4, "U", "x", "T1", "")], FEED)
    assert rows(cdc.replay(base, feed)) == {"A": ("Open", "T0")}
    assert rows(cdc.replay(base, feed.limit(0))) == {"A": ("Open", "T0")}
    assert rows(cdc.replay(base.limit(0), feed)) == {}


def test_versions_keep_untouched_buckets(spark):
    base = spark.createDataFrame([(f"K{i}", "Open", "T0", 0, "t") for i in range(50)], BASE)
    table = cdc.create_table(base)
    feed = spark.createDataFrame([("K1", 5, "U", "Done", None, "")], FEED)
    after = cdc.apply_changes(table, feed)
    changed = {b for b in after.folders if after.folders[b] != table.folders.get(b)}
    assert len(changed) == 1 and after.version == 1
    assert cdc.BucketedTable.load(spark, table.root) == after
    assert rows(cdc.current_state(after, spark))["K1"] == ("Done", "T0")
    again = cdc.apply_changes(after, feed)
    assert rows(cdc.current_state(again, spark)) == rows(cdc.current_state(after, spark))


def test_any_split_of_a_feed_equals_replay_at_once(spark):
    draw = random.Random(8)
    base = [(f"A{i}", "Open", "T-5", draw.choice([None, 10]), "x") for i in range(4)]
    feed = [
        ("A0", 50, "U", "Done", None, ""), ("NEW", 60, "U", "Late", None, ""), ("A1", 55, "D", None, None, ""), ("CUT", 70, None, "copy", "T9", ""),
        ("A0", 40, "U", None, "T-1", ""), ("NEW", 45, "I", "First", "T2", ""), ("A1", 54, "U", "x", "T3", ""), ("CUT", 70, "I", None, None, ""),
    ]
    first = [feed[:4], feed[4:]]
    more = [(draw.choice(["A0", "A1", "A2", "A3", "B", "C"]), q, draw.choice("IUD"), draw.choice(["a", None]), draw.choice(["T1", None]), "") for q in range(1, 60_000, 997)]
    draw.shuffle(more)
    for parts in (first, [more[i::4] for i in range(4)]):
        table = cdc.create_table(spark.createDataFrame(base, BASE))
        for part in parts:
            cdc.apply_changes(cdc.BucketedTable.load(spark, table.root), spark.createDataFrame(part, FEED))
        got = rows(cdc.current_state(cdc.BucketedTable.load(spark, table.root), spark))
        assert got == rows(cdc.replay(spark.createDataFrame(base, BASE), spark.createDataFrame(sum(parts, []), FEED)))
        if parts is first:
            assert got["A0"] == ("Done", "T-1") and got["NEW"] == ("Late", "T2") and got["CUT"] == ("copy", "T9") and "A1" not in got
