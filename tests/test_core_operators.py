import pytest

from keelson.functions import similarity, text
from keelson.operators import dedupe, events, findings, graph, mapping, package, profile, rank, validate
from keelson.skew import join_by_value
from keelson.sources import files
from keelson.storage import durable
from pyspark.sql import functions as F


def one(spark, expression, *values):
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in frame.select(expression(F.col("v"))).collect()]


def test_text_functions(spark):
    assert one(spark, text.format_signature, "AB-12", "Äb cd", "--", "", None) == ["A-D", "A A", "-", "", None]
    assert one(spark, text.split_identifier, "vendorName2", "VAT_number") == ["vendor name 2", "vat number"]
    assert one(spark, text.offset_value, "T-25", "T0", "T+3", "X", None) == [-25, 0, 3, None, None]
    assert one(spark, text.slug_id, " a b/c ") == ["A-B-C"]
    assert one(spark, lambda c: text.legal_form(text.basic_name(c)), "Foo GmbH & Co. KG", "Foo Inc.", "Foo") == ["gmbh_co_kg", "inc", None]
    assert one(spark, text.csv_safe, "=1", "a") == ["'=1", "a"]
    assert one(spark, text.is_missing, None, " \t", "x") == [True, True, False]


def test_similarities(spark):
    frame = spark.createDataFrame([("MARTHA", "MARHTA"), ("", "a"), (None, "a"), ("b a", "a b")], "x string, y string")
    got = frame.select(similarity.jaro_winkler(F.col("x"), F.col("y")), similarity.token_sort_ratio(F.col("x"), F.col("y"))).collect()
    assert round(got[0][0], 4) == 0.9611 and got[1][0] == 0 and got[2][0] is None and got[3][1] == 100


def test_profile_of_empty_and_clashing_columns(spark):
    frame = spark.createDataFrame([("a", " "), ("a", None)], "field string, value string")
    got = {r["field"]: r for r in profile.profile(frame, ["field", "value"]).collect()}
    assert (got["field"]["distinct_values"], got["value"]["missing"], got["value"]["distinct_ratio"]) == (1, 2, 0.0)
    assert profile.profile(frame.limit(0), ["field"]).count() == 0


def test_keys_and_orphans(spark):
    child = spark.createDataFrame([(1, 1), (2, None), (3, 9)], "id int, k int")
    parent = spark.createDataFrame([(1,), (1,), (None,)], "p int")
    assert [r["id"] for r in validate.orphans(child, parent, {"k": "p"}).collect()] == [3]
    assert validate.repeated_keys(child.unionByName(child), ["id"]).count() == 3


def test_ranks_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([("a", 3.0, i) for i in range(5)] + [("b", 1.0, 9)], "g string, s double, i int")
    expected = None
    for parts in (1, 3, 7):
        got = sorted(rank.top_per_group(rows.repartition(parts), ["g"], [F.desc("s"), F.col("i")], 2).collect())
        expected = expected or got
        assert got == expected
    margin = {r["g"]: r["margin"] for r in rank.margin_to_next(rows, ["g"], "s", "i").collect()}
    assert margin == {"a": 0.0, "b": None}


def test_join_by_value_salts_hot_keys(spark, monkeypatch):
    import keelson.skew as skew

    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    rows = spark.range(5000).select(F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), "id")
    lookup = durable(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m")))
    joined = join_by_value(rows, lookup, ["k"], "n")
    assert joined.count() == 5000 and joined.where("k = 'hot' and m <> 1999").count() == 0
    assert join_by_value(rows, lookup.where("k <> 'hot'"), ["k"], "n", "left").where("m is null").count() == 2000
    assert join_by_value(rows, lookup.where("k = 'hot'"), ["k"], "n", "left_semi").count() == 2000


def test_blocking_and_weights(spark):
    rows = spark.createDataFrame([("1", "x", None), ("2", "x", "y"), ("3", None, "y"), ("4", None, None)], "id string, k1 string, k2 string")
    rules = {"k1": F.col("k1"), "k2": F.col("k2")}
    assert sorted(dedupe.blocking_pairs(rows, "id", rules).collect()) == [("1", "2"), ("2", "3")]
    share, m = dedupe.fit_weights([((1, 1), 90), ((0, 0), 900), ((1, 0), 10)], [[0.95, 0.05], [0.95, 0.05]])
    assert 0.05 < share < 0.15 and m[1][1] > 0.9
    frame = spark.createDataFrame([(1, 1), (0, 0)], "a int, b int")
    p = [r[0] for r in frame.select(dedupe.match_probability([F.col("a"), F.col("b")], share, m, [[0.95, 0.05], [0.95, 0.05]])).collect()]
    assert p[0] > 0.95 and p[1] < 0.05


def test_package_and_lineage(spark):
    rows = spark.createDataFrame([("1", "F"), (" ", "F"), ("3", "?"), ("4", None)], "id string, s string")
    maps = [package.FieldMapping("t", "id", required=True), package.FieldMapping("u", "s", kind="value_map", values={"F": "x"})]
    got = {r["record_id"]: r["reject_reason"] for r in package.build(rows, "id", maps).collect()}
    assert got == {"1": None, " ": "missing_record_id", "3": "value_map_missing:u", "4": None}
    assert sorted((r["record_id"], r["target"]) for r in package.lineage(rows, "id", maps).collect()) == [("1", "t"), ("1", "u"), ("4", "t")]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "zz")], "node string, needs string")
    assert {r[0] for r in graph.on_cycles(edges).collect()} == {"a", "b", "c"}
    assert graph.on_cycles(edges.where("node in ('d', 'e')")).count() == 0
    start = spark.createDataFrame([("d",)], "node string")
    assert {tuple(r) for r in graph.ancestors(edges, start).collect()} == {("d", 0), ("a", 1), ("b", 2), ("c", 3)}
    assert [r["needs"] for r in graph.dangling(edges, edges.select("node")).collect()] == ["zz"]


def test_findings_and_events(spark):
    rows = [("r", "k", "low", "s2", f"{i:03d}") for i in range(30)] + [("r", "k", "high", "s1", "000")]
    got = findings.merge(spark.createDataFrame(rows, "rule_id string, dedupe_key string, severity string, source string, row_key string")).first()
    assert got["severity"] == "high" and got["sources"] == "s1,s2" and got["rows"] == 31 and got["sample_keys"].count(",") == 9
    log = spark.createDataFrame([("e", 1, "a"), ("e", 2, "b"), ("e", 3, "a")], "entity string, seq int, status string")
    legal = [r["legal"] for r in events.transitions(log, "entity", ["seq"], "status", {"a": ["b"]}, "a").orderBy("seq").collect()]
    assert legal == [True, True, False]
    assert events.state_as_of(log, "entity", ["seq"], "status", F.col("seq") < 3).first()["status"] == "b"


def test_mapping(spark):
    sources = spark.createDataFrame([("vendorName", "string"), ("zzz", "boolean")], "source string, kind string")
    targets = spark.createDataFrame([("supplier_name", "string", ["vendor name"]), ("iban", "string", None)], "target string, kind string, aliases array<string>")
    best = {r["source"]: r for r in mapping.suggest(mapping.score(sources, targets), 1).collect()}
    assert best["vendorName"]["target"] == "supplier_name" and best["vendorName"]["band"] == "high"
    assert best["zzz"]["status"] == "no_confident_target"


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"=2"\n')
    (tmp_path / "b.csv").write_text("x,x\n1,2\n")
    rows = files.read_csv(spark, "a.csv", str(tmp_path))
    assert [tuple(r) for r in rows.collect()] == [("1", "=2")]
    for bad in ("http://x/a.csv", "../a.csv", "b.csv"):
        with pytest.raises(files.SourceError):
            files.read_csv(spark, bad, str(tmp_path))
    files.write_csv(rows, ["y"], str(tmp_path / "out"), guard_formulas=True)
    assert [r[0] for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()] == ["'=2"]
    known = files.write_if_changed(rows, str(tmp_path / "p"), None)
    assert files.write_if_changed(rows.repartition(3), str(tmp_path / "q"), known) == known and not (tmp_path / "q").exists()


def test_stream_of_changes(spark, tmp_path):
    from keelson.operators import cdc
    from keelson.streaming.changes import apply_stream

    base = spark.createDataFrame([("A", "Open", "T0", 0)], "entity_id string, status string, effective_offset string, applied_sequence bigint")
    schema = "entity_id string, sequence bigint, change_type string, new_status string, effective_offset string"
    table = cdc.create_table(base, str(tmp_path / "t"))
    spark.createDataFrame([("A", 2, "U", "Done", None), ("B", 1, "I", "New", "T1")], schema).write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "feed"))
    apply_stream(stream, table.root, str(tmp_path / "c")).awaitTermination(60)
    got = {r["entity_id"]: r["current_status"] for r in cdc.current_state(cdc.BucketedTable.load(spark, table.root), spark).collect()}
    assert got == {"A": "Done", "B": "New"}


def test_scores_from_context_and_concepts(spark):
    rows = [("a", "t1", 0.9), ("b", "t2", 0.5), ("b", "x1", 0.5), ("c", "t3", 0.8), ("bank_sort_code", "routing_number", 0.6), ("bank_sort_code", "bank_name", 0.62)]
    frame = spark.createDataFrame([(*r, 0.1, False, 1.0) for r in rows], "source string, target string, score double, lexical double, alias boolean, gate double")
    positions = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("bank_sort_code", 9)], "source string, position int")
    resources = spark.createDataFrame([("t1", "T"), ("t2", "T"), ("t3", "T"), ("x1", "X")], "target string, resource string")
    support = mapping.resource_support(frame, positions, resources)
    assert [tuple(r) for r in support.collect()] == [("b", "T", 1.0)]
    raised = mapping.with_resource_context(frame, support, resources)
    assert {r["target"]: r["score"] for r in raised.collect()}["t2"] == 0.55
    ranked = {(r["source"], r["rank"]): r["target"] for r in mapping.tier_locked(mapping.with_concepts(raised)).collect()}
    assert ranked["bank_sort_code", 1] == "routing_number" and ranked["b", 1] == "t2"


def test_small_helpers(spark):
    from keelson.operators import evaluate

    assert one(spark, lambda c: text.expand_synonyms(F.split(c, " "), {"vat": "tax"}), "vat no") == [["vat", "tax", "no"]]
    assert one(spark, lambda c: text.expand_synonyms(F.split(c, " "), {"vat": "tax"}, True), "vat no") == [["tax", "no"]]
    assert one(spark, lambda c: text.significant(c, 3), "1234.5") == [1230.0]
    assert one(spark, text.has_cjk, "状態", "a") == [True, False]
    assert one(spark, lambda c: text.found_keywords(c, ["EDI", "api"]), "The API of EDI") == [["EDI", "api"]]
    truth = spark.createDataFrame([("a", "clean"), ("b", "dirty"), ("c", "dirty")], "id string, level string")
    got = {r["level"]: r["recall"] for r in evaluate.recall_by_level(truth, truth.where("id <> 'c'").select("id"), ["id"], "level").collect()}
    assert got == {"clean": 1.0, "dirty": 0.5}
    edges = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.96), ("b", "c", 0.8)], "a string, b string, score double")
    groups = spark.createDataFrame([("a", 1), ("b", 1)], "id string, group_id int")
    assert [tuple(r) for r in dedupe.borderline_pairs(edges, groups).collect()] == [("b", "c", 0.8)]


def test_members_with_one_usable_value_are_blocked(spark, tmp_path):
    from keelson.plans import core_queries

    vendors = [("A", "DE123456789", None), ("B", "123 456 789", "b@x"), ("C", "12", "c@x.de"), ("D", None, " C@x.de"), ("E", "12", "b@x"), ("F", "123456789", "c@x.de")]
    spark.createDataFrame(vendors, "legacy_vendor_id string, tax_number string, email string").write.parquet(f"{tmp_path}/legacy_vendors.parquet")
    groups = [(1, "A"), (1, "B"), (2, "C"), (2, "D"), (3, "B"), (3, "E")]
    spark.createDataFrame(groups, "group_id bigint, legacy_vendor_id string").write.parquet(f"{tmp_path}/vendor_duplicate_groups.parquet")
    assert sorted(tuple(r) for r in core_queries.blocking_pairs(spark, str(tmp_path)).collect()) == [("A", "B"), ("C", "D")]
    assert tuple(core_queries.blocking_coverage(spark, str(tmp_path)).first()) == (3, 2, 2 / 3)


def test_all_loads_are_linked_and_tagged(spark, tmp_path):
    from keelson.plans import linkage_queries, more_queries

    rows = [(f"V{i}", f"Firm {i // 2} & Co", "Bonn", "EUR", "20200101", f"1234567{10 + i // 2}", f"m{i // 2}@firm.de", f"0228 99{12345 + i // 2}", i % 6 + 1, f"Weg {i // 2}", f"53{i // 2:03d}") for i in range(24)]
    columns = "legacy_vendor_id string, vendor_name string, city string, currency string, created_date string, tax_number string, email string, phone string, load_no int, street string, postal_code string"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/legacy_vendors.parquet")
    linked = {(r["a"], r["b"]) for r in linkage_queries.vendor_linkage(spark, str(tmp_path)).collect()}
    assert linked == {tuple(sorted((f"V{i}", f"V{i + 1}"))) for i in range(0, 24, 2)}
    assert {r["legacy_vendor_id"] for r in more_queries.name_writing_tags(spark, str(tmp_path)).where("has_ampersand").collect()} == {f"V{i}" for i in range(24)}
