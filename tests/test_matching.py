from keelson.operators import matching as m
from pyspark.sql import functions as F

TARGET = "target string, resource string, name string, kind string, description string, semantic_type string, aliases array<string>, enum_values array<string>, pattern string, max_length int"


def test_candidates_and_suggestions(spark):
    sources = spark.createDataFrame(
        [("client_phone", "string", 1.0, 12, ["1"]), ("iban", "string", 1.0, 22, ["DE02120300000000202051"]), ("flag", "boolean", 0.1, 3, ["yes", " "]), ("old_id", "string", 1.0, 8, [])],
        "source string, kind string, distinct_ratio double, longest bigint, samples array<string>",
    )
    targets = spark.createDataFrame(
        [("p.phone", "p", "phone", "string", "telephone of the customer", "phone", [], [], None, None), ("p.account", "p", "account", "string", "bank account", "iban", None, [], None, None),
         ("p.email", "p", "email", "string", "", "email", ["old-ID"], [], None, None), ("p.day", "p", "day", "date", None, None, [], [], None, None)], TARGET,
    )
    scored = {(r["source"], r["target"]): r for r in m.candidates(sources, targets).collect()}
    assert len(scored) == 16 and scored["old_id", "p.email"]["alias"] and scored["old_id", "p.email"]["score"] >= 0.9
    assert scored["iban", "p.account"]["evidence"] == ["iban_shape"] and scored["iban", "p.account"]["score"] > scored["iban", "p.account"]["base"]
    assert scored["flag", "p.email"]["gate"] == 0.6 and scored["flag", "p.email"]["warnings"] == ["boolean_source_for_text_target"]
    best = {r["source"]: r for r in m.suggestions(m.ranked(m.candidates(sources, targets))).collect()}
    assert best["old_id"]["basis"] == "alias" and best["old_id"]["status"] == "suggested" and best["client_phone"]["best"] == "p.phone"
    assert best["flag"]["status"] == "no_confident_target" and best["flag"]["reasons"] == ["best_score_below_threshold"]
    assert m.candidates(sources.limit(0), targets).count() == 0 and m.candidates(sources, targets.limit(0)).count() == 0


def test_status_order(spark):
    rows = [(0.39, False, 0.0, 0.6, []), (0.5, False, 0.0, 0.6, ["w"]), (0.75, False, 0.0, 1.0, []), (0.5, True, 0.0, 0.6, ["w"]), (0.42, False, 0.5, 1.0, []), (0.6, False, 0.0, 1.0, ["w"])]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, score double, alias boolean, lexical double, gate double, warnings array<string>")
    name, band, reasons = m.status()
    got = [tuple(r) for r in frame.orderBy("i").select(name, band, F.array_join(reasons, ",")).collect()]
    assert got == [
        ("no_confident_target", "low", "best_score_below_threshold"), ("possible_false_friend", "medium", "no_lexical_anchor,type_gate_warning"), ("suggested", "high", ""),
        ("needs_review", "medium", "medium_confidence,w"), ("no_confident_target", "low", "best_score_below_threshold"), ("needs_review", "medium", "medium_confidence,no_lexical_anchor,w"),
    ]


def test_benchmark_of_empty_groups(spark):
    cases = spark.createDataFrame([(1, "a", ["x"], "x"), (2, "a", ["x", "y"], "x"), (3, "b", [], None)], "case_id int, scenario string, expected array<string>, recommended string")
    found = spark.createDataFrame([(1, "x", 2), (2, "x", 1), (2, "y", 3), (3, "x", 1)], "case_id int, target string, rank int")
    got = {r["scenario"]: r for r in m.benchmark(cases, found, "scenario").collect()}
    assert (got["a"]["top1"], got["a"]["recall_at_1"], got["a"]["recall_at_3"], got["a"]["mrr"], got["a"]["no_target"], got["a"]["full_coverage"]) == (0.0, 0.3333, 1.0, 0.6111, None, 1.0)
    assert got["b"]["top1"] is None and got["b"]["no_target"] == 1.0 and got[None]["cases"] == 3
    assert {r["case_id"]: r["verdict"] for r in m.case_verdicts(cases, found).collect()} == {1: "correct_but_ranked_2_or_3", 2: "multi_target_fully_covered", 3: "correct_no_target"}


def test_replaced_words_and_free_text(spark):
    row = spark.range(1).select(m.replaced(F.lit("tax zip x")), m.letters_only(F.lit("Old-Id 7")), m.free_text(F.lit(0.6), F.lit(16.0), F.lit(None)), m.free_text(F.lit(0.1), F.lit(1.0), F.lit(True))).first()
    assert tuple(row) == ("tax vat postal x", "oldid", True, True)
