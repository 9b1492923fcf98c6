import pytest

from keelson.operators import contracts as c
from keelson.operators import decisions, preload
from keelson.operators.preload import Mapped
from keelson.sources.files import SourceError

DOCUMENT = {
    "name": "x", "resources": [
        {"name": "t", "schema": {"primaryKey": ["a", "b"], "fields": [{"name": "a"}, {"name": "b", "type": "integer"}, {"name": "c", "constraints": {"unique": True}}, {"name": "gone"}],
                                 "foreignKeys": [{"fields": ["c"], "reference": {"resource": "p", "fields": ["k"]}}]}},
        {"name": "p", "schema": {"fields": [{"name": "k", "constraints": {"required": True, "enum": ["u", "v"]}}]}},
    ]}


def test_violations_of_nulls_ties_and_repeated_rows(spark):
    t = spark.createDataFrame([(1, "x", "1", "u", "e"), (2, "x", "1", " ", "e"), (3, "x", "1", "u", "e"), (4, None, "1", "w", "e"), (5, "x", "1.5", None, "e")], "id int, a string, b string, c string, value string")
    p = spark.createDataFrame([("u", 1), ("u", 2), (None, 3), ("z", 4)], "k string, id int")
    found = c.validate_contract({"t": t, "p": p}, c.parse_contract(DOCUMENT), {"t": "id", "p": "id"}).collect()
    assert sorted((r["field"], r["category"], r["row_key"], r["first_row"]) for r in found if r["category"] != "schema") == [
        ("a, b", "primary_key", "2", "1"), ("a, b", "primary_key", "3", "1"), ("b", "type", "5", None), ("c", "foreign_key", "4", None), ("c", "unique", "3", "1"),
        ("k", "enum", "4", None), ("k", "required", "3", None),
    ]
    assert [r["field"] for r in found if r["category"] == "schema"] == ["gone"]
    empty = {"t": t.limit(0), "p": p.limit(0)}
    assert [r["category"] for r in c.validate_contract(empty, c.parse_contract(DOCUMENT), {"t": "id", "p": "id"}).collect()] == ["schema"]


@pytest.mark.parametrize("change", [
    {"name": ""}, {"resources": []}, {"home": "https://example.test/x"}, {"path": "/etc/x"}, {"path": "a/../b"}, {"note": "api_key=abc"},
    {"resources": [{"name": "t", "schema": {"fields": []}}]}, {"resources": [{"name": "t", "schema": {"fields": [{"name": "a"}], "primaryKey": "b"}}]},
])
def test_unsound_contracts_are_refused(change):
    with pytest.raises(SourceError):
        c.parse_contract(DOCUMENT | change)


def test_contract_files(spark, tmp_path):
    import json

    (tmp_path / "c.json").write_text(json.dumps(DOCUMENT))
    read = c.read_contract(spark, "c.json", str(tmp_path))
    assert c.contract_fields(spark, read).count() == 5
    with pytest.raises(SourceError):
        c.read_contract(spark, "../c.json", str(tmp_path))
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(DOCUMENT))
    assert c.read_contract(spark, "c.yaml", str(tmp_path)) == read


def test_record_issues_and_root_causes(spark):
    rows = spark.createDataFrame([(1, "Germany", "k"), (2, "DE", "k"), (3, None, None), (4, "", "m")], "id int, country string, k string")
    mappings = [Mapped("country", "T.C", max_length=2, nullable=False), Mapped("k", "T.K", key=True, verified=False)]
    issues = preload.record_issues(rows, "id", mappings)
    assert sorted((r["record_id"], r["source"], r["issue"]) for r in issues.collect()) == [
        ("1", "country", "max_length_overflow"), ("1", "k", "duplicate_primary_key"), ("2", "k", "duplicate_primary_key"), ("3", "country", "required_field_missing"),
        ("3", "k", "required_field_missing"), ("4", "country", "required_field_missing"),
    ]
    coded = preload.field_issues(rows, mappings, []).where("issue = 'normalization_required'")
    causes = {(r["source"], r["root_cause"]): r for r in preload.root_causes(issues, coded).collect()}
    assert causes["country", "normalization_required"]["sample"] == "1" and causes["k", "duplicate_primary_key"]["records"] == 2
    assert causes["k", "required_field_missing"]["unverified"] and preload.record_issues(rows.limit(0), "id", mappings).count() == 0
    assert preload.offenders(rows, mappings).collect() == [("country", "Germany", 1)]


def test_decisions(spark):
    schema = "source string, target string, decision string, transformation string"
    said = spark.createDataFrame([("a", "x", "approved", "copy"), ("b", "x", "approved", "copy"), ("b", "x", "approved", "copy"), ("a", "y", "deferred", None), (None, "x", "approved", "copy")], schema)
    known = lambda name, *values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    found = decisions.faults(said, known("source", "a", "b"), known("target", "x", "y"), said.select("source", "target").where("source = 'a'"))
    assert sorted((r["rule"], r["source"]) for r in found.collect()) == [("missing_part", None), ("not_proposed", "b"), ("repeated_link", "b"), ("repeated_target", "a"), ("repeated_target", "b")]
    assert decisions.summary(said.limit(0)).first()["export_ready"] is False
    assert decisions.faults(said.limit(0), known("source"), known("target"), said).count() == 0
    one = decisions.manifest("x", said, {"r": said}, said, said.limit(0), {"in": "00"})
    assert one == decisions.manifest("x", said.repartition(3), {"r": said}, said, said.limit(0), {"in": "00"}) and one["source"]["rows"] == 5
