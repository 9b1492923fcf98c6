from keelson.operators import csv_records as c

HEAD = "legacy_client_id,client_name,nation,contact_email,account_currency,marketing_opt_in"
GOOD = 'LC-1,"Ann ""A"", Co",DE,a@b.cd,EUR,yes'


def found(spark, *texts, mark="LC-"):
    frame = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], "job_id bigint, csv_text string, raw string")
    records = c.split_records(frame, "job_id", "csv_text", mark)
    bad = {(r["job_id"], r["line_no"]): r["reason"] for r in c.faulty_records(records, "job_id").collect()}
    good = {(r["job_id"], r["line_no"]): r["record"] for r in c.loadable_records(records, "job_id").collect()}
    return bad, good


def test_reasons_and_line_numbers(spark):
    text = "\r\n".join([
        "﻿" + HEAD, GOOD, "", 'LC-2,"x\r\n\r\ny",DE,,EUR,No', 'LC-3,"open,DE,a@b.cd,EUR,yes', "LC-4,a,b", 'LC-5,a"b,DE,,EUR,1',
        "LC-6,n,de,,EUR,0", "LC-7,n,DE,a(at)b,EUR,0", "LC-8,n,DE,,EURO,0", "LC-9,n,DE,,EUR,maybe", "LC-10,n\x00,DE,,EUR,0", "LC-11,n�,DE,,EUR,0", "LC-12,n,DE,,EUR,TRUE",
    ])
    bad, good = found(spark, text)
    assert {k[1]: v for k, v in bad.items()} == {
        7: "quoting", 8: "column_count", 9: "quoting", **{n: "invalid_value" for n in range(10, 16)},
    }
    assert sorted(k[1] for k in good) == [2, 4, 16]
    assert good[0, 2]["client_name"] == 'Ann "A", Co' and good[0, 4]["client_name"] == "x\r\n\r\ny"


def test_empty_header_only_null_and_missing_columns(spark):
    bad, good = found(spark, None, "", "  ", HEAD, "legacy_client_id,client_name\nLC-1,x", HEAD + "\nLC-1," + "x" * 200_000 + ",DE,,EUR,y")
    assert bad == {} and sorted(good) == [(4, 2), (5, 2)]


def test_empty_table(spark):
    assert found(spark) == ({}, {})


def test_empty_opt_in_is_left_out_and_faults_are_named(spark):
    frame = spark.createDataFrame([(1, HEAD + "\nLC-1,n,de,a,EUR,\nLC-2,n,DE,,EUR,")], "job_id bigint, csv_text string")
    bad = c.faulty_records(c.split_records(frame, "job_id", "csv_text", "LC-"), "job_id").collect()
    assert [(r["line_no"], r["details"]) for r in bad] == [(2, ["contact_email: not an e-mail address", "nation: not two capital letters"])]


def test_texts_without_mark(spark):
    text = 'client_name,nation\r\n"two\r\n""lines""",DE\r\n\r\nplain,AT\r\n"open,DE\r\nnext,DE\nshort\n7\ue000x,de\n"12\ue000\n13\ue000",FR'
    bad, good = found(spark, text, mark=None)
    assert {k[1]: v for k, v in bad.items()} == {6: "quoting", 8: "column_count", 9: "invalid_value"}
    assert {k[1]: v["client_name"] for k, v in good.items()} == {2: 'two\r\n"lines"', 5: "plain", 7: "next", 10: "12\ue000\n13\ue000"}
