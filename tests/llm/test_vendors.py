import random
from datetime import datetime

from keelson.llm import canonical, edits, survivor, variants


def test_edits_and_trie():
    assert edits.edits("spian", "spain", 2) == 1 and edits.edits("abc", "xyz", 2) == 3 and edits.edits("", "ab", 2) == 2
    words = ["walter", "wlater", "walters", "valter", "wa", "harbour"]
    tree = edits.Trie(words)
    for probe in [*words, "waltre", "h"]:
        assert sorted(tree.near(probe, 1)) == sorted(w for w in words if edits.edits(w, probe, 1) <= 1)


def test_canonical_values(spark):
    listed = spark.createDataFrame([("DE", "Germany"), ("US", "United States"), ("KR", "South Korea"), ("ES", "Spain")], "code string, name string")
    known = canonical.country_names(spark)
    texts = {
        "Germany": "DE", " GERMANY ": "DE", "Geruany": "DE", "de": "DE", "D.E.": "DE", "DE - Germany": "DE", "Alemania": "DE", "uNITED sTATES": "US",
        "United tSates": "US", "U.S.A.": "US", "States United": "US", "Korea (South)": "KR", "North Korea": "NONE", "Spian": "ES", "Niger": "NONE", "n/a": "NONE",
        "overseas": "NONE", "???": "NONE", "x" * 5000: "NONE",
    }
    rows = [(f"V{i}", t, "x") for i, t in enumerate(texts)] + [("V0", "Germany", "x"), ("N1", None, "x"), ("N2", "  ", "x"), ("L", "DE", "x"), (None, "US", "x")]
    frame = spark.createDataFrame(rows, "id string, country string, code string")
    got = {r["id"]: r["code"] for r in canonical.canonical_column(frame, "id", "country", listed, known).collect()}
    assert got == {f"V{i}": code for i, code in enumerate(texts.values())}
    assert canonical.canonical_column(frame.limit(0), "id", "country", listed, known).count() == 0


def test_other_reference_lists(spark):
    cities = [("c1", "Frankfurt am Main"), ("c2", "Frankfurt an der Oder"), ("c3", "Sankt Gallen"), ("c4", "New York City"), ("c5", "York")]
    jobs = [("j1", "Head of Data Migration"), ("j2", "Head of Finance"), ("j3", "Data Migration Engineer"), ("j4", "Master Data Steward")]
    short = [("c3", "St. Gallen"), ("c4", "NYC"), ("x9", "Frankfurt Kentucky")]
    texts = {
        "frankfurt a. main": "NONE", "Main, Frankfurt am": "c1", "Frankfrut an der Oder": "c2", "St Galen": "c3", "n y c": "c4", "new yorkcity": "c4", "Kentucky Frankfurt": "NONE", "Yorck": "c5", "Rome": "NONE",
        "Hed of Data Migraton": "j1", "head finance of": "j2", "Engineer, Data Migration": "j3", "data steward master": "j4", "of of of": "NONE",
    }
    frame = spark.createDataFrame([(t,) for t in texts], "value string")
    got = {}
    for listed, known in ((cities, short), (jobs, None)):
        names = spark.createDataFrame(listed, "code string, name string")
        more = spark.createDataFrame(known, "code string, name string") if known else None
        for r in canonical.canonical_values(frame, names, more).collect():
            if r["code"] != "NONE" or r["value"] not in got:
                got[r["value"]] = r["code"]
    assert {t: c for t, c in got.items() if texts[t] != "NONE"} == {t: c for t, c in texts.items() if c != "NONE"}
    assert all(got[t] in ("NONE", "c1") for t, c in texts.items() if c == "NONE")
    assert {r["code"] for r in canonical.canonical_values(frame, spark.createDataFrame([], "code string, name string")).collect()} == {"NONE"}


def test_common_tokens_find_no_candidates_but_count(spark, monkeypatch):
    listed = spark.createDataFrame([(f"k{i}", f"Republic of the {a}{b}land") for i, (a, b) in enumerate((a, b) for a in ("Bor", "Mel", "Tul", "Zak") for b in ("an", "el", "is", "om"))], "code string, name string")
    frame = spark.createDataFrame([("Repulbic of the Boranland",), ("the Zakomland of Republic",), ("Melisland",), ("republic of the",), ("of",)], "value string")
    found = {r["value"]: (r["code"], r["score"]) for r in canonical.canonical_values(frame, listed).collect()}
    monkeypatch.setattr(canonical, "_telling", lambda own: own.select("part", "token"))
    assert {r["value"]: (r["code"], r["score"]) for r in canonical.canonical_values(frame, listed).collect()} == found
    assert found["Repulbic of the Boranland"][0] == "k0" and found["the Zakomland of Republic"][0] == "k15" and found["Melisland"][0] == "k6"


VENDOR = "legacy_vendor_id string, vendor_name string, city string, street string, postal_code string, tax_number string, email string, phone string, created_date string, source_system string, changed_at timestamp, loaded_at timestamp, value string"


VENDOR_REST = ["tax_number", "email", "phone", "street", "postal_code", "created_date"]


def vendor(i, name="n", tax=None, phone=None, city=None, system=None, changed=1, postal=None, street=None, email=None, created="20200101"):
    day = datetime(2020, 1, changed)
    return (i, name, city, street, postal, tax, email, phone, created, system, day, day, "clash")


def test_survivors(spark):
    vendors = [
        vendor("A", city="same as above", tax="DE123456789", system="LOW", changed=9), vendor("B", city="Bonn", tax="XX000000000", system="TOP", changed=1),
        vendor("C", city="Köln ", tax="de 123456789", system=None, changed=20, phone="12"), vendor("D", city="Ulm", system="TOP", changed=1), vendor("D", city="Ulm", system="TOP", changed=1),
    ]
    groups = spark.createDataFrame([(1, x) for x in "ABCD"] + [(1, "D"), (1, "Z"), (2, "C"), (None, "A"), (3, None)], "group_id bigint, legacy_vendor_id string")
    sources = spark.createDataFrame([("TOP", 1), ("LOW", 5)], "source_system string, trust_rank int")
    frame = spark.createDataFrame(vendors, VENDOR)
    values = survivor.member_values(groups, frame, sources)
    got = {(r["group_id"], r["field_name"]): r["legacy_vendor_id"] for r in survivor.survivors(values).collect()}
    assert got == {(1, "city"): "B", (1, "tax_number"): "A", (2, "city"): "C", (2, "tax_number"): "C"}
    golden = {r["group_id"]: r for r in survivor.golden_records(groups, frame, sources).collect()}
    assert golden[1]["tax_number"]["value"] == "DE123456789" and golden[2]["city"]["value"] == "Köln " and golden[1]["phone"] is None
    ranked = survivor.golden_records(groups, frame, sources, votes="rank")
    assert {(r["group_id"], r["field_name"]): r["legacy_vendor_id"] for r in survivor.winners(ranked).collect()} == got
    assert ranked.count() == 3
    assert survivor.survivors(survivor.member_values(groups.limit(0), frame, sources)).count() == 0


def test_sums_let_members_agree_and_ranks_do_not(spark):
    vendors = [vendor(x, city=c, system=s, changed=d) for x, c, s, d in [("A", "Ulm", "TOP", 1), ("B", "Bonn", "MID", 2), ("C", "bonn", "MID", 9), ("D", "Bonn ", "MID", 9)]]
    groups = spark.createDataFrame([(1, x) for x in "ABCD"], "group_id bigint, legacy_vendor_id string")
    sources = spark.createDataFrame([("TOP", 1), ("MID", 2)], "source_system string, trust_rank int")
    values = survivor.member_values(groups, spark.createDataFrame(vendors, VENDOR), sources)
    assert [r["legacy_vendor_id"] for r in survivor.survivors(values, "sum").collect()] == ["C"]
    assert [r["legacy_vendor_id"] for r in survivor.survivors(values, "rank").collect()] == ["A"]


def test_names_fit():
    fit = lambda a, b: variants.names_fit(variants.name_words(a), variants.name_words(b))
    same = [
        ("Lorken Mascihnenbau GmbH & Co. KG", "Lorken M. GmbH & Co. KG"), ("Andreas Naramer Dachdeckerei", "Naramar, Andi Dachdeckerei"), ("SelvicLaboratories NV", "selvik laboratories n.v."),
        ("Solmofels Maschinen-Bau", "Solmofels Maschinenbau KG"), ("Zelmark Cast APS", "Zelmark Castings"), ("Malerbetrieb Calltal, Inh. Theo Calltal", "Theodor Caltal Malerbetrieb"),
        ("Cormiletin P. Limited Liability Co.", "Cormiletin Precision Tools LLC"), ("Landen E. s.r.o.", "Landen Engineering s.r.o."), ("Gelpa Precision Tls", "Gelpa Precision Tools Sp. z o.o."),
    ]
    other = [("Rallavik Großhandel AG", "Rallavik Anlagenbau e.K."), ("Telbeck Bearings AB", "Harkabach Laboratories AB"), ("Brunvator Components Ltd", "Brunvator B. S.A."), ("", "x")]
    assert all(fit(a, b) and fit(b, a) for a, b in same) and not any(fit(a, b) for a, b in other)


def test_name_variants_and_large_shards(spark, monkeypatch):
    rows = [
        vendor("A", "Zortor Labortechnik GmbH", tax="DE111222333"), vendor("B", "Zortro Labortechnik", tax="111222333"), vendor("C", "Zortor Labortechnik GmbH", tax="DE111222333"),
        vendor("D", "Labortechnik Zortor", phone="+49 555 1234567"), vendor("E", "Zortor L. GmbH", tax="DE-111-222333", phone="0049 555 1234567"), vendor("F", "Other Desk AG", phone="+49 555 1234567"),
        vendor("G", "Zortor Labortechnik GmbH"), vendor("H", None, tax="DE111222333"), vendor("A", "Zortor Labortechnik GmbH", tax="DE111222333"),
    ]
    expected = {("A", "B"), ("B", "C"), ("A", "D"), ("B", "D"), ("C", "D"), ("A", "E"), ("B", "E"), ("C", "E"), ("D", "E")}
    frame = spark.createDataFrame(rows, VENDOR)
    for large in (200, 1):
        monkeypatch.setattr(variants, "LARGE_SHARD", large)
        assert {tuple(r) for r in variants.name_variants(frame).collect()} == expected
    assert variants.name_variants(frame.limit(0)).count() == 0


def test_large_shards_give_what_small_ones_give(spark, monkeypatch):
    pairs = [("Hans Meier", "HANSMEIER"), ("Maschinenbau", "Mxschixenbxu"), ("Talsen", "Tlaesn"), ("Quorvin", "Quorvni"), ("Abcd Zelmark", "Zelmark Xbcd"), ("Kolm", "Kol")]
    rows = [vendor(f"{k}{side}", name, phone=f"+49 555 {9_135_702 + 13 * k}") for k, pair in enumerate(pairs) for side, name in zip("AB", pair, strict=True)]
    found = []
    for large in (200, 1):
        monkeypatch.setattr(variants, "LARGE_SHARD", large)
        found.append({tuple(r) for r in variants.name_variants(spark.createDataFrame(rows, VENDOR)).collect()})
    assert found[0] == found[1] >= {(f"{k}A", f"{k}B") for k in range(5)}


def test_words_within_reach_meet_under_a_key():
    draw = random.Random(6)
    for _ in range(3000):
        word = "".join(draw.choice("abcde") for _ in range(draw.randrange(4, 18)))
        other = word
        for _ in range(variants.most_edits(len(word))):
            at = draw.randrange(len(other) - 1)
            other = draw.choice([other[:at] + other[at + 1 :], other[:at] + "z" + other[at:], other[:at] + "z" + other[at + 1 :], other[:at] + other[at + 1] + other[at] + other[at + 2 :]])
        if edits.edits(word, other, 3) <= variants.most_edits(len(word)):
            assert variants.probe_keys(word) & variants.index_keys(other), (word, other)


def test_missing_dates_at_one_postal_code(spark):
    rows = [
        vendor("A", "Quorvin Labortechnik GmbH", postal="53111", created="20200101"), vendor("B", "Labortechnik Quorvni", postal="53111", created=None),
        vendor("C", "Quorvin L. GmbH", postal="53111", created="unknown"), vendor("D", "Zelmark Tools", postal="53112", created="20200101"), vendor("E", "Tools Zelmark", postal="53112", created="20220101"),
    ]
    assert {tuple(r) for r in variants.name_variants(spark.createDataFrame(rows, VENDOR)).collect()} == {("A", "B")}


def test_names_of_short_words(spark, monkeypatch):
    pairs = [("SAP AG", "SAP SE"), ("Kai Ott", "Ott, Kai"), ("Li Fang", "Lifang")]
    rows = [vendor(f"{k}{side}", name, tax=f"DE{135_702_468 + k}") for k, pair in enumerate(pairs) for side, name in zip("AB", pair, strict=True)]
    rows += [vendor("XA", "Kai Ott", tax="DE246813579"), vendor("XB", "Kai Utz", tax="DE246813579")]
    for large in (200, 1):
        monkeypatch.setattr(variants, "LARGE_SHARD", large)
        assert {tuple(r) for r in variants.name_variants(spark.createDataFrame(rows, VENDOR)).collect()} == {(f"{k}A", f"{k}B") for k in range(3)}


def test_same_names_count_once_and_still_link(spark, monkeypatch):
    rows = [vendor(f"A{k:03d}", "Quorvin Labortechnik", phone="+49 555 9135702") for k in range(300)]
    rows += [vendor("B", "Quorvni Labortechnik", tax="DE135792468"), vendor("A007", "Quorvin Labortechnik", phone="+49 555 9135702", tax="DE135792468")]
    for most in (1_000, 50):
        monkeypatch.setattr(variants, "MEMBERS_AT_ONCE", most)
        found = {tuple(r) for r in variants.name_variants(spark.createDataFrame(rows, VENDOR)).collect()}
        assert found == {(f"A{k:03d}", "B") for k in range(300)}
    assert variants.direct_links(spark.createDataFrame(rows[:300], VENDOR).selectExpr("legacy_vendor_id as id", "vendor_name as name", *VENDOR_REST)).count() == 299


def test_automaton_equals_edits():
    draw = random.Random(1)
    words = {"".join(draw.choice("abcd") for _ in range(draw.randrange(0, 9))) for _ in range(200)}
    tree = edits.Trie(words)
    for most in range(4):
        for probe in sorted(words)[:60]:
            assert sorted(tree.near(probe, most)) == sorted(w for w in words if edits.edits(w, probe, most) <= most)
