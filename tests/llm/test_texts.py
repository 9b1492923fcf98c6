import random

from keelson.llm import leaks, mixture, reading, tokens
from pyspark.sql import functions as F

ITEM = "The dispatch planner keeps seven ledgers of glazed tiles for the harbour guild while every batch diary waits in a locked drawer until the first frost arrives in late autumn"


def test_leaks(spark):
    words = ITEM.split()
    changed = words[:28]
    changed[12] = "various"
    docs = [
        (1, "before " + ITEM + " after"), (2, "x\n> " + " ".join(words[:13]).upper() + "-\n> " + " ".join(words[13:26])),
        (3, " ".join(words[4:12])), (4, None), (5, ""), (6, "**" + "** _".join(changed) + "_"), (7, "nothing here " * 5000 + ITEM), (8, "Antworten Sie in ganzen Sätzen."),
    ]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(10, ITEM), (11, None), (12, "")], "item_id bigint, item_text string")
    got = {r["doc_id"]: r for r in leaks.leaked_items(frame, items).collect()}
    assert sorted(got) == [1, 2, 6, 7] and all(r["item_id"] == 10 for r in got.values())
    assert docs[0][1][got[1]["first_char"] : got[1]["last_char"] + 1] == ITEM
    assert leaks.leaked_items(frame, items.limit(0)).count() == 0 and leaks.leaked_items(frame.limit(0), items).count() == 0


def test_leaks_of_repeated_items_and_shared_runs(spark, monkeypatch):
    letters = "bcdfghjklmnpqrstvwxz"
    own = lambda i, k: letters[i % 20] + "a" + letters[i // 20] + "e" + letters[k]
    phrase = "please answer the following question in full and well formed sentences and give reasons for every step you take in it"
    common = " ".join(ITEM.split()[:24])
    texts = {i: " ".join(own(i, k) for k in range(20)) for i in range(80)}
    texts |= {i: f"{phrase} {texts[i]}" for i in range(20)} | {i: f"{texts[i]} {common}" for i in range(20, 23)}
    texts |= {100: ITEM + " every year", 101: ITEM.upper() + " every year!", 102: "**" + ITEM + "** every year"}
    docs = [(1, f"x {ITEM} every year y"), (2, phrase), (3, common), (4, texts[3])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame(list(texts.items()), "item_id bigint, item_text string")
    expected = {(1, i) for i in (100, 101, 102, 20, 21, 22)} | {(3, i) for i in (100, 101, 102, 20, 21, 22)} | {(4, 3)}
    for size in (20_000, 30):
        monkeypatch.setattr(leaks, "ITEMS_PER_PASS", size)
        assert {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(frame, items).collect()} == expected
    # Words of a set phrase count behind others of the item.
    monkeypatch.setattr(leaks, "FEW_HOLDERS", 1)
    monkeypatch.setattr(leaks, "SET_PHRASE_SHARE", 0.0)
    pair = spark.createDataFrame([(1, f"{texts[30][:47]} {phrase}"), (2, f"{texts[31][:47]} {phrase}")], "item_id bigint, item_text string")
    found = leaks.leaked_items(spark.createDataFrame([(1, f"{texts[30][:47]} {phrase}"), (2, phrase)], "doc_id bigint, text string"), pair)
    assert [(r["doc_id"], r["item_id"], r["words"]) for r in found.collect()] == [(1, 1, 8 + len(phrase.split()))]


def test_markup_of_any_length_is_no_text(spark):
    words = ITEM.split()
    address = "https://example.test/" + "path-of-a-page/" * 20
    tagged = " ".join(f'<a href="{address}" title=\'x y\'>{w}</a>' for w in words)
    linked = " ".join(f"[{w}]({address})" for w in words)
    frame = spark.createDataFrame([(1, tagged), (2, linked), (3, "a <b " * 20_000), (4, '<a href="' * 20_000)], "doc_id bigint, text string")
    items = spark.createDataFrame([(10, ITEM)], "item_id bigint, item_text string")
    assert sorted(r["doc_id"] for r in leaks.leaked_items(frame, items).collect()) == [1, 2]


def test_reduced_offsets():
    text = "Ä<b>b</b> ﬁ-\nx"
    assert leaks.reduced(text) == "abfix" and len(leaks.reduced_offsets(text)) == 5


def test_token_counts(spark):
    frame = spark.createDataFrame([("hello world",), ("",), (None,), ("word " * 60_000,)], "t string")
    assert [r[0] for r in frame.select(tokens.token_count(F.col("t"))).collect()] == [2, 0, 0, 60_001]


def test_mixture_shares_and_caps(spark):
    draw = random.Random(1)
    docs = [(i, draw.choice(["big"] * 9 + ["small"]), "word " * draw.randrange(5, 60), "x") for i in range(3000)]
    docs += [(9001, None, "a b", "x"), (9002, "big", None, "x"), (9003, "big", "", "x"), (9004, "other", "a", "x")]
    frame = spark.createDataFrame(docs, "doc_id bigint, source string, text string, tokens string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 4), ("absent", 0.2, 2)], "source string, target_share double, max_repeats int")
    mixed = mixture.mix(frame, targets).cache()
    report = {r["source"]: r for r in mixture.mixture_report(mixed, targets).collect()}
    assert abs(report["big"]["actual_share"] - 0.625) < 0.01 and abs(report["small"]["actual_share"] - 0.375) < 0.01
    assert report["absent"]["actual_share"] == 0 and report["small"]["most_repeats"] <= 4 and report["big"]["most_repeats"] == 1
    assert [r[0] for r in mixed.select("position_key").collect()] == sorted(r[0] for r in mixed.select("position_key").collect())
    assert mixture.mix(frame.limit(0), targets).count() == 0


def test_small_sources_come_as_close_as_their_documents_allow(spark):
    draw = random.Random(9)
    docs = [(i, "big", "word " * draw.randrange(20, 40)) for i in range(400)] + [(1000 + i, "few", "word " * draw.randrange(20, 40)) for i in range(12)]
    frame = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("big", 0.96, 2), ("few", 0.04, 9)], "source string, target_share double, max_repeats int")
    report = {r["source"]: r for r in mixture.mixture_report(mixture.mix(frame, targets, total_tokens=15_000), targets).collect()}
    total = sum(r["tokens"] for r in report.values())
    assert abs(report["few"]["tokens"] - 0.04 * total) <= 40 and abs(report["big"]["tokens"] - 0.96 * 15_000) <= 80


EASY, PLAIN, HARD = "The box is red. We need it now. ", "The finance lead wants a second check of the postal code before the next load starts. ", (
    "Notwithstanding the comprehensive harmonisation of jurisdictional obligations previously acknowledged by the continuity oversight council, "
    "the rationalisation presupposes an irreconcilable apportionment whose longitudinal implications transcend conventional interpretation. "
)


def test_reading_levels(spark):
    draw = random.Random(4)
    docs, labels = [], []
    for i in range(90):
        docs.append((i, (EASY, PLAIN, HARD)[i % 3] * draw.randrange(3, 8) + f"Ref{i}."))
        if i < 45:
            labels.append((i, draw.choice([1, 2, 3]) if i % 9 == 0 else i % 3 + 1, "r"))
    docs += [(900, "too short"), (901, None), (902, ""), (903, HARD * 400)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("reading_level", F.lit(9))
    rated = spark.createDataFrame([*labels, (None, 1, "r"), (5, None, "r"), (777, 3, "r")], "doc_id bigint, reading_level int, rater string")
    got = {r["doc_id"]: r["reading_level"] for r in reading.reading_levels(frame, rated).collect()}
    assert all(got[i] == i % 3 + 1 for i in range(90)) and got[903] == 3 and not {900, 901, 902} & set(got)
    assert reading.reading_levels(frame, rated.limit(0)).count() == 0
    assert reading.reading_levels(frame.limit(0), rated).count() == 0


def test_coverage_does_not_depend_on_the_head(spark):
    draw = random.Random(4)
    words = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(60)] + ["long" * 20]
    docs = [(i, " ".join(draw.choice(words[: 1 + draw.randrange(61)]) for _ in range(40))) for i in range(50)] + [(99, "long" * 20 + " " + ("long" * 20 + " ") * 20)]
    features = reading.document_features(spark.createDataFrame(docs, "doc_id bigint, text string")).cache()
    whole = {r["doc_id"]: r["coverage"] for r in reading.coverage_ranks(features).collect()}
    assert len(whole) == 51
    for head in (0, 1, 7):
        assert {r["doc_id"]: r["coverage"] for r in reading.coverage_ranks(features, head_words=head).collect()} == whole
