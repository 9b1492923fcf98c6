"""Reading level of each document from the vocabulary it needs and the build of its sentences.

All statistics cover all documents: words are counted per language, each word gets its frequency rank, and the
coverage rank of a document is the size of the smallest frequency-ranked vocabulary that covers a fixed share of its
tokens. The most frequent words, a number fixed by a parameter, are broadcast to the documents, which settles every
document whose share they cover without a shuffle of its words; the others are joined with all words. Together with sentence and word length it is calibrated against rated documents by aggregates alone: features
are centred and scaled per language over all documents, the rated ones give a median point for each level and a
median spread, and each document gets the level of the nearest point. Medians keep single wrong ratings without
effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.skew import join_by_value
from keelson.storage import durable

COVERED_SHARE = 0.5
LEAST_WORDS = 12
#: Words per language, and letters of a word, in the broadcast head of the ranks.
HEAD_WORDS, HEAD_LETTERS = 20_000, 40
FEATURES = ["coverage", "sentence", "word"]
# Frequent function words that tell the two languages apart.
GERMAN = ["der", "die", "das", "und", "nicht", "ist", "wir", "den", "mit", "von", "auf", "aus", "des", "eine", "werden", "bitte", "sind"]
ENGLISH = ["the", "and", "of", "to", "is", "that", "we", "for", "it", "in", "was", "be", "from", "not"]


def _unwrapped(text: Column) -> Column:
    """The text without hyphenation at line ends and without quote marks, list marks and time stamps at line starts."""
    # Patterns begin with the character that is sought, so that most places fail at once.
    joined = F.regexp_replace(text, r"-(?<=\p{Ll}-)\r?\n[> ]*(?=\p{Ll})", "")
    return F.regexp_replace(joined, r"(?m)^\s*(?:>|[-*•]|\d+[.)]|\[\d\d:\d\d\])\s*", "")


def document_features(documents: DataFrame) -> DataFrame:
    """(doc_id, language, words, n_words, sentence, word): logarithm of the words per sentence and letters per word."""
    clean = documents.where("text is not null").select("doc_id", _unwrapped(F.col("text")).alias("t"))
    split = clean.select(
        "doc_id",
        F.array_remove(F.split(F.lower("t"), r"\P{L}+"), "").alias("words"),
        F.split("t", r"\s(?:(?<=[.!?;]\s)|(?<=\n)\s*\n|(?<=\n)(?=[A-Z0-9])|/\s)").alias("parts"),
    )
    sentence = F.size(F.filter("parts", lambda p: p.rlike(r"\p{L}+\P{L}+\p{L}+\P{L}+\p{L}+")))
    lean = F.aggregate("words", F.lit(0), lambda n, w: n + F.when(w.isin(GERMAN), 1).when(w.isin(ENGLISH), -1).otherwise(0))
    return split.where(F.size("words") >= LEAST_WORDS).select(
        "doc_id",
        F.when(lean > 0, "de").otherwise("en").alias("language"),
        "words",
        F.size("words").alias("n_words"),
        F.log(F.size("words") / F.greatest(sentence, F.lit(1))).alias("sentence"),
        (F.length(F.array_join("words", "")) / F.size("words")).alias("word"),
    )


def word_ranks(features: DataFrame) -> DataFrame:
    """(language, w, rank, last, n): each word's frequency rank and rows; words of equal frequency share the rank of the
    first of them, ``last`` is that of the last. Words are counted with map-side combination."""
    total = durable(features.select("language", F.explode("words").alias("w")).groupBy("language", "w").agg(F.count(F.lit(1)).alias("n")))
    # Ranks by frequency come from the distinct frequencies, of which there are few (their sum is the corpus size).
    levels = total.groupBy("language", "n").agg(F.count(F.lit(1)).alias("k"))
    so_far = Window.partitionBy("language").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = levels.withColumn("last", F.sum("k").over(so_far)).select("language", "n", (F.col("last") - F.col("k") + 1).alias("rank"), "last")
    return durable(total.join(ranked, ["language", "n"]).select("language", "w", "rank", "last", "n"))


def coverage_ranks(features: DataFrame, share: float = COVERED_SHARE, head_words: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, coverage): logarithm of the rank within which ``share`` of the document's tokens lie.

    ``features`` should be a written table of unique doc_id. The result does not depend on ``head_words``.
    """
    ranks = word_ranks(features)
    head = ranks.where((F.col("last") <= head_words) & (F.length("w") <= HEAD_LETTERS)).select("language", "w", "rank")
    # The words of a document lie together, so its percentile is complete before anything is shuffled.
    words = features.select("doc_id", "language", F.explode("words").alias("w"))
    beyond = F.lit(2.0**60)
    placed = words.join(F.broadcast(head), ["language", "w"], "left").select("doc_id", F.coalesce(F.col("rank").cast("double"), beyond).alias("rank"))
    covered = durable(placed.groupBy("doc_id").agg(F.percentile("rank", F.lit(share)).alias("rank")))
    settled = covered.where(F.col("rank") <= head_words)
    open_docs = covered.where(F.col("rank") > head_words).select("doc_id")
    if not open_docs.isEmpty():
        counts = words.join(open_docs, "doc_id", "left_semi").groupBy("doc_id", "language", "w").agg(F.count(F.lit(1)).alias("tf"))
        exact = join_by_value(counts, ranks.select("language", "w", "rank", "n"), ["language", "w"], "n")
        settled = settled.unionByName(exact.groupBy("doc_id").agg(F.percentile("rank", F.lit(share), F.col("tf")).alias("rank")))
    return settled.select("doc_id", F.log("rank").alias("coverage"))


def reading_features(documents: DataFrame) -> DataFrame:
    """(doc_id, language, coverage, sentence, word), each feature centred and scaled over all documents of its language."""
    features = durable(document_features(documents))
    joined = durable(
        features.select("doc_id", "language", "sentence", "word").join(coverage_ranks(features), "doc_id")
    )
    scale = joined.groupBy("language").agg(
        *(F.percentile_approx(c, 0.5).alias(f"{c}_m") for c in FEATURES), *(F.stddev_pop(c).alias(f"{c}_s") for c in FEATURES)
    )
    safe = lambda c: F.when(F.col(f"{c}_s") > 0, (F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s")).otherwise(F.lit(0.0))
    # One row per language: two.
    return joined.join(F.broadcast(scale), "language").select("doc_id", "language", *(safe(c).alias(c) for c in FEATURES))


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, reading_level) for every document of at least ``LEAST_WORDS`` words.

    ``labels``: (doc_id, reading_level), any number of ratings per document; ratings of unknown documents are without
    effect. Without any usable rating there are no rows. Equal distances go to the lower level. NULL and short texts
    have no row.
    """
    scored = durable(reading_features(documents))
    rated = scored.join(labels.select("doc_id", F.col("reading_level").cast("bigint").alias("reading_level")), "doc_id").where(
        "reading_level is not null"
    )
    points = rated.groupBy("reading_level").agg(*(F.percentile_approx(c, 0.5).alias(f"{c}_p") for c in FEATURES))
    apart = rated.join(F.broadcast(points), "reading_level").agg(
        *(F.percentile_approx(F.abs(F.col(c) - F.col(f"{c}_p")), 0.5).alias(f"{c}_d") for c in FEATURES)
    )
    # One row per level, of which there are three.
    model = points.crossJoin(F.broadcast(apart))
    far = sum(F.pow((F.col(c) - F.col(f"{c}_p")) / F.greatest(F.col(f"{c}_d"), F.lit(1e-6)), F.lit(2)) for c in FEATURES)
    return (
        scored.crossJoin(F.broadcast(model))
        .groupBy("doc_id")
        .agg(F.min_by("reading_level", F.struct(far.alias("far"), "reading_level")).alias("reading_level"))
    )
