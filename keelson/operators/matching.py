"""Matching source columns to the fields of a contract: signals, blends, evidence of values, and what to suggest.

Sources and targets are lists of columns, so their product is small whatever the tables hold; the profiles of the
sources come from whole tables. Every signal is an expression of the pair, but the likeness of names by longest common
subsequence, which is computed in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.similarity import cosine, token_sort_ratio
from keelson.functions.text import confidence_band, is_missing, normalize_text, split_identifier
from keelson.operators.mapping import ALIAS_FLOOR, GATE_FLOOR, MOST_FIELDS, NO_MATCH, PATTERN_BONUS, WEIGHTS, hashed_vector
from keelson.operators.rank import top_per_group

# Words of field names and what they stand for.
SYNONYMS = {
    "client": "customer", "vendor": "supplier", "telephone": "phone", "vat": "tax", "nation": "country", "terms": "payment terms",
    "condition": "payment terms", "recon": "reconciliation", "gl": "general ledger", "legal": "company", "entity": "company",
    "iban": "bank account", "currency": "currency code", "partner": "category",
}
# Words put in place of others by the older scorer.
REPLACEMENTS = {
    "vendor": "vendor supplier business partner organization", "supplier": "supplier vendor business partner organization",
    "legacy": "old external", "tax": "tax vat", "zip": "postal",
}
# Forms of values by the meaning of the target, with the strength of the evidence.
VALUE_FORMS = {
    "iban_shape": ("iban", r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\z", 1.0),
    "bic_shape": ("bic", r"^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?\z", 1.0),
    "uppercase_alpha_code_3": ("currency_code", r"^[A-Z]{3}\z", 0.85),
    "uppercase_alpha_code_2": ("country_code", r"^[A-Z]{2}\z", 0.85),
}
OTHER_STRENGTHS = {"contract_enum_match": 1.0, "contract_regex_match": 1.0, "date_type": 0.8, "boolean_type": 0.8}
LEAST_SUPPORT, SAMPLES = 0.8, 5
#: Of 100, from which likeness on a name counts as an alias.
ALIAS_RATIO = 96
#: The older scorer: weights of name signals, what is taken off for fields that the target computes.
OLD_WEIGHTS = {"semantic": 0.55, "fuzzy": 0.20}
COMPUTED_PENALTY = 0.85
DATES = ("date", "datetime")
MARGIN_DIGITS = 4


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def expanded(c: Column) -> Column:
    """The words of a name, each followed by what it stands for."""
    words = F.filter(F.split(normalize_text(c), " "), lambda w: w != "")
    table = _table(SYNONYMS)
    return F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(F.split(table[w], " "), F.array().cast("array<string>")))))


def replaced(c: Column) -> Column:
    """A split name with words replaced, as text."""
    table = _table(REPLACEMENTS)
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.coalesce(table[w], w)), " ")


def lexical_overlap(a: Column, b: Column) -> Column:
    """The shared part of two word lists; 0 if one is empty."""
    common, both = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / both).otherwise(F.lit(0.0))


def source_profiles(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(source, position, present, distinct_ratio, longest, samples): the profile of each column as matching needs it;
    samples are the first ``SAMPLES`` different values by ``order``, a column that tells all rows apart."""
    long = rows.select(F.col(order).alias("_at"), *(F.trim(F.col(c).cast("string")).alias(c) for c in columns)).unpivot(["_at"], columns, "source", "value")
    values = long.where(~is_missing(F.col("value"))).groupBy("source", "value").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    figures = values.groupBy("source").agg(
        F.sum("n").alias("present"), (F.count(F.lit(1)) / F.sum("n")).alias("distinct_ratio"), F.max(F.length("value")).alias("longest")
    )
    first = top_per_group(values.select("source", "value", "_first"), ["source"], [F.col("_first")], SAMPLES)
    samples = first.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("samples"))
    listed = rows.sparkSession.createDataFrame(list(enumerate(columns)), "position int, source string")
    none = F.array().cast("array<string>")
    return listed.join(figures, "source", "left").join(samples, "source", "left").select(
        "source", "position", F.coalesce("present", F.lit(0)).alias("present"), F.coalesce("distinct_ratio", F.lit(0.0)).alias("distinct_ratio"),
        F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce("samples", none).alias("samples"),
    )


def gate(kind: Column, target_kind: Column, semantic: Column, distinct_ratio: Column, longest: Column) -> tuple[Column, Column]:
    """How far types let a pair pass, and the warnings; the rules apply in order and may undo each other."""
    text = F.coalesce(semantic, F.lit(""))
    dated = kind.isin(*DATES) & ~target_kind.isin(*DATES)
    flagged = (kind == "boolean") & (text != "category_code")
    numeric = kind.isin("integer", "number") & text.isin("organization_name", "email", "phone")
    strong = (text == "identifier") & (distinct_ratio >= 0.9) & (longest <= 24)
    weak = (text == "identifier") & (distinct_ratio < 0.5) & (longest > 40)
    value = F.when(dated, 0.82).otherwise(F.lit(1.0))
    value = F.when(flagged | numeric, F.least(value, F.lit(GATE_FLOOR))).otherwise(value)
    value = F.when(strong, F.greatest(value, F.lit(1.0))).otherwise(value)
    value = F.when(weak, F.least(value, F.lit(0.75))).otherwise(value)
    warnings = [
        F.when(dated, "weak_date_to_text_compatibility"), F.when(flagged, "boolean_source_for_text_target"),
        F.when(numeric, "numeric_source_for_textual_target"), F.when(weak, "low_distinct_long_text_for_identifier"),
    ]
    return value, F.array_compact(F.array(*warnings))


def value_evidence(kind: Column, samples: Column, target_kind: Column, semantic: Column, enum_values: Column, pattern: Column) -> Column:
    """A struct (score, support, evidence): what the samples of a source say about a target. A form counts if at least
    ``LEAST_SUPPORT`` of the samples have it; types are evidence without support."""
    present = F.filter(samples, lambda v: ~is_missing(v))
    share = lambda test: F.when(F.size(present) > 0, F.round(F.size(F.filter(present, test)) / F.size(present), 4))
    found = {
        "contract_enum_match": F.when(F.size(enum_values) > 0, share(lambda v: F.array_contains(enum_values, v))),
        "contract_regex_match": F.when(pattern.isNotNull(), share(lambda v: F.regexp_like(v, F.concat(F.lit("^(?:"), pattern, F.lit(r")\z"))))),
    }
    # A function of its own for each form, since a second parameter would be the place in the array.
    of_form = lambda form: lambda v: v.rlike(form)
    for name, (meaning, form, _) in VALUE_FORMS.items():
        found[name] = F.when(semantic == meaning, share(of_form(form)))
    strengths = OTHER_STRENGTHS | {name: strength for name, (_, _, strength) in VALUE_FORMS.items()}
    entry = lambda name, holds, support: F.when(holds, F.struct(F.lit(name).alias("name"), F.lit(strengths[name]).alias("strength"), support.alias("support")))
    entries = [entry(name, support >= LEAST_SUPPORT, support) for name, support in found.items()]
    none = F.lit(None).cast("double")
    entries += [entry("date_type", kind.isin(*DATES) & target_kind.isin(*DATES), none), entry("boolean_type", (kind == "boolean") & (target_kind == "boolean"), none)]
    held = F.array_compact(F.array(*entries))
    return F.struct(
        F.coalesce(F.array_max(F.transform(held, lambda e: e["strength"])), F.lit(0.0)).alias("score"),
        F.when(F.size(held) == 0, 0.0).otherwise(F.array_max(F.transform(held, lambda e: e["support"]))).alias("support"),
        F.array_sort(F.transform(held, lambda e: e["name"])).alias("evidence"),
    )


def candidates(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """All pairs with their signals and scores.

    ``sources``: (source, kind, distinct_ratio, longest, samples); ``targets`` as of
    :func:`keelson.operators.contracts.contract_fields`. Columns: source, target, resource, semantic, fuzzy, lexical,
    alias, gate, warnings, support, evidence, base (names and types) and score (with the evidence of values).
    """
    if targets.count() > MOST_FIELDS:
        raise ValueError("too many target fields for one pass")
    joined = lambda words: F.array_join(words, " ")
    left = sources.withColumn("sw", expanded(F.col("source"))).withColumn("sn", normalize_text(F.col("source")))
    about = F.concat_ws(" ", "name", "description", "semantic_type")
    texts = F.transform(F.array("name", "target", "semantic_type", "description"), lambda c: joined(expanded(F.coalesce(c, F.lit("")))))
    right = targets.select(
        "target", "resource", F.col("kind").alias("target_kind"), "semantic_type", "enum_values", "pattern", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        expanded(about).alias("tw"), texts.alias("texts"),
    )
    pairs = left.withColumn("sv", hashed_vector(joined(F.col("sw")))).crossJoin(F.broadcast(right.withColumn("tv", hashed_vector(joined(F.col("tw"))))))
    names = F.transform("aliases", normalize_text)
    # Each of the four texts and each alias is one comparison of names.
    likeness = F.greatest(*(token_sort_ratio(joined(F.col("sw")), F.element_at("texts", i)) for i in range(1, 5)))
    close = pairs.select("source", "target", "sn", F.explode(names).alias("alias")).withColumn("ratio", token_sort_ratio(F.col("sn"), F.col("alias")))
    close = close.groupBy("source", "target").agg(F.max(F.when(F.col("sn") == F.col("alias"), 100.0).otherwise(F.col("ratio"))).alias("ratio"))
    allowed, warnings = gate(F.col("kind"), F.col("target_kind"), F.col("semantic_type"), F.col("distinct_ratio"), F.col("longest"))
    seen = value_evidence(F.col("kind"), F.col("samples"), F.col("target_kind"), F.col("semantic_type"), F.col("enum_values"), F.col("pattern"))
    signals = pairs.join(close, ["source", "target"], "left").select(
        "source", "target", "resource", cosine(F.col("sv"), F.col("tv")).alias("semantic"), (likeness / 100).alias("fuzzy"), lexical_overlap(F.col("sw"), F.col("tw")).alias("lexical"),
        F.coalesce(F.col("ratio") >= ALIAS_RATIO, F.lit(False)).alias("alias"), allowed.alias("gate"), warnings.alias("warnings"), seen.alias("seen"),
    )
    blend = sum(F.col(name) * weight for name, weight in WEIGHTS.items())
    blend = F.when(F.col("alias"), F.greatest(blend, F.lit(ALIAS_FLOOR))).otherwise(blend)
    within = lambda c: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 4)
    signals = signals.withColumn("_blend", blend)
    raised = F.col("_blend") + PATTERN_BONUS * F.col("seen.score") * (1 - F.col("_blend"))
    return signals.select(
        "source", "target", "resource", "semantic", "fuzzy", "lexical", "alias", "gate", "warnings", "seen.support", "seen.evidence",
        within(F.col("_blend") * F.col("gate")).alias("base"), within(raised * F.col("gate")).alias("score"),
    )


def basis() -> Column:
    """What a suggestion rests on."""
    return (
        F.when(F.col("alias"), "alias").when((F.col("semantic") >= 0.68) & (F.col("fuzzy") < 0.65), "semantic")
        .when((F.col("fuzzy") >= 0.72) & (F.col("semantic") < 0.68), "fuzzy").when(F.col("score") < NO_MATCH, "none").otherwise("mixed")
    )


def status() -> tuple[Column, Column, Column]:
    """Status, band and reasons of a best candidate."""
    unanchored = ~F.col("alias") & (F.col("lexical") == 0)
    false_friend = (F.col("score") >= 0.45) & unanchored & (F.col("gate") <= GATE_FLOOR)
    low = (F.col("score") < NO_MATCH) | (~false_friend & (F.col("score") < 0.45))
    name = F.when(low, "no_confident_target").when(false_friend, "possible_false_friend").when(F.col("score") >= 0.70, "suggested").otherwise("needs_review")
    band = F.when(name == "no_confident_target", "low").when(name == "suggested", "high").otherwise("medium")
    few = F.array_distinct(F.concat(F.array_compact(F.array(F.lit("medium_confidence"), F.when(unanchored, "no_lexical_anchor"))), F.col("warnings")))
    reasons = (
        F.when(low, F.array(F.lit("best_score_below_threshold"))).when(false_friend, F.array(F.lit("no_lexical_anchor"), F.lit("type_gate_warning")))
        .when(name == "suggested", F.array().cast("array<string>")).otherwise(few)
    )
    return name, band, reasons


def suggestions(ranked: DataFrame) -> DataFrame:
    """One row per source from candidates with ``rank``: the best target with basis, status, band, reasons and margin to
    the second, and the targets in order."""
    name, band, reasons = status()
    best = ranked.where("rank = 1").select("source", F.col("target").alias("best"), "score", basis().alias("basis"), name.alias("status"), band.alias("band"), reasons.alias("reasons"))
    rest = ranked.groupBy("source").agg(
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("_second"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "target"))), lambda x: x["target"]).alias("targets")
    )
    return best.join(rest, "source").withColumn("margin", F.round(F.col("score") - F.col("_second"), MARGIN_DIGITS)).drop("_second")


def ranked(scored: DataFrame, most: int = 3) -> DataFrame:
    return top_per_group(scored, ["source"], [F.desc("score"), F.col("target")], most)


# The older scorer, for targets without contracts.


def letters_only(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def alias_index(listings: list[DataFrame]) -> DataFrame:
    """(token, target, origin) from several listings (alias, target, origin): names by their letters alone."""
    out = listings[0].select("alias", "target", "origin")
    for more in listings[1:]:
        out = out.unionByName(more.select("alias", "target", "origin"))
    return out.select(letters_only(F.col("alias")).alias("token"), "target", "origin").where("token <> ''").distinct()


def type_fit(kind: Column, longest: Column, free_text: Column, target_type: Column, max_length: Column, target_free_text: Column) -> tuple[Column, Column]:
    """How well a source fits a target by type (half), length (three tenths) and being free text (a fifth), and whether
    values would be cut."""
    by_type = (
        F.when(target_type == "string", F.when(kind == "string", 1.0).otherwise(0.6)).when(target_type == "date", F.when(kind == "date", 1.0).otherwise(0.15)).otherwise(0.10)
    )
    cut = F.coalesce(longest > max_length, F.lit(False))
    score = 0.5 * by_type + 0.3 * F.when(cut, 0.3).otherwise(1.0) + 0.2 * F.when(free_text == target_free_text, 1.0).otherwise(0.5)
    return score, cut


def old_score(semantic: Column, fuzzy: Column, fit: Column, alias: Column, computed: Column) -> Column:
    """Names weighted among themselves, passed through a gate by the fit of types; an alias has a floor, a field that the
    target computes a penalty."""
    names = (semantic * OLD_WEIGHTS["semantic"] + fuzzy * OLD_WEIGHTS["fuzzy"]) / sum(OLD_WEIGHTS.values())
    passed = names * (GATE_FLOOR + (1 - GATE_FLOOR) * fit)
    floored = F.when(alias, F.greatest(passed, F.lit(ALIAS_FLOOR))).otherwise(passed)
    return F.when(computed, floored * COMPUTED_PENALTY).otherwise(floored)


def old_suggestions(pairs: DataFrame, most: int = 3) -> DataFrame:
    """(source, rank, target, score, band, status) from pairs (source, target, semantic, fuzzy, fit, alias, computed).

    Of targets with the same field name (after the last dot) only the best is kept. Any candidate without a shared word
    and alias may be a false friend, however it scores above the lowest bar."""
    score = F.round(old_score(*(F.col(c) for c in ("semantic", "fuzzy", "fit", "alias", "computed"))), 4)
    name = F.substring_index("target", ".", -1)
    shared = F.size(F.array_intersect(F.split(split_identifier(F.col("source")), " "), F.split(split_identifier(name), " "))) > 0
    scored = pairs.withColumn("score", score).withColumn("_name", name).withColumn("_shared", shared)
    one_each = top_per_group(scored, ["source", "_name"], [F.desc("score"), F.col("target")], 1).drop("rank")
    best = top_per_group(one_each, ["source"], [F.desc("score"), F.col("target")], most)
    status = (
        F.when(F.col("score") < NO_MATCH, "no_confident_target").when(~F.col("alias") & ~F.col("_shared"), "possible_false_friend")
        .when(F.col("score") < 0.70, "needs_review").otherwise("suggested")
    )
    return best.select("source", "rank", "target", "score", confidence_band(F.col("score")).alias("band"), status.alias("status"))


def free_text(distinct_ratio: Column, average_length: Column, known: Column) -> Column:
    """Whether a column is free text: known to be, or many different and long values."""
    return F.coalesce(known, F.lit(False)) | ((distinct_ratio > 0.50) & (average_length > 15.0))


def benchmark(cases: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """Scores of suggestions against expected targets, for each value of ``by`` and over all (NULL).

    ``cases``: (case_id, by, expected array, recommended), an empty array where no target is right and a NULL
    recommendation where none was given; ``found``: (case_id, target, rank) of the candidates. Figures without cases
    are NULL: top1 (single target), recall_at_1, recall_at_3 and mrr (of expected links), no_target, full_coverage.
    """
    links = cases.select("case_id", F.explode("expected").alias("target")).join(found.where("rank <= 3"), ["case_id", "target"], "left")
    per = links.groupBy("case_id").agg(
        F.sum((F.col("rank") == 1).cast("int")).alias("at1"), F.count("rank").alias("at3"), F.sum(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("points")
    )
    n = F.size("expected")
    each = cases.join(per, "case_id", "left").select(
        by, n.alias("links"), F.coalesce("at1", F.lit(0)).alias("at1"), F.coalesce("at3", F.lit(0)).alias("at3"), F.coalesce("points", F.lit(0.0)).alias("points"),
        (n == 1).alias("single"), (n > 1).alias("multi"), (n == 0).alias("none"), F.col("recommended").isNull().alias("silent"),
    )
    count = lambda c: F.sum(c.cast("int"))
    share = lambda part, whole: F.round(F.when(whole > 0, part / whole), 4)
    single, multi, none = F.col("single"), F.col("multi"), F.col("none")
    return each.rollup(by).agg(
        F.count(F.lit(1)).alias("cases"), F.sum("links").alias("links"),
        share(count(single & (F.col("at1") == 1)), count(single)).alias("top1"), share(F.sum("at1"), F.sum("links")).alias("recall_at_1"),
        share(F.sum("at3"), F.sum("links")).alias("recall_at_3"), share(F.sum("points"), F.sum("links")).alias("mrr"),
        share(count(none & F.col("silent")), count(none)).alias("no_target"), share(count(multi & (F.col("at3") == F.col("links"))), count(multi)).alias("full_coverage"),
    )


def case_verdicts(cases: DataFrame, found: DataFrame) -> DataFrame:
    """(case_id, verdict): how each case of :func:`benchmark` came out."""
    links = cases.select("case_id", F.explode("expected").alias("target")).join(found.where("rank <= 3"), ["case_id", "target"], "left")
    per = links.groupBy("case_id").agg(F.count("rank").alias("hits"), F.min("rank").alias("best"))
    n = F.size("expected")
    verdict = (
        F.when(n == 0, F.when(F.col("recommended").isNull(), "correct_no_target").otherwise("false_positive_for_no_target"))
        .when((n > 1) & (F.col("hits") == n), "multi_target_fully_covered").when((n > 1) & (F.col("hits") > 0), "multi_target_partially_covered").when(n > 1, "multi_target_missing")
        .when(F.col("best") == 1, "correct_top1").when(F.col("best") <= 3, "correct_but_ranked_2_or_3").otherwise("expected_target_missing_from_top3")
    )
    return cases.join(per, "case_id", "left").select("case_id", verdict.alias("verdict"))
