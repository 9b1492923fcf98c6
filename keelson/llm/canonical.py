"""Mapping freely typed values to the entries of a reference list.

The values are reduced to distinct ones first. A value is taken as a whole and, where it has separators
(``DE - Germany``, ``(JP) Nihon``), by its parts. Each distinct token of these is repaired against the vocabulary of
the reference names by edit distance; candidates for that come from a join on deletion neighbourhoods (both sides
with up to two letters left out), never from all pairs. The repaired tokens are combined by soft TF-IDF to rank whole
reference names. The letters of the whole part, run together, are a second reading of it: a vector of one token, whose
soft TF-IDF against a name read alike is the likeness of both; it mends spaces typed in the wrong place. The better
reading counts and the best name decides.

Tokens that many names hold (of, the, republic) find no candidates: a name that shares only such tokens of a part
cannot reach the least score, by a bound on its cosine. They count in the score of the candidates that others found.

The reference list may be any; further names of its entries, and names of entries that it does not hold, come as a
table. Names of other entries compete as well, so that a value meaning another entry is reported as ``NONE`` rather
than bent to a listed one. :func:`country_names` makes that table for countries by rule from the locale data of the
JVM (names of all countries in some languages, their codes) and a short list of colloquial and official names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.edits import edit_column
from keelson.llm.survivor import STAND_INS
from keelson.skew import blank_to_null, join_by_value, observed
from keelson.storage import durable

LANGUAGES = ["en", "de", "fr", "es", "it", "pt", "nl", "pl", "sv", "da", "nb", "fi", "cs", "sk", "sl", "hu", "tr"]
OFFICIAL = ["republic of", "federal republic of", "kingdom of", "the", "commonwealth of"]
LEAST_SCORE = 0.7
NONE = "NONE"
# Names and codes in use that the locale data lack.
OTHER_NAMES = {
    "DE": "BRD|GER|Fed Rep of Germany|Bundesrepublik Deutschland|Federal Republic Germany|Allemagne|Alemania|Germania",
    "US": "USA|US of A|U S A|America|United States of America|Vereinigte Staaten von Amerika|Etats Unis d Amerique|EEUU|VSA",
    "JP": "Nippon|Nihon|State of Japan", "GB": "UK|Great Britain|Britain|England|Grossbritannien|Gran Bretana|Grande Bretagne|Scotland|Wales|UKM",
    "FR": "French Republic|Republique francaise", "AT": "Republik Oesterreich|Republic Austria", "AU": "Commonwealth Australia",
    "CH": "SUI|Swiss Confederation|Schweizerische Eidgenossenschaft|Confoederatio Helvetica|Helvetia|Confederation suisse",
    "IT": "Italian Republic|Repubblica Italiana", "ES": "Kingdom Spain|Reino de Espana", "NL": "NED|Holland|Netherland|Koninkrijk der Nederlanden",
    "BE": "Belgie Belgique|Royaume de Belgique", "SE": "Konungariket Sverige", "NO": "Noreg|Kongeriket Norge", "DK": "DEN|Kongeriget Danmark",
    "FI": "Republic Finland|Suomen tasavalta", "PL": "Rzeczpospolita Polska", "CZ": "Czech Republic|Tschechische Republik|Ceska republika|CSR",
    "SK": "Slovak Republic|Slowakische Republik|Slovenska republika", "SI": "Republika Slovenija|SLO", "HU": "Magyar Koztarsasag",
    "IE": "Eire|Republic Ireland|Irish Republic", "PT": "POR|Portuguese Republic|Republica Portuguesa", "TR": "Turkey|Turkiye Cumhuriyeti|Republic Turkey",
    "CN": "PRC|PR China|Peoples Republic of China|VR China|Volksrepublik China|Mainland China|Zhongguo", "IN": "Bharat|Republic India",
    "KR": "Republic of Korea|Korea Republic of|Korea South|ROK|Korea Rep|Daehan Minguk|Hanguk", "KP": "DPRK|Democratic Peoples Republic of Korea|Korea North",
    "BR": "Federative Republic of Brazil|Republica Federativa do Brasil", "MX": "United Mexican States|Estados Unidos Mexicanos",
    "CA": "Dominion of Canada", "ZA": "RSA|Republic South Africa|Suid Afrika|Afrique du Sud", "NG": "Federal Republic Nigeria", "NE": "Republic Niger",
}

_names: list[tuple[str, str]] = []


def country_names(spark: SparkSession) -> DataFrame:
    """(code, name) of all countries: about 250 codes times the languages, whatever the data."""
    if not _names:
        locale = spark._jvm.java.util.Locale
        spoken = [locale(lang) for lang in LANGUAGES]
        for code in locale.getISOCountries():
            place = locale("", code)
            found = {place.getDisplayCountry(lang) for lang in spoken} | {code, place.getISO3Country()}
            english = place.getDisplayCountry(spoken[0])
            found |= {f"{form} {english}" for form in OFFICIAL} | set(OTHER_NAMES.get(code, "").split("|"))
            _names.extend((code, name) for name in sorted(found) if name)
    return spark.createDataFrame(_names, "code string, name string")


def folded(column: Column) -> Column:
    """Lower case, without accents; letters spelled as two (ae for a-umlaut) become one base letter alike."""
    text = F.lower(F.translate(column, "@¡|", "aii"))
    text = F.translate(text, "àáâãäåāăąçćčďđèéêëēěęğìíîïīıłľñńňòóôõöøōőřśšşťùúûüūůűýÿźżžþ", "aaaaaaaaacccddeeeeeeegiiiiiillnnnoooooooorssstuuuuuuuyyzzzt")
    return F.replace(F.replace(F.replace(text, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))


def _words(text: Column) -> Column:
    """Tokens; digits typed for letters are read as letters inside words, single letters with dots are run together."""
    joined = F.regexp_replace(text, r"(?<=\b\p{L})\.\s?(?=\p{L}\b)", "")
    leet = F.translate(joined, "01345", "oleas")
    return F.regexp_extract_all(leet, F.lit(r"(\p{L}+)"), F.lit(1))


def _with_compact(words: Column) -> Column:
    """The tokens and, marked by a blank before it, the letters run together."""
    return F.concat(F.array_distinct(words), F.array(F.concat(F.lit(" "), F.array_join(words, ""))))


def _most_edits(length: Column) -> Column:
    return F.when(length < 4, 0).when(length < 6, 1).otherwise(2)


def _without_one(text: Column) -> Column:
    """All texts made by leaving out one letter."""
    n = F.length(text)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n)))


#: Letters from which on a token is keyed by its two ends instead of as a whole.
LONG, END = 12, 6


def _neighbourhood(token: Column) -> Column:
    """Keys of which two tokens within the allowed edits share one: the token with none, one or two letters left out.

    Of two edits in a long token at most one lies in its first or in its last letters, so its keys are both ends with
    at most one letter left out; their number does not grow with the length.
    """
    n = F.length(token)
    nothing = F.array().cast("array<string>")
    one = F.when((n >= 4) & (n < LONG), _without_one(token)).otherwise(nothing)
    two = F.when((n >= 6) & (n < LONG), F.flatten(F.transform(one, _without_one))).otherwise(nothing)
    ends = F.array(F.substring(token, F.lit(1), F.lit(END)), F.substring(token, n - (END - 1), F.lit(END)))
    marked = F.flatten(F.transform(ends, lambda e, i: F.transform(_without_one(e), lambda k: F.concat(F.when(i == 0, "<").otherwise(">"), k))))
    return F.array_distinct(F.when(n >= LONG + 2, marked).otherwise(F.concat(one, two, F.array(token), F.when(n >= LONG - 2, marked).otherwise(nothing))))


def reference_vocabulary(reference: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Names (name_id, code, listed, norm) and their tokens (name_id, token, weight) of a list (code, name) and of further
    names ``known`` (code, name) of listed and other entries; weights are idf over entries."""
    own = reference.select("code", F.explode(F.array("name", "code")).alias("name"))
    every = own if known is None else own.unionByName(known.select("code", "name"))
    listed = reference.select("code", F.lit(True).alias("listed")).where("code is not null").distinct()
    names = (
        every.where("code is not null and name is not null")
        .select("code", _words(folded(F.col("name"))).alias("words"))
        .where(F.size("words") > 0)
        .select("code", F.array_sort("words").alias("words"), F.array_join("words", "").alias("compact"))
        .groupBy("words", "code").agg(F.min("compact").alias("compact"))
        .join(listed, "code", "left")
        .withColumn("name_id", F.concat_ws(" ", F.col("code"), F.lit("="), F.array_join("words", " ")))
    )
    tokens = names.select("name_id", "code", F.explode(F.concat(F.array_distinct("words"), F.array(F.concat(F.lit(" "), "compact")))).alias("token"))
    entries = names.agg(F.count_distinct("code").alias("entries"))
    idf = tokens.groupBy("token").agg(F.count_distinct("code").alias("df")).crossJoin(F.broadcast(entries)).select(
        "token", F.log(1 + F.col("entries") / F.col("df")).alias("weight")
    )
    tokens = durable(tokens.join(idf, "token").select("name_id", "token", "weight"))
    norms = tokens.where(~F.col("token").startswith(" ")).groupBy("name_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    names = durable(names.join(norms, "name_id").select("name_id", "code", F.coalesce("listed", F.lit(False)).alias("listed"), "norm"))
    return names, tokens


def _repairs(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, word, sim): the vocabulary words within the edits that the shorter of both allows."""
    ours = tokens.select("token", F.explode(_neighbourhood(F.col("token"))).alias("key"))
    theirs = vocabulary.select(F.col("token").alias("word"), F.explode(_neighbourhood(F.col("token"))).alias("key"))
    pairs = ours.join(theirs, "key").select("token", "word").distinct()
    same_kind = F.col("token").startswith(" ") == F.col("word").startswith(" ")
    own, other = F.length(F.trim("token")), F.length(F.trim("word"))
    # A swap is one edit here and two of the built-in distance, which goes first.
    near = pairs.where(same_kind & (F.levenshtein("token", "word", 4) >= 0)).repartition(tokens.sparkSession.sparkContext.defaultParallelism)
    counted = near.withColumn("edits", edit_column(F.col("token"), F.col("word"), 2))
    return counted.where(F.col("edits") <= _most_edits(F.least(own, other))).select(
        "token", "word", (1 - F.col("edits") / F.greatest(own, other)).alias("sim")
    )


def _telling(own: DataFrame) -> DataFrame:
    """(part, token) of the tokens that find candidates. ``own``: (part, token, weight, most), ``most`` being the largest
    weight of a word that the token may stand for.

    The score of a name that shares only some n tokens of a part is at most the root of n * sum of most ** 2 over the
    sum of the other tokens' weight ** 2, so the lightest tokens are left out while that stays below the least score.
    Parts are short, so their tokens fit into an array."""
    light = F.array_sort(F.collect_list(F.struct("most", "token", "weight")))
    part = own.groupBy("part").agg(light.alias("tokens"), F.sum(F.col("weight") ** 2).alias("whole"))
    first = lambda i: F.slice("tokens", F.lit(1), i + 1)
    squares = lambda i, c: F.aggregate(first(i), F.lit(0.0), lambda s, t: s + t[c] ** 2)
    below = F.transform("tokens", lambda _, i: (i + 1) * squares(i, "most") < LEAST_SCORE**2 * 0.999 * (F.col("whole") - squares(i, "weight")))
    # The bound only grows from token to token, so the tokens below it are the first ones.
    skipped = F.size(F.filter(below, lambda b: b))
    kept = F.slice("tokens", skipped + 1, F.size("tokens"))
    return part.select("part", F.explode(kept).alias("t")).select("part", "t.token")


def canonical_values(values: DataFrame, reference: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(value, code, score) for each distinct ``value`` (not NULL): the code of the listed entry meant, or ``NONE``.

    ``reference``: (code, name); ``known``: see :func:`reference_vocabulary`. An empty reference list maps everything to
    ``NONE``. Equal scores are decided for listed entries, then for the smaller code; of the parts of a value the one
    with the better score counts, then the longer one.
    """
    clean = F.regexp_replace(folded(F.col("value")), r"[\s ]+", " ")
    bare = F.regexp_replace(F.regexp_replace(clean, r"^\s+|\s+$", ""), r"[.!:;?\s]+$", "")
    parts = F.filter(F.split("bare", r"[/,()\[\]|;]|\s[-–]\s"), lambda x: F.trim(x) != "")
    stands_in = F.replace("bare", F.lit(" "), F.lit("")).isin(STAND_INS)
    segments = durable(
        values.select("value", bare.alias("bare")).where(~stands_in)
        .select("value", F.explode(F.array_distinct(F.concat(F.array("bare"), parts))).alias("part"))
        .select("value", "part", _words(F.col("part")).alias("words"))
        .where(F.size("words") > 0)
    )
    names, vocabulary = reference_vocabulary(reference, known)
    words = segments.groupBy("part").agg(F.first("words").alias("words"))
    tokens = durable(words.select("part", F.explode(_with_compact(F.col("words"))).alias("token")))
    counted = durable(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    lexicon = durable(vocabulary.groupBy("token").agg(F.max("weight").alias("weight")))
    repairs = _repairs(counted, lexicon).join(lexicon.withColumnRenamed("token", "word"), "word")
    # An unknown token weighs as much as the rarest word, one that may be several words as much as the closest; of a name
    # that it is read into, it weighs what the word does.
    top = lexicon.agg(F.coalesce(F.max("weight"), F.lit(1.0))).first()[0]
    read = repairs.groupBy("token").agg(
        F.max(F.struct("sim", "weight"))["weight"].alias("weight"), F.max("weight").alias("most"), F.collect_list(F.struct("word", "sim", F.col("weight").alias("w"))).alias("reads")
    )
    lookup, facts = observed(
        counted.join(read, "token", "left").select("token", "n", F.coalesce("weight", F.lit(top)).alias("weight"), F.coalesce("most", F.lit(0.0)).alias("most"), "reads"), "n"
    )
    placed = durable(join_by_value(tokens, lookup, ["token"], "n", facts=facts))
    is_compact = F.col("token").startswith(" ")
    plain = placed.where(~is_compact)
    own = plain.groupBy("part").agg(F.sum(F.col("weight") ** 2).alias("whole"))
    finding = _telling(plain.select("part", "token", "weight", "most")).unionByName(placed.where(is_compact).select("part", "token"))
    reads = placed.where("reads is not null").select("part", "token", F.col("weight").alias("own"), F.inline("reads"))
    holders = vocabulary.select(F.col("token").alias("word"), "name_id")
    found = durable(reads.join(finding, ["part", "token"], "left_semi").join(holders, "word").select("part", "name_id").distinct())
    # Of several words read into a token the closest counts per name.
    hits = found.join(holders, "name_id").join(reads, ["part", "word"])
    best = hits.groupBy("part", "name_id", "token").agg(F.max(F.struct("sim", F.col("w").alias("weight"), "own")).alias("m"))
    scored = best.groupBy("part", "name_id").agg(
        F.sum(F.when(~is_compact, F.col("m.sim") * F.col("m.weight") ** 2)).alias("dot"), F.max(F.when(is_compact, F.col("m.sim"))).alias("compact"),
        F.sum(F.when(~is_compact, F.col("m.weight") ** 2 - F.col("m.own") ** 2).otherwise(0.0)).alias("shift"),
    )
    score = F.greatest(F.coalesce(F.col("compact"), F.lit(0.0)), F.coalesce(F.col("dot") / (F.col("norm") * F.sqrt(F.col("whole") + F.col("shift"))), F.lit(0.0)))
    ranked = scored.join(names, "name_id").join(own, "part").select("part", "code", "listed", F.round(score, 6).alias("score"))
    order = F.struct((-F.col("score")).alias("s"), (~F.col("listed")).alias("l"), "code")
    chosen = ranked.where(F.col("score") >= LEAST_SCORE).groupBy("part").agg(F.min_by(F.struct("code", "listed", "score"), order).alias("c"))
    by_value = segments.join(chosen, "part").select("value", "c.*", F.length(F.array_join("words", "")).alias("size"))
    final = by_value.groupBy("value").agg(F.max_by(F.struct("code", "listed", "score"), F.struct("score", "size", "code")).alias("c"))
    code = F.when(F.col("c.listed"), F.col("c.code")).otherwise(NONE)
    return values.select("value").distinct().join(final, "value", "left").select(
        "value", F.coalesce(code, F.lit(NONE)).alias("code"), F.coalesce("c.score", F.lit(0.0)).alias("score")
    )


def canonical_column(rows: DataFrame, key: str, column: str, reference: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(key, code) for each record whose value is present and not a listed code as it stands.

    Repeated deliveries of a key count once, with the largest of its values should they differ. NULL and blank values
    give no row; rows without a key neither.
    """
    present = rows.select(key, blank_to_null(F.col(column)).alias("value")).where(f"{key} is not null")
    once = present.groupBy(key).agg(F.max("value").alias("value")).where("value is not null")
    codes = reference.select(F.col("code").alias("value")).where("value is not null").distinct()
    open_values = once.join(codes, "value", "left_anti")
    counts = durable(open_values.groupBy("value").agg(F.count(F.lit(1)).alias("n")))
    mapped, facts = observed(canonical_values(counts.select("value"), reference, known).join(counts, "value").select("value", "code", "n"), "n")
    return join_by_value(open_values, mapped, ["value"], "n", facts=facts).select(key, "code")


def value_report(rows: DataFrame, key: str, column: str, reference: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(value, code, score, records): how each distinct value was mapped, unmatched ones as ``NONE``."""
    present = rows.select(key, blank_to_null(F.col(column)).alias("value")).where(f"{key} is not null and value is not null")
    counts = durable(present.distinct().groupBy("value").agg(F.count(F.lit(1)).alias("records")))
    return canonical_values(counts.select("value"), reference, known).join(counts, "value")
