"""Text expressions (Column in, Column out), all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms as they end a normalised name, longest first, with their canonical form.
LEGAL_FORMS = {
    "gmbh and co kg": "gmbh_co_kg", "gmbh": "gmbh", "mbh": "gmbh", "ag": "ag", "a g": "ag", "inc": "inc", "incorporated": "inc",
    "llc": "llc", "l l c": "llc", "corp": "corp", "corporation": "corp", "kk": "kk", "k k": "kk", "kabushiki kaisha": "kk",
    "co ltd": "co_ltd", "company limited": "co_ltd",
}


def is_missing(c: Column) -> Column:
    """NULL, empty or white space only."""
    return c.isNull() | c.rlike(r"^\s*$")


def format_signature(c: Column) -> Column:
    """Letters as A, digits as D, all else as it is; runs of the same symbol are one symbol."""
    letters = F.regexp_replace(c, r"\p{L}+", "A")
    return F.regexp_replace(F.regexp_replace(letters, r"\p{Nd}+", "D"), r"(?s)(.)\1+", "$1")


def split_identifier(c: Column) -> Column:
    """camelCase, digits and separators as lower-case words."""
    spaced = F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " ")
    return F.trim(F.lower(F.regexp_replace(spaced, r"[^A-Za-z0-9]+", " ")))


def normalize_text(c: Column) -> Column:
    """Lower case, everything but letters and digits as one blank."""
    return F.trim(F.lower(F.regexp_replace(c, r"[^A-Za-z0-9]+", " ")))


def slug_id(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.regexp_replace(c, r"[^A-Za-z0-9]+", "-")), r"^-+|-+$", "")


def basic_name(c: Column) -> Column:
    """Lower case without Latin accents; & and 'und' as 'and'; single blanks."""
    plain = F.translate(F.lower(c), "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    words = F.trim(F.regexp_replace(F.replace(plain, F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", " "))
    return F.regexp_replace(words, r"\bund\b", "and")


def legal_form(name: Column) -> Column:
    """The canonical legal form at the end of a normalised name; NULL if there is none."""
    forms = "|".join(sorted(LEGAL_FORMS, key=lambda f: -len(f)))
    table = F.create_map(*(F.lit(x) for pair in LEGAL_FORMS.items() for x in pair))
    return table[F.nullif(F.regexp_extract(name, rf"(?:^| )({forms})$", 1), F.lit(""))]


def name_core(name: Column) -> Column:
    forms = "|".join(sorted(LEGAL_FORMS, key=lambda f: -len(f)))
    return F.regexp_replace(name, rf" (?:{forms})$", "")


def digits(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"[^0-9]", ""), F.lit(""))


def tokens(c: Column, least: int = 3) -> Column:
    """Distinct words of letters, in order of their first use."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z]+)"), F.lit(1)), lambda t: F.length(t) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct tokens; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def offset_value(c: Column) -> Column:
    """T-25, T0, T+3 as an integer; NULL for anything else."""
    return F.nullif(F.regexp_extract(c, r"^T([+-]?\d+)$", 1), F.lit("")).cast("int")


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.70, "high").when(score >= 0.45, "medium").otherwise("low")


def csv_safe(c: Column) -> Column:
    """A leading = + - @ is kept from being read as a formula."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def stable_id(prefix: str, *parts: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit(prefix), F.upper(F.substring(digest, 1, 12)))


def expand_synonyms(words: Column, synonyms: dict[str, str], replace: bool = False) -> Column:
    """An array of words with each word's synonym after it, or in its place."""
    table = F.create_map(*(F.lit(x) for pair in synonyms.items() for x in pair))
    if replace:
        return F.transform(words, lambda w: F.coalesce(table[w], w))
    return F.flatten(F.transform(words, lambda w: F.array_compact(F.array(w, table[w]))))


def significant(c: Column, digits: int = 6) -> Column:
    """Rounded to significant digits."""
    return F.format_string(f"%.{digits - 1}e", c.cast("double")).cast("double")


def has_cjk(c: Column) -> Column:
    return c.rlike(r"[\x{4e00}-\x{9fff}]")


def found_keywords(c: Column, keywords: list[str]) -> Column:
    """The keywords that the text contains, sorted, whatever the case."""
    return F.filter(F.array(*(F.lit(k) for k in sorted(keywords))), lambda k: F.contains(F.lower(c), F.lower(k)))


#: What the folding of a name evens out, one step each; the steps do not depend on each other.
FOLDS = ("case", "ampersand", "punctuation", "whitespace")


def folded_name(c: Column, skip: str | None = None) -> Column:
    """A name without Latin accents, case, signs and spaces, and with & and 'und' as 'and'; ``skip`` leaves one out."""
    text = F.translate(c, "áàâäãåçéèêëíìîïñóòôöõúùûüýÿÁÀÂÄÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")
    if skip != "case":
        text = F.lower(text)
    if skip != "ampersand":
        text = F.regexp_replace(F.replace(text, F.lit("&"), F.lit("and")), r"(?i)\bund\b", "and")
    if skip != "punctuation":
        text = F.regexp_replace(text, r"[^\p{L}\p{N}_\s]+", "")
    return text if skip == "whitespace" else F.regexp_replace(text, r"\s+", "")


def difference_tags(a: Column, b: Column) -> Column:
    """The ways in which two writings of a name differ, as an array: a way counts if the names differ once its folding
    is left out. ``legal_suffix`` if the legal forms are written differently, ``different_name`` if the names are not
    the same at all, ``other`` if nothing explains the difference; empty for equal texts."""
    core_a, core_b = (name_core(basic_name(x)) for x in (a, b))
    form_a, form_b = (F.coalesce(legal_form(basic_name(x)), F.lit("")) for x in (a, b))
    suffix_a, suffix_b = (F.regexp_replace(F.replace(basic_name(x), name_core(basic_name(x)), F.lit("")), " ", "") for x in (a, b))
    suffixes = (suffix_a != suffix_b) & (form_a == form_b)
    # With suffixes written differently only the rest is compared.
    rest = lambda x: F.regexp_replace(x, rf"(?i)[\s,]*(?:{'|'.join(_loose(f) for f in sorted(LEGAL_FORMS, key=lambda f: -len(f)))})\.?\s*$", "")
    left, right = F.when(suffixes, rest(a)).otherwise(a), F.when(suffixes, rest(b)).otherwise(b)
    ways = [F.when(folded_name(left, d) != folded_name(right, d), d) for d in FOLDS]
    tags = F.array_compact(F.array(F.when(suffixes, "legal_suffix"), *ways))
    same = (core_a == core_b) & (form_a == form_b)
    return (
        F.when(a == b, F.array().cast("array<string>")).when(~same, F.array(F.lit("different_name")))
        .when(F.size(tags) == 0, F.array(F.lit("other"))).otherwise(tags)
    )


def _loose(form: str) -> str:
    """A legal form with any signs between its words."""
    return form.replace(" ", r"[\s.&,]*").replace("and", "(?:and|und)?")


def identifier(c: Column) -> Column:
    """Letters and digits in upper case, as tax numbers are compared; NULL if there are none."""
    return F.nullif(F.upper(F.regexp_replace(c, r"[^A-Za-z0-9]", "")), F.lit(""))


def prefix_key(name: Column, letters: int = 4) -> Column:
    """The first letters of a name; NULL if it is empty."""
    return F.nullif(F.substring(name, 1, letters), F.lit(""))


def has_control_characters(c: Column) -> Column:
    return c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


# Words left out when requirements are compared.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "to", "for", "of", "in", "on", "with", "into",
    "from", "at", "by", "as", "is", "are", "be", "that", "this", "it", "when",
    "should", "must", "need", "needs", "want", "wants", "we", "our", "us",
]


def content_words(c: Column) -> Column:
    """Distinct words of three and more letters without stop words."""
    return F.filter(tokens(c), lambda t: ~t.isin(STOP_WORDS))


def code_legality(c: Column, form: str, longest: int) -> Column:
    """``code`` if a value has the form of a code, ``fits`` if it is merely short enough, else ``too_long``; NULL for
    missing values."""
    return F.when(~is_missing(c), F.when(c.rlike(form), "code").when(F.length(c) <= longest, "fits").otherwise("too_long"))
