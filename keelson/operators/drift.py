"""Column profiles of every load of a table, and the columns that change from one load to the next.

The rows are read once and reduced to (load, column, value) counts before the first shuffle ends; everything else
works on these counts: missing ratio, distinct count, lengths, ranges, patterns and value mix. Column patterns are
induced by minimum description length from the shapes of all distinct values; their sums are taken per shape, then
per coarser reading, and joined back, so no task ever holds all shapes of a column. Two successive loads are compared
by tests whose threshold is in standard deviations, so the result does not depend on the size of a load.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.storage import durable

#: Standard deviations beyond which a difference is more than chance (about 1 in 10 million per test).
THRESHOLD = 5.0
#: Categories with fewer rows in both loads together are counted as one category.
LEAST_ROWS = 10
CHAR_BITS = 8.0
#: Bits for the length of one run, where a pattern leaves it open.
RUN_BITS = 3.0
BITS_OF = {"A": 4.7, "a": 4.7, "9": 3.32, "w": 5.7}
#: Marks an open run in a reading, until it becomes the + of an expression; a + of the values themselves stays apart.
RUN = "\ue001"
_BLANK = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\xa0\u2007\u202f\u3000"
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def value_counts(rows: DataFrame, load: str, columns: list[str]) -> DataFrame:
    """(load_no, column_name, value, n): all values with their rows; blank values are NULL, others are trimmed.

    Rows without a load number form a load of their own (NULL), which is profiled but never compared.
    """
    slim = rows.select(F.col(load).cast("bigint").alias("load_no"), *(F.col(c).cast("string").alias(c) for c in columns))
    long = slim.unpivot(["load_no"], columns, "column_name", "value")
    value = F.nullif(F.btrim(F.col("value"), F.lit(_BLANK)), F.lit(""))
    return long.withColumn("value", value).groupBy("load_no", "column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def shape(value: Column) -> Column:
    """Each letter as A or a, each digit from 0 to 9 as 9, all else as it is."""
    ascii_shape = F.translate(value, _UPPER + _LOWER + _DIGITS, "A" * 26 + "a" * 26 + "9" * 10)
    upper = F.regexp_replace(value, r"\p{Lu}", "A")
    any_shape = F.regexp_replace(F.regexp_replace(upper, r"[\p{L}&&[^\p{Lu}]]", "a"), r"\d", "9")
    return F.when(F.octet_length(value) == F.length(value), ascii_shape).otherwise(any_shape)


def shape_counts(values: DataFrame) -> DataFrame:
    """(load_no, column_name, s1, n, d, length): the value counts reduced to shapes, with rows and distinct values."""
    return (
        values.where("value is not null")
        .groupBy("load_no", "column_name", shape(F.col("value")).alias("s1"))
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"))
        .withColumn("length", F.length("s1"))
    )


def _symbols(pattern: Column, symbol: str) -> Column:
    return F.length(pattern) - F.length(F.replace(pattern, F.lit(symbol), F.lit("")))


def _bits(s1: Column, merged: bool) -> Column:
    """Bits to tell a value of this shape, once the pattern is known."""
    letters = _symbols(s1, "A") + _symbols(s1, "a")
    return letters * (BITS_OF["w"] if merged else BITS_OF["a"]) + _symbols(s1, "9") * BITS_OF["9"]


def induce_patterns(shapes: DataFrame) -> DataFrame:
    """(column_name, s1, pattern): the pattern that each shape falls under; NULL for shapes that no pattern covers.

    For each column three readings of a shape compete: exact runs (``99-99``), open runs (``9+-9+``) and words
    (letters of either case as one open run). The coarser reading replaces the finer ones below it where the bits for
    the fewer patterns plus the open run lengths are less than the bits for the many exact patterns. A pattern is
    adopted only if it saves more than it costs against writing its values out, so shapes of a few odd values stay
    without a pattern: their rows are the nonconforming ones. Every pattern matches all values of its shapes.
    """
    d, s1, s2, s3 = (F.col(c) for c in ("d", "s1", "s2", "s3"))
    code = lambda n: n * F.log2(F.col("all") / n)
    # One row per column of the table.
    totals = shapes.groupBy("column_name").agg(F.sum("d").alias("all"))
    each = durable(
        shapes.groupBy("column_name", "s1").agg(F.sum("d").alias("d"))
        .withColumn("s2", F.regexp_replace("s1", r"(A|a|9)\1*", f"$1{RUN}"))
        .withColumn("s3", F.regexp_replace(F.regexp_replace("s2", f"(?:[Aa]{RUN})+", f"w{RUN}"), f"w{RUN}(?: w{RUN})*", f"w{RUN}"))
        .join(F.broadcast(totals), "column_name")
    )
    told = d * _bits(s1, True)
    fine = each.groupBy("column_name", "all", "s2", "s3").agg(
        F.sum("d").alias("d"),
        F.sum(CHAR_BITS * F.length(s1) + code(d) + d * _bits(s1, False)).alias("exact"),
        F.sum(d * (_bits(s1, False) + RUN_BITS * _symbols(s2, RUN))).alias("spread"),
        F.sum(d * (_bits(s1, True) + RUN_BITS * _symbols(s3, RUN) + RUN_BITS * _symbols(s1, " "))).alias("words"),
        F.sum(d * CHAR_BITS * F.length(s1)).alias("plain"),
        F.sum(told).alias("told"),
    )
    fine = fine.withColumn("open", CHAR_BITS * F.length(s2) + code(d) + F.col("spread"))
    middle = fine.groupBy("column_name", "all", "s3").agg(
        F.sum("d").alias("d"), F.sum("words").alias("words"), F.sum(F.least("exact", "open")).alias("below"),
        F.sum("plain").alias("plain3"), F.sum("told").alias("told3"), F.sum("d").alias("d3"),
    )
    middle = middle.withColumn("word", CHAR_BITS * F.length(s3) + code(d) + F.col("words"))
    adopted = lambda reading, plain, bits, n: F.when(
        plain > bits + n * RUN_BITS * _symbols(reading, RUN) + CHAR_BITS * F.length(reading), _as_regex(reading)
    )
    merged = F.col("word") < F.col("below")
    opened = F.col("open") < F.col("exact")
    readings = fine.join(middle.select("column_name", "s3", "word", "below", "plain3", "told3", "d3"), ["column_name", "s3"]).select(
        "column_name", "s2", (merged | opened).alias("coarse"),
        F.when(merged, adopted(s3, F.col("plain3"), F.col("told3"), F.col("d3")))
        .when(opened, adopted(s2, F.col("plain"), F.col("told"), d)).alias("pattern"),
    )
    exact = adopted(s1, d * CHAR_BITS * F.length(s1), told, d)
    return each.join(readings, ["column_name", "s2"]).select(
        "column_name", "s1", F.when(F.col("coarse"), F.col("pattern")).otherwise(exact).alias("pattern")
    )


def _as_regex(reading: Column) -> Column:
    """A reading as a regular expression. The symbols of a reading are its only letters and digits, and none of the
    meanings holds one of them."""
    text = F.regexp_replace(reading, r"([\\.*?^$()\[\]{}|+])", r"\\$1")
    for symbol, meaning in (("A", r"\p{Lu}"), ("a", r"[^\P{L}\p{Lu}]"), ("9", r"\d"), ("w", r"[\p{L} ]"), (RUN, "+")):
        text = F.replace(text, F.lit(symbol), F.lit(meaning))
    return F.concat(F.lit("^"), text, F.lit("$"))


def patterned_shapes(values: DataFrame) -> DataFrame:
    """The shape counts with the pattern of each, as a written table: profile and tests read it more than once."""
    shapes = durable(shape_counts(values))
    return durable(shapes.join(induce_patterns(shapes), ["column_name", "s1"]))


def column_profile(rows: DataFrame, load: str, columns: list[str]) -> DataFrame:
    """One row per load and column: rows, missing_ratio, distinct_count, observed_max_length, lowest_value,
    highest_value, n_patterns, main_pattern, nonconforming_rows, top_value, top_share.

    A column that is missing throughout has distinct_count 0 and NULL for lengths, range and patterns. An empty
    table gives no rows. Ties for main_pattern and top_value go to the larger text.
    """
    values = durable(value_counts(rows, load, columns))
    keys = ["load_no", "column_name"]
    overall = values.groupBy(*keys).agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.count("value").alias("distinct_count"),
        F.max(F.length("value")).alias("observed_max_length"),
        F.min("value").alias("lowest_value"),
        F.max("value").alias("highest_value"),
        F.max(F.when(F.col("value").isNotNull(), F.struct("n", "value"))).alias("top"),
    )
    patterned = (
        patterned_shapes(values)
        .groupBy(*keys, "pattern").agg(F.sum("n").alias("n"))
        .groupBy(*keys).agg(
            F.count("pattern").alias("n_patterns"),
            F.max(F.when(F.col("pattern").isNotNull(), F.struct("n", "pattern")))["pattern"].alias("main_pattern"),
            F.sum(F.when(F.col("pattern").isNull(), F.col("n")).otherwise(0)).alias("nonconforming_rows"),
        )
    )
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    return overall.alias("o").join(patterned.alias("p"), same[0] & same[1], "left").select(
        "o.load_no", "o.column_name", "rows", (F.col("missing") / F.col("rows")).alias("missing_ratio"), "distinct_count",
        "observed_max_length", "lowest_value", "highest_value", "n_patterns", "main_pattern", "nonconforming_rows",
        F.col("top.value").alias("top_value"), (F.col("top.n") / F.col("rows")).alias("top_share"),
    )


def _beside_previous(counts: DataFrame, loads: DataFrame) -> DataFrame:
    """(load_no, column_name, facet, cur, prev): for each category its rows in a load and in the load before; one of
    both may be 0.

    ``loads`` has one row per load number, so ordering it in one task and broadcasting it does not grow with the rows.
    """
    beside = Window.orderBy("load_no")
    order = loads.where("load_no is not null").select(
        "load_no", F.lag("load_no").over(beside).alias("before"), F.lead("load_no").over(beside).alias("after")
    )
    same = Window.partitionBy("column_name", "facet", "category").orderBy("load_no")
    seen = counts.join(F.broadcast(order), "load_no").select(
        "*", F.lag("load_no").over(same).alias("seen"), F.lag("n").over(same).alias("was"), F.lead("load_no").over(same).alias("next")
    )
    none = F.lit(0).cast("bigint")
    here = F.when(
        F.col("before").isNotNull(),
        F.struct(F.col("load_no").alias("load_no"), F.col("n").alias("cur"), F.when(F.col("seen") == F.col("before"), F.col("was")).otherwise(none).alias("prev")),
    )
    gone = F.when(
        F.col("after").isNotNull() & ~F.col("next").eqNullSafe(F.col("after")),
        F.struct(F.col("after").alias("load_no"), none.alias("cur"), F.col("n").alias("prev")),
    )
    return seen.select("column_name", "facet", F.inline(F.array_compact(F.array(here, gone))).alias("load_no", "cur", "prev"))


def mix_tests(facets: DataFrame, loads: DataFrame) -> DataFrame:
    """(load_no, column_name, facet, z) for counts (load_no, column_name, facet, category, n): the two-sample
    chi-square of the categories against the load before, as standard deviations (Wilson and Hilferty).

    The sum over categories of (cur * sqrt(n0 / n1) - prev * sqrt(n1 / n0)) ** 2 / (cur + prev) is taken apart into
    three sums that need neither total, so one aggregation does it.
    """
    cur, prev = F.col("cur").cast("double"), F.col("prev").cast("double")
    many = F.col("cur") + F.col("prev") >= LEAST_ROWS
    parts = {"cc": (cur, cur), "cp": (cur, prev), "pp": (prev, prev)}
    sums = _beside_previous(facets, loads).groupBy("load_no", "column_name", "facet").agg(
        F.sum("cur").alias("n1"), F.sum("prev").alias("n0"), F.sum(many.cast("int")).alias("k"),
        F.sum(F.when(~many, cur).otherwise(0.0)).alias("few_cur"), F.sum(F.when(~many, prev).otherwise(0.0)).alias("few_prev"),
        *(F.sum(F.when(many, a * b / (cur + prev)).otherwise(0.0)).alias(name) for name, (a, b) in parts.items()),
    )
    few = F.col("few_cur") + F.col("few_prev")
    rest = {"cc": F.col("few_cur") ** 2, "cp": F.col("few_cur") * F.col("few_prev"), "pp": F.col("few_prev") ** 2}
    cc, cp, pp = (F.col(name) + F.when(few > 0, rest[name] / few).otherwise(0.0) for name in parts)
    tested = sums.withColumn("df", F.col("k") + (few > 0).cast("int") - 1).where("n1 > 0 and n0 > 0 and df > 0")
    x = F.greatest(F.lit(0.0), cc * F.col("n0") / F.col("n1") - 2 * cp + pp * F.col("n1") / F.col("n0"))
    spread = 2 / (9 * F.col("df"))
    return tested.select("load_no", "column_name", "facet", ((F.cbrt(x / F.col("df")) - (1 - spread)) / F.sqrt(spread)).alias("z"))


def distinct_tests(values: DataFrame, loads: DataFrame) -> DataFrame:
    """(load_no, column_name, facet, z) for the number of distinct values.

    The count of a sample varies by about the number of values seen once, and by no more than the number of repeats.
    A column of few values has the same count in a larger load, an identifier has one in proportion; the smaller of
    both differences counts, so that neither is a change.
    """
    each = values.where("value is not null").groupBy("load_no", "column_name").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("d"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("once")
    )
    each = each.withColumn("v", F.greatest(F.lit(1), F.least(F.col("once"), F.col("rows") - F.col("d"))))
    ahead = loads.select("load_no", F.lead("load_no").over(Window.orderBy("load_no")).alias("next")).where("next is not null")
    before = each.join(F.broadcast(ahead), "load_no").select(
        F.col("next").alias("load_no"), "column_name", *(F.col(c).alias(f"{c}0") for c in ("rows", "d", "v"))
    )
    ratio = (F.col("d") / F.col("rows") - F.col("d0") / F.col("rows0")) / F.sqrt(
        F.col("v") / F.pow("rows", F.lit(2)) + F.col("v0") / F.pow("rows0", F.lit(2))
    )
    plain = (F.col("d") - F.col("d0")) / F.sqrt(F.col("v") + F.col("v0"))
    both = each.join(before, ["load_no", "column_name"])
    return both.select("load_no", "column_name", F.lit("distinct").alias("facet"), F.least(F.abs(ratio), F.abs(plain)).alias("z"))


def load_tests(rows: DataFrame, load: str, columns: list[str]) -> DataFrame:
    """(load_no, column_name, facet, z) for the facets missing, distinct, length, pattern and value of each load but
    the first. Loads follow each other by number, whatever numbers are absent. Facets without two categories give no
    row; a column that is missing throughout in a load is compared by its missing ratio alone."""
    values = durable(value_counts(rows, load, columns))
    loads = values.select("load_no").where("load_no is not null").distinct()
    patterns = patterned_shapes(values)
    label = F.coalesce("pattern", F.lit("nonconforming"))
    small = {
        "missing": (values, F.col("value").isNull().cast("string")),
        "length": (patterns, F.col("length").cast("string")),
        "pattern": (patterns, label),
    }
    facets = [
        source.groupBy("load_no", "column_name", F.lit(name).alias("facet"), category.alias("category")).agg(F.sum("n").alias("n"))
        for name, (source, category) in small.items()
    ]
    mix = values.where("value is not null").select("load_no", "column_name", F.lit("value").alias("facet"), F.col("value").alias("category"), "n")
    counts = reduce(DataFrame.unionByName, facets, mix)
    return mix_tests(counts, loads).unionByName(distinct_tests(values, loads))


def changed_columns(rows: DataFrame, load: str, columns: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """(load_no, column_name) whose content differs from the load before by more than chance."""
    return load_tests(rows, load, columns).where(F.col("z") > threshold).select("load_no", "column_name").distinct()
