"""Splitting CSV texts into records, and separating the records that cannot be loaded with the reason why.

All work is done by built-in expressions. A text is cut into records once and the records are written; everything else
reads that table. A record without quotes is split at its commas, any other one is checked against RFC 4180 by one
possessive pattern (linear, no backtracking). Values are not checked record by record: every distinct (column, value)
is checked once, the invalid ones form a dictionary with a reason each, and only that dictionary is joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.skew import join_by_value
from keelson.storage import durable

_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",\r\n]*+)'
_RECORD = rf"{_FIELD}(?:,{_FIELD})*+"
#: A whole record at the start of the piece, up to its line end. Group 1 is the record without the line end.
_FIRST = rf"^({_RECORD})(?:\r?\n|\r?\z)"
#: Stands between the number of a line and the line while a text without marks is cut.
_TAG = ""
#: A record of numbered lines, or else the one line that begins at this place.
_NUMBERED = rf"\G(?:\d+{_TAG}{_RECORD}(?:\r?\n|\r?\z)|[^\n]++\n?)"


@dataclass(frozen=True)
class ValueRule:
    """``valid`` is a pattern that the whole value must match; an empty value is valid if ``optional``. ``fault`` says
    what is wrong with a value that does not."""

    column: str
    valid: str
    optional: bool = False
    fault: str = "not a valid value"


#: The rules of the customer import. (?s) lets a dot stand for line breaks as well.
CUSTOMER_RULES = (
    ValueRule("contact_email", r"^[^@\s]+@[^@\s]+\.[^@\s]+$", optional=True, fault="not an e-mail address"),
    ValueRule("nation", r"^[A-Z]{2}\z", fault="not two capital letters"),
    ValueRule("account_currency", r"^[A-Z]{3}\z", fault="not three capital letters"),
    ValueRule("marketing_opt_in", r"(?i)^(true|false|yes|no|y|n|0|1)\z", optional=True, fault="not a yes or no"),
    ValueRule("client_name", r"(?s)^[^\x00-\x09\x0b\x0c\x0e-\x1f\x7f-\x9f\x{fffd}]*\z", fault="control or replacement character"),
)


def _fields(piece: Column) -> Column:
    """The unquoted fields of the record at the start of ``piece``; NULL if its quoting is broken."""
    line = F.substring_index(piece, "\n", 1)
    line = F.when(line.endswith("\r"), line.substr(F.lit(1), F.length(line) - 1)).otherwise(line)
    plain = ~piece.contains('"') & ~line.contains("\r")
    record = F.regexp_extract(piece, _FIRST, 1)
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({_FIELD})"), F.lit(1))
    unquoted = F.transform(
        raw,
        lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x),
    )
    return F.when(plain, F.split(line, ",")).when(record != "", unquoted)


def _marked_pieces(body: Column, mark: str) -> Column:
    """(line_no, raw) of the pieces that begin with ``mark`` at the start of a line."""
    starts = F.filter(
        F.transform(F.split(body, "\n"), lambda line, i: F.when((i > 0) & line.startswith(mark), i + 1)), lambda n: n.isNotNull()
    )
    pieces = F.split(body, rf"\n(?=\Q{mark}\E)")
    # Piece 0 is the header with whatever follows it.
    return F.arrays_zip(starts.alias("line_no"), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("raw"))


def _all_pieces(body: Column) -> Column:
    """(line_no, raw) of all records after line 1; blank lines are none.

    Each line gets its number in front before the text is cut, so that a record knows where it starts however many line
    breaks its quoted fields hold.
    """
    lines = F.split(body, "\n")
    rest = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda line, i: F.concat((i + 2).cast("string"), F.lit(_TAG), line))
    found = F.regexp_extract_all(F.array_join(rest, "\n"), F.lit(f"({_NUMBERED})"), F.lit(1))
    cut = F.transform(
        found,
        lambda x: F.struct(
            F.substring_index(x, _TAG, 1).cast("int").alias("line_no"),
            F.regexp_replace(F.regexp_replace(x, rf"^\d+{_TAG}", ""), rf"(?<=\n)\d+{_TAG}", "").alias("raw"),
        ),
    )
    return F.filter(cut, lambda x: ~x["raw"].rlike(r"^\s*\z"))


def split_records(texts: DataFrame, key: str, text: str, mark: str | None = None) -> DataFrame:
    """One row per record: ``key``, ``line_no``, ``header`` (array), ``fields`` (array, NULL for broken quoting),
    ``reason`` (NULL, ``quoting`` or ``column_count``) and ``raw``.

    Line 1 is the header. With a ``mark`` a record starts at a line that begins with it and ends at its line break
    outside quotes, or before the next such line; lines that belong to no record give none. Without a mark records
    follow each other as RFC 4180 has it, and a line whose quoting is broken is a record of its own, so one open quote
    does not swallow the rest. A byte-order mark is ignored, CRLF and LF count once, blank lines count as lines. NULL,
    blank and header-only texts give no rows.
    """
    body = F.regexp_replace(F.col(text), "^﻿", "")
    first = F.substring_index(body, "\n", 1)
    header = F.coalesce(_fields(first), F.split(F.regexp_replace(first, r"\r\z", ""), ","))
    pieces = _marked_pieces(body, mark) if mark else _all_pieces(body)
    cut = texts.where(F.col(text).isNotNull()).select(F.col(key), header.alias("header"), pieces.alias("_pieces"))
    placed = cut.select(key, "header", F.inline("_pieces").alias("line_no", "raw"))
    checked = placed.select(key, F.col("line_no").cast("bigint").alias("line_no"), "header", _fields(F.col("raw")).alias("fields"), "raw")
    reason = F.when(F.col("fields").isNull(), "quoting").when(F.size("fields") != F.size("header"), "column_count")
    return checked.withColumn("reason", reason)


def _fault(rules: tuple[ValueRule, ...]) -> Column:
    """What is wrong with a (column_name, value); NULL if nothing is."""
    found = F.lit(None).cast("string")
    for rule in rules:
        broken = ~F.col("value").rlike(rule.valid)
        if rule.optional:
            broken = broken & (F.col("value") != "")
        found = F.when((F.col("column_name") == rule.column) & broken, rule.fault).otherwise(found)
    return found


def _ruled_values(records: DataFrame, rules: tuple[ValueRule, ...], *keep: str) -> DataFrame:
    """Long rows (keep..., column_name, value) of the ruled columns of the records without structural fault."""
    names = F.array(*(F.lit(r.column) for r in rules))
    pairs = F.filter(
        F.arrays_zip(F.col("header").alias("column_name"), F.col("fields").alias("value")),
        lambda x: F.array_contains(names, x["column_name"]),
    )
    return records.where("reason is null").select(*keep, F.inline(pairs).alias("column_name", "value"))


def invalid_values(records: DataFrame, rules: tuple[ValueRule, ...] = CUSTOMER_RULES) -> DataFrame:
    """The dictionary of invalid values: (column_name, value, rows, fault). Each distinct value is checked once."""
    distinct = _ruled_values(records, rules).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("rows"))
    return distinct.withColumn("fault", _fault(rules)).where("fault is not null")


def faulty_records(records: DataFrame, key: str, rules: tuple[ValueRule, ...] = CUSTOMER_RULES) -> DataFrame:
    """(key, line_no, reason, details) of the records that cannot be loaded: structural faults first, then
    ``invalid_value``, whose details name each column and what is wrong with it.

    ``records`` should be a written table, since it is read for the dictionary, its values and its structural faults.
    """
    invalid = durable(invalid_values(records, rules))
    values = _ruled_values(records, rules, key, "line_no")
    named = F.concat_ws(": ", "column_name", "fault")
    bad_values = (
        join_by_value(values, invalid, ["column_name", "value"], "rows")
        .groupBy(key, "line_no")
        .agg(F.sort_array(F.collect_set(named)).alias("details"))
        .select(key, "line_no", F.lit("invalid_value").alias("reason"), "details")
    )
    broken = records.where("reason is not null").select(key, "line_no", "reason", F.array().cast("array<string>").alias("details"))
    return broken.unionByName(bad_values)


def loadable_records(records: DataFrame, key: str, rules: tuple[ValueRule, ...] = CUSTOMER_RULES) -> DataFrame:
    """(key, line_no, record map column -> value) of all other records."""
    bad = faulty_records(records, key, rules).where("reason = 'invalid_value'").select(key, "line_no")
    good = records.where("reason is null").join(bad, [key, "line_no"], "left_anti")
    # Repeated header names keep their first column.
    pairs = F.arrays_zip(F.col("header").alias("k"), F.col("fields").alias("v"))
    once = F.filter(pairs, lambda x, i: (F.array_position("header", x["k"]) == i + 1) & x["k"].isNotNull())
    return good.select(key, "line_no", F.map_from_entries(once).alias("record"))


#: Limits of one uploaded text.
MOST_BYTES, MOST_ROWS, MOST_COLUMNS = 2**20, 10_000, 200


def upload_faults(texts: DataFrame, key: str, text: str, most_bytes: int = MOST_BYTES, most_rows: int = MOST_ROWS, most_columns: int = MOST_COLUMNS) -> DataFrame:
    """(key, fault) for each limit that a text breaks: empty, too_large, too_many_rows (lines that are not blank),
    too_many_columns, unnamed_column, repeated_column. It refuses texts, it never cuts them."""
    body = F.regexp_replace(F.col(text), "^﻿", "")
    lines = F.filter(F.split(body, "\n"), lambda line: F.trim(F.regexp_replace(line, r"\r\z", "")) != "")
    header = F.transform(F.split(F.regexp_replace(F.element_at(lines, 1), r"\r\z", ""), ","), lambda c: F.lower(F.trim(c)))
    blank = F.col(text).isNull() | F.col(text).rlike(r"^﻿?\s*\z")
    faults = [
        F.when(blank, "empty"), F.when(F.octet_length(text) > most_bytes, "too_large"), F.when(~blank & (F.size(lines) - 1 > most_rows), "too_many_rows"),
        F.when(~blank & (F.size(header) > most_columns), "too_many_columns"), F.when(~blank & F.array_contains(header, ""), "unnamed_column"),
        F.when(~blank & (F.size(F.array_distinct(header)) < F.size(header)), "repeated_column"),
    ]
    return texts.select(key, F.explode(F.array_compact(F.array(*faults))).alias("fault"))
