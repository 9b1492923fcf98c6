"""Guarded reading and deterministic writing of files."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.text import csv_safe


class SourceError(ValueError):
    """A file that must not or cannot be read as a table."""


def safe_path(path: str, root: str) -> str:
    """``path`` below ``root``; remote addresses and parent steps are refused."""
    import posixpath

    if "://" in path or path.startswith("//"):
        raise SourceError("remote addresses are not read")
    if ".." in path.replace("\\", "/").split("/"):
        raise SourceError("the path leaves its folder")
    full = posixpath.normpath(path if path.startswith("/") else f"{root}/{path}")
    if not full.startswith(root.rstrip("/") + "/"):
        raise SourceError("the path leaves its folder")
    return full


def read_csv(spark: SparkSession, path: str, root: str) -> DataFrame:
    """All columns as text, missing cells as empty text. Refuses empty and repeated column names and empty tables."""
    full = safe_path(path, root)
    header = spark.read.text(full).limit(1).collect()
    names = [n.strip().strip('"') for n in header[0][0].lstrip("﻿").split(",")] if header else []
    if not names or any(not n for n in names):
        raise SourceError("a column has no name")
    if len(set(names)) < len(names):
        raise SourceError("a column name is repeated")
    rows = spark.read.csv(full, header=True, multiLine=True, escape='"', mode="FAILFAST").na.fill("")
    if rows.isEmpty():
        raise SourceError("there are no rows")
    return rows


def read_json(spark: SparkSession, path: str, root: str) -> DataFrame:
    return spark.read.json(safe_path(path, root), multiLine=True)


def write_csv(rows: DataFrame, columns: list[str], path: str, guard_formulas: bool = False) -> None:
    """Columns in the given order, missing cells empty; arrays joined by semicolons."""
    kinds = dict(rows.dtypes)
    cells = []
    for c in columns:
        cell = F.array_join(c, ";") if kinds[c].startswith("array") else F.col(c).cast("string")
        cells.append((csv_safe(cell) if guard_formulas else cell).alias(c))
    rows.select(*cells).na.fill("").write.mode("overwrite").option("emptyValue", "").csv(path, header=True)


def content_hash(rows: DataFrame) -> str:
    """A hash of the set of rows that does not depend on their order or partitions, made by aggregation."""
    digest = F.xxhash64(F.to_json(F.struct(*sorted(rows.columns))))
    facts = rows.select(digest.alias("h")).agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.pmod("h", F.lit(1_000_003)))).first()
    return hashlib.sha256(json.dumps([sorted(rows.dtypes), *facts], default=str).encode()).hexdigest()


def write_if_changed(rows: DataFrame, path: str, known_hash: str | None) -> str:
    """Write parquet only if the content differs from ``known_hash``; returns the content's hash."""
    found = content_hash(rows)
    if found != known_hash:
        rows.write.mode("overwrite").parquet(path)
    return found
