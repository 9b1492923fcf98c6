"""Contracts of target tables: reading them, the index of their fields, and validating tables against them.

A contract names resources (tables) with fields, a primary key and foreign keys. Checks of single rows are made in one
scan of the table; keys are counted with map-side combination and only repeated ones are joined back; references are
anti-joins on distinct keys.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.text import is_missing
from keelson.operators.validate import parses_as, severity
from keelson.skew import join_by_value, observed
from keelson.sources.files import SourceError

# What a descriptor must say about itself, and texts that it must not hold.
REQUIRED_KEYS = ["name", "resources"]
FORBIDDEN = {
    "remote address": r"(?i)^[a-z][a-z0-9+.-]*://",
    "absolute path": r"^(?:/|[A-Za-z]:[\\/])",
    "parent step": r"(?:^|[\\/])\.\.(?:[\\/]|$)",
    "secret": r"(?i)(?:password|passwd|secret|api[_-]?key|token)\s*[=:]\s*\S",
}
CATEGORIES = ["required", "type", "enum", "pattern", "max_length", "constraint", "unique", "primary_key", "foreign_key", "schema"]


@dataclass(frozen=True)
class Field:
    """A declared column. ``kind``: string, integer, number, boolean or date."""

    name: str
    kind: str = "string"
    required: bool = False
    unique: bool = False
    enum: tuple[str, ...] = ()
    pattern: str | None = None
    max_length: int | None = None
    minimum: float | None = None
    description: str = ""
    aliases: tuple[str, ...] = ()
    semantic: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    resource: str
    references: tuple[str, ...]


@dataclass(frozen=True)
class Resource:
    name: str
    fields: tuple[Field, ...]
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = field(default=())


@dataclass(frozen=True)
class Contract:
    name: str
    resources: tuple[Resource, ...]


def disallowed_texts(node: object, at: str = "$") -> Iterator[tuple[str, str]]:
    """(place, what) for each text of a nested document that names a remote address, leaves its folder or looks like a
    secret. The document is a descriptor written by hand, so it is walked on the driver."""
    if isinstance(node, dict):
        for key, value in node.items():
            yield from disallowed_texts(value, f"{at}.{key}")
    elif isinstance(node, list):
        for i, value in enumerate(node):
            yield from disallowed_texts(value, f"{at}[{i}]")
    elif isinstance(node, str) and not at.endswith((".pattern", ".description")):
        yield from ((at, what) for what, form in FORBIDDEN.items() if re.search(form, node))


def parse_contract(document: dict) -> Contract:
    """A contract from a descriptor: resources with ``schema.fields`` (constraints required, unique, enum, pattern,
    maxLength, minimum), ``primaryKey`` and ``foreignKeys``. Raises SourceError if it is not sound."""
    bad = [f"{key} is missing" for key in REQUIRED_KEYS if not document.get(key)]
    bad += [f"{what} at {place}" for place, what in disallowed_texts(document)]
    if bad:
        raise SourceError("; ".join(bad))
    resources = []
    for entry in document["resources"]:
        schema = entry.get("schema", {})
        fields = []
        for f in schema.get("fields", []):
            rules = f.get("constraints", {})
            fields.append(
                Field(
                    f["name"], f.get("type", "string"), bool(rules.get("required")), bool(rules.get("unique")), tuple(map(str, rules.get("enum", ()))),
                    rules.get("pattern"), rules.get("maxLength"), rules.get("minimum"), f.get("description", ""), tuple(f.get("aliases", ())), f.get("semanticType"),
                )
            )
        listed = lambda x: (x,) if isinstance(x, str) else tuple(x or ())
        keys = tuple(
            ForeignKey(listed(k["fields"]), k["reference"].get("resource") or entry["name"], listed(k["reference"]["fields"]))
            for k in schema.get("foreignKeys", [])
        )
        resources.append(Resource(entry["name"], tuple(fields), listed(schema.get("primaryKey")), keys))
    contract = Contract(document["name"], tuple(resources))
    _check_names(contract)
    return contract


def _check_names(contract: Contract) -> None:
    names = {r.name: {f.name for f in r.fields} for r in contract.resources}
    bad = [f"resource {r.name} is repeated" for r in contract.resources if sum(x.name == r.name for x in contract.resources) > 1]
    for r in contract.resources:
        bad += [f"{r.name} has no fields"] if not r.fields else []
        bad += [f"{r.name}.{c} is no field" for c in r.primary_key if c not in names[r.name]]
        for key in r.foreign_keys:
            bad += [f"{r.name}.{c} is no field" for c in key.columns if c not in names[r.name]]
            bad += [f"{key.resource}.{c} is no field" for c in key.references if c not in names.get(key.resource, ())]
    if bad:
        raise SourceError("; ".join(sorted(set(bad))))


def read_contract(spark: SparkSession, path: str, root: str) -> Contract:
    """A contract from a JSON or YAML file below ``root``; YAML needs the package yaml."""
    from keelson.sources.files import safe_path

    text = spark.read.text(safe_path(path, root), wholetext=True).first()[0]
    if path.endswith((".yaml", ".yml")):
        import yaml

        return parse_contract(yaml.safe_load(text))
    return parse_contract(json.loads(text))


def contract_fields(spark: SparkSession, contract: Contract) -> DataFrame:
    """One row per declared field: the target side of schema matching."""
    rows = [
        (r.name, f.name, f"{r.name}.{f.name}", f.kind, f.required, f.unique or r.primary_key == (f.name,), f.name in r.primary_key, f.max_length, list(f.enum), f.pattern,
         f.description, list(f.aliases), f.semantic)
        for r in contract.resources for f in r.fields
    ]
    schema = (
        "resource string, name string, target string, kind string, required boolean, unique boolean, primary_key boolean, max_length int, "
        "enum_values array<string>, pattern string, description string, aliases array<string>, semantic_type string"
    )
    return spark.createDataFrame(rows, schema)


def _faults(f: Field) -> Iterator[tuple[str, Column]]:
    """The categories that a single value can break, each with the condition of the fault. Only required concerns
    missing values."""
    value = F.col(f.name).cast("string")
    missing = is_missing(value)
    if f.required:
        yield "required", missing
    checks = [("max_length", F.length(value) > f.max_length)] if f.max_length is not None else []
    if f.kind not in ("string", "any"):
        checks.append(("type", ~F.coalesce(parses_as(F.trim(value), f.kind), F.lit(False))))
    if f.enum:
        checks.append(("enum", ~value.isin(*f.enum)))
    if f.pattern:
        checks.append(("pattern", ~value.rlike(rf"^(?:{f.pattern})\z")))
    if f.minimum is not None:
        checks.append(("constraint", value.try_cast("double") < f.minimum))
    for category, broken in checks:
        yield category, ~missing & F.coalesce(broken, F.lit(False))


def row_violations(rows: DataFrame, resource: Resource, key: str) -> DataFrame:
    """(resource, field, category, row_key, value, first_row) of all faults of single values, in one scan. Declared
    columns that the table lacks are one ``schema`` fault each, without a row."""
    held = [f for f in resource.fields if f.name in rows.columns]
    faults = [
        F.when(
            broken,
            F.struct(F.lit(f.name).alias("field"), F.lit(category).alias("category"), F.col(key).cast("string").alias("row_key"), F.col(f.name).cast("string").alias("value")),
        )
        for f in held for category, broken in _faults(f)
    ]
    none = F.lit(None).cast("string")
    absent = [(f.name,) for f in resource.fields if f.name not in rows.columns]
    schema = rows.sparkSession.createDataFrame(absent, "field string").select("field", F.lit("schema").alias("category"), none.alias("row_key"), none.alias("value"))
    found = rows.select(F.inline(F.array_compact(F.array(*faults)))).unionByName(schema) if faults else schema
    return found.select(F.lit(resource.name).alias("resource"), "field", "category", "row_key", "value", none.alias("first_row"))


def key_violations(rows: DataFrame, resource: Resource, key: str) -> DataFrame | None:
    """The second and later rows of every value of a primary key or unique field, with the first row (the smallest
    ``key``). Keys with a missing part repeat nothing."""
    kinds = [("primary_key", resource.primary_key)] if resource.primary_key else []
    kinds += [("unique", (f.name,)) for f in resource.fields if f.unique and (f.name,) != resource.primary_key]
    out = None
    for category, columns in kinds:
        parts = [F.col(c).cast("string") for c in columns]
        whole = F.when(~F.greatest(F.lit(False), *(is_missing(p) for p in parts)), F.to_json(F.array(*parts)))
        keyed = rows.select(whole.alias("_whole"), F.col(key).alias("_row"), F.concat_ws(", ", *parts).alias("value")).where("_whole is not null")
        repeated, facts = observed(keyed.groupBy("_whole").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("_first")).where("n > 1"), "n")
        later = join_by_value(keyed, repeated, ["_whole"], "n", facts=facts).where("_row > _first")
        found = later.select(
            F.lit(resource.name).alias("resource"), F.lit(", ".join(columns)).alias("field"), F.lit(category).alias("category"),
            F.col("_row").cast("string").alias("row_key"), "value", F.col("_first").cast("string").alias("first_row"),
        )
        out = found if out is None else out.unionByName(found)
    return out


def reference_violations(tables: dict[str, DataFrame], resource: Resource, key: str) -> DataFrame | None:
    """Rows whose foreign key is complete and held by no row of the table it refers to."""
    out = None
    for reference in resource.foreign_keys:
        parent = tables[reference.resource].select(*(F.col(p).cast("string").alias(f"_k{i}") for i, p in enumerate(reference.references))).distinct()
        parts = {f"_k{i}": F.col(c).cast("string") for i, c in enumerate(reference.columns)}
        child = tables[resource.name].select(F.col(key).cast("string").alias("row_key"), *(p.alias(n) for n, p in parts.items()))
        for name in parts:
            child = child.where(~is_missing(F.col(name)))
        found = child.join(parent, list(parts), "left_anti").select(
            F.lit(resource.name).alias("resource"), F.lit(", ".join(reference.columns)).alias("field"), F.lit("foreign_key").alias("category"),
            "row_key", F.concat_ws(", ", *parts).alias("value"), F.lit(None).cast("string").alias("first_row"),
        )
        out = found if out is None else out.unionByName(found)
    return out


def validate_contract(tables: dict[str, DataFrame], contract: Contract, keys: dict[str, str]) -> DataFrame:
    """(resource, field, category, severity, row_key, value, first_row): every violation of ``tables`` (by resource
    name) against ``contract``. ``keys`` names the column that identifies a row of each table; its order decides which
    row of a repeated key is the first. Empty tables have schema faults at most; extra columns are ignored."""
    out = None
    for resource in contract.resources:
        key = keys[resource.name]
        found = [row_violations(tables[resource.name], resource, key), key_violations(tables[resource.name], resource, key), reference_violations(tables, resource, key)]
        for part in found:
            if part is not None:
                out = part if out is None else out.unionByName(part)
    return out.select("resource", "field", "category", severity(F.col("category")).alias("severity"), "row_key", "value", "first_row")


def report_order(violations: DataFrame) -> list[Column]:
    """The columns that order a report of violations: resource, row (those without one first), field, category."""
    number = F.col("row_key").try_cast("bigint")
    return [F.col("resource"), F.coalesce(number, F.lit(-1)), F.coalesce("row_key", F.lit("")), F.coalesce("field", F.lit("")), F.col("category")]


def category_counts(violations: DataFrame, contract: Contract) -> DataFrame:
    """(resource, category, findings) over all resources and categories, with 0 where there is none."""
    spark = violations.sparkSession
    grid = spark.createDataFrame([(r.name, c) for r in contract.resources for c in CATEGORIES], "resource string, category string")
    counts = violations.groupBy("resource", "category").agg(F.count(F.lit(1)).alias("findings"))
    return grid.join(F.broadcast(counts), ["resource", "category"], "left").na.fill(0, ["findings"])
