"""Applying a feed of inserts, updates and deletes to a bucketed table by copy-on-write.

The table is a set of hash buckets of parquet files and a chain of manifests. Each bucket has its snapshot (the base
rows), a log of the changes applied since, and the state that follows from both. One call of :func:`apply_changes`
routes the changes to buckets, adds them to the logs of the touched buckets, merges there the whole log and the
snapshot in sequence order, writes replacement files of the state and commits a new manifest that points to the
replaced and to the untouched files. Changes may therefore arrive in any order and in any number of calls. A failed
job leaves no trace in the committed state, since the manifest is written last and renamed into place.

The merge never sorts all changes of one key in one task. A change, a base row and any run of changes are all the
same kind of thing, a function from the item's state before to its state after, kept as a struct (``cut``, ``ex``,
``st`` ...). Runs are composed first within ranges of ``2 ** RANGE_BITS`` sequence numbers, then level by level, so
one key may hold any share of the feed. A base row acts as a change at its ``applied_sequence`` that fixes the state;
changes at or below it are thereby without effect and no join between base and feed is needed.

The log is never cut, since any change may still get an earlier one; its size grows with the feed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.skew import blank_to_null
from keelson.storage import workspace

RANGE_BITS = 14
#: Rows aimed at per bucket of the base table; the number of buckets follows from it.
ROWS_PER_BUCKET = 1_000_000
LEAST_BUCKETS = 8
VALUES = ("st", "of")
# The written forms of the three kinds of change.
KIND_OF = {
    "i": "I", "ins": "I", "insert": "I",
    "u": "U", "upd": "U", "update": "U",
    "d": "D", "del": "D", "delete": "D",
}
BASE_SCHEMA = "entity_id string, st string, of string, gone boolean, applied_sequence bigint, bucket int"
LOG_SCHEMA = "entity_id string, sequence bigint, kind string, st string, of string"


def _path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file and rename it into place, so that readers see all of it or nothing."""
    temporary, fs = _path(spark, path + ".tmp")
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(temporary, _path(spark, path)[0]):
        raise OSError(f"{path} could not be committed")


@dataclass(frozen=True)
class BucketedTable:
    """A committed state: for each bucket the folder that holds its file; buckets without rows have none.

    ``snapshot`` holds the folders of the base rows, ``logs`` those of the changes applied since, ``span`` the lowest
    and highest sequence among them."""

    root: str
    version: int
    buckets: int
    folders: dict[int, str] = field(default_factory=dict)
    snapshot: dict[int, str] = field(default_factory=dict)
    logs: dict[int, list[str]] = field(default_factory=dict)
    span: tuple[int, int] | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        return _read(spark, [p for _, p in sorted(self.folders.items())], BASE_SCHEMA)

    def read_snapshot(self, spark: SparkSession, only: set[int]) -> DataFrame:
        return _read(spark, [p for b, p in sorted(self.snapshot.items()) if b in only], BASE_SCHEMA)

    def commit(self, spark: SparkSession) -> BucketedTable:
        text = {"version": self.version, "buckets": self.buckets, "folders": self.folders, "snapshot": self.snapshot, "logs": self.logs, "span": self.span}
        _put(spark, f"{self.root}/manifest-{self.version:08d}.json", json.dumps(text))
        return self

    @staticmethod
    def load(spark: SparkSession, root: str) -> BucketedTable:
        """The latest committed state below ``root``."""
        jpath, fs = _path(spark, root)
        names = sorted(s.getPath().getName() for s in fs.listStatus(jpath))
        last = [n for n in names if n.startswith("manifest-") and n.endswith(".json")][-1]
        text = json.loads(spark.read.text(f"{root}/{last}", wholetext=True).first()[0])
        folders, snapshot, logs = ({int(b): p for b, p in text.get(k, {}).items()} for k in ("folders", "snapshot", "logs"))
        # In a table of a version without logs, its state is all there is.
        snapshot = snapshot if "snapshot" in text else folders
        return BucketedTable(root, text["version"], text["buckets"], folders, snapshot, logs, tuple(text["span"]) if text.get("span") else None)


def _read(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("entity_id"), F.lit(buckets)).cast("int")


def entity_key(column: Column) -> Column:
    """Ids in upper case without surrounding blanks; blank ids are missing."""
    return F.upper(blank_to_null(F.regexp_replace(column, r"^[\s ]+|[\s ]+$", "")))


def _write(rows: DataFrame, folder: str, *spread: Column) -> dict[int, str]:
    """Write the buckets of ``rows`` as files of their own, or as several each by ``spread``; returns where each written
    bucket lies. What an uncommitted attempt left there is replaced."""
    rows.repartition("bucket", *spread).withColumn("part", F.col("bucket")).write.partitionBy("part").mode("overwrite").parquet(folder)
    jpath, fs = _path(rows.sparkSession, folder)
    names = [s.getPath().getName() for s in fs.listStatus(jpath) if s.isDirectory()]
    return {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith("part=")}


def create_table(base: DataFrame, root: str | None = None, buckets: int | None = None, expected: int = 0) -> BucketedTable:
    """A bucketed table from ``base`` (entity_id, status, effective_offset, applied_sequence), with buckets for its rows
    and for ``expected`` rows to come.

    Rows without an id are left out. Of repeated ids the row with the highest applied_sequence is kept (ties: the
    largest status, then offset), so the result does not depend on the order of rows. Other columns are ignored.
    """
    spark = base.sparkSession
    root = root or workspace(spark, "table")
    buckets = buckets or max(LEAST_BUCKETS, -(-(base.count() + expected) // ROWS_PER_BUCKET))
    row = F.struct(
        F.coalesce(F.col("applied_sequence").cast("bigint"), F.lit(-(2**62))).alias("applied_sequence"),
        blank_to_null(F.col("status")).alias("st"),
        blank_to_null(F.col("effective_offset")).alias("of"),
    )
    rows = (
        base.select(entity_key(F.col("entity_id")).alias("entity_id"), row.alias("row"))
        .where("entity_id is not null")
        .groupBy("entity_id")
        .agg(F.max("row").alias("row"))
        .select(
            "entity_id", "row.st", "row.of", F.lit(False).alias("gone"), "row.applied_sequence", _bucket(buckets).alias("bucket")
        )
    )
    written = _write(rows, f"{root}/v0")
    return BucketedTable(root, 0, buckets, written, written).commit(spark)


def _effect(kind: Column, st: Column, of: Column) -> Column:
    """The change as a state function: ``cut`` says that the state before does not matter, (``ex``, ``st``, ``of``) is
    the state after if the item did not exist before, (``ust``, ``uof``) are the values an existing item gets.
    Kinds: I, U, D of the feed; S and T are base rows, T one of an item that is gone."""
    none = F.lit(None).cast("string")
    makes = kind.isin("I", "S")
    return F.struct(
        kind.isin("S", "T", "D").alias("cut"),
        makes.alias("ex"),
        F.when(makes, st).otherwise(none).alias("st"),
        F.when(makes, of).otherwise(none).alias("of"),
        F.when(kind.isin("I", "U"), st).otherwise(none).alias("ust"),
        F.when(kind.isin("I", "U"), of).otherwise(none).alias("uof"),
    )


def _then(first: Column, second: Column) -> Column:
    """The effect of ``first`` and then ``second``."""
    chained = F.struct(
        first["cut"].alias("cut"),
        (first["ex"] | second["ex"]).alias("ex"),
        *(
            F.when(first["ex"], F.coalesce(second["u" + v], first[v])).otherwise(second[v]).alias(v)
            for v in VALUES
        ),
        *(F.coalesce(second["u" + v], first["u" + v]).alias("u" + v) for v in VALUES),
    )
    return F.when(second["cut"], second).otherwise(chained)


def _compose(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Compose the effects of each group in the order of (sequence, turn); groups are bounded by the caller."""
    nothing = F.struct(
        F.lit(False).alias("cut"),
        F.lit(False).alias("ex"),
        *(F.lit(None).cast("string").alias(v) for v in ("st", "of", "ust", "uof")),
    )
    ordered = F.array_sort(F.collect_list(F.struct("sequence", "turn", "effect")))
    return (
        parts.groupBy(*keys)
        .agg(ordered.alias("run"))
        .select(
            *keys,
            F.element_at("run", -1)["sequence"].alias("sequence"),
            F.element_at("run", -1)["turn"].alias("turn"),
            F.aggregate("run", nothing, lambda acc, x: _then(acc, x["effect"])).alias("effect"),
        )
    )


def normalise_changes(changes: DataFrame) -> DataFrame:
    """(entity_id, sequence, kind, st, of) of the usable rows of a feed.

    Rows without sequence, entity_id or a known change_type in any copy change nothing. Values of white space count
    as left out. ``effective_offset`` and ``new_status`` may be NULL.
    """
    kinds = F.create_map(*(F.lit(x) for pair in KIND_OF.items() for x in pair))
    return changes.select(
        entity_key(F.col("entity_id")).alias("entity_id"),
        F.col("sequence").cast("bigint").alias("sequence"),
        kinds[F.lower(F.trim("change_type"))].alias("kind"),
        blank_to_null(F.col("new_status")).alias("st"),
        blank_to_null(F.col("effective_offset")).alias("of"),
    ).where("entity_id is not null and sequence is not null")


def apply_changes(table: BucketedTable, changes: DataFrame) -> BucketedTable:
    """Apply a feed (entity_id, sequence, change_type, new_status, effective_offset) and commit the next version.

    Rows with the same entity and sequence are one change; its values are taken from whichever copies have them (the
    largest, should copies differ). An insert of an existing item acts as an update, an update of an item that does
    not exist and changes at or below the base row's applied_sequence have no effect. Each call merges all changes so
    far, so any split of a feed over calls, in any order, gives the state of the feed at once. An empty feed returns
    the table as it is.
    """
    spark = changes.sparkSession
    version = table.version + 1
    piece = F.shiftright("sequence", RANGE_BITS)
    logged = _write(normalise_changes(changes).withColumn("bucket", _bucket(table.buckets)), f"{table.root}/log{version}", piece)
    touched = set(logged)
    if not touched:
        return table
    facts = _read(spark, list(logged.values()), LOG_SCHEMA).agg(F.min("sequence").alias("low"), F.max("sequence").alias("high")).first()
    low, high = (facts["low"], facts["high"]) if table.span is None else (min(facts["low"], table.span[0]), max(facts["high"], table.span[1]))
    logs = table.logs | {b: [*table.logs.get(b, []), p] for b, p in logged.items()}
    feed = _read(spark, [p for b in sorted(touched) for p in logs[b]], LOG_SCHEMA)
    base = table.read_snapshot(spark, touched).select(
        "entity_id", F.col("applied_sequence").alias("sequence"),
        F.when(F.col("gone"), "T").otherwise("S").alias("kind"), "st", "of", F.lit(1).alias("turn"),
    )
    one_each = (
        feed.withColumn("turn", F.lit(0)).unionByName(base)
        .withColumn("piece", piece)
        .repartition("entity_id", "piece")
        .groupBy("entity_id", "piece", "sequence", "turn")
        .agg(F.max("kind").alias("kind"), F.max("st").alias("st"), F.max("of").alias("of"))
        .where("kind is not null")
    )
    effect = _effect(F.col("kind"), F.col("st"), F.col("of"))
    parts = _compose(one_each.withColumn("effect", effect), ["entity_id", "piece"])
    span = (high >> RANGE_BITS) - (low >> RANGE_BITS)
    while span >> RANGE_BITS:
        parts = _compose(parts.withColumn("piece", F.shiftright("piece", RANGE_BITS)), ["entity_id", "piece"])
        span >>= RANGE_BITS
    merged = _compose(parts, ["entity_id"]).select(
        "entity_id", "effect.st", "effect.of", (~F.col("effect.ex")).alias("gone"),
        F.col("sequence").alias("applied_sequence"), _bucket(table.buckets).alias("bucket"),
    )
    written = _write(merged, f"{table.root}/v{version}")
    return BucketedTable(table.root, version, table.buckets, table.folders | written, table.snapshot, logs, (low, high)).commit(spark)


def current_state(table: BucketedTable, spark: SparkSession) -> DataFrame:
    """(entity_id, current_status, current_offset) of the items that exist."""
    return (
        table.read(spark)
        .where("not gone")
        .select("entity_id", F.col("st").alias("current_status"), F.col("of").alias("current_offset"))
    )


def replay(base: DataFrame, changes: DataFrame) -> DataFrame:
    """The items that exist after ``changes`` were applied to ``base``: create a table, apply, read it."""
    return current_state(apply_changes(create_table(base, expected=changes.count()), changes), base.sparkSession)
