"""Target rows of a mapping, rejected rows with reasons, and the lineage of every written cell."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.text import is_missing


@dataclass(frozen=True)
class FieldMapping:
    """How a target field is made: ``copy``, ``constant`` or ``value_map`` (misses: reject_row, keep_original, empty)."""

    target: str
    source: str
    kind: str = "copy"
    value: str = ""
    values: dict[str, str] = field(default_factory=dict)
    on_missing: str = "reject_row"
    required: bool = False

    def _mapped(self) -> Column:
        return F.create_map(*(F.lit(x) for pair in self.values.items() for x in pair))[F.col(self.source).cast("string")]

    def cell(self) -> Column:
        source = F.col(self.source).cast("string")
        if self.kind == "constant":
            return F.lit(self.value)
        if self.kind == "copy":
            return F.coalesce(source, F.lit(""))
        if self.on_missing == "keep_original":
            return F.coalesce(self._mapped(), source, F.lit(""))
        return F.coalesce(self._mapped(), F.lit(""))

    def fault(self) -> Column:
        reason = F.lit(None).cast("string")
        source = F.col(self.source).cast("string")
        if self.kind == "value_map" and self.on_missing == "reject_row":
            reason = F.when(~is_missing(source) & self._mapped().isNull(), f"value_map_missing:{self.target}")
        if self.required and self.kind != "constant":
            reason = F.when(is_missing(source), f"missing_required_source_value:{self.target}").otherwise(reason)
        return reason


def build(rows: DataFrame, record_id: str, mappings: list[FieldMapping]) -> DataFrame:
    """(record_id, reject_reason, targets...): the first failing field in order decides."""
    reason = F.coalesce(F.when(is_missing(F.col(record_id).cast("string")), "missing_record_id"), *(m.fault() for m in mappings))
    return rows.select(F.col(record_id).cast("string").alias("record_id"), reason.alias("reject_reason"), *(m.cell().alias(m.target) for m in mappings))


def lineage(rows: DataFrame, record_id: str, mappings: list[FieldMapping]) -> DataFrame:
    """(record_id, target, source, transformation, source_sha256) for each non-empty cell of the kept rows; the hash is
    that of the source value. One pass, no shuffle."""
    cells = F.array(
        *(
            F.struct(
                F.lit(m.target).alias("target"), F.lit(m.source).alias("source"), F.lit(m.kind).alias("transformation"),
                F.sha2(F.coalesce(F.col(m.source).cast("string"), F.lit("")), 256).alias("source_sha256"), m.cell().alias("cell"),
            )
            for m in mappings
        )
    )
    reason = F.coalesce(F.when(is_missing(F.col(record_id).cast("string")), "missing_record_id"), *(m.fault() for m in mappings))
    return (
        rows.where(reason.isNull())
        .select(F.col(record_id).cast("string").alias("record_id"), F.inline(cells))
        .where("cell <> ''").drop("cell")
    )
