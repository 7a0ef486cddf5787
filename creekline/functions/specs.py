"""Measurement specifications and limits.

They are configuration: a handful of rows known when a plan is built. Lookups therefore
become literal CASE expressions inside the scan's stage, with no join and no broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creekline.functions import fixed_values as fixed

SPEC_SCHEMA = (
    "target string, ord int, source string, column string, label string, transform string, "
    "direction string, min double, max double, caution string"
)
LIMIT_SCHEMA = "target string, min double, max double, basis string"


@dataclass(frozen=True)
class TargetSpec:
    target: str
    source: str
    column: str
    label: str
    transform: str = "identity"
    direction: str = "high"
    min: float | None = None
    max: float | None = None
    caution: str = ""


@dataclass(frozen=True)
class LimitSpec:
    target: str
    min: float | None = None
    max: float | None = None
    basis: str = ""


def _bound(value) -> float | None:
    return None if value is None else float(value)


def default_specs() -> list[TargetSpec]:
    return [TargetSpec(*row[:6], _bound(row[6]), _bound(row[7]), row[8]) for row in fixed.TARGETS]


def default_limits() -> list[LimitSpec]:
    return [LimitSpec(name, _bound(low), _bound(high), basis) for name, low, high, basis in fixed.LIMITS]


def _read_json(spark: SparkSession, path: str) -> dict:
    """Read one small configuration file through Spark, so any file system works."""
    files = spark.read.format("binaryFile").load(path)
    return json.loads(bytes(files.select("content").first()[0]).decode("utf-8"))


def load_specs(spark: SparkSession, path: str) -> list[TargetSpec]:
    """Measurement specifications from a JSON object keyed by target, in file order."""
    return [
        TargetSpec(
            name, item["source"], item["column"], item["label"], item["transform"], item["direction"],
            _bound(item.get("min")), _bound(item.get("max")), item.get("caution", ""),
        )
        for name, item in _read_json(spark, path).items()
    ]


def load_limits(spark: SparkSession, path: str, specs: Sequence[TargetSpec]) -> list[LimitSpec]:
    """Limits for known targets; other keys (such as the source note) are dropped."""
    known = {s.target for s in specs}
    return [
        LimitSpec(name, _bound(item.get("min")), _bound(item.get("max")), item.get("basis", ""))
        for name, item in _read_json(spark, path).items()
        if name in known
    ]


def spec_frame(spark: SparkSession, specs: Sequence[TargetSpec]) -> DataFrame:
    rows = [
        (s.target, i, s.source, s.column, s.label, s.transform, s.direction, s.min, s.max, s.caution)
        for i, s in enumerate(specs)
    ]
    return spark.createDataFrame(rows, SPEC_SCHEMA)


def limit_frame(spark: SparkSession, limits: Sequence[LimitSpec]) -> DataFrame:
    return spark.createDataFrame([(x.target, x.min, x.max, x.basis) for x in limits], LIMIT_SCHEMA)


def names(specs: Iterable[TargetSpec]) -> list[str]:
    return [s.target for s in specs]


def choose(target: Column, pairs: dict[str, object], kind: str) -> Column:
    """A literal per target, NULL for targets not listed."""
    out = None
    for name, value in pairs.items():
        if value is None:
            continue
        literal = F.lit(value).cast(kind)
        out = F.when(target == name, literal) if out is None else out.when(target == name, literal)
    return F.lit(None).cast(kind) if out is None else out


def spec_value(specs: Sequence[TargetSpec], field: str, target: Column, kind: str = "string") -> Column:
    return choose(target, {s.target: getattr(s, field) for s in specs}, kind)


def transform(specs: Sequence[TargetSpec], target: Column, value: Column) -> Column:
    """Source units to the scale models work in."""
    logs = [s.target for s in specs if s.transform == "log1p"]
    return F.when(target.isin(*logs), F.log1p(value)).otherwise(value) if logs else value


def inverse(specs: Sequence[TargetSpec], target: Column, value: Column) -> Column:
    """Back to source units, clipped to the accepted range; NULL stays NULL."""
    logs = [s.target for s in specs if s.transform == "log1p"]
    raw = F.when(target.isin(*logs), F.expm1(value)).otherwise(value) if logs else value
    high = spec_value(specs, "max", target, "double")
    low = spec_value(specs, "min", target, "double")
    return F.when(raw.isNotNull(), F.greatest(F.least(raw, high), low))


def nonnegative_inverse(value: Column) -> Column:
    """First-generation inverse: log scale floored at zero."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.expm1(value)))


def in_range(specs: Sequence[TargetSpec], target: Column, value: Column) -> Column:
    low = F.coalesce(spec_value(specs, "min", target, "double"), F.lit(float("-inf")))
    high = F.coalesce(spec_value(specs, "max", target, "double"), F.lit(float("inf")))
    return (value >= low) & (value <= high)
