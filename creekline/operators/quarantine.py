"""Row and cell quarantine: bad input leaves with a recorded reason, never silently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creekline.functions import fixed_values as fixed
from creekline.functions.scalar import (
    null_if_outside, strip, to_number, to_sample_date,
)
from creekline.functions.specs import TargetSpec, in_range

EXTRA_PREFIX = "_c"


def extra_columns(df: DataFrame, prefix: str = EXTRA_PREFIX) -> list[str]:
    """Columns that had no header: the prefix followed by a number."""
    return [c for c in df.columns if c.startswith(prefix) and c[len(prefix):].isdigit()]


def has_overflow(extras: Sequence[str]) -> Column:
    """A shifted row spills into columns that have no header."""
    if not extras:
        return F.lit(False)
    return F.exists(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in extras]), lambda x: x != "")


def bad_site(site: Column) -> Column:
    return ~F.coalesce(site, F.lit("")).rlike(fixed.SITE_PATTERN)


def bad_created(created: Column) -> Column:
    return ~F.coalesce(created, F.lit("")).rlike(fixed.CREATED_PREFIX)


def bad_date(date: Column) -> Column:
    return date.isNull()


def after_snapshot(date: Column, snapshot: str) -> Column:
    return F.coalesce(date > F.lit(snapshot).cast("date"), F.lit(False))


def row_rules(df: DataFrame, snapshot: str) -> dict[str, Column]:
    """Structural rules in the order their reasons are written."""
    date = to_sample_date(F.col(fixed.SAMPLE_TIME_COLUMN))
    return {
        "nonempty_extra_columns": has_overflow(extra_columns(df)),
        "invalid_site_identifier": bad_site(F.col(fixed.SITE_COLUMN)),
        "invalid_or_shifted_metadata": bad_created(F.col(fixed.CREATED_COLUMN)),
        "invalid_date": bad_date(date),
        "sample_after_snapshot": after_snapshot(date, snapshot),
    }


def v1_row_rules(df: DataFrame, snapshot: str, kind: str) -> dict[str, Column]:
    """First-generation rules: two other reason names, and bacteria rows need a valid target."""
    renamed = {
        "invalid_or_shifted_metadata": "shifted_or_invalid_metadata",
        "sample_after_snapshot": "sample_after_export_date",
    }
    rules = {renamed.get(name, name): rule for name, rule in row_rules(df, snapshot).items()}
    if kind == "bacteria":
        ecoli = to_number(F.col("Average_e_coli"))
        rules["missing_or_negative_target"] = ecoli.isNull() | (ecoli < 0)
    return rules


def line_columns(df: DataFrame) -> list[str]:
    """What names a source record: its line and, where kept, its file."""
    return [c for c in ("csv_file", "csv_line") if c in df.columns]


def with_reason(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``reason`` joins every broken rule as ``name;``; an empty text means the row is good."""
    broken = [F.when(rule, F.lit(f"{name};")) for name, rule in rules.items()]
    return df.withColumn("reason", F.concat_ws("", F.array(*broken)))


def quarantine_rows(
    df: DataFrame, snapshot: str, rules: dict[str, Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Good rows with ``site`` and ``date``, and the excluded rows with their reasons."""
    judged = with_reason(df, row_rules(df, snapshot) if rules is None else rules)
    good = judged.filter(F.col("reason") == "").select(
        "*",
        F.col(fixed.SITE_COLUMN).alias("site"),
        to_sample_date(F.col(fixed.SAMPLE_TIME_COLUMN)).alias("date"),
    ).drop("reason")
    excluded = judged.filter(F.col("reason") != "").select("source", *line_columns(df), "globalid", "reason")
    return good, excluded


def ingest_audit(df: DataFrame, snapshot: str) -> DataFrame:
    """Input, excluded and retained rows per source."""
    excluded = F.when(F.col("reason") != "", 1).otherwise(0).cast("bigint")
    return (
        with_reason(df, row_rules(df, snapshot))
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("input_rows"), F.sum(excluded).alias("structurally_excluded_rows"))
        .withColumn("retained_rows", F.col("input_rows") - F.col("structurally_excluded_rows"))
    )


def wide_to_long(good: DataFrame, specs: Sequence[TargetSpec], source: str) -> DataFrame:
    """One row per source row and measurement: ``target`` with its stripped ``text``."""
    wanted = [s for s in specs if s.source == source]
    lines = line_columns(good)
    return good.select(
        F.lit(source).alias("source"), *lines, "site", "date", "waterbody",
        *[strip(F.coalesce(F.col(s.column), F.lit(""))).alias(s.target) for s in wanted],
    ).unpivot(
        ["source", *lines, "site", "date", "waterbody"], [s.target for s in wanted], "target", "text"
    )


def judged_cells(cells: DataFrame, specs: Sequence[TargetSpec]) -> DataFrame:
    """Add ``value`` and ``bad``. A blank cell is missing, not bad."""
    value = to_number(F.col("text"))
    usable = F.coalesce(in_range(specs, F.col("target"), value), F.lit(False))
    return cells.withColumn("value", value).withColumn("bad", (F.col("text") != "") & ~usable)


def quarantine_cells(cells: DataFrame, specs: Sequence[TargetSpec]) -> tuple[DataFrame, DataFrame]:
    """Valid measurements, and the cells that are no number or outside the accepted range."""
    judged, lines = judged_cells(cells, specs), line_columns(cells)
    valid = judged.filter((F.col("text") != "") & ~F.col("bad")).select(
        "source", *lines, "site", "date", "target", "value", "waterbody"
    )
    rejected = judged.filter("bad").select(
        "source", *lines, "target", F.col("text").alias("value"),
        F.lit("non_numeric_or_outside_configured_range").alias("reason"),
    )
    return valid, rejected


def v1_measurements(good: DataFrame, kind: str) -> DataFrame:
    """First-generation numeric columns; values outside their range become NULL."""
    ranges = fixed.V1_TEMPERATURES if kind == "bacteria" else fixed.V1_CHEMISTRY
    columns = [
        null_if_outside(to_number(F.col(name)), float(low), float(high)).alias(name)
        for name, (low, high) in ranges.items()
    ]
    if kind == "bacteria":
        columns.insert(0, to_number(F.col("Average_e_coli")).alias("ecoli"))
    return good.select("csv_line", "site", "date", *columns, "watershed", "waterbody")


def target_coverage(obs: DataFrame, eligible: DataFrame, spec_rows: DataFrame) -> DataFrame:
    """Per target: valid site-days, sites, dates and eligible forecasts; empty targets kept."""
    seen = obs.groupBy("target").agg(
        F.count(F.lit(1)).alias("valid_site_days"),
        F.count_distinct("site").alias("sites"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    forecasts = eligible.groupBy("target").agg(F.count(F.lit(1)).alias("eligible_forecasts"))
    zero = F.lit(0).cast("bigint")
    return (
        spec_rows.join(seen, "target", "left")
        .join(forecasts, "target", "left")
        .select(
            "target", "label",
            F.coalesce("valid_site_days", zero).alias("valid_site_days"),
            F.coalesce("sites", zero).alias("sites"),
            "first_date", "last_date",
            F.coalesce("eligible_forecasts", zero).alias("eligible_forecasts"),
            F.col("column").alias("source_column"), "caution",
        )
    )
