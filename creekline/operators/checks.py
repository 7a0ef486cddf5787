"""Checks of source values: profiles, arithmetic, methods, timing and identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creekline.functions import fixed_values as fixed
from creekline.functions.scalar import (
    is_close, strip, text_key, to_number, to_sample_time,
)
from creekline.functions.specs import TargetSpec
from creekline.operators.quarantine import line_columns, wide_to_long
from creekline.operators.ranking import exact_quantiles

MICROS_PER_DAY = 86_400_000_000


def profile_measurements(good: DataFrame, specs: Sequence[TargetSpec], source: str) -> DataFrame:
    """Per target: rows, numeric values, extremes, zeros and the most common value (lowest on ties)."""
    cells = wide_to_long(good, specs, source).withColumn("value", to_number(F.col("text")))
    # One row per distinct value first: the rest is small, however large a target is.
    counted = cells.groupBy("target", "value").agg(F.count(F.lit(1)).alias("n"))
    numeric = F.when(F.col("value").isNotNull(), F.col("n"))
    return counted.groupBy("target").agg(
        F.sum("n").alias("structurally_valid_rows"),
        F.coalesce(F.sum(numeric), F.lit(0)).alias("numeric_values"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing_or_nonnumeric"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        F.coalesce(F.sum(F.when(F.col("value") == 0, F.col("n"))), F.lit(0)).alias("zero_values"),
        F.min_by("value", F.when(F.col("value").isNotNull(), F.struct(-F.col("n"), F.col("value")))).alias(
            "most_common_value"
        ),
        F.coalesce(F.max(numeric), F.lit(0)).alias("most_common_count"),
    )


def _stacked(rows: DataFrame, ids: Sequence[str], entries: list[Column], kind: str) -> DataFrame:
    """A row per entry; none at all, if the table has none of the columns."""
    if not entries:
        return rows.select(*ids, F.from_json(F.lit("{}"), kind).alias("_e")).select(*ids, "_e.*").limit(0)
    return rows.select(*ids, F.explode(F.array(*entries)).alias("_e")).select(*ids, "_e.*")


def reviewed_vs_original(
    good: DataFrame, specs: Sequence[TargetSpec], reviewed: dict[str, str] | None = None
) -> DataFrame:
    """Cells whose reviewed copy is a different number."""
    reviewed = fixed.REVIEW_COLUMNS if reviewed is None else reviewed
    entries = [
        F.struct(
            F.lit(s.target).alias("target"),
            to_number(F.col(s.column)).alias("original"),
            to_number(F.col(reviewed[s.target])).alias("reviewed"),
        )
        for s in specs
        if s.target in reviewed and reviewed[s.target] in good.columns and s.column in good.columns
    ]
    pairs = _stacked(good, ["source", *line_columns(good)], entries, "target string, original double, reviewed double")
    both = F.col("original").isNotNull() & F.col("reviewed").isNotNull()
    return pairs.filter(both & ~is_close(F.col("original"), F.col("reviewed"), 1e-4, 0.01))


def discrepancy_type(match: Column, reported: Column, expected: Column) -> Column:
    return (
        F.when(match, "match")
        .when(F.abs(reported - expected) <= 0.5, "within_half_unit_rounding")
        .when((reported == 1) & (expected == 0), "possible_zero_floor_to_one")
        .otherwise("requires_protocol_review")
    )


def count_volume_check(
    good: DataFrame, reported: dict[str, str], counts: dict[str, Sequence[str]] | None = None,
    volume: str = fixed.VOLUME_COLUMN,
) -> DataFrame:
    """Mean of the replicate counts x 100 / volume against the reported average, complete rows only."""
    counts = fixed.COUNT_COLUMNS if counts is None else counts
    entries = []
    for target, columns in counts.items():
        parts = [to_number(F.col(c)) for c in columns]
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        size = to_number(F.col(volume))
        entries.append(
            F.struct(
                F.lit(target).alias("target"),
                to_number(F.col(reported[target])).alias("reported"),
                F.when(size > 0, F.try_divide(total / len(parts) * 100, size)).alias(
                    "candidate_count_volume_formula"
                ),
            )
        )
    kind = "target string, reported double, candidate_count_volume_formula double"
    rows = _stacked(good, line_columns(good), entries, kind).filter(
        F.col("reported").isNotNull() & F.col("candidate_count_volume_formula").isNotNull()
    )
    expected = F.col("candidate_count_volume_formula")
    match = is_close(F.col("reported"), expected, 0.001, 0.02)
    return rows.select(
        "*", match.alias("matches_candidate_formula"),
        discrepancy_type(match, F.col("reported"), expected).alias("discrepancy_type"),
    )


def derived_value_check(
    good: DataFrame, reported: dict[str, str], formulas: dict[str, tuple] | None = None
) -> DataFrame:
    """Mean of the parts x a factor against the reported value, complete rows only."""
    formulas = fixed.DERIVED_FORMULAS if formulas is None else formulas
    entries = []
    for target, (columns, factor) in formulas.items():
        parts = [to_number(F.col(c)) for c in columns]
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        entries.append(
            F.struct(
                F.lit(target).alias("target"),
                to_number(F.col(reported[target])).alias("reported"),
                (total / len(parts) * factor).alias("candidate_formula"),
            )
        )
    kind = "target string, reported double, candidate_formula double"
    rows = _stacked(good, line_columns(good), entries, kind).filter(
        F.col("reported").isNotNull() & F.col("candidate_formula").isNotNull()
    )
    match = is_close(F.col("reported"), F.col("candidate_formula"), 0.001, 0.05)
    return rows.withColumn("matches_candidate_formula", match)


def discrepancy_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("target", "discrepancy_type").agg(F.count(F.lit(1)).alias("rows"))


def review_rows(checks: DataFrame, source_file: str) -> DataFrame:
    """Rows that do not match, with blank columns for the data owner's answer."""
    kept = checks
    if "discrepancy_type" in checks.columns:
        kept = checks.filter(F.col("discrepancy_type") != "match").drop("matches_candidate_formula")
    else:
        kept = checks.filter(~F.col("matches_candidate_formula")).drop("matches_candidate_formula")
    order = [*line_columns(checks), "target", "reported", *[
        c for c in ("candidate_count_volume_formula", "candidate_formula", "discrepancy_type") if c in kept.columns
    ]]
    return kept.select(
        F.lit(source_file).alias("source_file"), *order,
        F.lit("").alias("correct_value"), F.lit("").alias("notes"),
    )


def method_crosstab(good: DataFrame, method: str = fixed.METHOD_COLUMN, value: str = "Turbidity") -> DataFrame:
    """Per recorded method: rows, numeric values and values equal to 8."""
    number = to_number(F.col(value))
    return good.groupBy(F.col(method).alias("method")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(number).alias("numeric_values"),
        F.count_if(number == 8).alias("value_equal_8"),
    )


def label_default(method: Column) -> Column:
    """Text for rows without a recorded method."""
    return F.when(method != "", method).otherwise(F.lit(fixed.NO_METHOD))


def timing_audit(good: DataFrame) -> DataFrame:
    """Per source: rows, midnight stamps, median creation lag in days, distinct creation dates."""
    sampled = to_sample_time(F.col(fixed.SAMPLE_TIME_COLUMN))
    created = to_sample_time(F.col(fixed.CREATED_COLUMN))
    rows = good.select(
        "source", sampled.alias("sampled"), created.alias("created"),
        ((F.unix_micros(created) - F.unix_micros(sampled)) / F.lit(float(MICROS_PER_DAY))).alias("lag"),
    )
    midnight = (F.hour("sampled") == 0) & (F.minute("sampled") == 0)
    counts = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(midnight).alias("midnight_sample_timestamps"),
        F.count_distinct(F.to_date("created")).alias("creation_dates"),
    )
    lags = exact_quantiles(rows, ["source"], "lag", {"median_creation_lag_days": 0.5})
    return counts.join(lags, "source", "left")


def site_identity_audit(raw: DataFrame) -> DataFrame:
    """Per site: rows, spelling variants of waterbody and location, dates, and the names used.

    Variants are made distinct per site before they are counted or joined into one text.
    """
    keyed = raw.select(
        "site", "date", "waterbody",
        text_key(F.col("waterbody")).alias("waterbody_key"),
        text_key(F.col(fixed.LOCATION_COLUMN)).alias("location_key"),
    )
    variants = keyed.groupBy("site", "waterbody", "waterbody_key", "location_key").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last")
    )
    located = F.when(F.col("location_key") != "", F.col("location_key"))
    counts = variants.groupBy("site").agg(
        F.sum("n").alias("rows"),
        F.count_distinct("waterbody_key").alias("waterbody_variants"),
        F.count_distinct(located).alias("location_variants"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
    )
    names = variants.select("site", "waterbody").distinct().groupBy("site").agg(
        F.array_join(F.sort_array(F.collect_list("waterbody")), "; ").alias("waterbodies")
    )
    return counts.join(names, "site")


def candidate_aliases(raw: DataFrame) -> DataFrame:
    """Site codes that share a normalised waterbody and location: candidates, never merged."""
    keyed = raw.select(
        "site", "csv_line", "waterbody", "source",
        text_key(F.col("waterbody")).alias("waterbody_key"),
        text_key(F.col(fixed.LOCATION_COLUMN)).alias("location_key"),
    ).filter(F.col("location_key") != "")
    per_site = keyed.groupBy("waterbody_key", "location_key", "site").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("source", "csv_line", "waterbody")).alias("first")
    )
    return (
        per_site.groupBy("waterbody_key", "location_key")
        .agg(
            F.min("first").alias("first"),
            F.array_join(F.sort_array(F.collect_list("site")), ";").alias("site_codes"),
            F.count(F.lit(1)).alias("site_count"),
            F.sum("n").alias("rows"),
        )
        .filter(F.col("site_count") > 1)
        .select(
            F.col("first.waterbody").alias("waterbody"), "site_codes", "site_count", "rows",
            F.lit(fixed.ALIAS_NOTE).alias("note"),
        )
    )


def site_conflicts(identities: DataFrame) -> DataFrame:
    """Sites under several names; only listed columns leave, blank names dropped."""
    names = F.filter(F.split("waterbodies", "; "), lambda x: strip(x) != "")
    return identities.filter(F.col("waterbody_variants") > 1).select(
        "site", "rows", "first_date", "last_date",
        F.array_join(names, "; ").alias("waterbodies"),
        F.lit("").alias("same_physical_site"), F.lit("").alias("authoritative_name"), F.lit("").alias("notes"),
    )
