"""How results change when questionable outcomes are left out. Nothing is corrected or refitted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creekline.functions import fixed_values as fixed
from creekline.operators.errors import error_sums, finish_errors

PREDICTION_KEY = ["site", "date", "target"]
FLAGS = [
    "ambiguous_site_label", "formula_protocol_review", "any_formula_difference",
    "reported_turbidity_nonmeter_or_missing_method", "formula_checked",
]


def assert_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    """Raise when a key repeats; counted where the data is, one row comes back."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    if not repeated.isEmpty():
        raise ValueError(f"{what}: {', '.join(keys)} must be unique")


def join_many_to_one(checks: DataFrame, raw: DataFrame, key: Sequence[str] = ("csv_file", "csv_line")) -> DataFrame:
    """Site, date and target of every check; any flagged replicate marks its aggregate.

    Records are named by file and line; where no file is kept, there is one file.
    """
    key = [k for k in key if k in checks.columns and k in raw.columns]
    assert_unique(raw, key, "source rows")
    return checks.join(raw.select(*key, "site", "date"), key).select(*PREDICTION_KEY).distinct()


def union_keys(*tables: DataFrame) -> DataFrame:
    """Distinct union of flagged keys."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out.distinct()


def flag_membership(df: DataFrame, keys: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """True where the row's key is among ``keys``."""
    marked = keys.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(marked, list(on), "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def unknown_method_days(raw: DataFrame, method: str = fixed.METHOD_COLUMN) -> DataFrame:
    """Site-days with a turbidity row whose method is not the meter."""
    return raw.filter(F.col(method) != fixed.METER_METHOD).select("site", "date").distinct()


def observation_flags(
    predictions: DataFrame,
    ambiguous_sites: DataFrame,
    protocol_review: DataFrame,
    any_difference: DataFrame,
    unknown_method: DataFrame,
    checked: DataFrame,
    method_target: str = "turbidity_reported",
) -> DataFrame:
    """All flags per prediction. A missing formula check does not confirm an outcome.

    The three formula flags share a key, so they are combined first and joined once.
    """
    tables = {
        "formula_protocol_review": protocol_review,
        "any_formula_difference": any_difference,
        "formula_checked": checked,
    }
    marks = None
    for name, keys in tables.items():
        part = keys.select(*PREDICTION_KEY, *[F.lit(n == name).alias(n) for n in tables])
        marks = part if marks is None else marks.unionByName(part)
    marks = marks.groupBy(*PREDICTION_KEY).agg(*[F.max(n).alias(n) for n in tables])
    out = predictions.join(marks, PREDICTION_KEY, "left").withColumns(
        {n: F.coalesce(F.col(n), F.lit(False)) for n in tables}
    )
    out = flag_membership(out, ambiguous_sites, ["site"], "ambiguous_site_label")
    out = flag_membership(out, unknown_method, ["site", "date"], "_unknown_method")
    flag = (F.col("target") == method_target) & F.col("_unknown_method")
    return out.withColumn("reported_turbidity_nonmeter_or_missing_method", flag).drop("_unknown_method")


def scenario_masks() -> dict[str, Column]:
    ambiguous = F.col("ambiguous_site_label")
    different = F.col("any_formula_difference")
    method = F.col("reported_turbidity_nonmeter_or_missing_method")
    return {
        "all_test_observations": F.lit(True),
        "exclude_ambiguous_site_labels": ~ambiguous,
        "exclude_protocol_formula_flags": ~F.col("formula_protocol_review"),
        "exclude_any_formula_difference": ~different,
        "reported_turbidity_meter_only": ~method,
        "combined_conservative_subset": ~(ambiguous | different | method),
    }


def _by_scenario(df: DataFrame, names: Sequence[str]) -> DataFrame:
    masks = scenario_masks()
    entries = [
        F.struct(F.lit(name).alias("scenario"), masks[name].alias("included")) for name in names
    ]
    return df.select("*", F.explode(F.array(*entries)).alias("_s")).select("*", "_s.*").drop("_s")


def sensitivity_scenarios(flagged: DataFrame) -> DataFrame:
    """Error summary per target and scenario; a target left without samples keeps its row.

    Errors are summed per target, site and flag pattern first; the scenarios repeat only those.
    """
    cells = flagged.groupBy("target", F.col("site").alias("_site"), *FLAGS).agg(*error_sums())
    return finish_errors(
        _by_scenario(cells, list(scenario_masks())), ["target", "scenario"], "_site", F.col("included")
    )


def scenario_gains(flagged: DataFrame) -> DataFrame:
    """Rows for the site bootstrap of the full and the conservative set: target, scenario, site, gain."""
    rows = flagged.select(
        "target", "site", (F.col("baseline_error") - F.col("error")).alias("gain"), *FLAGS
    )
    wanted = ["all_test_observations", "combined_conservative_subset"]
    return _by_scenario(rows, wanted).filter("included").select("target", "scenario", "site", "gain")
