"""Forecasts for planned visits: grid, status, forecasts, limits, what-if and overviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creekline.functions import fixed_values as fixed
from creekline.functions.scalar import is_finite, strip, three_digits
from creekline.functions.specs import (
    LimitSpec, TargetSpec, choose, in_range, inverse, names, spec_value, transform,
)
from creekline.operators.history import ELIGIBLE, history_features, issue_date
from creekline.operators.ranking import most_common
from creekline.operators.revisions import overlay

NO_MODEL = "insufficient_training_history"
OVERLAPS = "date_overlaps_training_information"
REGISTRY_SCHEMA = (
    "target string, selected string, selected_baseline string, median double, lower double, upper double, "
    "prevalence double, alert_cutoff double, training_end date, risk_selection string, "
    "test_mae double, regressor string, classifier string"
)


def scoring_grid(obs: DataFrame, specs: Sequence[TargetSpec], date: str) -> DataFrame:
    """Every site with every target on the planned date; targets are an array literal, not a join."""
    targets = F.array(*[F.lit(name) for name in names(specs)])
    return obs.select("site").distinct().select(
        "site", F.explode(targets).alias("target"), F.lit(date).cast("date").alias("date")
    )


def forecast_status(date: Column, training_end: Column, feature_status: Column) -> Column:
    """No model, then dates the model has information about, then the history's status."""
    return (
        F.when(training_end.isNull(), NO_MODEL)
        .when(date <= F.date_add(training_end, 10), OVERLAPS)
        .otherwise(feature_status)
    )


def status_text(status: Column) -> Column:
    out = status
    for name, text in fixed.STATUS_TEXT.items():
        out = F.when(status == name, text).otherwise(out)
    return out


def baseline_forecast(name: Column, median: Column) -> Column:
    """Forecast of a named baseline on the transformed scale."""
    return (
        F.when(name == "global_median", median)
        .when(name == "last_observation", F.col("last_value"))
        .when(name == "site_median", F.col("history_median"))
        .when(name == "site_seasonal", F.col("seasonal_site"))
    )


def limit_check(
    value: Column, target: Column, limits: Sequence[LimitSpec], specs: Sequence[TargetSpec], margin: Column
) -> tuple[Column, Column]:
    """Level and text: red past a limit, yellow within the margin of it; the upper side comes first."""
    high = choose(target, {x.target: x.max for x in limits}, "double")
    low = choose(target, {x.target: x.min for x in limits}, "double")

    def text(prefix: str, bound: Column) -> Column:
        return F.concat(F.lit(f"{prefix} the "), three_digits(bound), F.lit(" limit"))

    scaled = transform(specs, target, value)
    near = "within typical forecast error of"
    rules = [
        (value > high, "red", text("above", high)),
        (scaled > transform(specs, target, high) - margin, "yellow", text(near, high)),
        (value < low, "red", text("below", low)),
        (scaled < transform(specs, target, low) + margin, "yellow", text(near, low)),
    ]
    level = wording = None
    for rule, color, words in rules:
        hit = F.coalesce(rule, F.lit(False))
        level = F.when(hit, color) if level is None else level.when(hit, color)
        wording = F.when(hit, words) if wording is None else wording.when(hit, words)
    return level, wording


def limit_margins(limits: Sequence[LimitSpec], registry: DataFrame) -> DataFrame:
    """Margin per limited target: its test error on the transformed scale, 0 without one."""
    wanted = registry.sparkSession.createDataFrame([(x.target,) for x in limits], "target string")
    return wanted.join(registry.select("target", "test_mae"), "target", "left").select(
        "target", F.coalesce("test_mae", F.lit(0.0)).alias("margin")
    )


def grid_features(
    obs: DataFrame, specs: Sequence[TargetSpec], registry: DataFrame, date: str, cross: bool = True,
    sites: DataFrame | None = None,
) -> DataFrame:
    """Grid rows with their as-of features, the target's model row and the final status."""
    grid = scoring_grid(sites if sites is not None else obs, specs, date)
    rows = history_features(obs, specs, probes=grid, cross=cross)
    return (
        rows.drop("actual")
        .join(registry, "target", "left")
        .withColumn("status", forecast_status(F.col("date"), F.col("training_end"), F.col("status")))
    )


def score_rows(
    rows: DataFrame,
    specs: Sequence[TargetSpec],
    limits: Sequence[LimitSpec],
    regressed: Column | None = None,
    probability: Column | None = None,
) -> DataFrame:
    """Point forecast, baseline, flag, limits and reason per grid row.

    ``regressed`` and ``probability`` are the fitted models' outputs where a target has them;
    without them the named baseline and the constant prevalence are used.
    """
    target = F.col("target")
    ok = F.col("status") == ELIGIBLE
    simple = baseline_forecast(F.col("selected"), F.col("median"))
    forecast = simple if regressed is None else F.coalesce(simple, regressed)
    risk = F.col("prevalence") if probability is None else F.coalesce(probability, F.col("prevalence"))
    base = baseline_forecast(F.col("selected_baseline"), F.col("median"))
    scored = rows.select(
        "site", "target", "date", "issue_date", "status",
        status_text(F.col("status")).alias("reason"),
        F.when(ok, inverse(specs, target, forecast)).alias("predicted"),
        F.when(ok, inverse(specs, target, base)).alias("baseline"),
        F.when(ok, inverse(specs, target, F.col("last_value"))).alias("last_value"),
        F.when(ok, F.col("target_age_days")).alias("age_days"),
        F.when(ok, risk).alias("experimental_tail_probability"),
        F.when(ok, risk >= F.col("alert_cutoff")).alias("flag"),
        F.when(ok, F.col("selected").isin(*fixed.BASELINES)).alias("uses_baseline"),
        F.when(ok, F.col("selected")).alias("selected_model"),
        F.when(ok, F.col("risk_selection")).alias("risk_model"),
        F.coalesce(F.col("test_mae"), F.lit(0.0)).alias("_margin"),
    )
    level, text = limit_check(F.col("predicted"), target, limits, specs, F.col("_margin"))
    return scored.select("*", level.alias("limit_level"), text.alias("limit_text")).drop("_margin")


def predict_grid(
    obs: DataFrame, specs: Sequence[TargetSpec], limits: Sequence[LimitSpec], registry: DataFrame, date: str,
    sites: DataFrame | None = None,
) -> DataFrame:
    """Scored grid where every target's selected forecast is a baseline."""
    return score_rows(grid_features(obs, specs, registry, date, cross=False, sites=sites), specs, limits)


def site_overview(scored: DataFrame, specs: Sequence[TargetSpec]) -> DataFrame:
    """Per site: forecasts available or not, and flagged targets in specification order."""
    ok = F.col("status") == ELIGIBLE
    order = choose(F.col("target"), {name: i for i, name in enumerate(names(specs))}, "int")
    flagged = F.collect_list(
        F.when(ok & F.coalesce(F.col("flag"), F.lit(False)), F.struct(order.alias("o"), F.col("target").alias("t")))
    )
    return scored.groupBy("site").agg(
        F.count_if(ok).alias("eligible_targets"),
        F.count_if(~ok).alias("unavailable_targets"),
        F.array_join(F.transform(F.sort_array(flagged), lambda x: x["t"]), ";").alias("flagged_targets"),
        F.lit(fixed.OVERVIEW_NOTE).alias("note"),
    )


def site_names(obs: DataFrame) -> DataFrame:
    """Most common stripped waterbody per site, blanks included; blank only if every name is."""
    counted = obs.select("site", strip(F.col("waterbody")).alias("name"))
    top = most_common(counted, ["site"], "name").select("site", F.col("most_common_value").alias("name"))
    return top


def forecast_summary(scored: DataFrame) -> DataFrame:
    """Counts for the whole grid: available, red, yellow, unavailable forecasts and sites."""
    ok = F.col("status") == ELIGIBLE
    return scored.agg(
        F.count_if(ok).alias("forecasts"),
        F.count_distinct("site").alias("sites"),
        F.count_if(ok & (F.col("limit_level") == "red")).alias("red"),
        F.count_if(ok & (F.col("limit_level") == "yellow")).alias("yellow"),
        F.count_if(~ok).alias("unavailable"),
    )


def site_levels(scored: DataFrame) -> DataFrame:
    """Per site: any forecast, and the worst limit level."""
    red = F.max((F.col("limit_level") == "red").cast("int"))
    yellow = F.max((F.col("limit_level") == "yellow").cast("int"))
    return scored.groupBy("site").agg(
        (F.max((F.col("status") == ELIGIBLE).cast("int")) == 1).alias("has_forecast"),
        F.when(red == 1, "red").when(yellow == 1, "yellow").otherwise("").alias("level"),
    )


def overview_filter(levels: DataFrame, site_names_: DataFrame, search: str = "", show: str = "all") -> DataFrame:
    """Sites whose id or name contains the text, and that have a forecast, a flag or a red flag."""
    sites = levels.join(site_names_, "site", "left")
    text = search.strip().lower()
    if text:
        sites = sites.filter(
            F.col("site").contains(text) | F.lower(F.coalesce("name", F.lit(""))).contains(text)
        )
    if show == "forecast":
        sites = sites.filter("has_forecast")
    elif show == "flagged":
        sites = sites.filter(F.col("level") != "")
    elif show == "red":
        sites = sites.filter(F.col("level") == "red")
    return sites


def site_backtest(predictions: DataFrame) -> DataFrame:
    """Average miss of model and baseline per site and target, in source units."""
    return predictions.groupBy("site", "target").agg(
        F.count(F.lit(1)).alias("tested"),
        F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("model_miss"),
        F.avg(F.abs(F.col("actual") - F.col("baseline_predicted"))).alias("baseline_miss"),
    )


def freshness(obs: DataFrame, max_age: int = fixed.MAX_AGE_DAYS) -> DataFrame:
    """Last sample, last useful visit date, number of sites and the busiest one."""
    per_site = obs.groupBy("site").agg(F.count(F.lit(1)).alias("samples"), F.max("date").alias("last"))
    return per_site.agg(
        F.max("last").alias("last_sample"),
        F.date_add(F.max("last"), max_age).alias("latest_useful_date"),
        F.count(F.lit(1)).alias("sites"),
        F.sum("samples").alias("samples"),
        F.min_by("site", F.struct(-F.col("samples"), F.col("site"))).alias("busiest_site"),
    )


def samples_per_site(obs: DataFrame) -> DataFrame:
    return obs.groupBy("site").agg(F.count(F.lit(1)).alias("samples"))


def validate_scenario(measurements: DataFrame, specs: Sequence[TargetSpec]) -> DataFrame:
    """Hypothetical values must be of a known target, finite and inside its range."""
    target, value = F.col("target"), F.col("value")
    problem = (
        F.when(~target.isin(*names(specs)), F.lit("unknown measurement"))
        .when(
            ~is_finite(value) | ~F.coalesce(in_range(specs, target, value), F.lit(False)),
            F.concat(spec_value(specs, "label", target), F.lit(" value is outside the allowed range")),
        )
    )
    return measurements.select("*", F.coalesce(problem, F.lit("")).alias("problem"))


def what_if(
    obs: DataFrame, measurements: DataFrame, specs: Sequence[TargetSpec], limits: Sequence[LimitSpec],
    registry: DataFrame, date: str,
) -> DataFrame:
    """Forecasts of the affected sites before and after adding hypothetical measurements.

    ``measurements``: site, date, target, value. Raises if any is invalid or a site is unknown.
    """
    judged = validate_scenario(measurements, specs)
    bad = judged.filter(F.col("problem") != "").select("problem").first()
    if bad is not None:
        raise ValueError(bad["problem"])
    sites = measurements.select("site").distinct()
    if not sites.join(obs, "site", "left_anti").isEmpty():
        raise ValueError("Unknown site")
    own = obs.join(sites, "site", "left_semi").select("site", "date", "target", "value")
    return compare_runs(own, overlay(own, measurements.select("site", "date", "target", "value")), specs, limits, registry, date)


def compare_runs(
    before: DataFrame, after: DataFrame, specs: Sequence[TargetSpec], limits: Sequence[LimitSpec],
    registry: DataFrame, date: str,
) -> DataFrame:
    """Forecasts from two versions of the observations side by side."""
    kept = ["predicted", "status", "limit_level"]
    runs = [
        predict_grid(obs, specs, limits, registry, date).select(
            "site", "target", *[F.col(c).alias(f"{c}_{label}") for c in kept]
        )
        for label, obs in (("before", before), ("after", after))
    ]
    return runs[0].join(runs[1], ["site", "target"], "full_outer").withColumn(
        "change", F.col("predicted_after") - F.col("predicted_before")
    )


def site_history(obs: DataFrame, predictions: DataFrame, site: str, target: str) -> DataFrame:
    """Observations and tested forecasts of one series; both filters reach the scans."""
    chosen = (F.col("site") == site) & (F.col("target") == target)
    measured = obs.filter(chosen).select(
        F.lit("observation").alias("kind"), "date", F.col("value").alias("actual"),
        F.lit(None).cast("double").alias("predicted"), F.lit(None).cast("double").alias("baseline"),
    )
    if obs.filter(F.col("site") == site).isEmpty():
        raise ValueError("Unknown site")
    tested = predictions.filter(chosen).select(
        F.lit("tested").alias("kind"), "date", "actual", "predicted",
        F.col("baseline_predicted").alias("baseline"),
    )
    return measured.unionByName(tested)


def target_catalog(
    spec_rows: DataFrame, summary: DataFrame, registry: DataFrame, limits: DataFrame
) -> DataFrame:
    """One row per target for readers: label, unit, evidence, interval, notes and limits."""
    target = F.col("target")
    notes = {name: fixed.NOTES.get(name, "") for name in fixed.NOTES}
    return (
        spec_rows.drop("min", "max")
        .join(summary.drop("label"), "target", "left")
        .join(registry.select("target", "classifier"), "target", "left")
        .join(limits.select("target", F.col("min").alias("limit_min"), F.col("max").alias("limit_max"),
                            F.col("basis").alias("limit_basis")), "target", "left")
        .select(
            "target", "label", choose(target, fixed.UNITS, "string").alias("unit"),
            (F.col("transform") == "log1p").alias("log"), "status", "selected_model", "baseline",
            "improvement_percent", "lower_95", "upper_95", "test", "source_MAE",
            F.col("classifier").isNotNull().alias("flags"),
            F.coalesce(choose(target, notes, "string"), F.lit("")).alias("note"), "caution",
            "limit_min", "limit_max", "limit_basis",
        )
    )
