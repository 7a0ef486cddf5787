"""Rain and flow known at issue time. A missing day stays missing; it is never a dry day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creekline.functions import fixed_values as fixed
from creekline.functions.scalar import day_number
from creekline.functions.specs import TargetSpec, transform
from creekline.operators.ranking import rank_correlation
from creekline.sources.sinks import staged

WET_DAY = 5.0
DRY_CAP = 60


def calendar_spine(rain: DataFrame, flow: DataFrame) -> DataFrame:
    """One row per series and day from the first to the last day of either input.

    Inputs: (series_id, day, rain) and (series_id, day, flow). A series is bounded by the
    calendar, so windows over it are too.
    """
    days = rain.select("series_id", "day").unionByName(flow.select("series_id", "day"))
    spine = (
        days.groupBy("series_id")
        .agg(F.min("day").alias("first"), F.max("day").alias("last"))
        .select("series_id", F.explode(F.sequence("first", "last")).alias("day"))
    )
    return spine.join(rain, ["series_id", "day"], "left").join(flow, ["series_id", "day"], "left")


def daily_features(daily: DataFrame) -> DataFrame:
    """Rolling features per series and day, from that day and earlier ones only."""
    base = Window.partitionBy("series_id").orderBy("day")

    def trailing(days: int) -> Window:
        return base.rowsBetween(-(days - 1), 0)

    number = day_number(F.col("day"))
    wet = F.last(F.when(F.col("rain") >= WET_DAY, number), ignorenulls=True).over(trailing_all(base))
    month_median = F.percentile(F.col("flow"), F.lit(0.5)).over(trailing(30))
    rows = daily.select(
        "series_id", "day", "rain", "flow",
        (F.sum(F.col("rain").isNull().cast("int")).over(trailing(30)) == 0).alias("complete"),
        *[F.sum("rain").over(trailing(n)).alias(f"rain_{n}") for n in fixed.RAIN_WINDOWS],
        F.coalesce(F.least(number - wet, F.lit(DRY_CAP)), F.lit(DRY_CAP)).cast("double").alias("days_since_rain5"),
        F.log1p("flow").alias("flow_log"),
        F.log1p(F.avg("flow").over(trailing(7))).alias("flow_7_log"),
        F.when(month_median > 0, F.col("flow") / month_median).alias("flow_ratio_30"),
        F.when(
            F.count("rain").over(base.rowsBetween(-3, 0)) == 4, F.sum("rain").over(base.rowsBetween(-3, 0))
        ).alias("rain_0_3"),
    )
    guarded = [F.when(F.col("complete"), F.col(name)).alias(name) for name in fixed.WEATHER_FEATURES]
    return rows.select("series_id", "day", "rain", "flow", "complete", "rain_0_3", *guarded)


def trailing_all(base: Window) -> Window:
    return base.rowsBetween(Window.unboundedPreceding, 0)


def add_weather(rows: DataFrame, features: DataFrame, series: str | None = None) -> DataFrame:
    """Features as of the day before issue; days off the calendar give NULL.

    The feature table has one row per series and day. It is joined without a hint, so it is
    broadcast only when its measured size allows. ``series`` names a column of ``rows`` that
    picks the series; without it there must be one series only.
    """
    known = features.select("series_id", "day", *fixed.WEATHER_FEATURES)
    known = known.withColumnRenamed("day", "_known")
    keyed = rows.withColumn("_known", F.date_sub("issue_date", 1))
    if series is None:
        _one_series(features)
        return keyed.join(known.drop("series_id"), "_known", "left").drop("_known")
    known = known.withColumnRenamed("series_id", series)
    return keyed.join(known, [series, "_known"], "left").drop("_known")


def add_event_rain(rows: DataFrame, features: DataFrame, series: str | None = None) -> DataFrame:
    """Rain on the sample day and three days before: unknown at issue time, diagnostic only."""
    seen = features.select("series_id", F.col("day").alias("date"), F.col("rain_0_3").alias("oracle_rain_0_3"))
    if series is None:
        _one_series(features)
        return rows.join(seen.drop("series_id"), "date", "left")
    return rows.join(seen.withColumnRenamed("series_id", series), [series, "date"], "left")


def _one_series(features: DataFrame) -> None:
    """Without a key, two series would multiply rows."""
    if len(features.select("series_id").distinct().limit(2).collect()) > 1:
        raise ValueError("there are several series: name the column that picks one")


def missing_rate(rows: DataFrame, columns: Sequence[str] = tuple(fixed.WEATHER_FEATURES)) -> DataFrame:
    """Share of rows with any of the columns missing."""
    missing = F.lit(False)
    for name in columns:
        missing = missing | F.col(name).isNull()
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(missing.cast("int")).alias("missing_rate")
    )


def weather_signal(rows: DataFrame, specs: Sequence[TargetSpec], inputs: Sequence[str], baseline: str = "seasonal_site") -> DataFrame:
    """``target, input, with, samples, spearman``: each input's rank correlation with the outcome and with what the
    baseline misses of it, all in one pass. An input that only follows the season ranks with the first alone.

    The remainder is rounded to nine digits, so equal ones tie whatever the order they were summed in.
    """
    y = transform(specs, F.col("target"), F.col("actual"))
    sides = F.array(
        F.struct(F.lit("outcome").alias("with"), y.alias("_y")),
        F.struct(F.lit("baseline_residual").alias("with"), F.round(y - F.col(baseline), 9).alias("_y")),
    )
    # What is read twice is written as one row per sample, not one per sample, input and side.
    known = staged(rows.select("target", *inputs, sides.alias("_sides")), "signal")
    both = known.select("target", *inputs, F.inline("_sides"))
    long = both.unpivot(["target", "with", "_y"], list(inputs), "input", "_x")
    return rank_correlation(long, ["target", "input", "with"], "_x", "_y")
