"""Forecast errors, tail events and the tables that summarise them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creekline.functions import fixed_values as fixed
from creekline.functions.scalar import (
    divide, event_group, history_age_bucket, percent_gain, season,
)
from creekline.functions.specs import TargetSpec, inverse, spec_value, transform
from creekline.operators.ranking import (
    exact_quantiles, ranking_aggregates, ranking_columns, score_ranks,
)

OUTSIDE = "outside_training_5th_95th_percentiles"
WITHIN = "within_training_5th_95th_percentiles"
SEEN = "seen_in_model_fit"
UNSEEN = "unseen_in_model_fit"
DIMENSIONS = [
    "site", "season", "year", "history_age", "event_group", "extreme_group", "site_training_status",
]


def error_columns(predictions: DataFrame, specs: Sequence[TargetSpec]) -> DataFrame:
    """Errors of model and baseline on the transformed scale, the source-unit error and the year."""
    target = F.col("target")
    actual = transform(specs, target, F.col("actual"))
    return predictions.select(
        "*",
        F.abs(actual - transform(specs, target, F.col("predicted"))).alias("error"),
        F.abs(actual - transform(specs, target, F.col("baseline_predicted"))).alias("baseline_error"),
        F.abs(F.col("actual") - F.col("predicted")).alias("source_error"),
        F.year("date").alias("year"),
    )


def segment_columns(errors: DataFrame) -> DataFrame:
    return errors.select(
        "*",
        season(F.col("date")).alias("season"),
        history_age_bucket(F.col("target_age_days")).alias("history_age"),
        event_group(F.col("actual_tail_event")).alias("event_group"),
    )


def extreme_group(predictions: DataFrame, rows: DataFrame, train_before: str) -> DataFrame:
    """Strictly outside the 5th..95th percentile of the target's training outcomes."""
    limits = exact_quantiles(
        rows.filter(F.col("date") < F.lit(train_before).cast("date")), ["target"], "actual",
        {"_low": 0.05, "_high": 0.95},
    )
    outside = (F.col("actual") < F.col("_low")) | (F.col("actual") > F.col("_high"))
    return (
        predictions.join(limits, "target", "left")
        .withColumn("extreme_group", F.when(outside, OUTSIDE).otherwise(WITHIN))
        .drop("_low", "_high")
    )


def fitted(date: Column, train_before: str, validation: tuple[str, str]) -> Column:
    """Rows a final model was fitted on: training, or the validation period."""
    return (date < F.lit(train_before).cast("date")) | date.between(
        F.lit(validation[0]).cast("date"), F.lit(validation[1]).cast("date")
    )


def seen_in_fit(
    predictions: DataFrame, rows: DataFrame, train_before: str, validation: tuple[str, str]
) -> DataFrame:
    """Whether the site had fitted rows for the target."""
    seen = (
        rows.filter(fitted(F.col("date"), train_before, validation))
        .select("site", "target")
        .distinct()
        .withColumn("_seen", F.lit(True))
    )
    return (
        predictions.join(seen, ["site", "target"], "left")
        .withColumn("site_training_status", F.when(F.col("_seen"), SEEN).otherwise(UNSEEN))
        .drop("_seen")
    )


def error_sums() -> list[Column]:
    """Additive parts of an error summary, so groups can be combined in any order."""
    event = F.col("actual_tail_event").cast("bigint")
    flag = F.col("experimental_flag").cast("bigint")
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum("error").alias("error"),
        F.sum("baseline_error").alias("baseline_error"),
        F.sum("source_error").alias("source_error"),
        F.sum(F.col("predicted") - F.col("actual")).alias("bias"),
        F.sum(event).alias("events"),
        F.sum(flag).alias("flags"),
        F.sum(event * flag).alias("caught"),
    ]


def finish_errors(cells: DataFrame, keys: Sequence[str], site: str, include: Column | None = None) -> DataFrame:
    """Summaries from additive parts; an undefined rate is NULL, never perfect.

    ``include`` restricts the summary and adds how many samples it left out.
    """
    def part(name: str) -> Column:
        return F.col(name) if include is None else F.when(include, F.col(name))

    names = ["n", "error", "baseline_error", "source_error", "bias", "events", "flags", "caught"]
    sites = F.count_distinct(part(site)).alias("sites")
    counted = cells.groupBy(*keys).agg(
        sites, F.sum("n").alias("_all"), *[F.sum(part(name)).alias(f"_{name}") for name in names]
    )
    n = F.col("_n")
    some = F.when(n > 0, F.col("sites")).alias("sites")
    columns = [
        F.coalesce(n, F.lit(0)).alias("samples"), some,
        divide(F.col("_error"), n).alias("MAE_transformed"),
        divide(F.col("_baseline_error"), n).alias("baseline_MAE_transformed"),
        percent_gain(F.col("_error"), F.col("_baseline_error")).alias("improvement_percent"),
        divide(F.col("_source_error"), n).alias("source_MAE"),
        divide(F.col("_bias"), n).alias("source_bias"),
        F.col("_events").alias("events"),
        F.col("_caught").alias("caught"),
        (F.col("_events") - F.col("_caught")).alias("missed"),
        (F.col("_flags") - F.col("_caught")).alias("false_flags"),
        divide(F.col("_caught"), F.col("_events")).alias("recall"),
        divide(F.col("_caught"), F.col("_flags")).alias("precision"),
    ]
    if include is not None:
        columns = [
            F.col("_all").alias("original_samples"),
            (F.col("_all") - F.coalesce(n, F.lit(0))).alias("excluded_samples"),
            *columns,
        ]
    return counted.select(*keys, *columns)


def error_summary(errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, errors, gain, bias and event rates per group."""
    others = [k for k in keys if k != "site"]
    cells = errors.groupBy(*others, F.col("site").alias("_site"), *(["site"] if "site" in keys else [])).agg(
        *error_sums()
    )
    return finish_errors(cells, keys, "_site")


def segment_errors(errors: DataFrame, dimensions: Sequence[str] = tuple(DIMENSIONS)) -> DataFrame:
    """Error summary per target and segment of each dimension, from one pass over the errors.

    Rows are first summed per combination of all dimensions; only those cells are repeated
    per dimension.
    """
    cells = errors.groupBy("target", F.col("site").alias("_site"), *dimensions).agg(*error_sums())
    sums = ["n", "error", "baseline_error", "source_error", "bias", "events", "flags", "caught"]
    long = cells.select(
        "target", "_site", *sums, *[F.col(d).cast("string").alias(d) for d in dimensions]
    ).unpivot(["target", "_site", *sums], list(dimensions), "dimension", "segment")
    summary = finish_errors(
        long.filter(F.col("segment").isNotNull()), ["target", "dimension", "segment"], "_site"
    )
    return summary.withColumn("small_sample", F.col("samples") < fixed.SMALL_SAMPLE)


def regression_metrics(
    scored: DataFrame, keys: Sequence[str], prediction: str, specs: Sequence[TargetSpec]
) -> DataFrame:
    """Mean absolute error on both scales; ``prediction`` is on the transformed scale."""
    target = F.col("target")
    return scored.groupBy(*keys).agg(
        F.avg(F.abs(transform(specs, target, F.col("actual")) - F.col(prediction))).alias("transformed_MAE"),
        F.avg(F.abs(F.col("actual") - inverse(specs, target, F.col(prediction)))).alias("source_MAE"),
    )


def v1_regression_metrics(scored: DataFrame, keys: Sequence[str], prediction: str) -> DataFrame:
    """First generation: log scale errors, and source errors with the prediction floored at zero."""
    miss = F.log1p("actual_ecoli") - F.col(prediction)
    back = F.greatest(F.lit(0.0), F.expm1(prediction))
    return scored.groupBy(*keys).agg(
        F.avg(F.abs(miss)).alias("log_MAE"),
        F.sqrt(F.avg(miss * miss)).alias("log_RMSE"),
        F.avg(F.abs(F.col("actual_ecoli") - back)).alias("raw_MAE"),
    )


def classification_metrics(
    scored: DataFrame, keys: Sequence[str], probability: str, label: str, cutoff: Column
) -> DataFrame:
    """Event metrics at ``p >= cutoff`` with AUC and average precision, from one table of score counts.

    Here undefined precision and recall are 0. ``cutoff`` is one value per group.
    """
    groups = [*keys, "alert_cutoff"]
    running = score_ranks(scored.withColumn("alert_cutoff", cutoff), groups, probability, label)
    p, pos, neg = F.col(probability), F.col("pos"), F.col("neg")
    alert = (p >= F.col("alert_cutoff")).cast("bigint")
    counts = running.groupBy(*groups).agg(
        F.sum(pos * (p - 1) * (p - 1) + neg * p * p).alias("_squares"),
        F.sum(pos).alias("events"),
        F.sum(pos + neg).alias("_rows"),
        F.sum(pos * alert).alias("caught"),
        F.sum(pos * (1 - alert)).alias("missed"),
        F.sum(neg * alert).alias("false_alerts"),
        F.sum((pos + neg) * alert).alias("alerts"),
        *ranking_aggregates(),
    )
    return counts.select(
        *groups, "events", "caught", "missed", "false_alerts", "alerts", *ranking_columns(),
        divide(F.col("_squares"), F.col("_rows")).alias("Brier"),
        divide(F.col("events"), F.col("_rows")).alias("prevalence"),
        F.coalesce(divide(F.col("caught"), F.col("alerts")), F.lit(0.0)).alias("precision"),
        F.coalesce(divide(F.col("caught"), F.col("events")), F.lit(0.0)).alias("recall"),
    )


def risk_label(value: Column, lower: Column, upper: Column) -> Column:
    """1 strictly outside the thresholds; an absent threshold never flags."""
    outside = F.coalesce(value < lower, F.lit(False)) | F.coalesce(value > upper, F.lit(False))
    return outside.cast("int")


def tail_thresholds(rows: DataFrame, specs: Sequence[TargetSpec], keys: Sequence[str] = ("target",)) -> DataFrame:
    """Historical tails of training outcomes, by the target's direction; exact quantiles."""
    quantiles = exact_quantiles(
        rows, list(keys), "actual", {"q10": 0.10, "q25": 0.25, "q75": 0.75, "q90": 0.90}
    )
    direction = spec_value(specs, "direction", F.col("target"))
    return quantiles.select(
        *keys,
        F.when(direction == "both", F.col("q10")).when(direction == "low", F.col("q25")).alias("lower"),
        F.when(direction == "both", F.col("q90")).when(direction == "high", F.col("q75")).alias("upper"),
    )


def largest_errors(errors: DataFrame, count: int = 10) -> DataFrame:
    """The largest errors per target; each task keeps only its own best rows before the shuffle."""
    order = Window.partitionBy("target").orderBy(F.desc("error"), "site", "date")
    return errors.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def missed_events(errors: DataFrame) -> DataFrame:
    """Tail events that were not flagged, worst first."""
    missed = (F.col("actual_tail_event") == 1) & ~F.col("experimental_flag")
    return errors.filter(missed).orderBy(F.desc("error"), "target", "site", "date")


def evidence_status(selected: Column, interval_low: Column) -> Column:
    return (
        F.when(selected.isin(*fixed.BASELINES), "baseline_selected")
        .when(interval_low > 0, "positive_signal")
        .otherwise("uncertain_signal")
    )


def verdict(n: Column, sites: Column, mean_gain: Column, low: Column, high: Column, selected: Column | None = None) -> Column:
    """Judgement of a frozen model on new samples; small samples are never judged."""
    judged = (
        F.when(
            (n < fixed.MIN_VERDICT_OBSERVATIONS) | (sites < fixed.MIN_VERDICT_SITES), "insufficient_data"
        )
        .when(low > 0, "confirmed")
        .when((high <= 0) | (mean_gain <= 0), "not_confirmed")
        .otherwise("inconclusive")
    )
    if selected is None:
        return judged
    return F.when(selected.isin(*fixed.BASELINES), "frozen_model_is_baseline").otherwise(judged)
