"""Rolling yearly folds for all targets at once: splits, support, baselines and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creekline.functions import fixed_values as fixed
from creekline.functions.scalar import divide, percent_gain
from creekline.functions.specs import TargetSpec, inverse, transform
from creekline.operators.bootstrap import cluster_bootstrap
from creekline.operators.errors import evidence_status, risk_label, tail_thresholds
from creekline.operators.ranking import exact_quantiles
from creekline.operators.scoring import baseline_forecast
from creekline.sources.sinks import staged

FOLD = ["target", "fold"]


def chronological_split(date: Column, year: int, final: bool = False) -> Column:
    """train / validation / test / embargo; ten days at year boundaries belong to no split."""
    def day(text: str) -> Column:
        return F.lit(text).cast("date")

    in_test = date >= day(f"{year}-01-01")
    if not final:
        in_test = in_test & (date <= day(f"{year}-12-31"))
    return (
        F.when(date < day(f"{year - 2}-12-22"), "train")
        .when(date.between(day(f"{year - 1}-01-01"), day(f"{year - 1}-12-21")), "validation")
        .when(in_test, "test")
        .otherwise("embargo")
    )


def fold_rows(rows: DataFrame, years: Sequence[int]) -> DataFrame:
    """Each row once per fold with its ``split``; the last year is open-ended. Embargo rows drop out."""
    entries = [
        F.struct(
            F.lit(str(year)).alias("fold"),
            chronological_split(F.col("date"), year, final=year == years[-1]).alias("split"),
        )
        for year in years
    ]
    return (
        rows.select("*", F.explode(F.array(*entries)).alias("_f"))
        .select("*", "_f.fold", "_f.split")
        .drop("_f")
        .filter(F.col("split") != "embargo")
    )


def fold_support(folded: DataFrame) -> DataFrame:
    """Rows per split, test sites, and whether the fold has enough of them."""
    counts = folded.groupBy(*FOLD).agg(
        *[F.count_if(F.col("split") == name).alias(name) for name in ("train", "validation", "test")],
        F.count_distinct(F.when(F.col("split") == "test", F.col("site"))).alias("test_sites"),
    )
    enough = (
        (F.col("train") >= fixed.MIN_TRAIN)
        & (F.col("validation") >= fixed.MIN_VALIDATION)
        & (F.col("test") >= fixed.MIN_TEST)
        & (F.col("test_sites") >= fixed.MIN_TEST_SITES)
    )
    return counts.withColumn("supported", enough)


def fold_medians(folded: DataFrame, specs: Sequence[TargetSpec], splits: Sequence[str]) -> DataFrame:
    """Exact median of the transformed outcome over the given splits."""
    moved = folded.filter(F.col("split").isin(*splits)).select(
        *FOLD, transform(specs, F.col("target"), F.col("actual")).alias("_y")
    )
    return exact_quantiles(moved, FOLD, "_y", {"median": 0.5})


def baseline_errors(folded: DataFrame, medians: DataFrame, split: str, specs: Sequence[TargetSpec]) -> DataFrame:
    """Mean absolute errors of every baseline on one split, all targets and folds in one pass."""
    target = F.col("target")
    rows = folded.filter(F.col("split") == split).join(medians, FOLD)
    actual = transform(specs, target, F.col("actual"))
    parts = []
    for name in fixed.BASELINES:
        forecast = baseline_forecast(F.lit(name), F.col("median"))
        parts.append(F.avg(F.abs(actual - forecast)).alias(f"t_{name}"))
        parts.append(F.avg(F.abs(F.col("actual") - inverse(specs, target, forecast))).alias(f"s_{name}"))
    wide = rows.groupBy(*FOLD).agg(*parts)
    entries = [
        F.struct(
            F.lit(name).alias("model"), F.lit(i).alias("ord"),
            F.col(f"t_{name}").alias("transformed_MAE"), F.col(f"s_{name}").alias("source_MAE"),
        )
        for i, name in enumerate(fixed.BASELINES)
    ]
    return wide.select(*FOLD, F.explode(F.array(*entries)).alias("_m")).select(*FOLD, "_m.*")


def select_model(scored: DataFrame, keys: Sequence[str] = tuple(FOLD), name: str = "selected") -> DataFrame:
    """The candidate with the least transformed error; the earlier one wins ties."""
    best = F.min_by("model", F.struct("transformed_MAE", "ord")).alias(name)
    return scored.groupBy(*keys).agg(best)


def fold_thresholds(folded: DataFrame, specs: Sequence[TargetSpec]) -> DataFrame:
    """Tail thresholds per target and fold from training outcomes."""
    return tail_thresholds(folded.filter(F.col("split") == "train"), specs, FOLD)


def class_counts(folded: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Events and rows per split, prevalences, and whether a classifier may be tried."""
    labelled = folded.join(thresholds, FOLD).withColumn(
        "label", risk_label(F.col("actual"), F.col("lower"), F.col("upper"))
    )
    parts = []
    for split in ("train", "validation"):
        here = F.col("split") == split
        parts.append(F.count_if(here & (F.col("label") == 1)).alias(f"{split}_events"))
        parts.append(F.count_if(here & (F.col("label") == 0)).alias(f"{split}_others"))
    counts = labelled.groupBy(*FOLD, "lower", "upper").agg(*parts)
    train = F.col("train_events") + F.col("train_others")
    both = train + F.col("validation_events") + F.col("validation_others")
    return counts.select(
        "*",
        divide(F.col("train_events"), train).alias("train_prevalence"),
        divide(F.col("train_events") + F.col("validation_events"), both).alias("prevalence"),
        (
            (F.least("train_events", "train_others") >= fixed.MIN_CLASS_TRAIN)
            & (F.least("validation_events", "validation_others") >= fixed.MIN_CLASS_VALIDATION)
        ).alias("classifier_allowed"),
    )


def test_gains(
    folded: DataFrame, chosen: DataFrame, medians: DataFrame, specs: Sequence[TargetSpec], model: Column | None = None
) -> DataFrame:
    """Per test row: forecast and baseline on the transformed scale, and the error gain.

    ``chosen`` names ``selected`` and ``selected_baseline`` per target and fold; ``model`` is a
    fitted model's output where the selection is not a baseline.
    """
    rows = folded.filter(F.col("split") == "test").join(chosen, FOLD).join(medians, FOLD)
    forecast = baseline_forecast(F.col("selected"), F.col("median"))
    forecast = forecast if model is None else F.coalesce(forecast, model)
    actual = transform(specs, F.col("target"), F.col("actual"))
    return rows.select(
        "*", forecast.alias("_forecast"),
        baseline_forecast(F.col("selected_baseline"), F.col("median")).alias("_base"),
        actual.alias("_y"),
    ).withColumn("gain", F.abs(F.col("_y") - F.col("_base")) - F.abs(F.col("_y") - F.col("_forecast")))


def evaluate_test(gains: DataFrame, specs: Sequence[TargetSpec], replicates: int = 1000) -> DataFrame:
    """Test errors, gain over the selected baseline, bootstrap interval and evidence status."""
    target = F.col("target")
    errors = gains.groupBy(*FOLD, "selected", "selected_baseline").agg(
        F.count(F.lit(1)).alias("test"),
        F.avg(F.abs(F.col("_y") - F.col("_forecast"))).alias("transformed_MAE"),
        F.avg(F.abs(F.col("actual") - inverse(specs, target, F.col("_forecast")))).alias("source_MAE"),
        F.avg(F.abs(F.col("_y") - F.col("_base"))).alias("baseline_MAE"),
    )
    interval = cluster_bootstrap(gains, FOLD, "gain", replicates)
    return errors.join(interval, FOLD).select(
        "*",
        F.coalesce(percent_gain(F.col("transformed_MAE"), F.col("baseline_MAE")), F.lit(0.0)).alias("improvement_percent"),
        evidence_status(F.col("selected"), F.col("lower_95")).alias("status"),
    )


def baseline_evaluation(
    rows: DataFrame, specs: Sequence[TargetSpec], years: Sequence[int], replicates: int = 1000
) -> DataFrame:
    """Rolling evaluation with baselines only: choose the best on validation, judge it on test
    against the last observation."""
    needed = ["site", "target", "date", "actual", "last_value", "history_median", "seasonal_site"]
    folded = fold_rows(rows.select(*needed), years)
    supported = fold_support(folded).filter("supported").select(*FOLD)
    folded = staged(folded.join(supported, FOLD, "left_semi"), "folds")
    validation = baseline_errors(folded, fold_medians(folded, specs, ["train"]), "validation", specs)
    chosen = select_model(validation).withColumn("selected_baseline", F.lit("last_observation"))
    medians = fold_medians(folded, specs, ["train", "validation"])
    return evaluate_test(test_gains(folded, chosen, medians, specs), specs, replicates)


def adoption_rule(scores: DataFrame, years: Sequence[int], candidate: str, reference: str) -> DataFrame:
    """Adopt a candidate only if its error is lower in every year."""
    wide = scores.filter(F.col("fold").isin(*[str(y) for y in years])).groupBy("target", "fold").agg(
        F.max(F.when(F.col("model") == candidate, F.col("transformed_MAE"))).alias("candidate"),
        F.max(F.when(F.col("model") == reference, F.col("transformed_MAE"))).alias("reference"),
    )
    return wide.groupBy("target").agg(
        F.count(F.lit(1)).alias("years"),
        F.bool_and(F.coalesce(F.col("candidate") < F.col("reference"), F.lit(False))).alias("adopt"),
    )


def results_tables(baselines: DataFrame, tested: DataFrame) -> DataFrame:
    """Gain over the validation-selected and over the strongest test baseline, per target and fold."""
    strongest = baselines.groupBy(*FOLD).agg(
        F.min_by("model", F.struct("transformed_MAE", "ord")).alias("strongest"),
        F.min("transformed_MAE").alias("_least"),
    )
    return tested.join(strongest, FOLD).select(
        *FOLD, "test", "selected", "source_MAE", "improvement_percent", "strongest",
        (F.lit(100.0) * (1 - divide(F.col("transformed_MAE"), F.col("_least")))).alias("gain_over_strongest"),
        "status",
    )


def fold_pivot(tested: DataFrame, years: Sequence[int]) -> DataFrame:
    """Improvement per fold side by side; folds are given, so no job looks for them."""
    return tested.groupBy("target").pivot("fold", [str(y) for y in years]).agg(F.max("improvement_percent"))


def rolling_table(tested: DataFrame, years: Sequence[int]) -> DataFrame:
    """``fold_pivot`` as text: signed percent to one digit, and words where a fold had too little history."""
    wide = fold_pivot(tested, years)
    cells = [
        F.when(F.col(str(y)).isNotNull(), F.format_string("%+.1f%%", F.col(str(y)))).otherwise(fixed.NOT_ENOUGH).alias(str(y)) for y in years
    ]
    return wide.select("target", *cells)


def unsupported_targets(spec_rows: DataFrame, support: DataFrame, coverage: DataFrame, final: str) -> DataFrame:
    """Targets without a final fold: their site-days and the forecasts that each split would have had."""
    counts = support.filter((F.col("fold") == final)).select("target", "train", "validation", "test", "supported")
    zero = F.lit(0).cast("bigint")
    joined = spec_rows.select("target", "label").join(counts, "target", "left").join(
        coverage.select("target", "valid_site_days"), "target", "left"
    )
    return joined.filter(~F.coalesce("supported", F.lit(False))).select(
        "target", "label", *[F.coalesce(F.col(c), zero).alias(c) for c in ("valid_site_days", "train", "validation", "test")]
    )


def risk_table(spec_rows: DataFrame, risk: DataFrame, final: str) -> DataFrame:
    """Tail events of the final fold: how many there were, were caught and were flagged in vain."""
    return spec_rows.select("target", "label").join(risk.filter(F.col("fold") == final), "target").select(
        "target", "label", "risk_model", "events", "caught", "false_alerts", "precision"
    )


def target_summary(spec_rows: DataFrame, support: DataFrame, tested: DataFrame, final: str, risk: DataFrame | None = None) -> DataFrame:
    """One row per target for the final fold; a target without support says so.

    ``risk`` (with ``risk_model``) adds the tail classifier, its recall and precision; they are
    NULL for a target without one.
    """
    counts = support.filter(F.col("fold") == final).select("target", "train", "validation", "test")
    results = tested.filter(F.col("fold") == final).drop("fold", "test")
    zero = F.lit(0).cast("bigint")
    summary = (
        spec_rows.select("target", "label")
        .join(counts, "target", "left")
        .join(results, "target", "left")
        .withColumn("status", F.coalesce("status", F.lit("insufficient_history")))
        .withColumnsRenamed({"selected": "selected_model", "selected_baseline": "baseline"})
        .withColumns({name: F.coalesce(F.col(name), zero) for name in ("train", "validation", "test")})
    )
    if risk is None:
        return summary
    flags = risk.filter(F.col("fold") == final).select(
        "target", "risk_model", F.col("recall").alias("risk_recall"), F.col("precision").alias("risk_precision")
    )
    return summary.join(flags, "target", "left")
