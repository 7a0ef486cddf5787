"""Audit of predictions and of the source tables behind them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creekline.functions import fixed_values as fixed
from creekline.functions.scalar import is_close
from creekline.functions.specs import TargetSpec
from creekline.operators import checks, errors, sensitivity
from creekline.operators.bootstrap import cluster_bootstrap
from creekline.operators.history import training_rows
from creekline.operators.quarantine import line_columns
from creekline.operators.revisions import verify_join_1_1
from creekline.sources.sinks import staged, write_table


def error_audit(
    predictions: DataFrame, clean: DataFrame, specs: Sequence[TargetSpec], train_before: str, validation: tuple[str, str],
    evaluated: tuple[DataFrame, DataFrame, str] | None = None,
) -> dict[str, DataFrame]:
    """Verified metrics, segment tables, largest errors and missed events.

    With ``evaluated`` (the evaluation's test table, its classification table and the fold that the predictions are
    of) the audit raises unless it derives the same errors and recalls from the predictions.
    """
    verify_join_1_1(predictions, clean)
    rows = staged(training_rows(clean, specs, cross=False), "rows")
    table = errors.segment_columns(errors.error_columns(predictions, specs))
    table = errors.extreme_group(table, rows, train_before)
    table = staged(errors.seen_in_fit(table, rows, train_before, validation), "errors")
    metrics = staged(errors.error_summary(table, ["target"]), "metrics")
    if evaluated:
        tested, risk, fold = evaluated
        assert_rederived(metrics.select("target", F.col("source_MAE"), "recall"), tested, risk, fold)
    return {
        "errors": table,
        "verified_metrics": metrics,
        "errors_by_segment": errors.segment_errors(table),
        "largest_errors": errors.largest_errors(table),
        "missed_events": errors.missed_events(table),
    }


def assert_rederived(metrics: DataFrame, tested: DataFrame, risk: DataFrame, fold: str) -> None:
    """Raise unless the audit's own source error and recall equal the evaluation's, for every target.

    An undefined recall is NULL here and 0 there.
    """
    there = tested.filter(F.col("fold") == fold).select("target", F.col("source_MAE").alias("_mae")).join(
        risk.filter(F.col("fold") == fold).select("target", F.col("recall").alias("_recall")), "target"
    )
    same = is_close(F.col("source_MAE"), F.col("_mae"), 1e-5, 1e-8) & is_close(F.coalesce("recall", F.lit(0.0)), F.col("_recall"), 1e-5, 1e-8)
    wrong = metrics.join(there, "target", "left").filter(~F.coalesce(same, F.lit(False))).select("target").limit(5).collect()
    if wrong:
        raise ValueError(f"the evaluation cannot be derived again for {', '.join(r['target'] for r in wrong)}")


def source_audit(good: dict[str, DataFrame], specs: Sequence[TargetSpec]) -> dict[str, DataFrame]:
    """Profiles, arithmetic checks, methods, timing and identities of the structurally good rows."""
    column = {s.target: s.column for s in specs}
    shared = ["source", *line_columns(good["bacteria"]), "site", "date", "waterbody", fixed.LOCATION_COLUMN, fixed.SAMPLE_TIME_COLUMN, fixed.CREATED_COLUMN]
    stamped = good["bacteria"].select(*shared).unionByName(good["chemistry"].select(*shared))
    identities = checks.site_identity_audit(stamped)
    bacteria = checks.count_volume_check(good["bacteria"], column)
    chemistry = checks.derived_value_check(good["chemistry"], column)
    return {
        "measurement_verification": checks.profile_measurements(good["bacteria"], specs, "bacteria").unionByName(
            checks.profile_measurements(good["chemistry"], specs, "chemistry")
        ),
        "review_value_disagreements": checks.reviewed_vs_original(good["chemistry"], specs),
        "bacteria_formula_checks": bacteria,
        "chemistry_derived_checks": chemistry,
        "turbidity_methods": checks.method_crosstab(good["chemistry"]),
        "timestamp_verification": checks.timing_audit(stamped),
        "site_identity_audit": identities,
        "candidate_site_aliases": checks.candidate_aliases(stamped),
        "site_conflicts": checks.site_conflicts(identities),
        "bacteria_rows_to_review": checks.review_rows(bacteria, "bacteria"),
        "chemistry_rows_to_review": checks.review_rows(chemistry, "chemistry"),
        "discrepancy_counts": checks.discrepancy_counts(bacteria),
    }


def sensitivity_audit(table: DataFrame, good: dict[str, DataFrame], audit: dict[str, DataFrame], replicates: int = 1000) -> dict[str, DataFrame]:
    """Results without questionable outcomes: scenario summaries, flags and site intervals."""
    lines = {source: rows.select(*line_columns(rows), "site", "date") for source, rows in good.items()}
    bacteria, chemistry = audit["bacteria_formula_checks"], audit["chemistry_derived_checks"]

    def keys(b: DataFrame, c: DataFrame) -> DataFrame:
        return sensitivity.union_keys(
            sensitivity.join_many_to_one(b, lines["bacteria"]), sensitivity.join_many_to_one(c, lines["chemistry"])
        )

    wrong = chemistry.filter(~F.col("matches_candidate_formula"))
    flagged = sensitivity.observation_flags(
        table,
        audit["site_identity_audit"].filter(F.col("waterbody_variants") > 1).select("site"),
        keys(bacteria.filter(F.col("discrepancy_type") == "requires_protocol_review"), wrong),
        keys(bacteria.filter(~F.col("matches_candidate_formula")), wrong),
        sensitivity.unknown_method_days(good["chemistry"]),
        keys(bacteria, chemistry),
    )
    flagged = staged(flagged, "flagged")
    return {
        "observation_flags": flagged.select(*sensitivity.PREDICTION_KEY, *sensitivity.FLAGS),
        "scenario_results": sensitivity.sensitivity_scenarios(flagged),
        "site_bootstrap": cluster_bootstrap(sensitivity.scenario_gains(flagged), ["target", "scenario"], "gain", replicates),
    }


def write_audit(tables: dict[str, DataFrame], out: str) -> None:
    for name, table in tables.items():
        write_table(table, f"{out}/{name}")
