"""Score frozen models on samples taken after their snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creekline.functions import fixed_values as fixed
from creekline.functions.scalar import percent_gain
from creekline.functions.specs import TargetSpec, inverse, names
from creekline.operators.bootstrap import cluster_bootstrap
from creekline.operators.errors import verdict
from creekline.operators.folds import test_gains
from creekline.operators.history import training_rows
from creekline.operators.models import apply_models, load_models
from creekline.operators.revisions import exclude_sites, revisions
from creekline.sources.sinks import assert_frozen, staged, write_metrics_json, write_table

SCOPE = ["target", "fold"]


def judge(rows: DataFrame, registry: DataFrame, specs: Sequence[TargetSpec], scope: str, replicates: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Errors, gain, interval and verdict per target, and the scored rows.

    ``rows`` carry ``regressed`` where the frozen forecast is a fitted model. One site gives no
    interval: its bounds are NULL.
    """
    tagged = rows.withColumns({"fold": F.lit(scope), "split": F.lit("test")})
    chosen = registry.select("target", "selected", "selected_baseline", F.lit(scope).alias("fold"))
    medians = registry.select("target", "median", F.lit(scope).alias("fold"))
    gains = staged(test_gains(tagged, chosen, medians, specs, model=F.col("regressed")), "judged")
    target = F.col("target")
    errors = gains.groupBy(*SCOPE, "selected", "selected_baseline").agg(
        F.count(F.lit(1)).alias("observations"),
        F.avg(F.abs(F.col("_y") - F.col("_forecast"))).alias("model_transformed_MAE"),
        F.avg(F.abs(F.col("actual") - inverse(specs, target, F.col("_forecast")))).alias("model_source_MAE"),
        F.avg(F.abs(F.col("_y") - F.col("_base"))).alias("baseline_transformed_MAE"),
        F.avg(F.abs(F.col("actual") - inverse(specs, target, F.col("_base")))).alias("baseline_source_MAE"),
    )
    several = F.col("sites") > 1
    interval = cluster_bootstrap(gains, SCOPE, "gain", replicates).withColumns({
        "lower_95": F.when(several, F.col("lower_95")), "upper_95": F.when(several, F.col("upper_95")),
    })
    # Every frozen target has a row; one without new samples has none observed and is never judged.
    frozen = registry.select("target", F.lit(scope).alias("fold"), "selected", "selected_baseline")
    seen = errors.drop("selected", "selected_baseline").join(interval, SCOPE)
    judged = frozen.join(seen, SCOPE, "left").withColumns({
        "observations": F.coalesce("observations", F.lit(0)), "sites": F.coalesce("sites", F.lit(0)),
    }).select(
        "*",
        F.coalesce(
            percent_gain(F.col("model_transformed_MAE"), F.col("baseline_transformed_MAE")), F.lit(0.0)
        ).alias("improvement_percent"),
        verdict(
            F.col("observations"), F.col("sites"), F.col("mean_gain"), F.col("lower_95"), F.col("upper_95"), F.col("selected")
        ).alias("verdict"),
        target.isin(*fixed.PRIMARY_TARGETS).alias("primary"),
    )
    scored = gains.select(
        "site", "date", "issue_date", "actual", "target_age_days", "target",
        inverse(specs, target, F.col("_forecast")).alias("predicted"),
        inverse(specs, target, F.col("_base")).alias("baseline_predicted"),
    )
    return judged, scored


def score_frozen(
    spark: SparkSession, observations: DataFrame, specs: Sequence[TargetSpec], models_path: str, digest: str, start: str,
    conflict_sites: Sequence[str] = tuple(fixed.CONFLICT_SITES), replicates: int = 1000,
) -> tuple[DataFrame, DataFrame]:
    """Refuse changed models; judge all sites and the sites without name conflicts."""
    assert_frozen(spark, models_path, digest)
    registry, models = load_models(spark, models_path)
    rows = training_rows(observations, specs).filter(F.col("date") >= F.lit(start).cast("date"))
    rows = staged(apply_models(rows, models, registry), "applied")
    every, scored = judge(rows, registry, specs, "all_sites", replicates)
    kept, _ = judge(exclude_sites(rows, conflict_sites), registry, specs, "excluding_site_conflicts", replicates)
    return every.unionByName(kept), scored


def protocol(old: DataFrame, new: DataFrame, digest: str, start: str, snapshot: str, frozen_snapshot: str) -> DataFrame:
    """One row on what a run may claim: the models' digest, the dates, whether it scores dates that the models were
    frozen with (then it only reproduces), and how the source changed before that snapshot."""
    changes = revisions(old, new, frozen_snapshot)
    return changes.select(
        F.lit(digest).alias("models_sha256"), F.lit(start).cast("date").alias("start"), F.lit(snapshot).cast("date").alias("snapshot_date"),
        (F.lit(start).cast("date") <= F.lit(frozen_snapshot).cast("date")).alias("reproduction_check_only"),
        "unchanged", "changed", "removed", "added",
    )


def run(
    spark: SparkSession, frozen: DataFrame, observations: DataFrame, specs: Sequence[TargetSpec], models_path: str, digest: str, start: str,
    snapshot: str, frozen_snapshot: str, out: str, conflict_sites: Sequence[str] = tuple(fixed.CONFLICT_SITES), replicates: int = 1000,
) -> tuple[DataFrame, DataFrame]:
    """A prospective run as it is filed: verdicts, protocol with source revisions, and predictions under ``out``.

    ``frozen`` are the clean measurements that the models were frozen with.
    """
    judged, scored = score_frozen(spark, observations, specs, models_path, digest, start, conflict_sites, replicates)
    judged = staged(judged, "verdicts")
    about = staged(protocol(frozen, observations, digest, start, snapshot, frozen_snapshot), "protocol")
    write_metrics_json(judged, f"{out}/evaluation")
    write_metrics_json(about, f"{out}/protocol")
    write_table(scored, f"{out}/predictions", ["target"], ["site", "date"])
    return judged, about
