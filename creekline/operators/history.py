"""As-of history: what was known about a series when a forecast is issued.

A visit on day d is forecast on d - lead from results at least ``delay`` days old, so only
samples dated d - lead - delay or earlier count. That is one pass over rows by site and day
(first generation: a range frame), not a join. Observations are unique per site, date and
target, so a site holds at most one row per calendar day and target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creekline.functions import fixed_values as fixed
from creekline.functions.scalar import day_number, month_angle
from creekline.functions.specs import TargetSpec, names, transform
from creekline.operators.running_median import with_running_median
from creekline.operators.site_states import with_site_states

CORE_FEATURES = [
    "month_sin", "month_cos", "target_age_days", "history_count", "last_value",
    "last3_mean", "history_median", "seasonal_site", "last_change",
]
TOO_FEW = "fewer_than_two_available_target_samples"
TOO_OLD = "target_history_older_than_120_days"
ELIGIBLE = "eligible"


def issue_date(date: Column, lead: int = fixed.LEAD_DAYS) -> Column:
    return F.date_sub(date, lead)


def eligibility(count: Column, age: Column, max_age: int = fixed.MAX_AGE_DAYS) -> Column:
    return F.when(count < 2, TOO_FEW).when(age > max_age, TOO_OLD).otherwise(ELIGIBLE)


def past(keys: Sequence, gap: int) -> Window:
    """Everything of the same keys at least ``gap`` days earlier."""
    return Window.partitionBy(*keys).orderBy("_day").rangeBetween(Window.unboundedPreceding, -gap)


def _timeline(obs: DataFrame, probes: DataFrame | None, specs: Sequence[TargetSpec]) -> DataFrame:
    """Observations on the transformed scale, plus probe rows that have no value, together by site."""
    known = obs.select("site", "target", "date", "value", F.lit(probes is None).alias("_probe"), F.lit(True).alias("_sampled"))
    if probes is not None:
        asked = probes.select("site", "target", "date", F.lit(True).alias("_probe"), F.lit(False).alias("_sampled"))
        known = known.unionByName(asked, allowMissingColumns=True)
    # The one shuffle.
    return known.repartition("site").select(
        "*",
        day_number(F.col("date")).alias("_day"),
        F.month("date").alias("_month"),
        transform(specs, F.col("target"), F.col("value").cast("double")).alias("_v"),
    )


def cross_target(specs: Sequence[TargetSpec], max_age: int) -> dict[str, Column]:
    """``prior_<t>`` and ``age_<t>``: latest value of every target at the cutoff, if not too old."""
    columns = {}
    for i, s in enumerate(specs):
        age = F.col("_day") - F.col(f"_day_{i}")
        columns[f"prior_{s.target}"] = F.when(age <= max_age, F.col(f"_value_{i}"))
        columns[f"age_{s.target}"] = F.when(age <= max_age, age)
    return columns


def history_features(
    obs: DataFrame,
    specs: Sequence[TargetSpec],
    probes: DataFrame | None = None,
    cross: bool = True,
    lead: int = fixed.LEAD_DAYS,
    delay: int = fixed.RESULT_DELAY_DAYS,
    max_age: int = fixed.MAX_AGE_DAYS,
) -> DataFrame:
    """Features and ``status`` for each observation, or for each (site, target, date) probe.

    ``actual`` is the observed value (NULL for probes). Features are NULL unless eligible.
    Statistics are taken on the transformed scale.
    """
    gap = lead + delay
    rows = with_site_states(_timeline(obs, probes, specs), gap, names(specs) if cross else [])
    age = F.col("_day") - F.col("_last_day")
    seasonal = (F.coalesce(F.col("_month_sum"), F.lit(0.0)) + 3 * F.col("history_median")) / (
        F.col("_month_count") + 3
    )
    columns = {
        "month_sin": F.sin(month_angle(F.col("date"))),
        "month_cos": F.cos(month_angle(F.col("date"))),
        "target_age_days": age,
        "history_count": F.col("history_count"),
        "last_value": F.col("_last_v"),
        "last3_mean": F.col("_last_mean3"),
        "history_median": F.col("history_median"),
        "seasonal_site": seasonal,
        "last_change": F.col("_last_v") - F.col("_last_previous"),
        **(cross_target(specs, max_age) if cross else {}),
    }
    rows = rows.filter("_probe").withColumn("status", eligibility(F.col("history_count"), age, max_age))
    eligible = F.col("status") == ELIGIBLE
    return rows.select(
        "site", "target", "date",
        issue_date(F.col("date"), lead).alias("issue_date"),
        F.col("value").alias("actual"),
        "status",
        *[F.when(eligible, column).alias(name) for name, column in columns.items()],
    )


def training_rows(obs: DataFrame, specs: Sequence[TargetSpec], cross: bool = True) -> DataFrame:
    """Eligible observations with their features and outcome."""
    return history_features(obs, specs, cross=cross).filter(F.col("status") == ELIGIBLE).drop("status")


def v1_features(
    bacteria: DataFrame,
    chemistry: DataFrame,
    probes: DataFrame | None = None,
    lead: int = fixed.LEAD_DAYS,
    delay: int = fixed.RESULT_DELAY_DAYS,
    max_age: int = fixed.MAX_AGE_DAYS,
) -> DataFrame:
    """First-generation features per bacteria site-day (or per site, date probe); ineligible rows drop out.

    Chemistry comes from the latest whole row at the cutoff: its NULLs stay NULL.
    """
    gap = lead + delay
    chem = list(fixed.V1_CHEMISTRY)
    site_rows = Window.partitionBy("site").orderBy("_day")
    day = day_number(F.col("date")).alias("_day")
    known = (
        bacteria.select("site", "date", "ecoli", "air_temperature", "water_temperature", day)
        .repartition("site")
        .withColumn("_v", F.log1p("ecoli"))
        .withColumn("_mean3", F.avg("_v").over(site_rows.rowsBetween(-2, 0)))
        .withColumn("_previous", F.lag("_v").over(site_rows))
        .select(
            "site", "date", "_day", "ecoli", "_v",
            F.struct(
                "_day", "_v", "_mean3", "_previous", "air_temperature", "water_temperature"
            ).alias("_sample"),
            F.lit(probes is None).alias("_probe"),
        )
    )
    lab = chemistry.select("site", "date", day, F.struct(day, *chem).alias("_chem"), F.lit(False).alias("_probe"))
    rows = known.unionByName(lab, allowMissingColumns=True)
    if probes is not None:
        asked = probes.select("site", "date", day, F.lit(True).alias("_probe"))
        rows = rows.unionByName(asked, allowMissingColumns=True)
    window = past(["site"], gap)
    rows = rows.select(
        "*",
        F.last("_sample", ignorenulls=True).over(window).alias("_latest"),
        F.last("_chem", ignorenulls=True).over(window).alias("_lab"),
        F.count("_v").over(window).alias("history_count"),
    )
    rows = with_running_median(rows, ["site"], "_day", "_v", gap, "_median").filter("_probe")
    age = F.col("_day") - F.col("_latest._day")
    lab_age = F.col("_day") - F.col("_lab._day")
    fresh = lab_age <= max_age
    return rows.filter((F.col("history_count") >= 2) & (age <= max_age)).select(
        "site", "date", issue_date(F.col("date"), lead).alias("issue_date"),
        F.col("ecoli").alias("actual_ecoli"),
        F.sin(month_angle(F.col("date"))).alias("month_sin"),
        F.cos(month_angle(F.col("date"))).alias("month_cos"),
        "history_count",
        age.alias("bacteria_age_days"),
        F.col("_latest._v").alias("last_log_ecoli"),
        F.col("_latest._mean3").alias("mean_last3_log_ecoli"),
        F.col("_median").alias("median_history_log_ecoli"),
        F.col("_latest.air_temperature").alias("last_air_temp"),
        F.col("_latest.water_temperature").alias("last_water_temp"),
        (F.col("_latest._v") - F.col("_latest._previous")).alias("trend_log_ecoli"),
        *[F.when(fresh, F.col(f"_lab.{name}")).alias(f"chem_{name}") for name in chem],
        F.when(fresh, lab_age).alias("chem_age_days"),
    )
