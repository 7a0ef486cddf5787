"""Comparing tables: silent source revisions, verified joins, overlays and exclusions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creekline.functions import fixed_values as fixed
from creekline.functions.scalar import is_close
from creekline.operators.sensitivity import PREDICTION_KEY, assert_unique


def verify_join_1_1(predictions: DataFrame, clean: DataFrame) -> DataFrame:
    """Join predictions to the clean value; raise unless keys are unique, matched and values agree."""
    assert_unique(predictions, PREDICTION_KEY, "predictions")
    assert_unique(clean, PREDICTION_KEY, "clean measurements")
    joined = predictions.join(clean.select(*PREDICTION_KEY, "value"), PREDICTION_KEY, "left")
    wrong = F.coalesce(~is_close(F.col("actual"), F.col("value")), F.lit(True))
    found = joined.agg(
        F.count_if(F.col("value").isNull()).alias("unmatched"), F.count_if(wrong).alias("wrong")
    ).first()
    if found["unmatched"] or found["wrong"]:
        raise ValueError(f"{found['unmatched']} predictions unmatched, {found['wrong']} without the clean value")
    return joined


def revisions(old: DataFrame, new: DataFrame, snapshot: str) -> DataFrame:
    """Unchanged, changed, removed and added aggregates dated up to the old snapshot, as one row."""
    before = old.select(*PREDICTION_KEY, F.col("value").alias("_old"), F.lit(True).alias("_in_old"))
    after = new.filter(F.col("date") <= F.lit(snapshot).cast("date")).select(
        *PREDICTION_KEY, F.col("value").alias("_new"), F.lit(True).alias("_in_new")
    )
    both = F.col("_in_old").isNotNull() & F.col("_in_new").isNotNull()
    same = F.coalesce(is_close(F.col("_old"), F.col("_new"), 1e-5, 1e-8), F.lit(False))
    return before.join(after, PREDICTION_KEY, "full_outer").agg(
        F.count_if(both & same).alias("unchanged"),
        F.count_if(both & ~same).alias("changed"),
        F.count_if(F.col("_in_new").isNull()).alias("removed"),
        F.count_if(F.col("_in_old").isNull()).alias("added"),
    )


def overlay(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Hypothetical rows replace real rows of the same site, date and target."""
    return base.join(extra.select(*PREDICTION_KEY), PREDICTION_KEY, "left_anti").unionByName(
        extra, allowMissingColumns=True
    )


def exclude_sites(df: DataFrame, sites: Sequence[str] = tuple(fixed.CONFLICT_SITES)) -> DataFrame:
    """Drop a fixed list of sites; the list is a literal in the filter, pushed to the scan."""
    return df.filter(~F.col("site").isin(*sites))
