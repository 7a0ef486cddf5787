"""Replicates collapse to one row per prediction unit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creekline.functions import fixed_values as fixed
from creekline.operators.quarantine import line_columns
from creekline.operators.ranking import exact_quantiles
from creekline.sources.sinks import staged

UNIT = ["site", "date", "target"]
#: Rows of one group that a task sorts; larger groups are ranked over bands.
SORTED_ROWS = 1 << 20


def _larger(rows: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """Keys with more than ``most`` rows, counted where the rows lie; at most rows / most of them."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return staged(counts.filter(F.col("_n") > most).select(*keys), "larger")


def _sorted_medians(rows: DataFrame, keys: Sequence[str], least: bool) -> DataFrame:
    """One shuffle and one sort: the row in the middle of its group knows the group's size and the next value."""
    order = Window.partitionBy(*keys).orderBy(F.col("_value").asc_nulls_last())
    group = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = rows.select(
        *keys, "_value",
        F.row_number().over(order).alias("_place"),
        F.lead("_value").over(order).alias("_next"),
        F.count("_value").over(group).alias("_known"),
        F.count(F.lit(1)).over(group).alias("rows"),
        *([F.min("_least").over(group).alias("_first")] if least else []),
    )
    between = F.col("_value") + (F.col("_next") - F.col("_value")) * 0.5
    # The lower of two middles; a group of NULLs alone has no middle and drops out.
    middle = placed.filter((F.col("_known") > 0) & (F.col("_place") == F.floor((F.col("_known") + 1) / 2)))
    return middle.select(
        *keys, F.when(F.col("_known") % 2 == 1, F.col("_value")).otherwise(between).alias("median"),
        "rows", *(["_first"] if least else []),
    )


def _banded_medians(rows: DataFrame, keys: Sequence[str], least: bool) -> DataFrame:
    """The same for groups of any size: values are counted first and ranked over bounded bands."""
    per_value = rows.groupBy(*keys, "_value").agg(
        F.count(F.lit(1)).alias("_n"), *([F.min("_least").alias("_least")] if least else [])
    )
    medians = exact_quantiles(per_value, keys, "_value", {"median": 0.5}, weight="_n")
    extra = [F.sum("_n").alias("rows"), *([F.min("_least").alias("_first")] if least else [])]
    return medians.join(per_value.groupBy(*keys).agg(*extra), keys)


def grouped_median(
    rows: DataFrame, keys: Sequence[str], value: str, least: Column | None = None, most: int = SORTED_ROWS
) -> DataFrame:
    """Exact median of each group's values that are not NULL as ``median``, and the group's number of ``rows``.

    ``least`` adds its smallest value per group as ``_first``. Groups of NULLs alone and groups with a NULL key
    drop out. Groups of up to ``most`` rows are sorted where a shuffle puts them; only the rows of larger ones are
    ranked over bands. Larger groups are looked for among the first keys that have more rows than that.
    """
    keys, named = list(keys), least is not None
    # -0.0 and 0.0 are one value.
    columns = [*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("_value"), *([least.alias("_least")] if named else [])]
    rows = rows.select(*columns)
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
    suspects = _larger(rows, keys[:1], most)
    if suspects.isEmpty():
        return _sorted_medians(rows, keys, named)
    large = _larger(rows.join(suspects, keys[:1], "left_semi"), keys, most)
    if large.isEmpty():
        return _sorted_medians(rows, keys, named)
    small = _sorted_medians(rows.join(large, keys, "left_anti"), keys, named)
    return small.unionByName(_banded_medians(rows.join(large, keys, "left_semi"), keys, named))


def collapse_replicates(measurements: DataFrame, names: bool = True, most: int = SORTED_ROWS) -> DataFrame:
    """Median value, first waterbody in source order and replicate count per site, date, target.

    Input: site, date, target, value, waterbody, csv_line. Rows are shuffled once, by unit; a unit of more than
    ``most`` rows is combined by value and spread over many tasks. Afterwards a series has at most one row per
    calendar day, which bounds all later work on it. Features need no waterbody: ``names=False`` leaves it out.
    """
    least = F.struct(*line_columns(measurements), "waterbody") if names else None
    collapsed = grouped_median(measurements, UNIT, "value", least, most)
    waterbody = [F.col("_first.waterbody").alias("waterbody")] if names else []
    return collapsed.select(*UNIT, F.col("median").alias("value"), *waterbody, F.col("rows").alias("replicate_rows"))


def v1_collapse_site_days(rows: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """First generation: median of each numeric column, first watershed and waterbody."""
    long = rows.unpivot(["site", "date"], list(numeric), "_name", "_cell").filter("_cell is not null")
    medians = grouped_median(long, ["site", "date", "_name"], "_cell")
    wide = medians.groupBy("site", "date").agg(
        *[F.max(F.when(F.col("_name") == name, F.col("median"))).alias(name) for name in numeric]
    )
    firsts = rows.groupBy("site", "date").agg(
        F.min(F.struct(*line_columns(rows), "watershed", "waterbody")).alias("_first"),
        F.count(F.lit(1)).alias("rows"),
    )
    return firsts.join(wide, ["site", "date"], "left").select(
        "site", "date", *numeric,
        F.col("_first.watershed").alias("watershed"), F.col("_first.waterbody").alias("waterbody"), "rows",
    )


def v1_ingest_audit(judged: DataFrame, site_days: DataFrame) -> DataFrame:
    """Counts and date span of a first-generation source, as one row."""
    excluded = F.when(F.col("reason") != "", 1).otherwise(0).cast("bigint")
    counts = judged.agg(F.count(F.lit(1)).alias("input_rows"), F.sum(excluded).alias("excluded_rows"))
    days = site_days.agg(
        F.count(F.lit(1)).alias("site_days"),
        F.sum(F.col("rows") - 1).alias("duplicate_site_days_collapsed"),
        F.count_distinct("site").alias("sites"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
    )
    one = F.lit(1).alias("_one")
    return (
        counts.select("*", one).join(days.select("*", one), "_one").drop("_one")
        .withColumn("retained_rows", F.col("input_rows") - F.col("excluded_rows"))
    )


V1_NUMERIC = {
    "bacteria": ["ecoli", *fixed.V1_TEMPERATURES],
    "chemistry": list(fixed.V1_CHEMISTRY),
}
