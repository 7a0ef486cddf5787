"""Exact order statistics that never put one group into one task.

A target or a source can hold a third of all rows, so a window over the whole group or a
``percentile`` aggregate over it would end in a single task. Here a group is first reduced
to distinct values with weights (map-side combined, keyed by group *and* value). Values are then
cut twice along the bits of a double: into outer bands by power of two and 256 parts of it, and
those into 2^22 inner bands. Totals are cumulated over outer bands, then over the inner bands of
each, and a last window runs inside an inner band, where 2^22 different doubles have room. So
every window is bounded by the number format, however many values a group has and however
closely they lie. Bands depend on values alone, so a recomputed task gives the same answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creekline.sources.sinks import staged

OUTER_PER_OCTAVE = 256
INNER_BANDS = 1 << 22
BANDS = ["_band", "_inner"]


def weighted_values(df: DataFrame, keys: Sequence[str], value: str, **weights: Column) -> DataFrame:
    """One row per group and distinct value with summed weights (default: a row count ``n``)."""
    if not weights:
        weights = {"n": F.lit(1).cast("bigint")}
    # -0.0 and 0.0 are one value.
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, (F.col(value) + F.lit(0.0)).alias(value))
        .agg(*[F.sum(w).alias(name) for name, w in weights.items()])
    )


def value_bands(value: Column) -> tuple[Column, Column]:
    """Outer and inner band: whole numbers that together never fall as ``value`` grows.

    They need no minimum or maximum of the data, so no pass and no join to find them. All steps
    are exact in double arithmetic, except the logarithm, which is put right afterwards.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    guess_scale = size / F.pow(F.lit(2.0), guess)
    power = F.when(guess_scale >= 2, guess + 1).when(guess_scale < 1, guess - 1).otherwise(guess)
    part = (size / F.pow(F.lit(2.0), power) - 1) * OUTER_PER_OCTAVE
    outer = (power + 1001) * OUTER_PER_OCTAVE + F.floor(part)
    inner = F.floor((part - F.floor(part)) * INNER_BANDS)
    tiny = size < F.lit(2.0**-1000)

    def signed(band: Column) -> Column:
        return F.when(tiny, F.lit(0)).when(value > 0, band).otherwise(-band).cast("bigint")

    return signed(outer), signed(inner)


def with_bands(counted: DataFrame, value: str) -> DataFrame:
    outer, inner = value_bands(F.col(value))
    return counted.withColumns({"_band": outer, "_inner": inner})


def _cumulated(table: DataFrame, group: Sequence[str], order: str, weights: Sequence[str], total: bool) -> DataFrame:
    """``_before_w``: the weight of earlier bands of the group; with ``total`` also the group's ``_total_w``."""
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    columns = {f"_before_{w}": F.coalesce(F.sum(f"_inside_{w}").over(earlier), F.lit(0)) for w in weights}
    if total:
        columns |= {f"_total_{w}": F.sum(f"_inside_{w}").over(whole) for w in weights}
    return table.withColumns(columns)


def band_offsets(counted: DataFrame, keys: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """Per group and inner band: weight in the band, before it and in the whole group."""
    keys = list(keys)
    sums = [F.sum(w).alias(f"_inside_{w}") for w in weights]
    inner = counted.groupBy(*keys, *BANDS).agg(*sums)
    outer = inner.groupBy(*keys, "_band").agg(*[F.sum(f"_inside_{w}").alias(f"_inside_{w}") for w in weights])
    outer = _cumulated(outer, keys, "_band", weights, True)
    outer = outer.select(*keys, "_band", *[F.col(f"_before_{w}").alias(f"_outer_{w}") for w in weights], *[f"_total_{w}" for w in weights])
    inner = _cumulated(inner, [*keys, "_band"], "_inner", weights, False)
    joined = inner.join(outer, [*keys, "_band"])
    return joined.select(
        *keys, *BANDS, *[f"_inside_{w}" for w in weights],
        *[(F.col(f"_before_{w}") + F.col(f"_outer_{w}")).alias(f"_before_{w}") for w in weights],
        *[f"_total_{w}" for w in weights],
    )


def _within_band(keys: Sequence[str], value: str):
    return (
        Window.partitionBy(*keys, *BANDS).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )


def running_totals(
    counted: DataFrame, keys: Sequence[str], value: str, weights: Sequence[str], extra: Sequence[str] = ()
) -> DataFrame:
    """Per group and distinct value: weight strictly below it (``below_w``) and of the group (``total_w``).

    ``extra`` names columns that go along."""
    # Written once: the bands and the join below read the counts, not all that they were made from.
    banded = with_bands(staged(counted, "counted"), value)
    inner = _within_band(keys, value)
    return banded.join(band_offsets(banded, keys, weights), [*keys, *BANDS]).select(
        *keys, value, *weights, *extra,
        *[
            (F.col(f"_before_{w}") + F.coalesce(F.sum(w).over(inner), F.lit(0))).alias(f"below_{w}")
            for w in weights
        ],
        *[F.col(f"_total_{w}").alias(f"total_{w}") for w in weights],
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    weight: str | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles per group: one row per group, a column per name."""
    counted = weighted_values(df, keys, value, n=F.col(weight) if weight else F.lit(1).cast("bigint"))
    # Written once: the bands and the join below read the counts, not all that they were made from.
    banded = with_bands(staged(counted, "counted"), value)
    position = {name: (F.col("_total_n") - 1) * F.lit(float(p)) for name, p in probabilities.items()}
    wanted = {}
    for name, at in position.items():
        wanted[f"_lo_{name}"] = F.floor(at)
        wanted[f"_hi_{name}"] = F.ceil(at)

    def holds(rank: Column, start: Column, count: Column) -> Column:
        return (rank >= start) & (rank < start + count)

    # Only bands holding a wanted rank go on: a few per group, whatever its size.
    needed = F.lit(False)
    for rank in wanted.values():
        needed = needed | holds(rank, F.col("_before_n"), F.col("_inside_n"))
    bands = band_offsets(banded, keys, ["n"]).filter(needed)
    start = F.col("_before_n") + F.coalesce(F.sum("n").over(_within_band(keys, value)), F.lit(0))
    picked = banded.join(bands, [*keys, *BANDS]).withColumn("_start", start)
    ends = picked.groupBy(*keys).agg(
        F.max("_total_n").alias("_total_n"),
        *[
            F.max(F.when(holds(rank, F.col("_start"), F.col("n")), F.col(value))).alias(name)
            for name, rank in wanted.items()
        ],
    )
    found = ends.select(
        *keys,
        *[
            (
                F.col(f"_lo_{name}")
                + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (at - F.floor(at))
            ).alias(name)
            for name, at in position.items()
        ],
    )
    # Written, so that its size is known: rows that it is joined to need not be dealt out by group, of which there
    # may be as few as targets.
    return staged(found, "quantiles")


def mid_ranks(counted: DataFrame, keys: Sequence[str], value: str, extra: Sequence[str] = ()) -> DataFrame:
    """Per group and distinct value of a count ``n`` each: ``midrank`` (ties share the mean rank) and group ``total``."""
    ranked = running_totals(counted, keys, value, ["n"], extra)
    return ranked.select(
        *keys, value, "n", *extra,
        (F.col("below_n") + (F.col("n") + 1) / F.lit(2.0)).alias("midrank"),
        F.col("total_n").alias("total"),
    )


def rank_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Spearman correlation per group, over rows where both values are present. ``df`` is read twice.

    Ranks of ``x`` are summed per distinct ``y`` before ``y`` is ranked, so pairs are never a table.
    """
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys, (F.col(x) + F.lit(0.0)).alias(x), (F.col(y) + F.lit(0.0)).alias(y)
    )
    # Every midrank's mean is (samples + 1) / 2.
    centred = F.col("midrank") - (F.col("total") + 1) / F.lit(2.0)
    of_x = staged(mid_ranks(weighted_values(rows, keys, x), keys, x).select(*keys, x, "n", centred.alias("_dx")), "ranks")
    per_y = rows.join(of_x.select(*keys, x, "_dx"), [*keys, x]).groupBy(*keys, y).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_dx").alias("_sum_dx")
    )
    dy = F.col("_dy")
    sums = mid_ranks(per_y, keys, y, ["_sum_dx"]).withColumn("_dy", centred).groupBy(*keys).agg(
        F.sum("n").alias("samples"), F.sum(F.col("_sum_dx") * dy).alias("_xy"), F.sum(F.col("n") * dy * dy).alias("_yy")
    )
    squares = of_x.groupBy(*keys).agg(F.sum(F.col("n") * F.col("_dx") * F.col("_dx")).alias("_xx"))
    return sums.join(squares, list(keys)).select(
        *keys, "samples",
        F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx")) * F.sqrt(F.col("_yy"))).alias("spearman"),
    )


def score_counts(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    return weighted_values(
        df, keys, score,
        pos=F.col(label).cast("bigint"), neg=F.lit(1).cast("bigint") - F.col(label).cast("bigint"),
    )


def score_ranks(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Positives and negatives at and below every distinct score."""
    return running_totals(score_counts(df, keys, score, label), keys, score, ["pos", "neg"])


def ranking_aggregates() -> list[Column]:
    """Sums over ``score_ranks`` rows that ``ranking_columns`` turns into the two metrics."""
    above_pos = F.col("total_pos") - F.col("below_pos")
    above_all = above_pos + F.col("total_neg") - F.col("below_neg")
    return [
        F.max("total_pos").alias("_p"),
        F.max("total_neg").alias("_n"),
        F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / F.lit(2.0))).alias("_wins"),
        F.sum(F.col("pos") * F.try_divide(above_pos.cast("double"), above_all.cast("double"))).alias("_area"),
    ]


def ranking_columns() -> list[Column]:
    return [
        F.try_divide(F.col("_wins"), F.col("_p").cast("double") * F.col("_n")).alias("AUC"),
        F.try_divide(F.col("_area"), F.col("_p").cast("double")).alias("average_precision"),
    ]


def ranking_metrics(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """``AUC`` (NULL with one class) and ``average_precision`` (NULL without positives)."""
    ranks = score_ranks(df, keys, score, label)
    return ranks.groupBy(*keys).agg(*ranking_aggregates()).select(*keys, *ranking_columns())


def recall_cutoff(df: DataFrame, keys: Sequence[str], score: str, label: str, recall: float) -> DataFrame:
    """Greatest threshold among 0 and the scores whose recall reaches ``recall``."""
    running = running_totals(score_counts(df, keys, score, label), keys, score, ["pos"])
    caught = (F.col("total_pos") - F.col("below_pos")).cast("double")
    reached = F.try_divide(caught, F.col("total_pos").cast("double")) >= recall
    return (
        running.groupBy(*keys)
        .agg(F.max(F.when(reached, F.col(score))).alias("_t"), F.max("total_pos").alias("_p"))
        .select(
            *keys,
            F.when(F.col("_p") > 0, F.greatest(F.coalesce(F.col("_t"), F.lit(0.0)), F.lit(0.0))).alias("cutoff"),
        )
    )


def most_common(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per group, the smallest on ties, and its count; counted per value first."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    # Two max/min steps instead of a frequency map held in one task.
    top = counted.groupBy(*keys).agg(
        F.min_by(F.col(value), F.struct(-F.col("n"), F.col(value))).alias("most_common_value"),
        F.max("n").alias("most_common_count"),
    )
    return top
