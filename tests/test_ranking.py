"""Distributed order statistics against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from creekline.operators import ranking as R


def frame(spark, groups):
    return spark.createDataFrame([(g, float(v)) for g, values in groups.items() for v in values], "g string, v double")


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(5)
    return {
        "mixed": np.concatenate([rng.normal(size=400) * 1e3, [0.0, -0.0, 1e-310, -1e300, 1e300, 2.0, 2.0, 4.0]]),
        "hot": np.concatenate([np.full(900, 7.25), rng.uniform(7.2, 7.3, 100)]),
        "narrow": 100 + rng.uniform(0, 1e-9, 200),
        "powers": np.array([2.0**k for k in range(-40, 41)]),
        "one": np.array([3.5]),
    }


def test_exact_quantiles(spark, groups):
    probabilities = {"a": 0.05, "b": 0.5, "c": 0.9, "d": 1.0}
    got = {r["g"]: r for r in R.exact_quantiles(frame(spark, groups), ["g"], "v", probabilities).collect()}
    for name, values in groups.items():
        for key, p in probabilities.items():
            assert got[name][key] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-300)


def test_weighted_quantile_equals_repeated_rows(spark):
    df = spark.createDataFrame([("g", 1.0, 3), ("g", 2.0, 1), ("g", 9.0, 2)], "g string, v double, n bigint")
    assert R.exact_quantiles(df, ["g"], "v", {"m": 0.5}, weight="n").first()["m"] == 1.5


def test_value_band_never_falls(spark, groups):
    values = np.unique(np.concatenate(list(groups.values())) + 0.0)
    rows = frame(spark, {"x": values}).select("v", F.struct(*R.value_bands(F.col("v"))).alias("b")).orderBy("v").collect()
    bands = [r["b"] for r in rows]
    assert bands == sorted(bands)


def test_narrow_range_is_spread_over_bands(spark):
    values = np.random.default_rng(4).uniform(20_000, 20_001, 5_000)
    df = frame(spark, {"x": values})
    bands = R.with_bands(df, "v").select(*R.BANDS).distinct().count()
    assert bands > 2_000
    got = R.exact_quantiles(df, ["g"], "v", {"q": 0.3, "m": 0.5}).first()
    assert got["q"] == pytest.approx(np.quantile(values, 0.3), rel=1e-14)
    assert got["m"] == pytest.approx(np.quantile(values, 0.5), rel=1e-14)


def brute_auc(scores, labels):
    wins = sum((p > n) + 0.5 * (p == n) for p in scores[labels == 1] for n in scores[labels == 0])
    return wins / ((labels == 1).sum() * (labels == 0).sum())


def brute_average_precision(scores, labels):
    total, out = labels.sum(), 0.0
    for s in np.unique(scores):
        at = scores == s
        above = scores >= s
        out += labels[at].sum() / total * labels[above].mean()
    return out


def test_ranking_metrics_and_cutoff(spark):
    rng = np.random.default_rng(3)
    scores, labels = np.round(rng.uniform(size=300), 2), (rng.uniform(size=300) < 0.3).astype(int)
    rows = [("a", float(s), int(y)) for s, y in zip(scores, labels, strict=True)]
    rows += [("none", 0.5, 0), ("none", 0.7, 0), ("all", 0.5, 1)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    got = {r["g"]: r for r in R.ranking_metrics(df, ["g"], "p", "y").collect()}
    assert got["a"]["AUC"] == pytest.approx(brute_auc(scores, labels))
    assert got["a"]["average_precision"] == pytest.approx(brute_average_precision(scores, labels))
    assert got["none"]["AUC"] is None and got["none"]["average_precision"] is None
    assert got["all"]["AUC"] is None and got["all"]["average_precision"] == 1.0
    cut = {r["g"]: r["cutoff"] for r in R.recall_cutoff(df, ["g"], "p", "y", 0.75).collect()}
    possible = [t for t in np.unique(np.r_[0.0, scores]) if labels[scores >= t].sum() / labels.sum() >= 0.75]
    assert cut["a"] == max(possible)


def test_rank_correlation(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=200), 1)
    y = np.round(x + rng.normal(size=200), 1)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y, strict=True)], "g string, x double, y double")

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    want = np.corrcoef(ranks(x), ranks(y))[0, 1]
    assert R.rank_correlation(df, ["g"], "x", "y").first()["spearman"] == pytest.approx(want)


def test_most_common_takes_the_smallest_on_ties(spark):
    row = R.most_common(frame(spark, {"g": [5, 5, 2, 2, 9]}), ["g"], "v").first()
    assert (row["most_common_value"], row["most_common_count"]) == (2.0, 2)


def test_values_are_counted_once(spark):
    """Bands and joins read the counts; the rows that they come from are read by one job."""
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(200).select(F.lit("g").alias("k"), (F.col("id") % 17).cast("double").alias("v"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    rows = df.mapInArrow(watched, df.schema)
    quantile = R.exact_quantiles(rows, ["k"], "v", {"q": 0.5}).first()
    assert quantile["q"] == 8.0 and seen.value == 200
    assert R.recall_cutoff(rows, ["k"], "v", "y", 0.5).first()["cutoff"] > 0 and seen.value == 400


def test_rank_correlation_reads_its_rows_twice(spark):
    """Ranks of one side are summed per value of the other; pairs are not counted as a table of their own."""
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(300).select(F.lit("g").alias("k"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 11).cast("double").alias("y"))
    got = R.rank_correlation(df.mapInArrow(watched, df.schema), ["k"], "x", "y").first()
    assert seen.value == 600 and got["samples"] == 300
    x, y = np.arange(300) % 7, np.arange(300) % 11
    ranks = [np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v]) for v in (x, y)]
    assert got["spearman"] == pytest.approx(np.corrcoef(*ranks)[0, 1])


def test_rows_are_not_dealt_out_by_group_to_meet_their_quantiles(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("g"), F.col("id").cast("double").alias("v"))
    joined = df.join(R.exact_quantiles(df, ["g"], "v", {"q": 0.5}), "g")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert {r["g"]: r["q"] for r in joined.select("g", "q").distinct().collect()} == {"0": 499.5, "1": 499.0, "2": 500.0}
