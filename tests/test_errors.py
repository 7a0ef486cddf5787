"""Error tables, bootstrap, verdicts, revisions, sensitivity."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from creekline.functions.specs import default_specs
from creekline.operators import bootstrap as B
from creekline.operators import checks as K
from creekline.operators import errors as E
from creekline.operators import revisions as V
from creekline.operators import sensitivity as N

SCHEMA = ("target string, site string, error double, baseline_error double, source_error double, actual double, predicted double, "
          "actual_tail_event int, experimental_flag boolean")


def test_denominators(spark):
    rows = [("t", "a", 1.0, 4.0, 1.0, 3.0, 2.0, 1, True), ("t", "a", 3.0, 4.0, 3.0, 5.0, 2.0, 1, False),
            ("t", "b", 2.0, 4.0, 2.0, 2.0, 4.0, 0, True), ("t", "b", 2.0, 4.0, 2.0, 2.0, 4.0, 0, False),
            ("u", "a", 1.0, 0.0, 1.0, 1.0, 2.0, 0, False)]
    got = {r["target"]: r for r in E.error_summary(spark.createDataFrame(rows, SCHEMA), ["target"]).collect()}
    t = got["t"]
    assert (t["samples"], t["sites"], t["improvement_percent"], t["caught"], t["missed"], t["false_flags"]) == (4, 2, 50.0, 1, 1, 1)
    assert (t["recall"], t["precision"]) == (0.5, 0.5)
    assert got["u"]["improvement_percent"] is None and got["u"]["recall"] is None and got["u"]["precision"] is None


def test_zero_rates_in_classification(spark):
    df = spark.createDataFrame([("t", 0.1, 0), ("t", 0.2, 0)], "target string, p double, y int")
    row = E.classification_metrics(df, ["target"], "p", "y", F.lit(0.5)).first()
    assert (row["precision"], row["recall"], row["AUC"], row["alerts"]) == (0.0, 0.0, None, 0)
    assert row["Brier"] == pytest.approx((0.01 + 0.04) / 2)


def test_tail_labels(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (10.0,)], "v double")
    none = F.lit(None).cast("double")
    label = lambda lo, hi: [r[0] for r in df.select(E.risk_label(F.col("v"), lo, hi)).collect()]
    assert label(F.lit(3.0), none) == [1, 0, 0]
    assert label(none, F.lit(7.0)) == [0, 0, 1]
    assert label(F.lit(3.0), F.lit(7.0)) == [1, 0, 1]


def hashed(*place):
    digits = hashlib.md5(":".join(map(str, place)).encode()).hexdigest()
    return [int(digits[8 * i :][:8], 16) for i in range(4)]


@pytest.mark.parametrize("bucket", [1024, 7, 3])
def test_bootstrap_repeats_its_hashed_draws(spark, bucket):
    rng = np.random.default_rng(1)
    rows = [("t", f"s{i % 7}", float(rng.normal() + 0.3)) for i in range(90)]
    df = spark.createDataFrame(rows, "target string, site string, gain double")
    got = B.cluster_bootstrap(df, ["target"], "gain", 50, bucket_sites=bucket).first()
    again = B.cluster_bootstrap(df.repartition(5), ["target"], "gain", 50, bucket_sites=bucket).first()
    assert list(got)[1:] == pytest.approx(list(again)[1:])
    sites = sorted({s for _, s, _ in rows}, key=lambda s: (hashlib.md5(s.encode()).hexdigest()[:3], s))
    sums = np.array([sum(g for _, s, g in rows if s == x) for x in sites])
    counts = np.array([sum(1 for _, s, _ in rows if s == x) for x in sites])
    estimates = []
    for rep in range(50):
        owners = [hashed(42, rep // 4, slot)[rep % 4] % 7 // bucket for slot in range(7)] if bucket < 7 else [0] * 7
        picks = []
        for b in range(-(-7 // bucket)):
            size = min(bucket, 7 - b * bucket)
            picks += [b * bucket + hashed(42, rep, b, k // 4)[k % 4] % size for k in range(owners.count(b))]
        assert len(picks) == 7
        estimates.append(sums[picks].sum() / counts[picks].sum())
    assert got["mean_gain"] == pytest.approx(sums.sum() / counts.sum())
    assert [got["lower_95"], got["upper_95"]] == pytest.approx(list(np.quantile(estimates, [0.025, 0.975])))


def test_bootstrap_over_buckets_spreads_like_one_over_sites(spark):
    rng = np.random.default_rng(4)
    rows = [("t", f"s{i}", float(g)) for i, g in enumerate(rng.normal(size=400))]
    df = spark.createDataFrame(rows, "target string, site string, gain double")
    gains = np.array([g for *_, g in rows])
    wanted = np.quantile(gains[rng.integers(0, 400, (4000, 400))].mean(1), [0.025, 0.975])
    for bucket in (1024, 32):
        got = B.cluster_bootstrap(df, ["target"], "gain", 1000, bucket_sites=bucket).first()
        assert [got["lower_95"], got["upper_95"]] == pytest.approx(list(wanted), abs=0.015)


def test_bootstrap_keeps_draws_in_arrays(spark):
    """Several groups share hashes; NULL gains are left out; a row per replicate and bucket leaves the tasks, none per draw."""
    rows = [(t, y, f"s{i}", None if i % 9 == 0 else float(i % 13) - 5 + y) for t in "ab" for y in (1, 2) for i in range(40 if t == "a" else 5)]
    df = spark.createDataFrame(rows, "target string, year int, site string, gain double")
    got = B.cluster_bootstrap(df, ["target", "year"], "gain", 30, bucket_sites=8)
    assert "Generate explode(sequence(0, 29" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "posexplode" not in plan
    found = {(r["target"], r["year"]): list(r)[2:] for r in got.collect()}
    assert len(found) == 4
    for key in found:
        alone = B.cluster_bootstrap(df.filter((F.col("target") == key[0]) & (F.col("year") == key[1])), ["target", "year"], "gain", 30, bucket_sites=8).first()
        assert list(alone)[2:] == pytest.approx(found[key])


def test_draws_are_counted_in_slices(spark):
    sites = spark.createDataFrame([("t", i, 50) for i in range(50)], "target string, slot bigint, sites bigint")

    def counts(held):
        total = {}
        for r in B.draws_per_bucket(sites, ["target"], 21, 42, 8, held).collect():
            for i, n in enumerate(r["_draws"]):
                place = (r["_bucket"], r["_from"] + i)
                total[place] = total.get(place, 0) + n
        return {place: n for place, n in total.items() if n}

    whole = counts(1 << 20)
    assert sum(whole.values()) == 50 * 21 and counts(60) == whole and counts(1) == whole


def test_verdict_ladder(spark):
    cases = [(99, 10, 1.0, 0.5, 1.0, "insufficient_data"), (100, 9, 1.0, 0.5, 1.0, "insufficient_data"), (100, 10, 0.2, 0.01, 0.4, "confirmed"),
             (100, 10, 0.2, -0.01, 0.4, "inconclusive"), (100, 10, -0.1, -0.3, 0.1, "not_confirmed"), (100, 10, -0.2, -0.3, -0.1, "not_confirmed")]
    df = spark.createDataFrame(cases, "n int, s int, m double, lo double, hi double, want string")
    rows = df.select("want", E.verdict(*[F.col(c) for c in ("n", "s", "m", "lo", "hi")]).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in rows)
    fixed = df.select(E.verdict(*[F.col(c) for c in ("n", "s", "m", "lo", "hi")], F.lit("site_median"))).distinct().collect()
    assert [r[0] for r in fixed] == ["frozen_model_is_baseline"]


def test_revisions(spark, day):
    schema = "site string, date date, target string, value double"
    old = spark.createDataFrame([("a", day("2026-01-01"), "ph", 7.0), ("a", day("2026-02-01"), "ph", 7.5), ("b", day("2026-03-01"), "ph", 8.0)], schema)
    new = spark.createDataFrame([("a", day("2026-01-01"), "ph", 7.0), ("a", day("2026-02-01"), "ph", 7.6), ("c", day("2026-03-01"), "ph", 6.0),
                                 ("a", day("2026-06-01"), "ph", 7.0)], schema)
    assert V.revisions(old, new, "2026-04-13").first().asDict() == {"unchanged": 1, "changed": 1, "removed": 1, "added": 1}
    with pytest.raises(ValueError):
        V.verify_join_1_1(old.withColumnRenamed("value", "actual"), new)
    assert V.verify_join_1_1(old.withColumn("actual", F.col("value")).drop("value"), old).count() == 3


def test_flags_are_per_replicate_and_per_target(spark, day):
    raw = spark.createDataFrame([(2, "a", day("2025-01-01")), (3, "a", day("2025-01-01")), (4, "b", day("2025-01-01"))], "csv_line bigint, site string, date date")
    checks = spark.createDataFrame([(2, "ecoli"), (3, "ecoli")], "csv_line bigint, target string")
    keys = N.join_many_to_one(checks, raw)
    assert [tuple(r) for r in keys.collect()] == [("a", day("2025-01-01"), "ecoli")]
    with pytest.raises(ValueError):
        N.join_many_to_one(checks, raw.unionByName(raw))


def test_empty_scenario_keeps_its_row(spark):
    rows = spark.createDataFrame([("t", "a", 1.0, 2.0, 1.0, 3.0, 2.0, 1, True)], SCHEMA)
    flagged = rows.select("*", F.lit(True).alias("ambiguous_site_label"), *[F.lit(False).alias(f) for f in N.FLAGS[1:]])
    got = {r["scenario"]: r for r in N.sensitivity_scenarios(flagged).collect()}
    gone = got["exclude_ambiguous_site_labels"]
    assert (gone["samples"], gone["excluded_samples"], gone["sites"], gone["MAE_transformed"]) == (0, 1, None, None)
    assert got["all_test_observations"]["samples"] == 1 and len(got) == 6


def test_discrepancies_and_review_rows(spark):
    rows = [(2, "3", "3", "3", "100", "3"), (3, "3", "3", "3", "100", "3.4"), (4, "0", "0", "0", "100", "1"), (5, "3", "3", "3", "100", "9"),
            (6, "3", "", "3", "100", "9"), (7, "3", "3", "3", "0", "9")]
    df = spark.createDataFrame(rows, "csv_line bigint, a string, b string, c string, sample_volume string, avg string")
    checked = K.count_volume_check(df, {"ecoli": "avg"}, {"ecoli": ["a", "b", "c"]})
    got = {r["csv_line"]: r["discrepancy_type"] for r in checked.collect()}
    assert got == {2: "match", 3: "within_half_unit_rounding", 4: "possible_zero_floor_to_one", 5: "requires_protocol_review"}
    review = K.review_rows(checked, "f.csv")
    assert {r["csv_line"] for r in review.collect()} == {3, 4, 5}
    assert review.columns[-2:] == ["correct_value", "notes"]


def test_site_conflicts_drop_blank_names_and_private_columns(spark):
    df = spark.createDataFrame([("1", 5, 1, "a", "b", "X", "secret"), ("2", 6, 3, "a", "b", "; Mill; Ford B", "secret")],
                               "site string, rows bigint, waterbody_variants bigint, first_date string, last_date string, waterbodies string, location string")
    rows = K.site_conflicts(df).collect()
    assert [(r["site"], r["waterbodies"]) for r in rows] == [("2", "Mill; Ford B")]
    assert "location" not in K.site_conflicts(df).columns


def test_segments_match_separate_groups(spark, day):
    specs = default_specs()
    rows = [("ph", f"s{i % 4}", day(f"2024-{1 + i % 12:02d}-03"), 7.0 + i % 3, 7.0, 6.5, 10 + i * 3, i % 2, i % 3 == 0) for i in range(36)]
    df = spark.createDataFrame(rows, "target string, site string, date date, actual double, predicted double, baseline_predicted double, "
                                     "target_age_days int, actual_tail_event int, experimental_flag boolean")
    table = E.segment_columns(E.error_columns(df, specs))
    got = {(r["dimension"], r["segment"]): r for r in E.segment_errors(table, ["site", "season", "history_age", "event_group"]).collect()}
    one = E.error_summary(table.filter("season = 'winter'"), ["target"]).first()
    assert got["season", "winter"]["MAE_transformed"] == pytest.approx(one["MAE_transformed"])
    assert got["season", "winter"]["sites"] == one["sites"] and got["season", "winter"]["small_sample"]
    assert sum(r["samples"] for (d, _), r in got.items() if d == "site") == 36
