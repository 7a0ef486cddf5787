"""Limits, status, what-if and weather."""

import datetime

import pytest
from pyspark.sql import functions as F

from creekline.functions.specs import LimitSpec, default_specs, inverse, transform
from creekline.operators import exogenous as X
from creekline.operators import scoring as G

SPECS = default_specs()
SCHEMA = "site string, date date, target string, value double"


def level(spark, value, limit, margin):
    df = spark.createDataFrame([(limit.target, value)], "target string, value double")
    out = G.limit_check(F.col("value"), F.col("target"), [limit], SPECS, F.lit(margin))
    return df.select(*out).first()


def test_limit_levels(spark):
    warm, oxygen = LimitSpec("water_temperature", None, 16.0), LimitSpec("dissolved_oxygen", 9.5, None)
    ecoli, ph = LimitSpec("ecoli", None, 320.0), LimitSpec("ph", 6.5, 8.5)
    assert level(spark, 16.1, warm, 1.5) == ("red", "above the 16 limit")
    assert level(spark, 14.6, warm, 1.5) == ("yellow", "within typical forecast error of the 16 limit")
    assert level(spark, 14.4, warm, 1.5) == (None, None)
    assert level(spark, 9.4, oxygen, 0.7)[0] == "red" and level(spark, 10.1, oxygen, 0.7)[0] == "yellow"
    assert level(spark, 100.0, ecoli, 1.6)[0] == "yellow" and level(spark, 50.0, ecoli, 1.6)[0] is None
    assert [level(spark, v, ph, 0.26)[0] for v in (8.6, 6.4, 7.5)] == ["red", "red", None]


def test_transform_round_trip_and_clip(spark):
    df = spark.createDataFrame([("ecoli", 41.0), ("ph", 7.0), ("ph", 99.0), ("ecoli", None)], "target string, v double")
    target = F.col("target")
    got = [r[0] for r in df.select(inverse(SPECS, target, transform(SPECS, target, F.col("v")))).collect()]
    assert got[0] == pytest.approx(41.0) and got[1:] == [7.0, 14.0, None]


@pytest.fixture(scope="module")
def setting(spark, day):
    rows = [("a", day(d), "ph", v) for d, v in (("2026-01-01", 7.0), ("2026-02-01", 7.2))]
    registry = spark.createDataFrame(
        [("ph", "last_observation", "site_median", 7.0, None, None, 0.2, 1.1, day("2025-12-31"), "constant_prevalence", 0.2, None, None)],
        G.REGISTRY_SCHEMA)
    return spark.createDataFrame(rows, SCHEMA), registry


def test_what_if_replaces_and_lists_every_target(spark, day, setting):
    obs, registry = setting
    extra = spark.createDataFrame([("a", day("2026-02-01"), "ph", 8.0)], SCHEMA)
    rows = {r["target"]: r for r in G.what_if(obs, extra, SPECS, [], registry, "2026-04-20").collect()}
    assert len(rows) == len(SPECS)
    assert (rows["ph"]["predicted_before"], rows["ph"]["predicted_after"]) == (7.2, 8.0)
    assert rows["ecoli"]["status_after"] == "insufficient_training_history"


@pytest.mark.parametrize("row, message", [
    (("a", "ph", 20.0), "outside the allowed range"), (("a", "lead", 1.0), "unknown measurement"),
    (("zz", "ph", 7.0), "Unknown site"), (("a", "ph", float("nan")), "outside"),
])
def test_what_if_rejects(spark, day, setting, row, message):
    extra = spark.createDataFrame([(row[0], day("2026-03-01"), row[1], row[2])], SCHEMA)
    with pytest.raises(ValueError, match=message):
        G.what_if(setting[0], extra, SPECS, [], setting[1], "2026-04-20")


def test_dates_overlapping_training(spark, setting):
    rows = {r["target"]: r for r in G.predict_grid(setting[0], SPECS, [], setting[1], "2026-01-10").collect()}
    assert rows["ph"]["status"] == "date_overlaps_training_information"
    assert rows["ph"]["predicted"] is None and rows["ph"]["reason"].startswith("Visit date overlaps")


def test_unknown_site_history(spark, setting):
    held = spark.createDataFrame([], "site string, date date, target string, actual double, predicted double, baseline_predicted double")
    assert G.site_history(setting[0], held, "a", "ph").count() == 2
    with pytest.raises(ValueError):
        G.site_history(setting[0], held, "zz", "ph")


def test_overview_and_names(spark, setting):
    obs = setting[0].withColumn("waterbody", F.when(F.col("value") > 7.1, " X ").otherwise("X"))
    assert G.site_names(obs).first()["name"] == "X"
    scored = G.predict_grid(setting[0], SPECS, [], setting[1], "2026-04-20")
    row = G.site_overview(scored, SPECS).first()
    assert (row["eligible_targets"], row["unavailable_targets"], row["flagged_targets"]) == (1, 14, "")


def table(spark, changes=None):
    start = datetime.date(2024, 1, 1)
    rows = []
    for i in range(60):
        d = start + datetime.timedelta(days=i)
        rain, flow = (changes or {}).get(str(d), (0.0, 10.0))
        rows.append(("all", d, rain, flow))
    return spark.createDataFrame(rows, "series_id string, day date, rain double, flow double")


def at(spark, changes, date):
    return X.daily_features(table(spark, changes)).filter(F.col("day") == date).first()


def test_weather_ignores_later_days(spark):
    later = {f"2024-02-{d:02d}": (100.0, 1000.0) for d in range(11, 30)}
    assert at(spark, later, "2024-02-10") == at(spark, None, "2024-02-10")


def test_weather_cutoff_is_the_day_before_issue(spark, day):
    known = X.daily_features(table(spark, {"2024-02-10": (20.0, 10.0)}))
    rows = spark.createDataFrame([(day("2024-02-10"), day("2024-02-17")), (day("2024-02-11"), day("2024-02-18"))], "issue_date date, date date")
    assert [r["rain_1"] for r in X.add_weather(rows, known).orderBy("date").collect()] == [0.0, 20.0]


def test_missing_rain_is_not_dry(spark):
    gap = {"2024-02-05": (None, 10.0)}
    row = at(spark, gap, "2024-02-10")
    assert row["rain_30"] is None and row["days_since_rain5"] is None
    assert at(spark, gap, "2024-02-06")["rain_0_3"] is None and at(spark, gap, "2024-02-09")["rain_0_3"] == 0.0


def test_several_series_need_a_key(spark, day):
    names = X.fixed.WEATHER_FEATURES
    known = spark.createDataFrame(
        [(s, day("2024-01-01"), *[1.0] * len(names), 2.0) for s in ("a", "b")],
        "series_id string, day date, " + ", ".join(f"{n} double" for n in names if n != "rain_0_3") + ", rain_0_3 double",
    ) if "rain_0_3" not in names else None
    rows = spark.createDataFrame([("a", day("2024-01-02"), day("2024-01-01"))], "creek string, issue_date date, date date")
    for call in (X.add_weather, X.add_event_rain):
        with pytest.raises(ValueError):
            call(rows, known)
    assert X.add_weather(rows, known, "creek").count() == 1
    assert X.add_event_rain(rows, known, "creek").count() == 1


def test_frozen_target_without_samples_keeps_its_row(spark, day):
    from creekline.functions.specs import default_specs
    from creekline.plans.prospective import judge

    kind = "site string, date date, issue_date date, actual double, target_age_days int, target string, last_value double, history_median double, seasonal_site double, last3_mean double, regressed double"
    rows = spark.createDataFrame([("s", day("2026-05-01"), day("2026-04-24"), 7.0, 20, "ph", 7.1, 7.2, 7.0, 7.1, None)], kind)
    registry = spark.createDataFrame(
        [("ph", "seasonal_site", "seasonal_site", 7.0), ("nitrate", "seasonal_site", "seasonal_site", 1.0)],
        "target string, selected string, selected_baseline string, median double",
    )
    judged, _ = judge(rows, registry, default_specs(), "all_sites", 20)
    got = {r["target"]: (r["observations"], r["verdict"]) for r in judged.collect()}
    assert got["nitrate"][0] == 0 and got["ph"][0] == 1
