"""A cross-section of registered queries against their SQL on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
NAMES = [
    "a1_read_survey_csv", "b1_quarantine_rows", "b8_valid_cells", "d1_collapse_hot_groups", "c1_as_of_history", "c2_as_of_probe",
    "c3_cross_target_as_of", "e12_to_e17_daily_features", "d6_segment_errors", "d8_classification_metrics", "d21_cluster_bootstrap",
    "d20_sensitivity_scenarios", "i9_select_model", "i15_score_with_context", "c8_revisions",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    from verification.compare import check, connect
    result, _ = check(spark, connect(SF), SF, name)
    assert result.startswith("ok"), result


def test_entry_point_lists():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_model_queries_take_all_targets_folds_and_trees(spark, monkeypatch):
    import inspect

    from creekline.operators.models import ForestSize
    from verification import q_models as q
    from verification import tables as t

    seen = []

    def record(module, name, result):
        shape = inspect.signature(getattr(module, name))

        def call(*args, **kwargs):
            bound = shape.bind(*args, **kwargs)
            bound.apply_defaults()
            seen.append((name, bound.arguments))
            return result

        monkeypatch.setattr(module, name, call)

    record(q.M, "evaluate_folds", None)
    record(q.forecasting, "train", None)
    record(q.forecasting, "forecast", None)
    record(q.prospective, "score_frozen", [None])
    record(q.first_generation, "train", type("Result", (), {"predictions": None}))
    record(q.weather_trial, "development_rows", None)
    record(q.weather_trial, "run", [spark.range(1)])
    for name in ("rows", "staged", "folder_digest", "weather", "v1_tables"):
        monkeypatch.setattr(q, name, lambda *args: (None, None))
    monkeypatch.setattr(q, "scratch_dir", lambda *args: "unused")
    monkeypatch.setattr(t, "observations", lambda *args: None)
    monkeypatch.setattr(t, "eligible_rows", lambda *args: None)
    q.evaluation(spark, SF)
    for query in (q.i11, q.i20, q.i16, q.i18):
        query(spark, SF)
    folds = [list(x["years"]) for name, x in seen if name in ("evaluate_folds", "train") and "years" in x]
    assert folds == [t.FOLD_YEARS, t.FOLD_YEARS, [1999, 2000]]
    assert all(x.get("targets") is None for _, x in seen)
    assert [x["target"] for name, x in seen if name == "development_rows"] == [None]
    sizes = [x["size"] for name, x in seen if name != "forecast" and "size" in x]
    assert len(sizes) == 5 and all(x == ForestSize() or x == q.first_generation.V1_SIZE for x in sizes)
    assert q.SIZE == ForestSize()


def test_doubles_are_rounded_like_decimal_text(spark):
    """Also where a product's last digits would decide, and without text for most numbers."""
    from pyspark.sql import functions as F

    from verification import tables

    values = [0.1234565, -0.1234565, 0.0000005, -1e-9, 1e15 + 0.3, 1099511.6277765, 2.5, -7.25, float("inf"), None]
    values += [n / 2e6 for n in range(-3001, 3001, 7)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select(tables.rounded("v", 6).alias("got"), F.round("v", 6).alias("want"))
    assert got.filter("not got + 0.0 <=> want + 0.0").isEmpty()
