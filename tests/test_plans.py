"""Whole plans on small exports: landing, ingest, audits, configuration and report tables."""

import json

import pytest
from pyspark.sql import functions as F

from creekline.functions import fixed_values as fixed
from creekline.functions.specs import default_limits, default_specs, load_limits, load_specs
from creekline.operators import folds
from creekline.plans import audit, ingest
from creekline.sources.survey import land_survey, read_observations

SPECS = default_specs()


def export(source, n=8):
    """CSV text of an export: one row per site and month, the last one without a valid site."""
    needed = [s.column for s in SPECS if s.source == source]
    if source == "bacteria":
        needed += [c for parts in fixed.COUNT_COLUMNS.values() for c in parts] + [fixed.VOLUME_COLUMN]
    else:
        needed += [c for parts, _ in fixed.DERIVED_FORMULAS.values() for c in parts] + [fixed.METHOD_COLUMN]
    columns = ["globalid", fixed.SITE_COLUMN, fixed.CREATED_COLUMN, fixed.SAMPLE_TIME_COLUMN, "watershed", "waterbody", fixed.LOCATION_COLUMN]
    columns += list(dict.fromkeys(needed))
    lines = [",".join(columns)]
    for i in range(n):
        site = "12" if i == n - 1 else f"530330{i % 2}"
        row = [f"{source}{i}", site, f"{1 + i % 9}/20/2024 10:00:00.000", f"{1 + i % 9}/15/2024 0:00:00.000", "w", f"Creek {i % 2}", '"Bridge\nroad"']
        lines.append(",".join(row + [str(5 + i % 3)] * (len(columns) - len(row))))
    return "\n".join(lines) + "\n"


@pytest.fixture(scope="module")
def ingested(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("exports")
    tables = {}
    for source in ("bacteria", "chemistry"):
        (folder / f"{source}.csv").write_text(export(source))
        tables[source] = land_survey(spark, str(folder / f"{source}.csv"), source)
    return ingest.ingest(tables, SPECS, "2026-04-13")


def test_ingest_writes_what_it_kept_and_what_it_left(spark, ingested, tmp_path):
    ingest.write_ingested(ingested, str(tmp_path))
    clean = read_observations(spark, f"{tmp_path}/clean_measurements")
    assert clean.count() == ingested.observations.count() > 0
    out = spark.read.parquet(f"{tmp_path}/excluded_rows").collect()
    assert sorted((r["csv_file"], r["csv_line"]) for r in out) == [("bacteria.csv", 9), ("chemistry.csv", 9)]
    counts = {r["source"]: r["retained_rows"] for r in spark.read.parquet(f"{tmp_path}/audit").collect()}
    assert counts == {"bacteria": 7, "chemistry": 7}


def test_source_audit_without_reviewed_columns(ingested, tmp_path, spark):
    tables = audit.source_audit(ingested.good, SPECS)
    audit.write_audit(tables, str(tmp_path))
    assert tables["review_value_disagreements"].count() == 0
    assert spark.read.parquet(f"{tmp_path}/site_identity_audit").count() == 2
    assert {r["source"] for r in spark.read.parquet(f"{tmp_path}/timestamp_verification").collect()} == {"bacteria", "chemistry"}
    assert spark.read.parquet(f"{tmp_path}/bacteria_formula_checks").count() == 14


def test_configuration_from_json(spark, tmp_path):
    specs = {
        s.target: {"source": s.source, "column": s.column, "label": s.label, "transform": s.transform, "direction": s.direction}
        | {k: getattr(s, k) for k in ("min", "max") if getattr(s, k) is not None} | ({"caution": s.caution} if s.caution else {})
        for s in SPECS
    }
    (tmp_path / "targets.json").write_text(json.dumps(specs))
    limits = {x.target: {k: getattr(x, k) for k in ("min", "max", "basis") if getattr(x, k) is not None} for x in default_limits()}
    (tmp_path / "limits.json").write_text(json.dumps({"_source": "a note", **limits}))
    read = load_specs(spark, str(tmp_path / "targets.json"))
    assert read == SPECS
    assert load_limits(spark, str(tmp_path / "limits.json"), read) == default_limits()


def test_report_tables(spark):
    spec_rows = spark.createDataFrame([("a", "A"), ("b", "B")], "target string, label string")
    support = spark.createDataFrame([("a", "2025", 500, 90, 80, True), ("b", "2025", 3, 2, 1, False)], "target string, fold string, train bigint, validation bigint, test bigint, supported boolean")
    coverage = spark.createDataFrame([("a", 700), ("b", 9)], "target string, valid_site_days bigint")
    assert [tuple(r) for r in folds.unsupported_targets(spec_rows, support, coverage, "2025").collect()] == [("b", "B", 9, 3, 2, 1)]
    tested = spark.createDataFrame([("a", "2024", 1.26, 0.5), ("a", "2025", -2.0, 0.4)], "target string, fold string, improvement_percent double, source_MAE double")
    assert tuple(folds.rolling_table(tested, [2023, 2024, 2025]).first()) == ("a", "not enough history", "+1.3%", "-2.0%")
    risk = spark.createDataFrame([("a", "2025", "forest", 10, 7, 3, 0.7, 0.7)], "target string, fold string, risk_model string, events bigint, caught bigint, false_alerts bigint, precision double, recall double")
    assert tuple(folds.risk_table(spec_rows, risk, "2025").first()) == ("a", "A", "forest", 10, 7, 3, 0.7)
    summary = {r["target"]: r for r in folds.target_summary(spec_rows, support, tested.withColumns({"status": F.lit("ok"), "test": F.lit(1), "selected": F.lit("x"), "selected_baseline": F.lit("y")}), "2025", risk).collect()}
    assert summary["a"]["risk_recall"] == 0.7 and summary["b"]["risk_model"] is None and summary["b"]["status"] == "insufficient_history"
    metrics = spark.createDataFrame([("a", 0.4, 0.7)], "target string, source_MAE double, recall double")
    audit.assert_rederived(metrics, tested, risk, "2025")
    with pytest.raises(ValueError):
        audit.assert_rederived(metrics.withColumn("recall", F.lit(0.6)), tested, risk, "2025")
