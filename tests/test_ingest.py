"""Reading, quarantine and collapse of survey exports."""

import pytest
from pyspark.sql import functions as F

from creekline.functions import scalar as S
from creekline.functions.specs import default_specs
from creekline.operators import collapse as C
from creekline.operators import quarantine as Q
from creekline.sources import survey

SPECS = default_specs()
HEAD = ["globalid", "gww_site_code_double", "CreationDate", "sample_date_time", "watershed", "waterbody", "Average_e_coli", "Average_coliform", ""]
GOOD = ["a", "7001234", "4/13/2026 22:00:00.000", "1/1/2024 0:00:00.000", "test", "Mill brook"]


def write_csv(path, rows):
    path.mkdir()
    quote = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') else v
    (path / "export.csv").write_text("\n".join(",".join(quote(v) for v in row) for row in [HEAD, *rows]) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    rows = [
        [*GOOD, "4", "12", ""],
        [*GOOD[:5], "Second\nline", "NA", "16", ""],
        ["b", "x7001234", "moved", "2/30/2024 0:00:00.000", "t", "w", "4", "5", "7001234"],
        ["c", "7001234", GOOD[2], "1/2/2030 0:00:00.000", "t", "w", "4", "5", ""],
        ["d", "700123", GOOD[2], GOOD[3], "t", "w", "4", "5", ""],
        ["e", "7001235", GOOD[2], "1/3/2024 1:02:03.5", "t", "w", "1.0d", "inf", ""],
        ["f", "7001235", GOOD[2], "1/4/2024 0:00:00.000", "t", "w", "-1", " 7 ", ""],
    ]
    path = write_csv(tmp_path_factory.mktemp("csv") / "x", rows)
    return survey.land_survey(spark, path, "bacteria").cache()


def test_lines_count_records_and_missing_text_becomes_blank(landed):
    rows = {r["csv_line"]: r for r in landed.collect()}
    assert sorted(rows) == list(range(2, 9))
    assert rows[3]["Average_e_coli"] == "" and rows[3]["waterbody"] == "Second\nline"
    assert Q.extra_columns(landed) == ["_c8"]


def test_row_reasons_in_order(landed):
    _, excluded = Q.quarantine_rows(landed, "2026-04-13")
    reasons = {r["csv_line"]: r["reason"] for r in excluded.collect()}
    assert reasons == {
        4: "nonempty_extra_columns;invalid_site_identifier;invalid_or_shifted_metadata;invalid_date;",
        5: "sample_after_snapshot;",
        6: "invalid_site_identifier;",
    }
    audit = Q.ingest_audit(landed, "2026-04-13").first()
    assert (audit["input_rows"], audit["structurally_excluded_rows"], audit["retained_rows"]) == (7, 3, 4)


def test_cells_and_replicates(landed):
    good, _ = Q.quarantine_rows(landed, "2026-04-13")
    valid, rejected = Q.quarantine_cells(Q.wide_to_long(good, SPECS, "bacteria"), SPECS)
    assert {(r["csv_line"], r["target"], r["value"]) for r in rejected.collect()} == {
        (7, "ecoli", "1.0d"), (7, "other_coliform", "inf"), (8, "ecoli", "-1"),
    }
    rows = {(r["site"], str(r["date"]), r["target"]): r for r in C.collapse_replicates(valid).collect()}
    row = rows["7001234", "2024-01-01", "other_coliform"]
    assert (row["value"], row["replicate_rows"], row["waterbody"]) == (14.0, 2, "Mill brook")
    assert rows["7001234", "2024-01-01", "ecoli"]["replicate_rows"] == 1


def test_site_with_trailing_newline_is_invalid(spark):
    rows = spark.createDataFrame([("7001234\n",), ("0012345",), ("123456789012",), ("1234567890123",), (None,)], "s string")
    assert [r[0] for r in rows.select(Q.bad_site(F.col("s"))).collect()] == [True, False, False, True, True]


def test_number_text(spark):
    cases = {"1": 1.0, " -2.5e3 ": -2500.0, ".5": 0.5, "5.": 5.0, "+3": 3.0, "1e999": None, "1.0d": None, "2f": None, "inf": None,
             "nan": None, "": None, "1 2": None, "0x10": None, "1e150": 1e150, "9" * 400: None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in rows.select(S.to_number(F.col("t"))).collect()] == list(cases.values())


def test_sample_time_is_strict(spark, day):
    cases = {"1/1/2024 0:00:00.000": "2024-01-01", "12/31/2023 23:59:59.123456": "2023-12-31", "2/30/2024 0:00:00.000": None,
             "1/1/2024 0:00:00": None, "2024-01-01": None, "1/1/24 0:00:00.000": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    got = [r[0] for r in rows.select(S.to_sample_date(F.col("t"))).collect()]
    assert got == [day(v) if v else None for v in cases.values()]


def test_hot_group_gives_the_same_median(spark, day):
    rows = [("s", day("2024-01-01"), "ph", (i * 37 % 1001) / 100, "w", i) for i in range(1000)]
    rows += [("t", day("2024-01-01"), "ph", 7.0, "w", 5000), ("t", day("2024-01-01"), "ph", 8.0, "v", 4000)]
    df = spark.createDataFrame(rows, "site string, date date, target string, value double, waterbody string, csv_line bigint")
    got = sorted(C.collapse_replicates(df).collect())
    assert got[0]["value"] == pytest.approx(sorted(r[3] for r in rows[:1000])[499] / 2 + sorted(r[3] for r in rows[:1000])[500] / 2)
    assert got[1]["value"] == 7.5 and got[1]["waterbody"] == "v"


def test_collapse_shuffles_once_and_large_units_agree(spark, day):
    rows = [(f"s{i % 7}", day(f"2024-01-0{1 + i % 3}"), "ph", None if i % 11 == 0 else float(i * 37 % 101) / 4, "w", i) for i in range(900)]
    rows += [("null", day("2024-01-01"), "ph", None, "w", 1), (None, day("2024-01-01"), "ph", 3.0, "w", 2), ("one", day("2024-01-01"), "ph", -0.0, "w", 3)]
    df = spark.createDataFrame(rows, "site string, date date, target string, value double, waterbody string, csv_line bigint")
    got = C.collapse_replicates(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    rows_of = sorted(got.collect())
    assert len(rows_of) == 22 and sum(r["replicate_rows"] for r in rows_of) == 901
    for most in (5, 42):
        assert sorted(C.collapse_replicates(df, most=most).collect()) == rows_of
    values = sorted(r[3] for r in rows[:900] if r[:2] == ("s0", day("2024-01-01")) and r[3] is not None)
    n = len(values)
    assert rows_of[1]["value"] == (values[(n - 1) // 2] + values[n // 2]) / 2


def test_files_with_other_column_order_and_lines(spark, tmp_path):
    from creekline.operators.sensitivity import join_many_to_one
    from creekline.sources.survey import land_survey

    (tmp_path / "one.csv").write_text("a,b,c\n1,2,3\n")
    (tmp_path / "two.csv").write_text("b,a\n20,10\n21,11\n")
    rows = land_survey(spark, str(tmp_path), "s")
    got = {(r["csv_file"], r["csv_line"]): (r["a"], r["b"], r["c"]) for r in rows.collect()}
    assert got == {("one.csv", 2): ("1", "2", "3"), ("two.csv", 2): ("10", "20", ""), ("two.csv", 3): ("11", "21", "")}
    raw = rows.withColumns({"site": F.col("a"), "date": F.lit("2024-01-01")})
    checks = rows.select("csv_file", "csv_line", F.lit("ph").alias("target"))
    assert sorted(r["site"] for r in join_many_to_one(checks, raw).collect()) == ["1", "10", "11"]


def test_no_reviewed_columns_give_an_empty_table(spark):
    from creekline.functions.specs import default_specs
    from creekline.operators.checks import reviewed_vs_original

    rows = spark.createDataFrame([("chemistry", 2, "7")], "source string, csv_line bigint, ph_standard_units string")
    out = reviewed_vs_original(rows, default_specs())
    assert out.columns == ["source", "csv_line", "target", "original", "reviewed"] and out.count() == 0


def test_v1_out_of_range_becomes_null(spark):
    rows = spark.createDataFrame([("41",), ("40",), ("0",), ("x",)], "v string")
    out = rows.select(S.null_if_outside(S.to_number(F.col("v")), 0.0, 40.0)).collect()
    assert [r[0] for r in out] == [None, 40.0, 0.0, None]


def test_three_digits(spark):
    cases = {16.0: "16", 0.25: "0.25", 320.0: "320", 1234.0: "1.23e+03", 6.5: "6.5", 0.0: "0"}
    rows = spark.createDataFrame([(k,) for k in cases], "v double")
    assert [r[0] for r in rows.select(S.three_digits(F.col("v"))).collect()] == list(cases.values())


def test_one_export_with_quoted_breaks_is_read_by_many_tasks(spark, tmp_path):
    """Parts of a file may begin inside a quoted cell; records and their lines come out as if it were read whole."""
    import csv
    import random

    draw = random.Random(5)
    notes = ["plain", "two\nlines", 'a "quoted" word', "\n\n", "x,y", '"', "", "tail\n", "ends with \r\nbreak", "é\n" * 40]
    rows = [[f"id{i}", draw.choice(notes), str(i)] for i in range(4000)]
    path = tmp_path / "one.csv"
    with path.open("w", newline="") as file:
        writer = csv.writer(file, lineterminator="\r\n")
        writer.writerow(["globalid", "note", ""])
        for i, row in enumerate(rows):
            writer.writerow(row)
            if i % 500 == 0:
                file.write("\r\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.option("lineSep", "\n").text(str(path)).rdd.getNumPartitions() > 20
        got = survey.land_survey(spark, str(path), "s").select("csv_line", "globalid", "note", "_c2").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    wanted = {(i + 2, *row) for i, row in enumerate(rows)}
    # A cell of white space alone is still text; only missing tokens become blank.
    assert len(got) == len(rows) and {tuple(r) for r in got} == wanted
    # The reader of whole files gives the same cells, but for breaks that it rewrites.
    plain = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(path))
    assert {tuple(r)[:2] for r in plain.select("globalid", "note").collect()} == {(r[1], r[2].replace("\r\n", "\n") or None) for r in got}


def tree_of(data, fan):
    import hashlib

    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = data.split(b"\n")
    lines = lines[:-1] if lines[-1] == b"" else lines
    return len(lines), [sha(x) for x in lines], sha


def test_tree_digests_do_not_depend_on_the_split(spark, tmp_path):
    import random

    from creekline.sources import sinks

    draw = random.Random(9)
    files = {
        "text": "".join(f"{draw.random()}\n" for _ in range(3000)).encode(), "binary": draw.randbytes(60_000), "one": b"no line feed",
        "ends": b"a\nb", "ended": b"a\nb\n", "blank": b"\n\n\n",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    found = []
    try:
        for size in ("4194304", "5000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            found.append({r["path"].split("/")[-1]: r for r in sinks.tree_digests(spark, [str(tmp_path)], 16).collect()})
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert found[0] == found[1] and set(found[0]) == set(files)
    # Three levels of 16 hold the longest file's lines.
    for name, data in files.items():
        n, nodes, sha = tree_of(data, 16)
        for _ in range(3):
            nodes = [sha("".join(nodes[i : i + 16]).encode()) for i in range(0, len(nodes), 16)]
        row = found[0][name]
        assert (row["lines"], row["length"]) == (n, len(data)) and len(nodes) == 1
        assert row["tree_sha256"] == sha(f"{len(data)}:{nodes[0]}".encode()), name
    assert len({r["tree_sha256"] for r in found[0].values()}) == len(files)


def test_fingerprints_of_files_that_one_value_cannot_hold(spark, tmp_path):
    """Above 2 GiB there was no digest, and below a file lay whole in memory. Holes take no disk."""
    import hashlib

    from creekline.sources import sinks

    long = tmp_path / "a long%20 file.bin"
    with open(long, "wb") as file:
        file.write(b"first")
        file.truncate((1 << 31) + 5)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "short.bin").write_bytes(b"x")
    found = {r["file"]: r for r in sinks.fingerprint_inputs(spark, [str(tmp_path)]).collect()}
    assert sorted(found) == [long.name, "short.bin"]
    with open(long, "rb") as file:
        assert found[long.name]["sha256"] == hashlib.file_digest(file, "sha256").hexdigest()
    assert found[long.name]["length"] == (1 << 31) + 5 and found["short.bin"]["sha256"] == hashlib.sha256(b"x").hexdigest()
