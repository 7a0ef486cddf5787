"""Survey exports: every column is text until a rule has looked at it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creekline.functions import fixed_values as fixed
from creekline.sources.sinks import staged

OBSERVATION_SCHEMA = (
    "site string, date date, target string, value double, waterbody string, replicate_rows bigint"
)
PREDICTION_SCHEMA = (
    "site string, date date, issue_date date, actual double, target_age_days int, target string, "
    "predicted double, baseline_predicted double, experimental_tail_probability double, "
    "actual_tail_event int, experimental_flag boolean"
)


def header_names(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header; a column without one is called ``_c`` and its position."""
    first = spark.read.option("header", False).option("multiLine", True).option("escape", '"').csv(path).first()
    return [name if name else f"_c{i}" for i, name in enumerate(first)]


def read_survey_csv(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, multiline: bool = True, numbered: bool = False
) -> DataFrame:
    """All columns as text, missing tokens and blanks as '', and ``_file``; ``numbered`` adds ``csv_line``.

    With ``multiline`` a quoted cell may hold line breaks, and one export is still read by many
    tasks (``quoted_records``); cells that hold quotes must be quoted and double them, as exports do.
    Exports without line breaks in cells need no such search (``multiline=False``).
    """
    if columns:
        return _read_as(spark, [path], list(columns), multiline, numbered)
    # Files whose headers differ are read by their own names and put together by name.
    groups: dict[tuple[str, ...], list[str]] = {}
    for file in _files(spark, path):
        groups.setdefault(tuple(header_names(spark, file)), []).append(file)
    parts = [_read_as(spark, files, list(names), multiline, numbered) for names, files in groups.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.fillna("", [c for c, kind in out.dtypes if kind == "string"]) if len(parts) > 1 else out


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files of an export: names only, no content is read."""
    found = spark.read.format("binaryFile").load(path).select("path").collect()
    return sorted(r["path"] for r in found)


def _read_as(spark: SparkSession, paths: list[str], columns: list[str], multiline: bool, numbered: bool) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    if multiline:
        records = quoted_records(spark, paths)
        raw = records.select(F.from_csv("_record", schema, {"escape": '"'}).alias("_cells"), "_file", "csv_line").select("_cells.*", "_file", "csv_line")
    else:
        raw = (
            spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("escape", '"').csv(paths)
            .select("*", F.col("_metadata.file_path").alias("_file"))
        )
    blank = list(fixed.MISSING_TOKENS)
    rows = raw.select(
        *[
            F.when(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").isin(*blank), "").otherwise(F.col(f"`{c}`")).alias(c)
            for c in columns
        ],
        "_file", *(["csv_line"] if multiline and numbered else []),
    )
    return with_source_line(rows) if numbered and not multiline else rows


def quoted_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``_file, csv_line, _record``: the records of CSV files, headers left out, each file read in parts.

    A line break ends a record unless an odd number of quotes precedes it in its file. Quotes
    are counted per line, summed over earlier lines of the same part and, for whole parts, over
    earlier parts of the same file. How many records a part starts is counted for both states it may be
    entered in, so numbering needs no further pass. Only lines of a record with breaks meet in a shuffle.
    Blank lines between records are no records. A quote that is never closed makes the rest of its
    file one record, as in any CSV reader.
    """
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_part"),
        F.monotonically_increasing_id().alias("_order"),
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("_quotes"),
    )
    in_part = Window.partitionBy("_file", "_part").orderBy("_order")
    filled = F.col("value").rlike("[^\\x00-\\x20]")
    lines = lines.withColumn(
        "_inside", F.coalesce(F.sum("_quotes").over(in_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    )
    # Records up to a line, were the part entered outside (0) or inside (1) of quotes.
    so_far = in_part.rowsBetween(Window.unboundedPreceding, 0)
    counts = [F.count_if((F.col("_inside") == state) & filled).over(so_far).alias(f"_records{state}") for state in (0, 1)]
    # Written once, so both uses below see the same parts.
    lines = staged(lines.select("*", *counts), "lines")
    parts = lines.groupBy("_file", "_part").agg(
        (F.sum("_quotes") % 2).alias("_odd"), *[F.max(f"_records{state}").alias(f"_records{state}") for state in (0, 1)]
    )

    def by_state(entered: Column) -> Column:
        return F.when(entered == 0, F.col("_records0")).otherwise(F.col("_records1"))

    before = Window.partitionBy("_file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_entered", F.coalesce(F.sum("_odd").over(before), F.lit(0)) % 2)
    parts = parts.withColumn("_started", by_state(F.col("_entered")))
    parts = parts.select("_file", "_part", "_entered", F.coalesce(F.sum("_started").over(before), F.lit(0)).alias("_offset"))
    opened = (F.col("_inside") + F.col("_entered")) % 2
    numbered = lines.join(parts, ["_file", "_part"]).withColumns({
        "_open": opened, "_ends_open": (opened + F.col("_quotes")) % 2, "csv_line": F.col("_offset") + by_state(F.col("_entered")),
    })
    single = (F.col("_open") == 0) & (F.col("_ends_open") == 0)
    plain = numbered.filter(single & filled).select("_file", "csv_line", F.col("value").alias("_record"))
    broken = numbered.filter(~single).groupBy("_file", "csv_line").agg(
        F.array_sort(F.collect_list(F.struct("_part", "_order", "value"))).alias("_lines")
    ).select("_file", "csv_line", F.array_join("_lines.value", "\n").alias("_record"))
    # The header is a file's first record, so a record's number is its line as counted from 1.
    records = plain.unionByName(broken).filter("csv_line > 1")
    return records.withColumn("_record", F.regexp_replace("_record", "\r$", ""))


def with_source_line(df: DataFrame) -> DataFrame:
    """``csv_line``: position of the record in its file plus 2 (the header is line 1).

    Rows are numbered inside each scan task's part of a file; only the parts' sizes are
    cumulated. Expects ``_file`` from ``read_survey_csv`` and must follow it directly.
    """
    tagged = df.withColumn("_part", F.spark_partition_id()).withColumn("_order", F.monotonically_increasing_id())
    # Written once, so both uses below see the same parts.
    tagged = staged(tagged, "lines")
    sizes = tagged.groupBy("_file", "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_order").alias("_start"))
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_file", "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_file", "_part").orderBy("_order")
    return (
        tagged.withColumn("_row", F.row_number().over(inside))
        .join(offsets, ["_file", "_part"])
        .withColumn("csv_line", F.col("_offset") + F.col("_row") + 1)
        .drop("_part", "_order", "_offset", "_row")
    )


def land_survey(spark: SparkSession, path: str, source: str, multiline: bool = True) -> DataFrame:
    """An export as a columnar table with its source name, and the file and line of every record."""
    rows = read_survey_csv(spark, path, multiline=multiline, numbered=True)
    return rows.withColumn("csv_file", F.element_at(F.split("_file", "/"), -1)).withColumn("source", F.lit(source))


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OBSERVATION_SCHEMA).parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION_SCHEMA).parquet(path)
