"""Daily rain and streamflow files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creekline.functions.scalar import to_number

FORMAT_ROW = "5s"


def station_daily(readings: DataFrame, series_id: str = "region") -> DataFrame:
    """Mean over stations per day; stations without a number that day are left out."""
    return readings.groupBy(F.lit(series_id).alias("series_id"), F.col("day")).agg(F.avg("rain").alias("rain"))


def read_station_daily(spark: SparkSession, path: str, series_id: str = "region") -> DataFrame:
    """Station file (STATION, DATE, PRCP) to one regional value per day."""
    raw = spark.read.option("header", True).csv(path)
    rows = raw.select(
        F.col("DATE").try_cast("date").alias("day"), to_number(F.col("PRCP")).alias("rain")
    )
    return station_daily(rows.filter(F.col("day").isNotNull()), series_id)


def read_gauge_rdb(spark: SparkSession, path: str, series_id: str = "region") -> DataFrame:
    """Gauge file: tab separated, '#' comments, a header, then a format row; flow is the 4th column."""
    raw = spark.read.option("sep", "\t").option("comment", "#").option("header", True).csv(path)
    return raw.filter(F.col("agency_cd") != FORMAT_ROW).select(
        F.lit(series_id).alias("series_id"),
        F.col("datetime").try_cast("date").alias("day"),
        to_number(F.col(raw.columns[3])).alias("flow"),
    )
