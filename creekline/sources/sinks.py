"""Written tables, metric files, fingerprints and frozen-model checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creekline.functions.scalar import finite_or_null
from creekline.session import scratch_dir

#: The longest file that Spark reads into one value.
MOST_BYTES = (1 << 31) - 1
#: How paths begin that Python opens as they are.
MOUNTED = "file:"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared scratch folder and read it back.

    Cuts the lineage: later jobs start from the files, also after an executor is lost.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    order: Sequence[str] = (),
    fmt: str = "parquet",
) -> None:
    """Overwrite ``path``; ``order`` deals rows out by range and sorts each file, so files follow one another."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    writer = ordered.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.format(fmt).save(path)


def finite_doubles(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL: JSON has no text for them."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[finite_or_null(F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns]
    )


def write_metrics_json(df: DataFrame, path: str) -> None:
    finite_doubles(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


#: Lines whose digests one node of the tree digest stands for.
LINES_PER_NODE = 1 << 16


def fingerprint_inputs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Name, length and SHA-256 of every file under the paths; hashed where the file is read.

    Files that executors have mounted (``file:``) are hashed as they are read, at any length and in a buffer's memory. Of
    other file systems Spark reads a file whole, so there ``sha256`` is NULL above the 2 GiB that a value may have;
    ``tree_digests`` has a digest for files of any size anywhere.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    # Names and lengths come from the listing: no content is read for them.
    listed = files.select(name, "path", "length")
    if listed.filter(~F.startswith("path", F.lit(MOUNTED))).isEmpty():
        return listed.mapInArrow(_hashed, "file string, path string, length bigint, sha256 string")
    # The content of longer files is never read.
    small = files.filter(F.col("length") <= MOST_BYTES).select(name, "path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > MOST_BYTES).select(name, "path", "length", F.lit(None).cast("string").alias("sha256"))
    return small.unionByName(large)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of mounted files with the SHA-256 of their bytes."""

    def digest(path: str) -> str:
        with open(path.removeprefix(MOUNTED), "rb") as file:
            return hashlib.file_digest(file, "sha256").hexdigest()

    for batch in batches:
        yield batch.append_column("sha256", pa.array([digest(path) for path in batch.column("path").to_pylist()], pa.string()))


def tree_digests(spark: SparkSession, paths: Sequence[str], lines_per_node: int = LINES_PER_NODE) -> DataFrame:
    """``path, length, lines, tree_sha256`` per file, read in parts by many tasks, whatever a file's size.

    Lines (bytes up to a line feed) are hashed where they lie and numbered by sums over a file's parts. A node
    is the digest of its children's digests in order: of ``lines_per_node`` lines first, then of as many nodes,
    up to one, which is hashed with the file's length. So the digest depends on the bytes alone, not on how
    a file was split. No task sees more than a part, or the children of a node.
    """
    path, part = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(list(paths)).select(
        path.alias("path"), part.alias("_part"), F.col("_metadata.file_size").alias("length"),
        F.monotonically_increasing_id().alias("_order"), F.sha2(F.col("value").cast("binary"), 256).alias("_digest"),
    )
    # Written once, so both uses below see the same parts.
    lines = staged(lines, "digests")
    before = Window.partitionBy("path").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = lines.groupBy("path", "_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.select("path", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("path", "_part").orderBy("_order")) - 1
    nodes = lines.withColumn("_place", place).join(parts, ["path", "_part"]).select(
        "path", "length", (F.col("_offset") + F.col("_place")).alias("_at"), "_digest"
    )
    totals = lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"))
    levels, most = 1, totals.agg(F.max("lines")).first()[0] or 0
    while lines_per_node**levels < most:
        levels += 1
    for _ in range(levels):
        children = F.array_sort(F.collect_list(F.struct("_at", "_digest")))
        nodes = nodes.groupBy("path", "length", F.floor(F.col("_at") / lines_per_node).alias("_at")).agg(
            F.sha2(F.array_join(F.transform(children, lambda x: x["_digest"]), ""), 256).alias("_digest")
        )
    root = F.sha2(F.concat_ws(":", "length", "_digest"), 256).alias("tree_sha256")
    return nodes.join(totals, "path").select("path", "length", "lines", root)


def folder_digest(spark: SparkSession, path: str) -> str:
    """One digest of a model folder: SHA-256 over its sorted file digests.

    A model folder holds few files (a pipeline's stages), and only their digests are listed.
    """
    root = path.rstrip("/").split("/")[-1]
    relative = F.substring_index("path", f"/{root}/", -1)
    lines = (
        fingerprint_inputs(spark, [path])
        .filter(~F.col("file").startswith(".") & ~F.col("file").startswith("_"))
        .agg(F.sort_array(F.collect_list(F.concat_ws(":", relative, "sha256"))).alias("lines"))
    )
    return lines.select(F.sha2(F.array_join("lines", "\n"), 256)).first()[0]


def assert_frozen(spark: SparkSession, path: str, expected: str) -> None:
    """Refuse to go on unless the model folder is the recorded one."""
    found = folder_digest(spark, path)
    if found != expected:
        raise ValueError(f"model folder changed ({found}); scoring needs the frozen models {expected}")
