"""Whitening of embeddings: eigenvectors of their covariance by contour integrals (the FEAST method).

Entries become whole numbers first, so sums over all vectors are exact in any order. The covariance is summed in
tasks, each row of it by one reducer; it has as many numbers as a vector has entries, squared, at any number of
vectors. Its spectrum is cut into intervals by counting eigenvalues above a shift (the inertia of the shifted matrix),
and each interval is one Spark task: a quadrature over complex shifted solves projects random columns onto the
interval's eigenvectors, Rayleigh-Ritz extracts them, and the inertia count says whether all were found.

Nulls and the like: a vector that is null, empty or holds null or non-finite entries is left out. If lengths differ,
those of the commonest length stay (of two equally common ones, the longer). Repeated rows and equal vectors all count
and all come back; a null key is kept as it is. Directions without variance (an eigenvalue of at most ``FLAT`` of the
sum) cannot be scaled to one and are no components, so equal vectors, or a single one, give no rows, and neither does
an empty table. Entries must stay below 2^40; extra columns are not read, so their names cannot clash. ``deviation`` is
null where its exact value does not fit a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creekline.llm.common import prepare_workers

#: Steps per unit, and what is added so that usual entries are positive (fixed values of the result's definition).
SCALE, SHIFT = 64, 1_000_000
#: Eigenvalues at most this share of their sum are rounding.
FLAT = 1e-12
#: Nodes on half a contour (the other half is its mirror image), eigenvalues per interval, residual, and rounds.
NODES, PER_INTERVAL, RESIDUAL, MOST_ROUNDS = 12, 8, 2e-14, 40
#: Rows of a matrix that are solved at once when eigenvalues are counted.
LEAF = 32


@dataclass
class Components:
    """Unit eigenvectors as columns, by falling eigenvalue."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def positive_count(matrix: np.ndarray) -> int:
    """Eigenvalues above zero: those of a leading block and of what it leaves, block by block (Haynsworth)."""
    d = len(matrix)
    if d > LEAF:
        h = d // 2
        a, b = matrix[:h, :h], matrix[:h, h:]
        return positive_count(a) + positive_count(matrix[h:, h:] - b.T @ np.linalg.solve(a, b))
    left, count = matrix.copy(), 0
    for i in range(d):
        pivot = left[i, i]
        if pivot == 0:
            raise ZeroDivisionError
        count += int(pivot > 0)
        left[i + 1 :, i + 1 :] -= np.outer(left[i + 1 :, i], left[i, i + 1 :] / pivot)
    return count


def above(matrix: np.ndarray, shift: float, scale: float) -> int:
    """Eigenvalues above ``shift``; a shift that meets an eigenvalue of a leading block is moved by a hair."""
    for nudge in range(8):
        try:
            return positive_count(matrix - (shift + nudge * 3e-15 * scale) * np.eye(len(matrix)))
        except (ZeroDivisionError, np.linalg.LinAlgError):
            continue
    raise ArithmeticError("no shift near this one has an inertia")


def intervals(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, count) from the top until ``wanted`` eigenvalues are covered, with ends in gaps where there are any."""
    trace = float(np.trace(matrix))
    if not trace > 0:
        return []
    top = float(np.abs(matrix).sum(1).max()) * 1.0001
    floor = FLAT * trace
    stack = [(floor, top, above(matrix, floor, top), 0)]
    found = []
    while stack:
        low, high, over_low, over_high = stack.pop()
        count = over_low - over_high
        if not count or over_high >= wanted:
            continue
        if count <= PER_INTERVAL or high - low <= 1e-11 * top:
            found.append((low, high, count))
            continue
        width = high - low
        for share in (0.5, 0.45, 0.55, 0.4, 0.6, 0.33, 0.67):
            cut = low + share * width
            over, margin = above(matrix, cut, top), 0.01 * width
            if above(matrix, cut - margin, top) == above(matrix, cut + margin, top):
                break
        stack += [(low, cut, over_low, over), (cut, high, over, over_high)]  # the upper part is next
    return found


def eigenpairs_within(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues in (low, high] and their vectors."""
    d = len(matrix)
    scale = float(np.abs(matrix).sum(1).max())
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (1 - nodes))
    middle, radius = (low + high) / 2, max((high - low) / 2, 1e-13 * scale)
    draw = np.random.default_rng(d)
    width = min(d, count + max(4, count // 2))
    basis = draw.normal(size=(d, width))
    for turn_of in range(MOST_ROUNDS):
        projected = np.zeros_like(basis)
        for w, e in zip(weights, turn, strict=True):
            projected += w / 2 * (radius * e * np.linalg.solve((middle + radius * e) * np.eye(d) - matrix, basis)).real
        directions, size, _ = np.linalg.svd(projected, full_matrices=False)
        directions = directions[:, size > 1e-14 * size[0]] if size[0] > 0 else directions
        if directions.shape[1] < count:  # columns that have run together are drawn anew
            extra = draw.normal(size=(d, width - directions.shape[1]))
            directions = np.linalg.qr(np.hstack([directions, extra]))[0]
        values, turned = np.linalg.eigh(directions.T @ matrix @ directions)
        basis = directions @ turned
        off = np.linalg.norm(matrix @ basis - basis * values, axis=0)
        inside = (values > low) & (values <= high)
        if inside.sum() == count and off[inside].max() <= RESIDUAL * scale:
            return values[inside], basis[:, inside]
        if turn_of and turn_of % 8 == 0 and basis.shape[1] < d:
            basis = np.hstack([basis, draw.normal(size=(d, min(d - basis.shape[1], width)))])
    settled = inside & (off <= 1e-10 * scale)
    if settled.sum() != count:
        raise ArithmeticError(f"{int(settled.sum())} of {count} eigenvalues found between {low} and {high}")
    return values[inside], basis[:, inside]


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, vector`` of the vectors that take part."""
    whole = F.forall(F.col("vector"), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("vector")).filter((F.size("vector") > 0) & whole)
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    commonest = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return rows.filter(F.size("vector") == (commonest["d"] if commonest else 0))


def whole_numbers(vectors: pa.Array, d: int) -> np.ndarray:
    entries = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return np.floor(SCALE * entries).astype(np.int64) + SHIFT


def _sums(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + 1, np.int64)
        for batch in batches:
            x = whole_numbers(batch.column(0), d)
            total[:d] += x.sum(0)
            total[d] += len(x)
        yield pa.record_batch({"i": pa.array(range(d + 1), pa.int32()), "s": pa.array(total)})

    found = rows.select("vector").mapInArrow(add, "i int, s bigint").groupBy("i").agg(F.sum("s").alias("s")).collect()
    total = np.zeros(d + 1, np.int64)
    for r in found:
        total[r["i"]] = r["s"]
    return int(total[d]), total[:d]


def _covariance(rows: DataFrame, d: int, width: int, n: int, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Covariance of ``centred`` rows, with divisor n. Each task adds up its own products; a reducer holds only the
    matrix rows that it adds up, so their size is bounded by the vectors' length, not by their number."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for batch in batches:
            c = centred(whole_numbers(batch.column(0), d))
            total[:width] += c.T @ c
            total[width] += c.sum(0)
        for at in range(0, width + 1, 256):
            part = total[at : at + 256]
            yield pa.record_batch({"i": pa.array(range(at, at + len(part)), pa.int32()), "row": pa.array(list(part), pa.list_(pa.float64()))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[i] = total.get(i, 0) + row.values.to_numpy()
        if total:
            yield pa.record_batch({"i": pa.array(list(total), pa.int32()), "row": pa.array(list(total.values()), pa.list_(pa.float64()))})

    kind = "i int, row array<double>"
    found = rows.select("vector").mapInArrow(products, kind).repartition("i").mapInArrow(add, kind).collect()
    table = np.zeros((width + 1, width))
    for r in found:
        table[r["i"]] = r["row"]
    mean = table[width] / n  # zero but for rounding
    cov = table[:width] / n - np.outer(mean, mean)
    return (cov + cov.T) / 2


def components(rows: DataFrame, most: int = 32) -> Components | None:
    """The ``most`` largest components of the vectors that ``usable`` returned; None without any."""
    spark = rows.sparkSession
    prepare_workers(spark)
    first = rows.select(F.size("vector").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    n, sums = _sums(rows, d)
    matrix = _covariance(rows, d, d, n, lambda x: _centred(x, n, sums))
    cuts = intervals(matrix, most)
    if not cuts:
        return None
    shared = spark.sparkContext.broadcast(matrix)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low, high, count in zip(frame["low"], frame["high"], frame["count"], strict=True):
                values, vectors = eigenpairs_within(shared.value, low, high, count)
                yield pd.DataFrame({"value": values, "vector": list(vectors.T)})

    listed = spark.createDataFrame(cuts, "low double, high double, count int").withColumn("at", F.monotonically_increasing_id())
    pairs = listed.repartition(len(cuts), "at").mapInPandas(solve, "value double, vector array<double>").collect()
    shared.destroy()
    pairs.sort(key=lambda r: -r["value"])
    values, vectors = np.array([r["value"] for r in pairs[:most]]), np.array([r["vector"] for r in pairs[:most]]).T
    return Components(n, sums, values, vectors, float(np.trace(matrix)))


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n times each entry's distance from its mean, in whole numbers; Python's own where a long is too short."""
    if n * float(np.abs(x).max(initial=0)) < 2**62:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (_deviation(x, n, sums) / n).astype(np.float64)


def _squares(z: np.ndarray) -> list[int | None]:
    if z.dtype != object and float(np.square(z, dtype=np.float64).sum(1).max(initial=0)) < 2**62:
        return np.square(z).sum(1).tolist()
    exact = [sum(int(e) ** 2 for e in row) for row in z]
    return [e if e < 2**63 else None for e in exact]


def whiten(df: DataFrame, key: str, vector: str, most: int = 32) -> DataFrame:
    """One row per vector that takes part and component: ``key`` under its own name, then ``component``, ``n``,
    ``deviation``, ``whitened``, ``explained`` and ``identity_error``, which is measured on the whitened vectors."""
    rows = usable(df, key, vector)
    kind = f"key {df.schema[key].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    found = components(rows, most)
    if found is None:
        return df.sparkSession.createDataFrame([], kind).withColumnRenamed("key", key)
    n, sums, d, m = found.n, found.sums, len(found.sums), len(found.values)
    turn = found.vectors / np.sqrt(found.values)
    cov = _covariance(rows, d, m, n, lambda x: _centred(x, n, sums) @ turn)
    error = float(np.abs(cov - np.eye(m)).max())
    share = found.values / found.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _deviation(whole_numbers(batch.column(1), d), n, sums)
            b = len(z)
            owner = np.repeat(np.arange(b), m)
            deviation = pa.array(_squares(z), pa.int64()).take(pa.array(owner))
            yield pa.record_batch({
                "key": batch.column(0).take(pa.array(owner)), "component": pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), b)),
                "n": pa.array(np.full(b * m, n, np.int64)), "deviation": deviation,
                "whitened": pa.array(((z / n).astype(np.float64) @ turn).ravel()), "explained": pa.array(np.tile(share, b)),
                "identity_error": pa.array(np.full(b * m, error)),
            })

    return rows.mapInArrow(project, kind).withColumnRenamed("key", key)
