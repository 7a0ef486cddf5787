"""Exact median of everything known so far in a series, in time linear in its length up to logarithms.

A window over a growing frame sorts the frame anew for every row, which is the square of a series' length. Here rows
arrive by series and day, and a worker keeps the values known so far in order: a new value is put in its place and the
middle is read off. A series is one row per day and target at most, so what is kept is bounded by the calendar.
"""

from __future__ import annotations

import types
from bisect import insort
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def running_medians() -> Callable[[int, int, float | None], float | None]:
    """A function of (until, day, value) for one series, called by rising day: the median of the values given
    earlier and dated ``until`` or before; the new value counts in later calls. Self-contained, as it goes to workers."""
    ordered: list[float] = []
    waiting: deque[tuple[int, float]] = deque()

    def median(until: int, day: int, value: float | None) -> float | None:
        while waiting and waiting[0][0] <= until:
            insort(ordered, waiting.popleft()[1])
        n = len(ordered)
        found = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2 if n else None
        if value is not None:
            waiting.append((day, value))
        return found

    return median


def with_running_median(rows: DataFrame, keys: Sequence[str], day: str, value: str, gap: int, name: str) -> DataFrame:
    """``rows`` with ``name``: the median of ``value`` over the same keys at least ``gap`` days earlier.

    NULL values are not counted; NULL where nothing is known yet. Days are whole numbers.
    """
    keys = list(keys)
    ordered = rows.repartition(keys[0]).sortWithinPartitions(*keys, day)
    schema = T.StructType([*ordered.schema.fields, T.StructField(name, T.DoubleType())])
    # Executors get the code with the task and need not have this package.
    fresh = types.FunctionType(running_medians.__code__, {"deque": deque, "insort": insort})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, median = None, fresh()
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in (*keys, day, value)]
            out: list[float | None] = []
            for *series, now, v in zip(*columns, strict=True):
                if series != at:
                    at, median = series, fresh()
                out.append(median(now - gap, now, v))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

    return ordered.mapInArrow(run, schema)
