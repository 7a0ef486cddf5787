"""What was known about each series of a site at a row's cutoff, from one pass over rows sorted by site and day.

A chain of windows sorts the same rows once per window key, and each sort holds rows that the windows before made wider.
Here rows are sorted once and a worker takes them in blocks of many sites. The samples of a block are numbered by series
and day, so what a row knew is a place in that list, found for all rows of a block by binary search; only medians and
sums per month are run through sample by sample. The last site's samples go on into the next block.
What is kept is a block and, bounded by the calendar, one sample per day and series of a site.
"""

from __future__ import annotations

import types
from bisect import insort
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LATEST = ["_last_day", "_last_v", "_last_mean3", "_last_previous"]
COLUMNS = ["history_count", "history_median", "_month_sum", "_month_count", *LATEST]
KINDS = [T.LongType(), T.DoubleType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]

#: Rows that a worker takes at once.
BLOCK_ROWS = 1 << 16
#: Bits of a day in a sample's place: years up to 90,000; the rest numbers series and months of a block.
DAY_BITS = 26


def site_states(gap: int, others: Sequence[str]) -> Callable:
    """A function of (site, target, day, month, sampled, value), arrays of the next rows sorted by site and day: what was
    known ``gap`` days before each row about its target, and the latest day and value of each of ``others``, as arrays.
    Self-contained, as it goes to workers.

    A row that is ``sampled`` counts in later rows, and among the last three of its series also if its value is NULL.
    """
    gap = max(gap, 1)  # a row never knows its own day
    carried: list = []  # the samples so far of the site that the last block ended in

    def known(*given: pa.Array) -> list:
        before = len(carried[0]) if carried else 0
        columns = [pa.concat_arrays(pair) for pair in zip(carried, given, strict=True)] if before else list(given)
        sites, targets = (c.dictionary_encode() for c in columns[:2])
        site = sites.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        names = targets.dictionary.to_pylist()
        target = targets.indices.fill_null(len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
        live = columns[2].is_valid().to_numpy(zero_copy_only=False)
        day, month = (c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns[2:4])
        sampled = columns[4].fill_null(False).to_numpy(zero_copy_only=False) & live
        valued = columns[5].is_valid().to_numpy(zero_copy_only=False)
        value = columns[5].fill_null(0.0).to_numpy(zero_copy_only=False)
        carried[:] = [c.filter(pa.array(sampled & (site == site[-1]))) for c in columns] if len(site) else []

        def place(of, when):
            return (of << DAY_BITS) + (when + (1 << DAY_BITS - 1))

        # Samples by series, each by rising day, with the mean of up to three and the one before.
        of = site * (len(names) + 1) + target
        rows = np.flatnonzero(sampled)
        rows = rows[np.argsort(of[rows], kind="stable")]
        series, v, has = of[rows], value[rows], valued[rows]
        total, rest, count = np.zeros(len(v)), np.zeros(len(v)), has.astype(np.int64)
        previous, known_previous = total, has
        for back in (2, 1, 0):
            x, there = np.zeros(len(v)), np.zeros(len(v), bool)
            there[back:] = has[: len(v) - back] & (series[back:] == series[: len(v) - back])
            x[back:] = v[: len(v) - back]
            x = np.where(there, x, 0.0)
            # Summed with the remainder that rounding lost, like Python's ``sum``.
            with np.errstate(invalid="ignore", over="ignore"):
                sum_ = total + x
                rest += np.where(np.abs(total) >= np.abs(x), (total - sum_) + x, (x - sum_) + total)
            total = sum_
            if back:
                count = count + there
            if back == 1:
                previous, known_previous = x, there
        mean = (total + np.where(np.isfinite(rest), rest, 0.0)) / np.maximum(count, 1)

        def kept(x):
            # One more element, so that place -1 is there where nothing is known.
            return np.append(x[has], x.dtype.type(0))

        rows = rows[has]
        months = month[rows]
        medians, sums, at, ordered, by_month = [], [], None, [], {}
        for own, m, x in zip(series[has].tolist(), months.tolist(), v[has].tolist(), strict=True):
            if own != at:
                at, ordered, by_month = own, [], {}
            insort(ordered, x)
            n = len(ordered)
            medians.append((ordered[(n - 1) // 2] + ordered[n // 2]) / 2)
            by_month[m] = by_month.get(m, 0.0) + x
            sums.append(by_month[m])
        medians, sums = np.array([*medians, 0.0]), np.array([*sums, 0.0])
        days, values, means = np.append(day[rows], 0), kept(v), kept(mean)
        previous, known_previous = kept(previous), kept(known_previous)
        places = place(of[rows], day[rows])
        monthly = place(of[rows] * 13 + months, day[rows])
        by = np.argsort(monthly, kind="stable")
        monthly, sums = monthly[by], np.append(sums[:-1][by], 0.0)
        new = slice(before, None)
        site, of, live, month, cut = site[new], of[new], live[new], month[new], day[new] - gap

        def column(x, there, kind):
            return pa.array(x, kind, mask=~there)

        def latest(own, when, among):
            """Place of the last sample up to ``when`` and how many there are."""
            last = np.searchsorted(among, place(own, when), "right")
            n = np.where(live, last - np.searchsorted(among, own << DAY_BITS), 0)
            return np.where(n > 0, last - 1, -1), n

        last, n = latest(of, cut, places)
        some, every = n > 0, np.ones(len(n), bool)
        in_month, n_month = latest(of * 13 + month, cut, monthly)
        out = [
            column(n, every, pa.int64()), column(medians[last], some, pa.float64()),
            column(sums[in_month], n_month > 0, pa.float64()), column(n_month, every, pa.int64()),
            column(days[last], some, pa.int32()), column(values[last], some, pa.float64()),
            column(means[last], some, pa.float64()), column(previous[last], some & known_previous[last], pa.float64()),
        ]
        for other in others:
            code = names.index(other) if other in names else len(names)
            last, n = latest(site * (len(names) + 1) + code, cut, places)
            some = (n > 0) & (other in names)
            out += [column(days[last], some, pa.int32()), column(values[last], some, pa.float64())]
        return out

    return known


def with_site_states(rows: DataFrame, gap: int, others: Sequence[str]) -> DataFrame:
    """``rows`` (site, target, ``_day``, ``_month``, ``_sampled``, ``_v``, more) with COLUMNS, then a day and a value per other target.

    Rows must lie together by site.
    """
    ordered = rows.sortWithinPartitions("site", "_day")
    added = [T.StructField(name, kind) for name, kind in zip(COLUMNS, KINDS, strict=True)]
    for i in range(len(others)):
        added += [T.StructField(f"_day_{i}", T.IntegerType()), T.StructField(f"_value_{i}", T.DoubleType())]
    schema = T.StructType([*ordered.schema.fields, *added])
    names = [f.name for f in added]
    others = list(others)
    # Executors get the code with the task and need not have this package.
    fresh = types.FunctionType(site_states.__code__, {"insort": insort, "np": np, "pa": pa, "DAY_BITS": DAY_BITS})
    block_rows = BLOCK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = fresh(gap, others), []

        def done() -> Iterator[pa.RecordBatch]:
            inputs = [
                pa.concat_arrays([batch.column(batch.schema.get_field_index(k)) for batch in block])
                for k in ("site", "target", "_day", "_month", "_sampled", "_v")
            ]
            made, start = known(*inputs), 0
            for batch in block:
                columns = [column.slice(start, batch.num_rows) for column in made]
                start += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

        for batch in batches:
            block.append(batch)
            if sum(x.num_rows for x in block) >= block_rows:
                yield from done()
                block = []
        if block:
            yield from done()

    return ordered.mapInArrow(run, schema)
