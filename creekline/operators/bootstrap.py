"""Site-level bootstrap of an error gain, with draws anyone can repeat.

Whole sites are resampled with replacement. A draw is a hash of its place, so it does not depend on
partitioning, retries or a random generator's state. Draws are split in two: how many of a replicate's
draws fall into each bucket of sites, then which sites they are inside it. The second half is made where
a bucket's sites lie, so no draw of a single site is ever shuffled. A place is the same for every group, so its
hash is taken once where the groups' rows of one slot or bucket lie together, and draws stay arrays in tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creekline.sources.sinks import staged

REPLICATES = 1000
SEED = 42
DRAWS_PER_HASH = 4
#: Sites whose sums lie side by side in one row.
BUCKET_SITES = 1024
#: Counts of draws that a task holds at once.
HELD_COUNTS = 1 << 24
#: Groups of one bucket whose draws are made together, and tasks that share a bucket's groups.
GROUPS_AT_ONCE, TASKS_PER_BUCKET = 64, 4


def site_slots(gains: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number the sites of each group from 0 (``slot``) and add their count (``sites``).

    Sites are spread over 4096 hash buckets: rows are numbered inside a bucket, and only the
    bucket sizes are cumulated, so no task sees all sites of a group.
    """
    bucket = F.conv(F.substring(F.md5(F.col("site")), 1, 3), 16, 10).cast("int")
    tagged = gains.withColumn("_bucket", bucket)
    group = Window.partitionBy(*keys)
    sizes = (
        tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
        .select(
            *keys, "_bucket",
            F.coalesce(
                F.sum("_size").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_offset"),
            F.sum("_size").over(group).alias("sites"),
        )
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("site")
    return (
        tagged.withColumn("_place", F.row_number().over(inside) - 1)
        .join(sizes, [*keys, "_bucket"])
        .withColumn("slot", F.col("_offset") + F.col("_place"))
        .drop("_bucket", "_offset", "_place")
    )


def draws_per_bucket(
    sites: DataFrame, keys: Sequence[str], replicates: int, seed: int, bucket_sites: int, held: int = HELD_COUNTS
) -> DataFrame:
    """``keys, _bucket, _from, _draws``: how many draws of the replicates from ``_from`` on fall into each bucket, as
    arrays that add up; only for groups of more than one bucket.

    A replicate draws as often as there are sites. Every site row makes the draws of its own slot, and tasks add up
    their own first. Replicates are split where a group has more than ``held`` counts.
    """
    keys, hashes = list(keys), -(-replicates // DRAWS_PER_HASH)
    # Hashes of a slice, so that its counts of all buckets can be held.
    each = F.greatest(F.lit(1), F.floor(held / (F.ceil(F.col("sites") / bucket_sites) * DRAWS_PER_HASH))).cast("int")
    first = F.explode(F.sequence(F.lit(0), F.lit(hashes - 1), F.least(each, F.lit(hashes)))).alias("_first")
    several = sites.filter(F.col("sites") > bucket_sites).select(*keys, "slot", "sites", each.alias("_each"), first)
    # Groups' rows of one slot follow each other.
    dealt = several.repartition("slot", "_first").sortWithinPartitions("_first", "slot")
    fields = [f for f in several.schema.fields if f.name in keys]
    schema = (
        T.StructType(fields).add("_bucket", T.LongType()).add("_from", T.IntegerType()).add("_draws", T.ArrayType(T.IntegerType()))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        cells, types, place, numbers = 0, [], None, None

        def flushed() -> Iterator[pa.RecordBatch]:
            for (*group, first), table in counts.items():
                some = np.flatnonzero(table.any(axis=1))
                for at in range(0, len(some), 256):
                    here = some[at : at + 256]
                    columns = [pa.array([k] * len(here), kind) for k, kind in zip(group, types, strict=True)]
                    columns += [pa.array(here, pa.int64()), pa.array([first * DRAWS_PER_HASH] * len(here), pa.int32())]
                    columns.append(pa.array(list(table[here]), pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            for *group, slot, n, each, first in zip(*[batch.column(c).to_pylist() for c in (*keys, "slot", "sites", "_each", "_first")], strict=True):
                last = min(first + each, hashes)
                if place != (slot, first, last):
                    place = (slot, first, last)
                    digests = b"".join(hashlib.md5(b"%d:%d:%d" % (seed, block, slot)).digest() for block in range(first, last))
                    numbers = np.frombuffer(digests, ">u4").astype(np.int64)[: replicates - first * DRAWS_PER_HASH]
                table = counts.get((*group, first))
                if table is None:
                    shape = (-(-n // bucket_sites), len(numbers))
                    if counts and cells + shape[0] * shape[1] > held:
                        yield from flushed()
                        counts, cells = {}, 0
                    table = counts[(*group, first)] = np.zeros(shape, np.int32)
                    cells += table.size
                table[numbers % n // bucket_sites, np.arange(len(numbers))] += 1
        yield from flushed()

    return dealt.mapInArrow(run, schema)


def drawn_sums(buckets: DataFrame, keys: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """``keys, replicate, gain, n``: sums over the sites that a replicate drew, one row per replicate and bucket.

    ``buckets`` holds ``keys, _bucket, _gains, _counts`` of its sites, ``_all`` (draws of every replicate, or NULL) and ``_parts``.
    """
    keys = list(keys)
    share = F.pmod(F.xxhash64(*keys), F.lit(TASKS_PER_BUCKET))
    dealt = buckets.repartition("_bucket", share).sortWithinPartitions("_bucket")
    fields = [f for f in buckets.schema.fields if f.name in keys]
    schema = T.StructType(fields).add("replicate", T.IntegerType()).add("gain", T.DoubleType()).add("n", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = []

        def made(bucket: int, groups: list) -> Iterator[pa.RecordBatch]:
            most = np.max([draws for *_, draws in groups], axis=0)
            sums = [([], []) for _ in groups]
            for replicate in range(replicates):
                blocks = range(-(-int(most[replicate]) // DRAWS_PER_HASH))
                digests = b"".join(hashlib.md5(b"%d:%d:%d:%d" % (seed, replicate, bucket, block)).digest() for block in blocks)
                numbers = np.frombuffer(digests, ">u4").astype(np.int64)
                for (_, gains, known, n, draws), (gain_sums, counts) in zip(groups, sums, strict=True):
                    at = numbers[: draws[replicate]] % len(n)
                    # A NULL gain is left out; only NULLs make NULL.
                    some = known is None or bool(known[at].any())
                    gain_sums.append(float(gains[at].sum()) if some and len(at) else None)
                    counts.append(int(n[at].sum()) if len(at) else None)
            for (group, *_), (gain_sums, counts) in zip(groups, sums, strict=True):
                columns = [pa.array([k] * replicates, kind) for k, kind in zip(group, types, strict=True)]
                columns += [pa.array(range(replicates), pa.int32()), pa.array(gain_sums, pa.float64()), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        at, groups = None, []
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            for i in range(batch.num_rows):
                *group, bucket, own, n, every, parts = (batch.column(c)[i].as_py() for c in (*keys, "_bucket", "_gains", "_counts", "_all", "_parts"))
                if groups and (bucket != at or len(groups) == GROUPS_AT_ONCE):
                    yield from made(at, groups)
                    groups = []
                at = bucket
                draws = np.full(replicates, every or 0, np.int64)
                for part in parts or []:
                    draws[part["_from"] : part["_from"] + len(part["_draws"])] += part["_draws"]
                known = None if None not in own else np.array([x is not None for x in own])
                groups.append((group, np.array([0.0 if x is None else x for x in own]), known, np.array(n), draws))
        if groups:
            yield from made(at, groups)

    return dealt.mapInArrow(run, schema)


def _bucket_of(slot: Column, bucket_sites: int) -> Column:
    return F.floor(slot / bucket_sites)


def cluster_bootstrap(
    rows: DataFrame, keys: Sequence[str], gain: str, replicates: int = REPLICATES, seed: int = SEED, bucket_sites: int = BUCKET_SITES
) -> DataFrame:
    """Mean gain and its 2.5..97.5 % interval per group.

    Rows are summed per site first; a replicate is the ratio of summed gains to summed counts.
    """
    keys = list(keys)
    gains = rows.groupBy(*keys, "site").agg(F.sum(gain).alias("gain"), F.count(F.lit(1)).alias("n"))
    # Staged: one small row per site.
    sites = staged(site_slots(gains, keys), "sites")
    own = F.array_sort(F.collect_list(F.struct("slot", "gain", "n")))
    every = F.when(F.max("sites") <= bucket_sites, F.max("sites"))
    buckets = sites.groupBy(*keys, _bucket_of(F.col("slot"), bucket_sites).alias("_bucket")).agg(own.alias("_own"), every.alias("_all"))
    buckets = buckets.select(*keys, "_bucket", F.col("_own.gain").alias("_gains"), F.col("_own.n").alias("_counts"), "_all")
    drawn = draws_per_bucket(sites, keys, replicates, seed, bucket_sites)
    # A row per task that counted draws of the bucket.
    drawn = drawn.groupBy(*keys, "_bucket").agg(F.collect_list(F.struct("_from", "_draws")).alias("_parts"))
    buckets = buckets.join(drawn, [*keys, "_bucket"], "left")
    estimates = (
        drawn_sums(buckets, keys, replicates, seed)
        .groupBy(*keys, "replicate")
        .agg((F.sum("gain") / F.sum("n")).alias("estimate"))
    )
    interval = estimates.groupBy(*keys).agg(
        F.percentile("estimate", F.array(F.lit(0.025), F.lit(0.975))).alias("_interval")
    )
    means = sites.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sites"), (F.sum("gain") / F.sum("n")).alias("mean_gain")
    )
    return means.join(interval, keys).select(
        *keys, "sites", "mean_gain",
        F.col("_interval")[0].alias("lower_95"), F.col("_interval")[1].alias("upper_95"),
    )
