"""Mixing sources to target weights, in DataFrame functions alone.

Target: sources share a budget by weight; none gets more than a number of times its own size, and what
it cannot take goes to the others by weight (water filling, in closed form over the sorted sources).

Selection: a source first gives whole epochs. The rest of its target is drawn without
replacement by the Efraimidis-Spirakis scheme: each document has the key ``-ln(u) / quality``, the
smallest keys are taken, and prefix sums of sizes in key order say where the target is reached.
A source may hold most rows, so its order is never made in one task: keys fall into buckets, bucket
sums are cumulated first, and only the bucket that holds the target is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creekline.llm.quality_rules import words_of
from creekline.sources.sinks import staged

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
#: Least quality weight, and buckets of the keys of a source.
LEAST_QUALITY = 0.25
BUCKETS = 1 << 14
SEED = 17
#: Parts that equal rows at a cutoff are numbered in.
SALTS = 1 << 10


def quality_weight(words: Column) -> Column:
    """From LEAST_QUALITY to 1, higher the less a text repeats itself; an empty text has the least."""
    variety = F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))
    return F.lit(LEAST_QUALITY) + (1 - LEAST_QUALITY) * F.least(2 * variety, F.lit(1.0))


def sampling_key(key: Column, text: Column, quality: Column) -> Column:
    """Exponential with rate ``quality``; a function of the row and the seed alone, so reruns agree."""
    u = (F.pmod(F.xxhash64(key, text, F.lit(SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(u) / quality


def source_targets(sizes: DataFrame, source: str, weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row per source.

    Sources are ordered by code point, null last, and weigh ``weights`` in turn. The windows here
    see one row per source.
    """
    # Null sources have a name of their own in the order; bytes of UTF-8 sort by code point.
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col(source).isNull(), source)) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("_w", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn))
    cap = F.lit(float(most)) * F.col("source_size")
    by_ratio = Window.orderBy("_r", F.col(source).isNull(), source)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    levels = weighed.withColumn("_r", cap / F.col("_w")).select(
        source, "source_size", "_w", "_r",
        F.sum("source_size").over(Window.partitionBy()).alias("_total"),
        F.coalesce(F.sum(cap).over(before), F.lit(0.0)).alias("_capped"),
        F.sum("_w").over(onward).alias("_open"),
    )
    # The level if this source is the first that keeps below its cap; the true one is the first that does.
    level = (F.col("_total") - F.col("_capped")) / F.col("_open")
    found = levels.withColumn("_level", level).withColumn(
        "_true", F.min(F.when(F.col("_level") <= F.col("_r"), F.col("_level"))).over(Window.partitionBy())
    )
    first = F.min(F.when(F.col("_level") <= F.col("_r"), F.struct("_r", "_level"))).over(Window.partitionBy())["_level"]
    return found.withColumn("_true", first).select(
        source, "source_size",
        F.least(cap, F.coalesce(F.col("_true") * F.col("_w"), cap)).alias("target"),
    )


def mix_plan(rows: DataFrame) -> DataFrame:
    """Per source: ``_epochs`` and the key ``_cutoff`` up to which documents are taken once more.

    ``rows``: ``_source, _size, _k``. A document is taken if the middle of its stretch of words lies
    within the target, so a source misses it by half a document at most. Of the ``_tied`` rows with the
    cutoff's key (equal rows) ``_most`` are taken.
    """
    # Monotone in the key; with the least quality as rate no bucket gets more than its share times 1 / LEAST_QUALITY.
    bucket = F.floor((1 - F.exp(-F.col("_k") * LEAST_QUALITY)) * BUCKETS).cast("int")
    keyed = rows.withColumn("_bucket", bucket)
    sums = staged(keyed.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_inside")), "mix-buckets")
    targets = source_targets(sums.groupBy("_source").agg(F.sum("_inside").alias("source_size")), "_source")
    epochs = F.least(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(MOST_EPOCHS))
    targets = targets.withColumn("_epochs", F.coalesce(epochs, F.lit(0)).cast("bigint"))
    targets = staged(targets.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size")), "mix-targets")
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("_start", F.coalesce(F.sum("_inside").over(earlier), F.lit(0)))
    held = placed.alias("b").join(targets.alias("t"), F.col("b._source").eqNullSafe(F.col("t._source"))).filter(
        (F.col("_start") <= F.col("_rest")) & (F.col("_start") + F.col("_inside") >= F.col("_rest")) & (F.col("_rest") > 0)
    ).select(F.col("b._source").alias("_s"), F.col("_bucket").alias("_b"), "_start", "_rest")
    inside = keyed.join(held, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    ties = inside.groupBy("_source", "_b", "_start", "_rest", "_k").agg(F.sum("_size").alias("_n"), F.count(F.lit(1)).alias("_tied"))
    before_it = Window.partitionBy("_source", "_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_start") + F.coalesce(F.sum("_n").over(before_it), F.lit(0))
    # Rows of one key are of one size; so many of them have their middle within the target.
    fit = F.floor((F.col("_rest") - at) * F.col("_tied") / F.col("_n") + 0.5)
    fit = F.when(F.col("_n") > 0, F.least(F.greatest(fit, F.lit(0)), F.col("_tied"))).otherwise(F.when(at <= F.col("_rest"), F.col("_tied")).otherwise(0))
    ends = ties.withColumn("_most", fit)
    # The bucket's own first key is passed by when not even its middle is reached: then all before it are taken.
    last = F.max(F.when(F.col("_most") > 0, F.struct("_k", "_most", "_tied")))
    cut = ends.groupBy("_source").agg(last.alias("_last"), F.min("_k").alias("_least")).select(
        F.col("_source").alias("_s"), F.coalesce("_last._k", F.col("_least") * (1 - 1e-12)).alias("_cutoff"), "_last._most", "_last._tied"
    )
    return targets.join(cut, F.col("_source").eqNullSafe(F.col("_s")), "left").select(
        "_source", "source_size", "target", "_epochs", "_cutoff", "_most", "_tied"
    )


def with_drawn(rows: DataFrame, plan: DataFrame, name: str, source: Column, key: Column, cutoff: Column, most: Column, tied: Column) -> DataFrame:
    """``rows`` with ``name``: whether the row is drawn once more.

    Of equal rows at a cutoff that do not all fit, as many as fit are drawn. They are told apart by where they lie, so
    the rows of a hot key are numbered in salted parts, of which only the sizes are cumulated. ``plan`` (one row per source) says whether there are any: its last two columns
    are ``most`` and ``tied``.
    """
    if plan.filter(F.col(plan.columns[-2]) < F.col(plan.columns[-1])).isEmpty():
        return rows.withColumn(name, F.coalesce(key <= cutoff, F.lit(False)))
    partly = F.coalesce((key == cutoff) & (most < tied), F.lit(False))
    plain = rows.filter(~partly).withColumn(name, F.coalesce(key <= cutoff, F.lit(False)))
    id_, part, of, rank, start = (f"{name}_{x}" for x in ("id", "part", "of", "rank", "start"))
    # Written once: both uses below must see the same numbers.
    equal = rows.filter(partly).withColumns({id_: F.monotonically_increasing_id(), of: source, rank: most})
    equal = staged(equal.withColumn(part, F.pmod(F.xxhash64(id_), F.lit(SALTS))), "mix-ties")
    before = Window.partitionBy(of).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = equal.groupBy(of, part).agg(F.count(F.lit(1)).alias(start)).withColumn(start, F.coalesce(F.sum(start).over(before), F.lit(0)))
    starts = starts.select(F.col(of).alias(f"{of}2"), F.col(part).alias(f"{part}2"), start)
    numbered = equal.withColumn(f"{name}_n", F.row_number().over(Window.partitionBy(of, part).orderBy(id_)))
    drawn = numbered.join(starts, F.col(of).eqNullSafe(F.col(f"{of}2")) & (F.col(part) == F.col(f"{part}2"))).withColumn(
        name, F.col(start) + F.col(f"{name}_n") <= F.col(rank)
    )
    return plain.unionByName(drawn.select(*rows.columns, name))


def _prepared(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    words = words_of(F.col("_text"))
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(source).alias("_source")).withColumn("_words", words)
    rows = rows.withColumns({"_size": F.size("_words").cast("bigint"), "_quality": quality_weight(F.col("_words"))})
    return rows.withColumn("_k", sampling_key(F.col("_key"), F.col("_text"), F.col("_quality"))).drop("_words", "_text")


def mix_sources(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``key, size, source_size, target, taken`` for every row of ``df``.

    ``taken`` is the words that the mix takes of the row, repeats counted: its size times
    the whole epochs, once more if drawn. A null text has size 0 and a null source is a source.
    Keys may be null or repeated. Other columns are not read.
    """
    rows = staged(_prepared(df, key, text, source), "mix-rows")
    plan = staged(mix_plan(rows), "mix-plan").withColumnRenamed("_source", "_s")
    joined = rows.join(plan, F.col("_source").eqNullSafe(F.col("_s")))
    columns = [F.col(c) for c in ("_source", "_k", "_cutoff", "_most", "_tied")]
    return with_drawn(joined, plan, "_drawn", *columns).select(
        F.col("_key").alias(key), F.col("_size").alias("size"), "source_size", "target",
        (F.col("_size") * (F.col("_epochs") + F.col("_drawn").cast("bigint"))).alias("taken"),
    )


def mixed_documents(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it; columns as in ``df``, whatever their names.

    Nulls, ties and repeated rows are as in ``mix_sources``; an empty table gives no rows.
    """
    p = "_mix"
    while any(c.lower().startswith(p) for c in df.columns):
        p = f"_{p}"
    names = {"_source": f"{p}_s", "_epochs": f"{p}_e", "_cutoff": f"{p}_c", "_most": f"{p}_m", "_tied": f"{p}_t"}
    plan = staged(mix_plan(staged(_prepared(df, key, text, source), "mix-rows")), "mix-plan").select(*[F.col(a).alias(b) for a, b in names.items()])
    joined = df.join(plan, F.col(source).eqNullSafe(F.col(names["_source"]))).withColumn(f"{p}_w", words_of(F.col(text)))
    joined = joined.withColumn(f"{p}_k", sampling_key(F.col(key), F.col(text), quality_weight(F.col(f"{p}_w")))).drop(f"{p}_w")
    columns = [F.col(c) for c in (source, f"{p}_k", names["_cutoff"], names["_most"], names["_tied"])]
    drawn = with_drawn(joined, plan, f"{p}_d", *columns)
    times = F.col(names["_epochs"]) + F.col(f"{p}_d").cast("bigint")
    copies = F.array_repeat(F.lit(1), times.cast("int"))
    return drawn.withColumn(f"{p}_copy", F.explode(copies)).select(*[F.col(f"`{c}`") for c in df.columns])
