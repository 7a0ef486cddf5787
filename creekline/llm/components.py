"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creekline.sources.sinks import staged


def _smallest(edges: DataFrame) -> DataFrame:
    """Per node the least of itself and its neighbours; partial minima are taken map-side."""
    return edges.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u, v``, undirected); root: the component's least node.

    Each round points neighbours at the least one seen (large star, then small star), written out
    before the next; rounds grow with the logarithm of a component's size. Loops and repeated
    edges do no harm; an empty table gives none.
    """
    edges = edges.filter("u <> v")
    stars = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    before = None
    for _ in range(most_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        large = staged(large.filter("u <> v").distinct(), "stars")
        # Here u is the larger end, so all its neighbours are smaller.
        least = large.groupBy("u").agg(F.min("v").alias("_m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("_m").alias("v")), F.struct(F.col("v").alias("u"), F.col("_m").alias("v")))).alias("e"))
        stars = staged(small.select("e.u", "e.v").filter("u <> v").distinct(), "stars")
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = stars.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
