"""Approximate nearest neighbours over learned partitions.

On a bounded sample a neighbour graph is built and cut into parts of equal size with few
edges between them. A small network learns which parts a vector's neighbours lie in. Every vector is
indexed in its most probable part; a query goes to its several most probable parts, as many
as the sample needed to find nearly all of its neighbours, and is reranked there on the original vectors.

Equal vectors are one entry that keeps its smallest ids, so a very common vector is no hot part;
large parts are dealt out in blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creekline.llm.common import prepare_workers
from creekline.sources.sinks import staged

#: Vectors that partitions are learnt on, at most; vectors of a part; least and most parts.
SAMPLE, PART, LEAST_PARTS, MOST_PARTS = 8_192, 2_000, 8, 256
NEIGHBOURS, HIDDEN, PASSES = 10, 64, 30
#: Share of the sample's neighbours that the probed parts must hold, and vectors of a block.
WANTED, BLOCK = 0.98, 4_096
#: By how much the fast product may miss a cosine.
FAST_ERROR = 1e-9


@dataclass
class Router:
    """A network from a unit vector to the probability of each part, and how many parts to probe."""

    layers: list[np.ndarray]
    parts: int
    probes: int

    def logits(self, unit: np.ndarray) -> np.ndarray:
        w, b, u, c = self.layers
        return np.maximum(unit @ w + b, 0) @ u + c

    def best(self, unit: np.ndarray, k: int) -> np.ndarray:
        return np.argsort(-self.logits(unit), axis=1, kind="stable")[:, :k]


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that no square overflows or vanishes.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def neighbour_graph(unit: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of each of a bounded sample, by blocks of rows."""
    out = np.empty((len(unit), k), np.int64)
    for at in range(0, len(unit), 1024):
        near = unit[at : at + 1024] @ unit.T
        near[np.arange(len(near)), at + np.arange(len(near))] = -2
        out[at : at + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, unit: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each node: equal halves along principal directions, then moves that save cut
    edges while no part grows over its share by a tenth."""
    part = np.zeros(len(unit), np.int64)

    def halve(rows: np.ndarray, first: int, count: int) -> None:
        if count == 1 or not len(rows):
            part[rows] = first
            return
        centred = unit[rows] - unit[rows].mean(0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(centred @ axis, kind="stable")]
        left = count // 2
        cut = len(rows) * left // count
        halve(order[:cut], first, left)
        halve(order[cut:], first + left, count - left)

    halve(np.arange(len(unit)), 0, parts)
    most = int(1.1 * len(unit) / parts) + 1
    size = np.bincount(part, minlength=parts)
    # Edges count in both directions.
    ends = np.concatenate([np.stack([np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()], 1), np.stack([graph.ravel(), np.repeat(np.arange(len(graph)), graph.shape[1])], 1)])
    for _ in range(rounds):
        held = np.zeros((len(unit), parts), np.int32)
        np.add.at(held, (ends[:, 0], part[ends[:, 1]]), 1)
        best = held.argmax(1)
        gain = held[np.arange(len(unit)), best] - held[np.arange(len(unit)), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < most:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def learn_router(sample: np.ndarray, total: int) -> Router:
    """Partitions and network from a sample of vectors out of ``total``."""
    unit = _unit(sample)
    parts = int(min(MOST_PARTS, max(LEAST_PARTS, total // PART), max(1, len(unit) // 16)))
    start = np.random.default_rng(3)
    dim = unit.shape[1]
    if parts == 1 or len(unit) <= NEIGHBOURS:
        return Router([np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1, 1)
    graph = neighbour_graph(unit, NEIGHBOURS)
    part = balanced_parts(graph, unit, parts)
    wanted = np.zeros((len(unit), parts))
    np.add.at(wanted, (np.repeat(np.arange(len(unit)), NEIGHBOURS), part[graph.ravel()]), 1 / NEIGHBOURS)
    wanted = 0.5 * wanted + 0.5 * np.eye(parts)[part]
    layers = [start.normal(0, (2 / dim) ** 0.5, (dim, HIDDEN)), np.zeros(HIDDEN), start.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, parts)), np.zeros(parts)]
    first, second = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers]
    kept_out = np.arange(len(unit)) % 5 == 0
    rows, step = np.flatnonzero(~kept_out), 0
    for _ in range(PASSES):
        start.shuffle(rows)
        for at in range(0, len(rows), 128):
            x, y = unit[rows[at : at + 128]], wanted[rows[at : at + 128]]
            w, b, u, c = layers
            hidden = np.maximum(x @ w + b, 0)
            z = hidden @ u + c
            p = np.exp(z - z.max(1, keepdims=True))
            error = (p / p.sum(1, keepdims=True) - y) / len(x)
            back = (error @ u.T) * (hidden > 0)
            step += 1
            for i, slope in enumerate((x.T @ back, back.sum(0), hidden.T @ error, error.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope**2
                layers[i] = layers[i] - 0.004 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    router = Router(layers, parts, parts)
    # Probes: judged on vectors that the network has not seen, by where all vectors will be indexed.
    home = router.best(unit, 1)[:, 0]
    order = router.best(unit[kept_out], parts)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :], 1)
    depth = np.take_along_axis(place, home[graph[kept_out]], 1).ravel()
    reached = np.cumsum(np.bincount(depth, minlength=parts)) / len(depth)
    router.probes = int(np.searchsorted(reached, WANTED) + 1)
    return router


def _entries(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """``_id, _key, _v`` of the vectors that take part: no null or non-finite component, not zero."""
    rows = df.select(F.col(id_).cast("bigint").alias("_id"), F.col(vector).cast("array<double>").alias("_vector"))
    rows = rows.filter(F.col("_id").isNotNull() & F.col("_vector").isNotNull() & ~F.exists("_vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = rows.filter(F.exists("_vector", lambda x: x != 0))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # Adding 0 makes -0.0 and 0.0 one number.
            raw = [(np.asarray(x, np.float64) + 0.0).tobytes() for x in frame["_vector"]]
            yield pd.DataFrame({"_id": frame["_id"], "_key": [xxhash.xxh64_intdigest(x, 0) - (1 << 63) for x in raw], "_v": raw})

    return rows.mapInPandas(pack, "_id bigint, _key bigint, _v binary")


def _least_ids(entries: DataFrame, keep: int) -> DataFrame:
    """``_key, _v, _ids``: distinct vectors with their ``keep`` smallest ids; each task first keeps its own smallest."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[bytes, list[int]]] = {}
        for frame in frames:
            for id_, key, v in zip(frame["_id"], frame["_key"], frame["_v"], strict=True):
                own = held.setdefault(key, (v, []))[1]
                if id_ not in own:
                    own.append(id_)
                    if len(own) > 4 * keep:
                        own[:] = sorted(own)[:keep]
        yield pd.DataFrame(
            [(k, v, sorted(ids)[:keep]) for k, (v, ids) in held.items()], columns=["_key", "_v", "_ids"]
        )

    lists = entries.mapInPandas(partial, "_key bigint, _v binary, _ids array<bigint>")
    merged = lists.groupBy("_key").agg(F.first("_v").alias("_v"), F.flatten(F.collect_list("_ids")).alias("_ids"))
    return merged.select("_key", "_v", F.slice(F.array_sort(F.array_distinct("_ids")), 1, keep).alias("_ids"))


def nearest(df: DataFrame, id_: str, vector: str, is_query, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row for which ``is_query``
    (a condition on ``id_``) holds, nearest first, ties to the smaller id; all if there are fewer.

    Score: cosine in double precision on the original vectors. Vectors that are null, zero, of
    another length than most or hold null or non-finite components take no part, neither do null
    ids. Rows that share an id count as the query's own. Other columns are not read.
    """
    prepare_workers(df.sparkSession)
    entries = _entries(df, id_, vector)
    usual = entries.groupBy(F.length("_v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    entries = entries.filter(F.length("_v") == usual["n"])
    index = staged(_least_ids(entries, k + 1), "distinct-vectors")
    total = index.count()
    # A sample by hash, of bounded size.
    share = max(1, min(1_000_000, 1_000_000 * SAMPLE // total))
    some = index.filter(F.pmod(F.xxhash64("_key", F.lit(2)), F.lit(1_000_000)) < share).select("_v").orderBy("_v").limit(2 * SAMPLE).collect()
    router = learn_router(np.stack([np.frombuffer(r["_v"]) for r in some]) if some else np.ones((1, usual["n"] // 8)), total)
    shared = df.sparkSession.sparkContext.broadcast(router)

    def route(probes: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    best = shared.value.best(_unit(np.stack([np.frombuffer(x) for x in frame["_v"]])), probes)
                    yield frame.assign(_parts=list(best.astype(np.int32)))

        return run

    homes = staged(index.mapInPandas(route(1), "_key bigint, _v binary, _ids array<bigint>, _parts array<int>").select("_key", "_v", "_ids", F.col("_parts")[0].alias("_part")), "index")
    blocks = {r["_part"]: -(-r["count"] // BLOCK) for r in homes.groupBy("_part").count().collect()}
    count = F.get(F.array(*[F.lit(blocks.get(p, 1)) for p in range(router.parts)]), F.col("_part"))
    asked = staged(entries.filter(is_query(F.col("_id"))).select("_id", "_key", "_v"), "queries")
    vectors = asked.groupBy("_key").agg(F.first("_v").alias("_v"))
    routed = vectors.mapInPandas(route(router.probes), "_key bigint, _v binary, _parts array<int>")
    routed = routed.select("_key", "_v", F.explode("_parts").alias("_part")).select("_key", "_v", "_part", F.explode(F.sequence(F.lit(0), count - 1)).alias("_block"))
    placed = homes.withColumn("_block", F.pmod(F.xxhash64("_key"), count).cast("int"))

    def rerank(queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(own):
            x = np.stack([np.frombuffer(v) for v in own["_v"]])
            unit = _unit(x)
            for at in range(0, len(queries), 512):
                part = queries.iloc[at : at + 512]
                y = np.stack([np.frombuffer(v) for v in part["_v"]])
                near = _unit(y) @ unit.T
                # All that the fast product cannot tell from the best ones; the exact measure orders them, then the id.
                most = min(len(x), k + 1)
                least = -np.partition(-near, most - 1, axis=1)[:, most - 1] - FAST_ERROR
                for i in range(len(part)):
                    found = [(-_cosine(y[i], x[j]), int(v)) for j in np.flatnonzero(near[i] >= least[i]) for v in own["_ids"].iloc[j]]
                    out += [(part["_key"].iloc[i], v, -score) for score, v in heapq.nsmallest(k + 1, found)]
        return pd.DataFrame(out, columns=["_key", "vec_id", "score"]).astype({"_key": "int64", "vec_id": "int64", "score": "float64"})

    met = routed.groupBy("_part", "_block").cogroup(placed.groupBy("_part", "_block")).applyInPandas(rerank, "_key bigint, vec_id bigint, score double")
    best = Window.partitionBy("_key").orderBy(F.desc("score"), "vec_id")
    top = met.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1)
    lists = top.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("_top"))
    found = asked.join(lists, "_key").withColumn("_top", F.slice(F.filter("_top", lambda x: x["vec_id"] != F.col("_id")), 1, k))
    return found.select(F.col("_id").alias("query_id"), F.posexplode("_top").alias("_p", "_t")).select(
        "query_id", (F.col("_p") + 1).alias("rank"), F.col("_t.vec_id").alias("vec_id"), F.col("_t.score").alias("score")
    )


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.dot(a, b) / (np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))))
