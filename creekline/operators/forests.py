"""Random forests over binned rows: tasks sum histograms, a shuffle by tree joins them, the driver keeps the nodes.

Rows are cut into at most ``bins`` bins per input once and written as packed blocks. For a level of all trees each task
leads its rows down from the roots and sums weights and outcomes per node, input and bin; the sums of a tree meet in
one task, which picks the best split of each of its nodes. Of two children only the lighter one is summed: the other has
the rest of their parent's sums, which are written with each level. A task holds its own rows, at about 80 bytes each, and
the histograms of one tree. How often a tree draws a row is a hash of the row and the tree, so draws do not
depend on the number of tasks. A share of events is a mean of 0 and 1, and the gini gain is twice the
gain in variance, so one kind of tree serves outcomes and events. Outcomes are summed in 131,071 whole steps of their
range, together with the weights in one number.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creekline.sources.sinks import staged

#: Rows of a block, whose columns fit a core's cache.
BLOCK_ROWS = 1 << 14
#: A row's number holds a one above its outcome, which counts the row, and the outcome in whole steps of its range. A row is drawn
#: at most seven times, so sums over a block stay exact: 17 bits of weight above 17 bits of weight and 17 of outcome.
STEPS, ONE_ROW = float((1 << 17) - 1), float(1 << 35)
#: Nodes of a tree whose histograms are one row of the shuffle.
NODES_PER_PART = 256
#: How closely bins follow the quantiles of an input.
QUANTILE_ACCURACY = 2_000
#: Share of the inputs that a node may be split by.
FEATURE_SHARE = 0.8
#: Rows that are compared with a node at once, and levels down to which nodes are; below, rows look up their own nodes.
CHUNK_ROWS, MASKED = 1 << 16, 6
#: Values of a number that several inputs share: more where a tree has few open nodes, as sums of all values are made often.
LEAST_BUNDLE, MOST_BUNDLE = 256, 1024
SPLITS = (
    "tree int, part int, feature array<int>, bin array<int>, weight array<double>, sum array<double>, "
    "left_weight array<double>, left_sum array<double>, below array<binary>"
)


@dataclass
class Forest:
    """``roots`` trees in one list of nodes; tree ``i`` starts at node ``i``. A node sends a row to ``left`` if its input lies
    in ``bin`` or below, else to the node after it. A leaf leads to itself."""

    roots: int
    edges: list[np.ndarray]
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        about = json.dumps({"roots": self.roots, "depth": self.depth, "edges": [e.tolist() for e in self.edges]})
        spark.createDataFrame([(about,)], "about string").write.mode("overwrite").parquet(f"{path}/about")
        nodes = pa.table({
            "id": pa.array(np.arange(len(self.left))), "feature": pa.array(self.feature), "bin": pa.array(self.bin.astype(np.int32)),
            "left": pa.array(self.left), "value": pa.array(self.value),
        })
        spark.createDataFrame(nodes).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")

    def transform(self, rows: DataFrame, features: Column, name: str) -> DataFrame:
        """``rows`` with the mean of all trees, from an array of inputs."""
        forest, schema = self, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, paths = None, forest.paths()
            for batch in batches:
                names = names or [n for n in batch.schema.names if n != "_inputs"]
                found = pa.array(forest.predict(_matrix(batch.column("_inputs"), len(forest.edges)), paths))
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], found], [*names, name])

        return rows.withColumn("_inputs", features).mapInArrow(run, schema)

    def paths(self) -> list[Paths]:
        return [Paths(self, tree, self.depth) for tree in range(self.roots)]

    def predict(self, x: np.ndarray, paths: list[Paths] | None = None) -> np.ndarray:
        out, paths = np.zeros(len(x)), paths or self.paths()
        for start in range(0, len(x), BLOCK_ROWS):
            codes = binned(x[start : start + BLOCK_ROWS], self.edges)
            n = codes.shape[1]
            total = np.zeros(n)
            for tree in paths:
                total += self.value.take(tree.ends(codes))
            out[start : start + n] = total / self.roots
        return out

    def walk(self, codes: np.ndarray, rows: np.ndarray, tree: int | np.ndarray, steps: int) -> np.ndarray:
        """The node of each of ``rows`` after ``steps`` steps down from ``tree``, a root or a node per row."""
        flat, n = codes.ravel(), codes.shape[1]
        # Results go to arrays at hand: new ones would cost more than what is computed.
        node, following, at = (np.full(len(rows), tree) for _ in range(3))
        code, end, beyond = np.empty(len(rows), codes.dtype), np.empty(len(rows), self.bin.dtype), np.empty(len(rows), bool)
        for _ in range(steps):
            np.take(self.feature, node, out=at, mode="clip")
            at *= n
            at += rows
            np.take(flat, at, out=code, mode="clip")
            np.take(self.bin, node, out=end, mode="clip")
            np.take(self.left, node, out=following, mode="clip")
            following += np.greater(code, end, out=beyond)
            node, following = following, node
        return node


def load_forest(spark: SparkSession, path: str) -> Forest:
    about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
    nodes = spark.read.parquet(f"{path}/nodes").toArrow().sort_by("id")
    feature, at, left, value = (nodes.column(c).to_numpy() for c in ("feature", "bin", "left", "value"))
    edges = [np.array(e, float) for e in about["edges"]]
    return Forest(about["roots"], edges, feature, at.astype(code_type(edges)), left, value, about["depth"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a column of equally long arrays; a missing number counts as NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, width)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers, inputs by rows: how many edges lie below a value."""
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)]).astype(code_type(edges))


def code_type(edges: list[np.ndarray]) -> type:
    return np.uint8 if max(map(len, edges)) < 255 else np.uint16


def bin_edges(rows: DataFrame, features: str, width: int, bins: int) -> tuple[list[np.ndarray], float, float]:
    """Upper ends of all bins but the last, per input: the least value and quantiles of all rows. With the range of ``_y``."""
    shares = [i / (bins - 1) for i in range(bins - 1)]
    found = rows.agg(
        *[F.percentile_approx(F.col(features)[i], shares, QUANTILE_ACCURACY).alias(f"q{i}") for i in range(width)],
        F.min("_y").alias("low"), F.max("_y").alias("high"),
    ).first()
    return [np.unique(np.array(found[f"q{i}"] or [0.0], float)) for i in range(width)], found["low"], found["high"]


def _blocks(rows: DataFrame, edges: list[np.ndarray], low: float, high: float) -> DataFrame:
    """``n, codes, packed, draw``: rows with ``_features``, ``_y`` and ``_draw``, up to ``BLOCK_ROWS`` of them a block."""

    def pack(table: pa.Table) -> pa.RecordBatch:
        codes = binned(_matrix(table.column("_features").combine_chunks(), len(edges)), edges)
        share = (table.column("_y").to_numpy() - low) / ((high - low) or 1.0)
        packed, draw = ONE_ROW + np.rint(share * STEPS), table.column("_draw").to_numpy()
        arrays = [pa.array([len(draw)], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (codes, packed, draw)]]
        return pa.RecordBatch.from_arrays(arrays, ["n", "codes", "packed", "draw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            piece = pa.Table.from_batches([batch])
            kept = pa.concat_tables([kept, piece]) if kept else piece
            while kept.num_rows >= BLOCK_ROWS:
                yield pack(kept.slice(0, BLOCK_ROWS))
                kept = kept.slice(BLOCK_ROWS)
        if kept and kept.num_rows:
            yield pack(kept)

    return rows.select("_features", "_y", "_draw").mapInArrow(run, "n int, codes binary, packed binary, draw binary")


def _draws(seed: int, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """A multiplier per tree, and how often a row is drawn by the upper 16 bits of a product: Poisson with mean 1."""
    rng = np.random.default_rng(seed)
    share, total, ends = np.exp(-1.0), 0.0, []
    for k in range(8):
        total += share
        ends.append(round(total * 65_536))
        share /= k + 1
    factors = rng.integers(0, 1 << 63, trees, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, np.minimum(np.searchsorted(ends, np.arange(65_536), side="right"), 7).astype(np.uint8)


def bundles(counts: list[int], most: int) -> list[list[int]]:
    """Inputs that are summed together, by their numbers of bins: those with few share one number, of ``most`` values at most."""
    out: list[list[int]] = []
    size = most + 1
    for i in sorted(range(len(counts)), key=lambda i: counts[i]):
        if size * counts[i] > most:
            out.append([])
            size = 1
        out[-1].append(i)
        size *= counts[i]
    return out


def _level_sums(blocks: DataFrame, forest: Forest, level: int, slot_of: np.ndarray, open_nodes: Sequence, bins: int, seed: int) -> DataFrame:
    """``tree, part, sums``: per pair of nodes of a tree the lighter one's weights and outcomes by input and bin.

    ``slot_of`` numbers the nodes that are summed within each tree, with -1 for every other node; ``open_nodes`` counts
    the pairs of each tree, of all or by its parts.
    """
    width, roots, coded = len(forest.edges), forest.roots, code_type(forest.edges)
    counts = [len(e) + 1 for e in forest.edges]
    parts = {
        tree: [(part, int(pairs)) for part, pairs in enumerate(np.atleast_1d(own)) if pairs] for tree, own in enumerate(open_nodes)
    }
    most = max((pairs for of_tree in parts.values() for _, pairs in of_tree), default=1)
    groups = bundles(counts, min(MOST_BUNDLE, max(LEAST_BUNDLE, 4 * MOST_BUNDLE // most)))

    def group_codes(codes: np.ndarray) -> list[tuple[np.ndarray, int]]:
        out = []
        for group in groups:
            code, size = codes[group[0]], counts[group[0]]
            for i in group[1:]:
                size *= counts[i]
                code = code.astype(np.uint8 if size <= 256 else np.uint16) * np.uint8(counts[i]) + codes[i]
            out.append((code, size))
        return out

    def tree_rows(tree: int, codes: np.ndarray, packed: np.ndarray, draw: np.ndarray, factor: np.uint64, times: np.ndarray) -> Iterator[tuple]:
        """Rows that the tree draws and that lie in lighter nodes, with the number of their pair and their numbers."""
        paths = Paths(forest, tree, level, slot_of)
        for start in range(0, codes.shape[1], CHUNK_ROWS):
            hashed = draw[start : start + CHUNK_ROWS] * factor
            hashed >>= np.uint64(48)
            weight = times.take(hashed.view(np.int64))
            rows, slot = paths.slots(codes, start, weight)
            yield rows, slot, packed.take(rows) * weight.take(rows - start)

    def add(sums: list[np.ndarray], grouped: list[tuple[np.ndarray, int]], rows: np.ndarray, slot: np.ndarray, packed: np.ndarray, pairs: int) -> None:
        at, bases = np.empty(len(rows), np.int64), {}
        for total, (codes, size) in zip(sums, grouped, strict=True):
            if size not in bases:
                bases[size] = slot * size
            np.add(bases[size], codes.take(rows), out=at)
            found = np.bincount(at, packed, pairs * size)
            weight = np.floor(found / ONE_ROW)
            total[0] += weight
            weight *= ONE_ROW
            found -= weight
            total[1] += found

    def by_input(sums: list[np.ndarray], pairs: int) -> np.ndarray:
        out = np.zeros((2, width, pairs, bins))
        for total, group in zip(sums, groups, strict=True):
            shaped = total.reshape(2, pairs, *[counts[i] for i in group])
            for axis, i in enumerate(group):
                out[:, i, :, : counts[i]] = shaped.sum(tuple(a + 2 for a in range(len(group)) if a != axis))
        return out

    def part_sums(drawn: list[tuple], grouped: list[tuple[np.ndarray, int]], start: int, pairs: int, whole: bool) -> np.ndarray:
        sums = [np.zeros((2, pairs * size)) for _, size in grouped]
        for rows, slot, packed in drawn:
            if not whole:
                mine = np.flatnonzero((slot >= start) & (slot < start + pairs))
                rows, slot, packed = rows.take(mine), slot.take(mine) - start, packed.take(mine)
            add(sums, grouped, rows, slot, packed, pairs)
        return by_input(sums, pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = []
        for batch in batches:
            for n, codes, packed, draw in zip(*[batch.column(c).to_pylist() for c in ("n", "codes", "packed", "draw")], strict=True):
                own.append((np.frombuffer(codes, coded).reshape(width, n), np.frombuffer(packed), np.frombuffer(draw, np.uint64)))
        if not own:
            return
        codes, packed, draw = (np.concatenate(v, axis=-1) for v in zip(*own, strict=True))
        own.clear()
        grouped = group_codes(codes)
        factors, times = _draws(seed, roots)
        for tree, of_tree in parts.items():
            drawn = _regrouped(tree_rows(tree, codes, packed, draw, factors[tree], times), BLOCK_ROWS)
            # A tree of one part is summed as its rows are found.
            drawn = drawn if len(of_tree) == 1 else list(drawn)
            start = 0
            for part, pairs in of_tree:
                sums = part_sums(drawn, grouped, start, pairs, len(of_tree) == 1)
                start += pairs
                arrays = [pa.array([tree], pa.int32()), pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["tree", "part", "sums"])

    return blocks.mapInArrow(run, "tree int, part int, sums binary")


def _regrouped(pieces: Iterator[tuple], size: int) -> Iterator[tuple]:
    """The same rows in pieces of ``size``; a sum over more of them would not be exact."""
    kept, n = [], 0
    for piece in pieces:
        kept.append(piece)
        n += len(piece[0])
        if n >= size:
            whole = tuple(np.concatenate(v) for v in zip(*kept, strict=True))
            for start in range(0, n - size + 1, size):
                yield tuple(v[start : start + size] for v in whole)
            rest = n - n % size
            kept, n = [tuple(v[rest:] for v in whole)], n % size
    if n:
        yield tuple(np.concatenate(v) for v in zip(*kept, strict=True))


class Paths:
    """Where rows of a chunk go in one tree. Down to ``MASKED`` levels each node compares all rows of the chunk at once, which is
    quicker than to look up every row's own node; rows then hold one bit per level."""

    def __init__(self, forest: Forest, tree: int, steps: int, slot_of: np.ndarray | None = None):
        self.forest, self.steps, self.masked, self.slot_of = forest, steps, min(steps, MASKED), slot_of
        rows = [np.array([tree])]
        for _ in range(self.masked):
            at = rows[-1]
            left = forest.left[at]
            rows.append(np.concatenate([left, np.where(left == at, at, left + 1)]))
        #: Nodes by the bits of the way to them.
        self.nodes = rows[-1]
        wanted = np.ones(len(self.nodes), bool)
        if slot_of is not None and steps == self.masked:
            self.slots_by_path = slot_of[self.nodes]
            wanted = self.slots_by_path >= 0
            self.code = np.where(wanted, self.slots_by_path + 1, 0).astype(np.uint8)
            self.code = np.concatenate([self.code, np.zeros(256 - len(self.code), np.uint8)]).tobytes()
        self.plan = self._plan(rows, wanted)

    def _plan(self, rows: list[np.ndarray], wanted: np.ndarray) -> list[tuple]:
        """Comparisons in the order in which a walk through the tree meets them: level, input, bin, and which of a node's children go on."""
        forest, need = self.forest, [wanted]
        for level in range(self.masked - 1, -1, -1):
            half = len(rows[level])
            need.append(need[-1][:half] | need[-1][half:])
        need.reverse()
        plan = []

        def visit(level: int, path: int) -> None:
            node = rows[level][path]
            if level == self.masked or forest.left[node] == node or not need[level][path]:
                return
            # Unwanted rows may get any bits below a node that no wanted row goes through.
            goes = [
                level + 1 < self.masked and need[level + 1][p] and forest.left[rows[level + 1][p]] != rows[level + 1][p]
                for p in (path, path + (1 << level))
            ]
            plan.append((level, forest.feature[node], forest.bin[node], *goes))
            if goes[0]:
                visit(level + 1, path)
            if goes[1]:
                visit(level + 1, path + (1 << level))

        visit(0, 0)
        return plan

    def bits(self, codes: np.ndarray) -> np.ndarray:
        n = codes.shape[1]
        bits = np.zeros((max(self.masked, 1), n), np.uint8)
        # Rows that reach the node at hand, per level, on its left and on its right.
        reach = [np.ones(n, np.uint8)]
        beyond = np.empty(n, bool)
        over = beyond.view(np.uint8)
        stack = [reach[0]]
        for level, feature, end, left, right in self.plan:
            mask = stack.pop()
            np.greater(codes[feature], end, out=beyond)
            if right or left:
                there = np.bitwise_and(over, mask)
                np.bitwise_or(bits[level], there, out=bits[level])
                if right:
                    stack.append(there)
                if left:
                    stack.append(np.bitwise_xor(mask, there))
            else:
                np.bitwise_and(over, mask, out=over)
                np.bitwise_or(bits[level], over, out=bits[level])
        path = bits[0]
        for level in range(1, self.masked):
            np.left_shift(bits[level], level, out=bits[level])
            np.bitwise_or(path, bits[level], out=path)
        return path

    def slots(self, codes: np.ndarray, start: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the chunk from ``start`` that have a weight and lie in numbered nodes, and those numbers."""
        path = self.bits(codes[:, start : start + len(weight)])
        if self.steps == self.masked:
            code = np.frombuffer(path.tobytes().translate(self.code), np.uint8)
            rows = np.flatnonzero((code != 0) & (weight != 0))
            slot = code.take(rows).astype(np.int64)
            slot -= 1
            return rows + start, slot
        rows = np.flatnonzero(weight)
        node = self.nodes.take(path.take(rows))
        rows += start
        slot = self.slot_of.take(self.forest.walk(codes, rows, node, self.steps - self.masked))
        kept = np.flatnonzero(slot >= 0)
        return rows.take(kept), slot.take(kept)

    def ends(self, codes: np.ndarray) -> np.ndarray:
        """The node of each row."""
        node, rest = self.nodes.take(self.bits(codes)), self.steps - self.masked
        return self.forest.walk(codes, np.arange(len(node)), node, rest) if rest else node


def best_splits(sums: np.ndarray, allowed: np.ndarray, leaf: float) -> tuple[np.ndarray, ...]:
    """Per node: input and bin of the split that lowers the squared error most (-1: none does), weight and sum of the
    node and of its left part. ``sums``: weights and outcomes by input, node and bin; ``allowed``: inputs by node."""
    weight, total = sums
    whole, whole_sum = weight[0].sum(1), total[0].sum(1)
    left, left_sum = weight[:, :, :-1].cumsum(2), total[:, :, :-1].cumsum(2)
    right = whole[:, None] - left
    valid = (left >= leaf) & (right >= leaf) & allowed[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        before = np.where(whole > 0, whole_sum**2 / whole, 0.0)
        gain = np.square(left_sum)
        gain /= left
        rest = whole_sum[:, None] - left_sum
        np.square(rest, out=rest)
        rest /= right
        gain += rest
        gain -= before[:, None]
    np.copyto(gain, -np.inf, where=~valid)
    # The best bin of each input first, then the first input that is best.
    width, nodes, ends = gain.shape
    every = np.arange(nodes)
    at = gain.reshape(width * nodes, ends).argmax(1).reshape(width, nodes)
    best = np.take_along_axis(gain, at[:, :, None], 2)[:, :, 0]
    feature = best.argmax(0)
    at = at[feature, every]
    good = best[feature, every] > 1e-12 * np.abs(before)
    return np.where(good, feature, -1), at, whole, whole_sum, left[feature, every, at], left_sum[feature, every, at]


def _level_splits(
    sums: DataFrame, parents: DataFrame | None, light: dict[tuple[int, int], np.ndarray], width: int, bins: int, leaf: float, level: int, seed: int,
    last: bool,
) -> DataFrame:
    """``SPLITS``: the best split of every open node, from its tree's sums of all tasks and those of its parent.

    Of two children of a node the one with less weight is summed, the other is the rest of their parent. ``light`` says per
    tree and part which of each pair that is: 0 or 1, or -1 if neither can be split. ``parents`` (``tree, part, sums``) are the
    sums of the nodes above. ``below`` has those of the nodes that are split, by part of the next level, but of the ``last`` none.
    """
    share = max(1, int(np.ceil(FEATURE_SHARE * width)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tree, part = (k.as_py() for k in key)
        own = light[tree, part]
        # Sums of whole numbers: a difference is as exact as a sum.
        found, above = np.zeros((2, 2, width, len(own), bins))
        for piece, parent in zip(table.column("sums"), table.column("parent").to_pylist(), strict=True):
            one = np.frombuffer(piece.as_buffer()).reshape(found.shape)
            np.add(above if parent else found, one, out=above if parent else found)
        if level:
            place = 2 * np.arange(len(own)) + np.maximum(own, 0)
            whole = np.empty((2, width, 2 * len(own), bins))
            whole[:, :, place], whole[:, :, place ^ 1] = found, above - found
            found = whole
        nodes = found.shape[2]
        order = np.random.default_rng([seed, level, tree, part]).random((width, nodes)).argsort(0).argsort(0)
        allowed = (order < share) & (np.repeat(own >= 0, 2) if level else True)
        feature, at, *amounts = best_splits(found, allowed, leaf)
        split = np.flatnonzero(feature >= 0)
        step = NODES_PER_PART // 2
        below = [] if last else [found[:, :, split[i : i + step]].tobytes() for i in range(0, len(split), step)]
        values = [feature.astype(np.int32), at.astype(np.int32), *amounts]
        arrays = [pa.array([tree], pa.int32()), pa.array([part], pa.int32()), *[pa.array([v]) for v in values], pa.array([below], pa.list_(pa.binary()))]
        return pa.table(arrays, ["tree", "part", "feature", "bin", "weight", "sum", "left_weight", "left_sum", "below"])

    every = sums.withColumn("parent", F.lit(False))
    if parents is not None:
        every = every.unionByName(parents.withColumn("parent", F.lit(True)))
    return every.groupBy("tree", "part").applyInArrow(run, SPLITS)


def fit_trees(rows: DataFrame, width: int, tasks: int, trees: int, depth: int, bins: int, leaf: int, seed: int) -> Forest:
    """A forest on rows with ``_features`` (arrays of ``width`` numbers), an outcome ``_y`` and a hash ``_draw``, dealt to ``tasks``.

    Each tree draws every row Poisson(1) times, rows of one hash together, and each node looks at ``FEATURE_SHARE`` of the inputs.
    """
    # Written once: bins are found and filled from it.
    table = staged(rows.coalesce(1) if tasks == 1 else rows.repartition(tasks), "forest-rows")
    edges, low, high = bin_edges(table, "_features", width, bins)
    blocks = staged(_blocks(table, edges, low, high), "forest-blocks")
    coded = code_type(edges)
    forest = Forest(trees, edges, np.zeros(trees, np.int64), np.full(trees, np.iinfo(coded).max, coded), np.arange(trees), np.zeros(trees), 0)
    frontier = {(tree, 0): np.array([tree]) for tree in range(trees)}
    light = {key: np.zeros(1, np.int8) for key in frontier}
    parents = None
    # Children's values come with the split, so the last level is never summed.
    for level in range(max(depth, 1)):
        last = level + 1 >= depth
        slot_of, open_nodes = _slots(forest, frontier, light)
        sums = _level_sums(blocks, forest, level, slot_of, open_nodes, bins, seed)
        splits = _level_splits(sums, parents, light, width, bins, leaf, level, seed, last)
        if not last:
            # Written once: the driver reads the splits, the next level the sums.
            splits = staged(splits, "forest-level")
            parents = splits.select("tree", "part", F.posexplode("below").alias("_at", "sums")).select(
                "tree", (F.col("part") * 2 + F.col("_at")).cast("int").alias("part"), "sums"
            )
        frontier, light = _grown(forest, frontier, splits.drop("below"), level, leaf, split=depth > 0)
        if not any((own >= 0).any() for own in light.values()):
            break
    forest.value = low + forest.value * ((high - low) / STEPS)
    return forest


def _slots(
    forest: Forest, frontier: dict[tuple[int, int], np.ndarray], light: dict[tuple[int, int], np.ndarray],
) -> tuple[np.ndarray, list[list[int]]]:
    """Per node the number of its pair within its tree if it is the lighter one, else -1; and the pairs by tree and part."""
    slot_of, open_nodes = np.full(len(forest.left), -1, np.int64), [[] for _ in range(forest.roots)]
    for tree, part in sorted(frontier):
        own, side, counts = frontier[tree, part], light[tree, part], open_nodes[tree]
        pairs = np.flatnonzero(side >= 0)
        slot_of[own[pairs if len(own) == len(side) else 2 * pairs + side[pairs]]] = sum(counts) + pairs
        counts += [0] * (part - len(counts)) + [len(side)]
    return slot_of, open_nodes


def _grown(
    forest: Forest, frontier: dict[tuple[int, int], np.ndarray], splits: DataFrame, level: int, leaf: float, split: bool,
) -> tuple[dict[tuple[int, int], np.ndarray], dict[tuple[int, int], np.ndarray]]:
    """Adds the children of every open node that was split, and returns them by tree and part, with the lighter one of each two."""
    found = splits.toArrow().sort_by([("tree", "ascending"), ("part", "ascending")])
    keys = list(zip(found.column("tree").to_pylist(), found.column("part").to_pylist(), strict=True))
    feature, at, weight, total, left_weight, left_sum = (
        found.column(c).combine_chunks().flatten().to_numpy() for c in ("feature", "bin", "weight", "sum", "left_weight", "left_sum")
    )
    nodes = np.concatenate([frontier[key] for key in keys]) if keys else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(keys)), [len(frontier[key]) for key in keys])
    if not level:
        # A tree that drew no row takes the mean of all others.
        forest.value[:] = total.sum() / weight.sum() if weight.sum() else 0.0
        forest.value[nodes] = np.where(weight > 0, total / np.maximum(weight, 1), forest.value[nodes])
    good = (feature >= 0) & split
    nodes, group, feature, at = nodes[good], group[good], feature[good], at[good]
    weight, total, left_weight, left_sum = weight[good], total[good], left_weight[good], left_sum[good]
    start, count = len(forest.left), 2 * len(nodes)
    children = start + 2 * np.arange(len(nodes))
    forest.feature[nodes], forest.bin[nodes], forest.left[nodes] = feature, at, children
    right_weight = weight - left_weight
    values = np.stack([left_sum / left_weight, (total - left_sum) / right_weight], 1).ravel()
    forest.feature = np.concatenate([forest.feature, np.zeros(count, np.int64)])
    forest.bin = np.concatenate([forest.bin, np.full(count, np.iinfo(forest.bin.dtype).max, forest.bin.dtype)])
    forest.left = np.concatenate([forest.left, np.arange(start, start + count)])
    forest.value = np.concatenate([forest.value, values])
    forest.depth = level + 1 if count else forest.depth
    # Two children of less than two leaves each are never split.
    side = np.where(np.maximum(left_weight, right_weight) < 2 * leaf, -1, left_weight > right_weight).astype(np.int8)
    below, light = {}, {}
    for i, (tree, part) in enumerate(keys):
        own, sides = children[group == i], side[group == i]
        for half, first in enumerate(range(0, len(own), NODES_PER_PART // 2)):
            some = slice(first, first + NODES_PER_PART // 2)
            below[tree, 2 * part + half] = np.stack([own[some], own[some] + 1], 1).ravel()
            light[tree, 2 * part + half] = sides[some]
    return below, light
