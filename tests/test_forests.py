"""Forests: splits by brute force, exact sums, the same forest from any number of tasks, quality next to Spark ML's, speed."""

import time

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from creekline.operators import forests as fo
from creekline.operators import models as M

SIZE = M.ForestSize(trees=20, depth=6)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 4))
    y = np.where(x[:, 0] > 0.3, 5.0, 0.0) + 2 * x[:, 1] + rng.normal(size=6000)
    data = [(f"s{i}", float(y[i]), *[float(v) for v in x[i]]) for i in range(6000)]
    df = spark.createDataFrame(data, "site string, _label double, a double, b double, c double, d double")
    table = df.select("site", "_label", F.array("a", "b", "c", "d").alias("_features"), F.col("_label").alias("_y"), F.xxhash64("site").alias("_draw"))
    return table.cache()


def test_a_split_is_the_best_of_all():
    rng = np.random.default_rng(0)
    weight = rng.integers(0, 9, (3, 5, 6)).astype(float)
    weight[1:] = [[rng.multinomial(int(weight[0, n].sum()), [1 / 6] * 6) for n in range(5)] for _ in range(2)]
    total = weight * rng.normal(size=weight.shape)
    total[1:] += (total[0].sum(1) - total[1:].sum(2))[:, :, None] / 6
    allowed = rng.random((3, 5)) < 0.7
    feature, at, whole, whole_sum, left, left_sum = fo.best_splits(np.stack([weight, total]), allowed, 8)
    for n in range(5):
        options = {}
        for i in range(3):
            for b in range(5):
                a, s = weight[i, n, : b + 1].sum(), total[i, n, : b + 1].sum()
                w, t = weight[i, n].sum(), total[i, n].sum()
                if allowed[i, n] and a >= 8 and w - a >= 8:
                    options[i, b] = s * s / a + (t - s) ** 2 / (w - a) - t * t / w
        if not options or max(options.values()) <= 1e-9:
            assert feature[n] == -1
        else:
            assert options[feature[n], at[n]] == pytest.approx(max(options.values()))
            assert left[n] == pytest.approx(weight[feature[n], n, : at[n] + 1].sum()) and left_sum[n] == pytest.approx(total[feature[n], n, : at[n] + 1].sum())


def test_the_number_of_tasks_does_not_change_a_forest(spark, rows, monkeypatch):
    monkeypatch.setattr(fo, "QUANTILE_ACCURACY", 1_000_000)
    one, many = (fo.fit_trees(rows.select("_features", "_y", "_draw"), 4, tasks, 6, 5, 32, 12, 42) for tasks in (1, 7))
    assert len(one.left) > 60 and all(np.array_equal(getattr(one, k), getattr(many, k)) for k in ("feature", "bin", "left"))
    assert np.abs(one.value - many.value).max() < 1e-12
    # Every leaf holds at least 12 drawn rows, and every tree draws its own.
    assert len({tuple(one.value[one.walk(np.zeros((4, 1), np.uint8), np.arange(1), t, 5)]) for t in range(6)}) == 6


def test_more_nodes_than_a_part_holds_and_depth_zero(spark, rows, monkeypatch):
    table = rows.select("_features", "_y", "_draw")
    whole = fo.fit_trees(table, 4, 1, 3, 5, 16, 5, 1)
    monkeypatch.setattr(fo, "NODES_PER_PART", 4)
    monkeypatch.setattr(fo, "FEATURE_SHARE", 1.0)
    parts = fo.fit_trees(table, 4, 1, 3, 5, 16, 5, 1)
    monkeypatch.setattr(fo, "NODES_PER_PART", 256)
    all_inputs = fo.fit_trees(table, 4, 1, 3, 5, 16, 5, 1)
    assert np.array_equal(parts.left, all_inputs.left) and np.array_equal(parts.feature, all_inputs.feature) and len(whole.left) > 60
    flat = fo.fit_trees(table, 4, 1, 3, 0, 16, 5, 1)
    mean = np.mean([r["_y"] for r in rows.collect()])
    assert flat.depth == 0 and flat.predict(np.zeros((2, 4))) == pytest.approx([mean] * 2, abs=0.2)


@pytest.mark.parametrize("kind", ["forest", "classifier"])
def test_quality_is_that_of_sparks_forest(spark, rows, kind):
    label = F.col("_label") if kind == "forest" else (F.col("_label") > 3).cast("double")
    held = F.pmod(F.xxhash64("site", F.lit(1)), F.lit(3)) == 0
    known = rows.withColumn(M.LABEL, label).withColumn(M.INPUTS, F.slice("_features", 2, 3)).withColumn("_level", F.col("_features")[0]).drop("_y", "_draw")
    train, test = known.filter(~held), known.filter(held)
    mine = M.forest_output(M.fit_forest(train, F.col(M.LABEL), 4000, kind, SIZE), test, "f")
    estimator = (M.forest_regressor if kind == "forest" else M.forest_classifier)(SIZE)
    vector = {"_features": array_to_vector("_features")}
    theirs = estimator.fit(train.withColumns(vector)).transform(test.withColumns(vector))
    got = mine.agg(F.avg((F.col("f") - F.col(M.LABEL)) ** 2)).first()[0]
    p = F.col("_prediction") if kind == "forest" else M.vector_to_array("_probability")[1]
    reference = theirs.agg(F.avg((p - F.col(M.LABEL)) ** 2)).first()[0]
    assert got < 1.05 * reference
    if kind == "classifier":
        assert all(0 <= r["f"] <= 1 for r in mine.collect())


def test_missing_numbers_go_right_and_constant_outcomes_stay(spark):
    rows = [(f"s{i}", 4.0, float("nan") if i % 3 else 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "site string, y double, a double").select("y", F.array("a").alias(M.INPUTS), F.lit(0.0).alias("_level"))
    model = M.fit_forest(df, F.col("y"), 100, "forest", SIZE)
    assert {r["f"] for r in M.forest_output(model, df, "f").collect()} == {4.0}
    with pytest.raises(ValueError):
        M.fit_forest(df.filter("y < 0"), F.col("y"), 0, "forest", SIZE)


def test_large_forests_take_one_round_of_tasks():
    assert M.forest_tasks(12, 3, 6_000_000) == 12 and M.forest_tasks(12, 3, 60_000_000) == 30 and M.forest_tasks(12, 36, 137_000) == 1


def test_a_task_sums_a_tree_level_in_time():
    """Walking and summing a row of a tree took Spark's forest about 400 ns a level (28.5 s: 60 trees, 137,173 rows, depth 8)."""

    class Blocks:
        def mapInArrow(self, run, schema):  # noqa: N802
            self.run = run
            return self

    import pyarrow as pa

    rng, own, width = np.random.default_rng(0), [], 21
    edges = [np.arange(31.0)] * width
    for _ in range(4):
        n = fo.BLOCK_ROWS
        arrays = (rng.integers(0, 32, (width, n)).astype(np.uint8), fo.ONE_ROW + np.rint(rng.random(n) * fo.STEPS), rng.integers(0, 1 << 62, n))
        own.append(pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], ["n", "codes", "packed", "draw"]))
    forest = fo.Forest(10, edges, np.zeros(10, np.int64), np.full(10, 255, np.uint8), np.arange(10), np.zeros(10), 0)
    blocks = Blocks()
    fo._level_sums(blocks, forest, 0, np.zeros(10, np.int64), np.ones(10, int), 32, 42)
    start = time.process_time()
    sums = [np.frombuffer(b.column("sums")[0].as_py()).reshape(2, width, 32) for b in blocks.run(iter(own))]
    taken = (time.process_time() - start) / (10 * 4 * fo.BLOCK_ROWS)
    assert taken < 400e-9
    # Sums are exact: every input counts the same rows and the same outcomes.
    for s in sums:
        assert np.array_equal(s.sum(2), np.repeat(s.sum(2)[:, :1], width, 1)) and abs(s[0, 0].sum() / (4 * fo.BLOCK_ROWS) - 1) < 0.03


def test_rows_go_the_same_way_by_comparisons_and_by_lookup(monkeypatch):
    """Levels where all rows are compared with a node, and deeper ones, lead each row to its node; leaves end early."""
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 8, (5, 700)).astype(np.uint8)
    feature, end, left = [0, 0], [255, 255], [0, 1]
    nodes = [0, 1]
    for _ in range(60):
        node = nodes.pop(rng.integers(len(nodes)))
        feature[node], end[node], left[node] = int(rng.integers(5)), int(rng.integers(7)), len(left)
        nodes += [len(left), len(left) + 1]
        left += [len(left), len(left) + 1]
        feature += [0, 0]
        end += [255, 255]
    forest = fo.Forest(2, [np.arange(7.0)] * 5, np.array(feature), np.array(end, np.uint8), np.array(left), np.zeros(len(left)), 9)
    weight = rng.integers(0, 3, 700).astype(np.uint8)
    slot_of = np.where(rng.random(len(left)) < 0.5, np.arange(len(left)), -1)
    for masked in (1, 3, 6, 9):
        monkeypatch.setattr(fo, "MASKED", min(masked, 8))
        for tree in range(2):
            for steps in (0, 1, 4, 9):
                want = forest.walk(codes, np.arange(700), tree, steps)
                assert np.array_equal(fo.Paths(forest, tree, steps).ends(codes), want)
                if steps and len(left) < 255:
                    rows, slot = fo.Paths(forest, tree, steps, slot_of).slots(codes, 0, weight)
                    kept = np.flatnonzero((slot_of[want] >= 0) & (weight > 0))
                    assert np.array_equal(rows, kept) and np.array_equal(slot, slot_of[want[kept]])


def test_only_one_of_two_children_is_summed(spark, rows, monkeypatch):
    """The other's sums are the parent's without them: about half of a level's rows are counted, and the forest is the
    one of sums over every open node."""
    counted, inner = [], fo._level_sums

    def spy(blocks, forest, level, slot_of, open_nodes, bins, seed):
        sums = inner(blocks, forest, level, slot_of, open_nodes, bins, seed)
        pairs = sum(map(sum, open_nodes))
        counted.append((pairs, sum(np.frombuffer(r["sums"]).reshape(2, 4, -1)[0, 0].sum() for r in sums.collect())))
        return sums

    monkeypatch.setattr(fo, "_level_sums", spy)
    forest = fo.fit_trees(rows.select("_features", "_y", "_draw"), 4, 2, 4, 4, 32, 12, 42)
    # Outcome and weight of every node, found by walking all rows down once more.
    data = rows.select("_features", "_y", "_draw").collect()
    x, y, draw = (np.array([r[i] for r in data]) for i in range(3))
    factors, times = fo._draws(42, 4)
    codes = fo.binned(x, forest.edges)
    for tree in range(4):
        weight = times[((draw.view(np.uint64) * factors[tree]) >> np.uint64(48)).astype(np.int64)].astype(float)
        node = forest.walk(codes, np.arange(len(y)), tree, 4)
        for one in np.unique(node[weight > 0]):
            mine = node == one
            assert forest.value[one] == pytest.approx(np.average(y[mine], weights=weight[mine]), abs=1e-3)
    assert counted[0][0] == 4 and all(n <= 0.5 * counted[0][1] for _, n in counted[1:])


def test_inputs_with_few_bins_share_a_number():
    assert fo.bundles([32, 2, 2, 32, 3], 256) == [[1, 2, 4], [0], [3]]
    assert fo.bundles([32, 32, 32], 1024) == [[0, 1], [2]] and fo.bundles([300, 2], 256) == [[1], [0]]
