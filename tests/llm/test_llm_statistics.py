"""Filter audit, quality from positive and unlabelled texts, and whitening."""

import random
from itertools import permutations

import numpy as np
import pytest

from creekline.llm import filter_audit, quality_classifier, whitening

LONG = " ".join(f"w{i}" for i in range(20_000))
PLAIN = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    None, "", " \t\n", "A B C", PLAIN, PLAIN + " #", PLAIN.upper(), "same " * 80, "same " * 80 + "#", LONG, LONG + " |",
    "\x0bx\x0c" * 30, "ÄÖ " * 60, "AB" * 40 + " " + PLAIN, "a\xa0b " * 70, PLAIN + " &",
]


def failing(text):
    words = [w for w in text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    found = "A" if len(words) < 50 else ""
    found += "B" if 100 * len(set(words)) < 65 * len(words) else ""
    found += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else ""
    return found + ("D" if any(c in "#$%&*|" for c in text) else "")


def brute_audit(documents, labels):
    docs = [(i, t or "", s or "") for i, t, s in documents]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    judged = []
    for i, t, s in docs:
        copy = i is not None and any(j is not None and j < i and u == t for j, u, _ in docs)
        judged.append((s, failing(t) + ("E" if copy else ""), i in good, i in toxic))
    out = {}
    for part in {s for s, *_ in judged}:
        own = [x for x in judged if x[0] == part]
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                redundant = sum(f in x[1] for x in own) - len(gone)
                steps.append((order, k + 1, f, len(left), len(gone), redundant, sum(x[1] == f for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)))
        for order, k, f, *counts in steps:
            out[part, order, k] = (*counts, shapley[f])
    return out


def audit_rows(frame):
    return {(r[0], r[1], r[2]): tuple(r)[3:] for r in frame.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()}


@pytest.fixture(scope="module")
def audited(spark):
    draw = random.Random(4)
    documents = [(i, draw.choice(TEXTS), draw.choice(["a", "b", None, ""])) for i in range(150)]
    documents += [(None, PLAIN, "a"), (None, PLAIN, "c"), (7, documents[7][1], "a"), (7, PLAIN, "a"), (-5, "same " * 80, None)]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 170, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, 2) for d in documents], "doc_id bigint, text string, source string, n int, part int").repartition(5)
    return documents, labels, frame, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_every_order_of_filters_equals_running_it(audited):
    documents, labels, frame, marks = audited
    got = filter_audit.audit_filters(frame, marks, "doc_id", "text", "source", "quality", "toxic")
    assert audit_rows(got) == brute_audit(documents, labels)


def test_audit_sql_says_the_same(audited, tmp_path):
    import duckdb

    documents, labels, frame, marks = audited
    con = duckdb.connect()
    for name, table in (("documents", frame), ("labels", marks)):
        table.write.parquet(str(tmp_path / name))
        con.execute(f"create view {name} as select * from '{tmp_path / name}/*.parquet'")
    wanted = con.execute(filter_audit.audit_sql()).df()
    got = filter_audit.audit_filters(frame, marks, "doc_id", "text", "source", "quality", "toxic").toPandas()
    columns = sorted(got.columns)
    assert sorted(wanted.columns) == columns
    assert got[columns].sort_values(columns).reset_index(drop=True).equals(wanted[columns].sort_values(columns).reset_index(drop=True).astype(got[columns].dtypes))


def test_audit_of_nothing(audited):
    _, _, frame, marks = audited
    for docs, labels in ((frame.limit(0), marks), (frame.limit(0), marks.limit(0))):
        assert filter_audit.audit_filters(docs, labels, "doc_id", "text", "source", "quality", "toxic").count() == 0
    got = filter_audit.audit_filters(frame, marks.limit(0), "doc_id", "text", "source", "quality", "toxic")
    assert got.filter("good_lost + toxic_lost > 0").count() == 0 and got.count() == 4 * 600


@pytest.mark.parametrize("n", [1, 2, 4, 5])
def test_paths_of_the_lattice(n):
    letters = "ABCDE"[:n]
    edges = filter_audit.lattice(n)
    listed = filter_audit.orders_through(letters)
    assert {(e.state, e.index): e.paths for e in edges} == {k: len(v) for k, v in listed.items()}
    assert len(edges) == n * 2 ** (n - 1)
    assert sum(e.paths for e in edges if e.state == 0) == len(list(permutations(letters)))


def quality_texts(n, seed):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(600)]
    rows = []
    for i in range(n):
        text = " ".join(draw.choice(words) for _ in range(draw.randint(40, 150)))
        kind = draw.random()
        if kind < 0.1:
            text += "\n" + " ".join(draw.choice(words).upper() + "!!" for _ in range(60))
        elif kind < 0.2:
            text += "\n" + (draw.choice(words) + " ") * 60
        elif kind < 0.3:
            text = " | ".join(text.split())
        rows.append((i, text, int(kind >= 0.3)))
    return rows


def test_quality_is_learnt_from_good_texts_alone(spark):
    rows = quality_texts(2000, 8)
    odd = [(5000, None, None), (5001, "", None), (5002, LONG, None), (None, rows[0][1], None), (5003, "\n \t", None)]
    frame = spark.createDataFrame([(*r, "x", 0.0) for r in rows + odd], "doc_id bigint, text string, mark int, _text string, _draw double").repartition(4)
    trusted = spark.createDataFrame([(i,) for i, _, good in rows if good and i % 4] + [(None,), (1,), (9999,)], "doc_id bigint")
    scorer = quality_classifier.fit_scorer(frame, trusted, "doc_id", "text")
    assert scorer.prior == pytest.approx(0.7, abs=0.07)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.with_quality(frame, "text", scorer).collect()}
    assert len(got) == len(rows) + len(odd) and all(0 <= s <= 1 for s in got.values())
    held = [(got[i] >= 0.7) == bool(good) for i, _, good in rows if i % 4 == 0]
    assert np.mean(held) >= 0.95
    assert got[5000] == got[5001]
    again = quality_classifier.fit_scorer(frame.repartition(2), trusted, "doc_id", "text", fit_rows=500)
    assert 0.4 < again.prior < 0.95
    assert quality_classifier.with_quality(frame.limit(0), "text", scorer).count() == 0


def test_quality_without_marks_or_texts(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint")
    for docs, trusted in ((frame, none), (frame.limit(0), none), (frame.limit(0), frame.select("doc_id"))):
        scorer = quality_classifier.fit_scorer(docs, trusted, "doc_id", "text")
        assert [r["score"] for r in quality_classifier.with_quality(frame, "text", scorer).collect()] == [0.5, 0.5]
    one = quality_classifier.fit_scorer(frame, frame.select("doc_id"), "doc_id", "text")
    assert quality_classifier.with_quality(frame, "text", one).filter("score between 0 and 1").count() == 2


def test_prior_of_a_known_mix():
    draw = np.random.default_rng(3)
    for prior in (0.2, 0.5, 0.85):
        good, bad = np.clip(draw.normal(700, 120, 20_000), 0, 999), np.clip(draw.normal(250, 90, 20_000), 0, 999)
        mixed = np.concatenate([good[: int(10_000 * prior)], bad[: 10_000 - int(10_000 * prior)]])
        counts = [np.bincount(x.astype(int), minlength=1000) for x in (good[10_000:], mixed)]
        assert quality_classifier.class_prior(*counts) == pytest.approx(prior, abs=0.04)


def test_risk_for_bad_texts_is_not_driven_below_nothing():
    draw = np.random.default_rng(9)
    scorer = quality_classifier.Scorer([np.arange(1.0, 200)], np.zeros(200))
    slots = draw.integers(0, 200, (300, 1))
    trusted = np.arange(300) < 100
    for turn in range(30):
        scorer = quality_classifier.train(scorer, slots, trusted, 0.6, turn)
    good, mixed = (scorer.scores(slots[m]) for m in (trusted, ~trusted))
    assert -np.log1p(-mixed).mean() + 0.6 * np.log1p(-good).mean() > -0.15


def brute_whitening(vectors, most=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums) / n
    values, turned = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    order = [k for k in order if values[k] > 1e-12 * values.sum()]
    deviation = [sum(int(e) ** 2 for e in row) for row in n * x - sums]
    return n, deviation, values[order], values.sum(), centred @ turned[:, order] / np.sqrt(values[order])


@pytest.mark.parametrize("d, scales", [(48, None), (5, [4, 2, 1, 0.5, 0]), (40, "close")])
def test_whitening_equals_a_dense_solver(spark, d, scales):
    draw = np.random.default_rng(d)
    scale = draw.uniform(0.1, 3, d) if scales is None else np.full(d, 1.0) if scales == "close" else np.array(scales)
    mix = np.linalg.qr(draw.normal(size=(d, d)))[0] if scales is None else np.eye(d)
    vectors = ((draw.normal(size=(700, d)) * scale) @ mix).tolist()
    rows = [(i, v, 1, 2.0) for i, v in enumerate(vectors)] + [(3, vectors[3], 1, 2.0), (None, vectors[5], 1, 2.0)]
    odd = [(900, None), (901, [0.5] * (d - 1) + [None]), (902, [float("nan")] * d), (903, [float("-inf")] + [0.0] * (d - 1)), (904, []), (905, [1.0])]
    frame = spark.createDataFrame(rows + [(*o, 1, 2.0) for o in odd], "vec_id bigint, embedding array<double>, key int, whitened double").repartition(4)
    got = whitening.whiten(frame, "vec_id", "embedding").toPandas()
    n, deviation, values, trace, white = brute_whitening([r[1] for r in rows])
    m = len(values)
    assert m == min(32, d - (scales == [4, 2, 1, 0.5, 0])) and len(got) == n * m and set(got["n"]) == {n}
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    explained = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(explained, values / trace, rtol=1e-10)
    key = got["vec_id"].fillna(-1).astype(int)
    own = {}
    for i, c, v, dev in zip(key, got["component"], got["whitened"], got["deviation"], strict=True):
        own.setdefault((i, c), []).append((v, dev))
    signs = [np.sign(own[0, c + 1][0][0] * white[0, c]) for c in range(m)]
    tight = 1e-8 if scales != "close" else 1e-6
    for at, (i, *_) in enumerate(rows):
        i = -1 if i is None else i
        for c in range(m):
            found = own[i, c + 1]
            assert len(found) == (2 if i == 3 else 1)
            assert all(dev == deviation[at] and abs(v - signs[c] * white[at, c]) < tight for v, dev in found)


def test_whitening_of_little(spark):
    kind = "vec_id bigint, embedding array<float>"
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, kind), "vec_id", "embedding")
    assert make([]).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert make([]).count() == make([(1, [1.0, 2.0])]).count() == make([(1, [1.0, 2.0])] * 9).count() == make([(1, None)]).count() == 0
    pair = make([(1, [0.0, 0.0]), (2, [1.0, 1.0])]).collect()
    assert sorted(round(r["whitened"], 12) for r in pair) == [-1, 1] and {r["deviation"] for r in pair} == {2 * 64**2}


def test_intervals_and_inertia():
    draw = np.random.default_rng(12)
    turn = np.linalg.qr(draw.normal(size=(90, 90)))[0]
    values = np.concatenate([np.repeat([50.0, 20.0], 12), draw.uniform(0.001, 10, 66)])
    matrix = (turn * values) @ turn.T
    assert [whitening.above(matrix, s, 50) for s in (60, 30, 15, 0)] == [0, 12, 24, 90]
    cuts = whitening.intervals(matrix, 32)
    assert sum(c for *_, c in cuts) >= 32
    found = np.sort(np.concatenate([whitening.eigenpairs_within(matrix, *c)[0] for c in cuts]))[::-1]
    assert np.allclose(found[:32], np.sort(values)[::-1][:32], rtol=1e-12)


def test_deviation_beyond_a_long():
    x = np.array([[2**40, 0], [0, 5]])
    z = whitening._deviation(x, 2**30, np.array([1, 1]))
    assert whitening._squares(z)[0] is None
    assert whitening._squares(whitening._deviation(x[1:], 3, np.array([1, 1]))) == [1 + 14**2]
