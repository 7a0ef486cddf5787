"""Fitted operators: held-out accuracy, recall against brute force, and odd input."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from creekline.llm import nearest, toxicity, url_filters

RULES = [
    url_filters.Rule("net/", "block"), url_filters.Rule("example.net/en/", "allow"),
    url_filters.Rule("example.com/de/", "block"), url_filters.Rule("org/fr/", "allow"),
]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for rule in RULES:
        name, _, tail = rule.text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule.text) > len(best.text)):
            best = rule
    return host, path, best


@pytest.fixture(scope="module")
def urls():
    draw = random.Random(1)
    out = [f"https://{draw.choice(['www.', '', 'm.'])}{draw.choice(['good', 'bad', 'fine'])}{i}.{draw.choice(['net', 'org', 'com'])}/{draw.choice(['en', 'de', 'fr'])}/{i}?q=1" for i in range(400)]
    out += [f"http://spam{i}.net/buy/{i}" for i in range(100)] + [f"http://news{i}.org/fr/{i}" for i in range(100)]
    odd = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x", "http://example.net/en/", "http://example.net", "http://notexample.com/de/", "http://x.example.com/de/a#b", "x://É.net/ä?/", "a://b://c.net/x", "http://net/", "ftp://org/fr/" + "z" * 5000]
    return [(i, u, "k", 1.0) for i, u in enumerate(out + odd + odd[3:5])] + [(None, out[0], None, None)]


def test_urls_by_rule_and_by_model(spark, urls):
    kind = "page_id bigint, url string, _key string, score double"
    df = spark.createDataFrame(urls, kind).repartition(3)
    got = url_filters.filter_urls(df, "page_id", "url", RULES).collect()
    assert len(got) == len(urls)
    by_id = {r["page_id"]: r for r in got}
    for i, url, *_ in urls:
        host, path, rule = brute_rule(url)
        r = by_id[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.text if rule else None), url
        assert r["verdict"] in ("allow", "block") and (rule is None or r["verdict"] == rule.verdict)
    assert url_filters.filter_urls(df.limit(0), "page_id", "url", RULES).count() == 0


def test_language_model_ratio_tells_styles_apart(spark):
    draw = random.Random(2)
    make = lambda bad, i: f"http://{'casino-win' if bad else 'library'}{i}.com/{'bonus' if bad else 'books'}/{draw.randint(1, 999)}"
    rows = [(make(i % 2, i), i % 2) for i in range(400)]
    model = url_filters.fit_models(spark.createDataFrame(rows, "_url string, _class int"))
    test = [make(i % 2, i) for i in range(1000, 1100)]
    assert ((url_filters.ratio(model, test) > 0) == (np.arange(100) % 2 == 1)).all()
    assert model[0, 1, 0].sum() == sum(len(u.encode()) + 1 for u, c in rows if c == 0)
    slope, offset = url_filters.calibrate([(0.5, 1, 30), (-0.5, 0, 300), (0.1, 0, 2)])
    assert slope > 0 and np.isfinite(offset)
    assert np.isfinite(url_filters.calibrate([])).all()


def test_toxicity_on_held_out_texts(spark):
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(800)]
    rows, labels = [], []
    for i in range(900):
        text = [draw.choice(words) for _ in range(draw.randint(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                text.insert(draw.randrange(len(text)), draw.choice(["vilexen", "Vilexes,", "grubbish", "grubbing!"]))
        rows.append((i, " ".join(text), "x", 0.0))
        if zlib.crc32(str(i).encode()) % 5:
            labels.append((i, int(toxic)))
    rows += [(1000, None, "x", 0.0), (1001, "", "x", 0.0), (None, "words", "x", 0.0), (1002, "long " * 30_000 + "vilexen grubbish", "x", 0.0)]
    labels += [(None, 1), (5000, 0), (1001, None), (1, 0)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, _text string, _label double").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    machine = toxicity.fit_machine(documents.select("doc_id", "text"), marks, "doc_id", "text", "toxic")
    got = {r["doc_id"]: r["score"] for r in toxicity.with_scores(documents, "text", machine).collect()}
    assert len(got) == len(rows) and all(0 <= v <= 1 for v in got.values())
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [(got[i] >= 0.5) == (i % 6 == 0) for i in held]
    assert np.mean(right) >= 0.98
    assert got[1000] == got[1001] < 0.5 <= got[1002]


def test_machine_learns_a_pair_that_no_sum_of_weights_can():
    a, b = 11, 12
    texts = [np.array(x, np.int32) for x in ([a], [b], [a, b], [7], [a, 7], [b, 7], [a, b, 7]) * 60]
    labels = np.array([1, 1, 0, 0, 1, 1, 0] * 60, np.float32)
    machine = toxicity.Machine.fresh()
    for turn in range(12):
        machine = toxicity.train(machine, texts, labels, turn)
    assert ((toxicity.raw_scores(machine, texts) > 0) == (labels == 1)).mean() > 0.99


def test_a_pair_counts_in_long_texts_as_it_was_learnt(spark):
    draw = random.Random(21)
    words = ["".join(draw.choice("klmnopqrst") for _ in range(7)) for _ in range(5000)]
    # Either word alone is mostly toxic and both together never are: only a pair term can tell.
    kinds = [(["vilexen"], 1), (["grubbish"], 1), (["vilexen", "grubbish"], 0), ([], 0), ([], 0), ([], 0)]
    rows = []
    for i in range(960):
        own, toxic = kinds[i % 6]
        text = [draw.choice(words) for _ in range(500)]
        for word in own:
            text.insert(draw.randrange(len(text)), word)
        rows.append((i, " ".join(text), toxic))
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(3)
    labels = documents.filter("doc_id % 4 > 0").select("doc_id", "toxic")
    machine = toxicity.fit_machine(documents.select("doc_id", "text"), labels, "doc_id", "text", "toxic")
    held = toxicity.with_scores(documents.filter("doc_id % 4 = 0"), "text", machine).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in held]) > 0.97


def test_toxicity_without_labels_scores_all(spark):
    documents = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    machine = toxicity.fit_machine(documents, none, "doc_id", "text", "toxic")
    assert toxicity.with_scores(documents, "text", machine).filter("score between 0 and 1").count() == 2
    assert toxicity.with_scores(documents.limit(0), "text", machine).count() == 0


def test_nearest_recall_and_odd_vectors(spark):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(20, 16))
    vectors = [(centres[i % 20] + 0.6 * draw.normal(size=16)).astype(float).tolist() for i in range(1500)]
    rows = [(i, v, 1, b"x") for i, v in enumerate(vectors)]
    rows += [(2000 + i, vectors[50], 1, b"x") for i in range(200)]  # one very common vector
    rows += [(3000, None, 1, None), (3050, [0.0] * 16, 1, None), (3100, [float("nan")] * 16, 1, None), (3150, [1.0] * 15 + [None], 1, None), (3200, [1.0, 2.0], 1, None), (None, vectors[0], 1, None), (3250, [1e200] * 16, 1, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, _v binary").repartition(4)
    got = {}
    for r in nearest.nearest(df, "vec_id", "embedding", lambda x: F.pmod(x, F.lit(50)) == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    valid = {i: np.array(v) for i, v, *_ in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.array(sorted(valid))
    x = np.stack([valid[i] / np.abs(valid[i]).max() for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    hit = total = 0
    for q, found in got.items():
        near = x @ x[np.searchsorted(ids, q)]
        near[ids == q] = -2
        best = [int(ids[i]) for i in np.lexsort((ids, -np.round(near, 12)))[:5]]
        found.sort()
        assert [r for r, *_ in found] == [1, 2, 3, 4, 5] and q not in [v for _, v, _ in found]
        hit += len(set(best) & {v for _, v, _ in found})
        total += 5
        if q != 3250:
            for _, v, s in found:
                assert s == pytest.approx(near[np.searchsorted(ids, v)], abs=1e-12)
    assert hit / total >= 0.9
    assert [v for _, v, _ in sorted(got[2050])] == [50, 2000, 2001, 2002, 2003]
    assert nearest.nearest(df.limit(0), "vec_id", "embedding", lambda x: x == 0).count() == 0
    few = nearest.nearest(df.filter("vec_id in (50, 51, 52)"), "vec_id", "embedding", lambda x: x == 50).collect()
    assert [r["rank"] for r in few] == [1, 2]


def test_tied_vectors_come_by_their_ids(spark):
    # All multiples of one vector by powers of two: every cosine is the same double.
    base = np.random.default_rng(8).normal(size=16)
    rows = [(i, (base * 2.0 ** (i % 60 - 30)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    got = nearest.nearest(df, "vec_id", "embedding", lambda x: F.pmod(x, F.lit(50)) == 0).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == {q: [i for i in range(6) if i != q][:5] for q in range(0, 400, 50)}


def test_parts_are_balanced():
    draw = np.random.default_rng(6)
    unit = nearest._unit(draw.normal(size=(600, 8)))
    graph = nearest.neighbour_graph(unit, 10)
    part = nearest.balanced_parts(graph, unit, 6)
    assert np.bincount(part).max() <= 1.1 * 100 + 1
    inside = (part[graph] == part[:, None]).mean()
    assert inside > 1.5 / 6
