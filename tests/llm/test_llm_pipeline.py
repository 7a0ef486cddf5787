"""The pipeline's stages on a small corpus, and the entry point's registration."""

import random
from collections import Counter

import pytest


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw = random.Random(9)
    words = ["".join(draw.choice("abcdefghijk") for _ in range(6)) for _ in range(2000)]
    rows, labels = [], []
    for i in range(240):
        text = [draw.choice(words) for _ in range(draw.randint(40, 120))]
        if i % 8 == 0:
            text[3:3] = ["vilexen", "grubbish", "vilexes"]
            labels.append((i, 1, 1))
        else:
            labels.append((i, 1, 0))
        if i % 9 == 1:
            text.append("mail me@example.org")
        rows.append((i, " ".join(text), "en", f"s{i % 4}", len(" ".join(text))))
    copy = rows[1]
    rows += [(300, copy[1], "en", "s1", copy[4]), (301, copy[1] + " tail", "en", "s1", copy[4] + 5), (302, None, None, None, None), (None, "", "en", "s0", 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages_one_after_another(spark, corpus, tmp_path):
    import corpus_pipeline

    folder, rows = corpus
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    ids = {name: Counter(r["doc_id"] for r in got) for name, got in seen.items()}
    assert not any(i % 8 == 0 for i in ids["toxicity"] if i is not None and i < 240)
    assert all(ids["toxicity"][i] for i in range(240) if i % 8)
    after = ids["simhash_dedup"]
    assert after[1] == 1 and not after[300] and not after[301] and all(after[i] == 1 for i in range(240) if i % 8)
    assert not any("@" in (r["text"] or "") for r in seen["personal_data"])
    assert all(r["n_chars"] == len(r["text"]) for r in seen["personal_data"] if r["text"] is not None)
    assert set(ids["mixing"]) <= set(ids["personal_data"])
    assert {r["doc_id"] for r in seen["packing"]} == {r["doc_id"] for r in seen["mixing"]}


def test_run_equals_its_stages(spark, corpus):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, corpus[0])
    assert set(out.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} and out.count() > 0


def test_entry_point_has_the_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 11)} <= {n.split("_")[0] + "_" for n in names}


CLASHING = ["_toxicity", "toxicity", "_own_hash", "_kept_key", "_row", "_found", "_base", "_key", "_text", "_hash", "_mix_s", "_mix_w", "given_1", "n", "h"]


def test_stages_take_clashing_columns_and_empty_tables(spark, corpus):
    import corpus_pipeline
    from pyspark.sql import functions as F

    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce("source", F.lit("none"))) for c in CLASHING})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert rows and all(r[c] == f"{c}:{'none' if r['source'] is None else r['source']}" for r in rows for c in CLASHING), name
        nothing = stage(spark, docs.limit(0), folder)
        assert nothing.columns == docs.columns and nothing.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
