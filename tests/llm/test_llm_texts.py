"""Operators on texts against brute force on small fixtures, with nulls, ties, long and empty texts."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from creekline.llm import common, mixing, packing, personal_data, quality_rules, simhash, substring_dedup, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, _key string, _text int"


@pytest.fixture(scope="module")
def texts():
    """Plain, odd, repeated, empty, null and long texts; ids hold a null and a repeat."""
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abcdeéßñ") for _ in range(draw.randint(2, 8))) for _ in range(300)]
    prose = [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(3, 300))) for _ in range(30)]
    passage = " ".join(draw.choice(vocabulary) for _ in range(80))
    near = prose[3].split()
    near[2:4] = ["changed", "words"]
    odd = [
        None, "", "   \n\t ", "one", "don't <|endoftext|> STOP <|ENDOFTEXT|> it's", "naïve\u00a0café\u2003x\x1cy Ångström e\u0301",
        "日本語 テスト 漢字", "😀 emoji's 12 34.5 __x__", "a" * 3000, "0" * 2500 + " 1", "word " * 9000,
        prose[0], prose[0], " ".join(near), passage + " tail one", "head two " + passage, "line\nline\n\nline\nx y z w v\n" * 4,
        "\n".join(["Same line here"] * 3), "## ** $$ %% && || << >> " * 5,
    ]
    rows = [(i, t, f"s{i % 3}", "k", 7) for i, t in enumerate(prose + odd)]
    rows += [(None, "no id here but words enough to count for the rules", None, None, None), (2, prose[2], "s2", "k", 7)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(rows):
    return sorted((tuple(-1 if v is None else v for v in r) for r in rows), key=str)


def test_token_counts_equal_the_library(docs, empty, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    got = token_counts.count_tokens(docs, "doc_id", "text", PATH, 2048).collect()
    want = []
    for i, text, *_ in texts:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((i, len((text or "").encode()), n, n > 2048))
    assert by_id(got) == by_id(want)
    assert token_counts.count_tokens(empty, "doc_id", "text", PATH, 2048).count() == 0


def test_chunk_cache_may_be_emptied_at_any_time():
    tokenizer = common.ChunkTokenizer(PATH)
    cache = common._Cache(lambda x: len(tokenizer.encode_chunk(x)), 2, {"the": 1})
    words = "the quick brown fox jumps over the lazy dog".split() * 3
    assert [cache[w] for w in words] == [len(tokenizer.encode_whole(w)) for w in words]


def test_other_tokenizers_are_asked_for_whole_texts(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = token_counts.count_tokens(docs.filter("doc_id < 5"), "doc_id", "text", path, 10).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.filter("doc_id < 5").collect()}
    assert all(r["n_tokens"] == len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids) for r in got)


def base_features(text):
    words, lines = WORDS.findall(text), [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_base_features_and_verdicts(docs, empty, texts):
    got = quality_rules.judge_quality(docs, "doc_id", "text").collect()
    want = []
    for i, text, *_ in texts:
        n, chars, symbols, lines, repeats = base_features(text or "")
        want.append((i, n, chars, symbols, lines, repeats, n < 10 or 100 * repeats > 20 * n))
    assert by_id([tuple(r)[:7] for r in got]) == by_id(want)
    assert not any(r["kept"] for r in got if r["base_failed"])
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] for i, t, *_ in texts if i is not None and i < 30 and len(t.split()) >= 40)
    assert quality_rules.judge_quality(empty, "doc_id", "text").count() == 0


def test_estimation_equals_plain_python(spark):
    names = ["v_a", "v_b", "v_c"]
    draw = random.Random(2)
    rows = []
    for _ in range(600):
        good = draw.random() < 0.8
        rows.append(tuple(0 if draw.random() < 0.3 else (1 if good == (draw.random() < q) else -1) for q in (0.9, 0.8, 0.7)))
    found = quality_rules.estimate(spark.createDataFrame(rows, "v_a tinyint, v_b tinyint, v_c tinyint"), names)
    evidence, odds = [list(quality_rules.START) for _ in names], np.log(4.0)
    for _ in range(quality_rules.ROUNDS):
        g = np.array([1 / (1 + np.exp(-(odds + sum(e[v + 1] for e, v in zip(evidence, row))))) for row in rows])
        new = []
        for j in range(3):
            v = np.array([r[j] for r in rows])

            def rate(k):
                return np.log((g[v == k].sum() + 1) / (g.sum() + 3)) - np.log(((1 - g)[v == k].sum() + 1) / ((1 - g).sum() + 3))

            new.append([min(rate(-1), -quality_rules.LEAST), 0.0, max(rate(1), 0.0)])
        p = min(quality_rules.PRIOR_MOST, max(quality_rules.PRIOR_LEAST, (g.sum() + 1) / (len(g) + 2)))
        evidence, odds = new, np.log(p / (1 - p))
    assert [found.evidence[n] for n in names] == [pytest.approx(e) for e in evidence]
    assert found.odds == pytest.approx(odds)
    assert -found.evidence["v_a"][0] > -found.evidence["v_c"][0]


def brute_removed(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("part", [substring_dedup.PART, 700])
def test_substrings_equal_brute_force(docs, empty, texts, monkeypatch, part):
    want = brute_removed([r[1] for r in texts], 200)
    monkeypatch.setattr(substring_dedup, "PART", part)
    got = substring_dedup.remove_repeats(docs, "doc_id", "text").collect()
    assert by_id(got) == by_id([(r[0], *w) for r, w in zip(texts, want)])
    assert substring_dedup.remove_repeats(empty, "doc_id", "text").count() == 0


def test_splitters_keep_what_the_bucket_before_tells(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET", 10)
    # A single one first, so that many a splitter is the second of its pair.
    rows = [(-1, 0, 999, 0, 3)] + [(i // 2, i // 2, 1000 + i, 0, 3) for i in range(200)]
    kind = substring_dedup.RECORD
    table = spark.createDataFrame(rows, kind).repartition(2)
    dealer = substring_dedup.Dealer(table, len(rows))
    assert dealer.size == 21
    dealt = table.mapInPandas(
        lambda frames: (f.assign(_bucket=dealer.buckets(*(f[c].to_numpy(np.int64) for c in substring_dedup.COLUMNS[:4]))) for f in frames),
        f"{kind}, _bucket int",
    )
    got = substring_dedup.sorted_neighbours(dealt, dealer).collect()
    assert {r["_doc"] for r in got if r["_n"] == 3 and r["_flags"] & 10} == {r[2] for r in rows[1:]}


def test_pairs_across_splitters_equal_brute_force(spark, monkeypatch):
    draw = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz "

    def prose(n):
        return "".join(draw.choice(letters) for _ in range(n))

    passages = [prose(draw.randint(210, 500)) for _ in range(60)]
    texts = [prose(150) + p + prose(150) for p in passages for _ in range(2)]
    # Some share leading bytes only, so that windows are sorted too.
    texts += [prose(60) + passages[i][:260] + prose(90) for i in range(0, 60, 3)]
    monkeypatch.setattr(substring_dedup, "BUCKET", 60)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.remove_repeats(rows, "doc_id", "text").collect()}
    assert got == dict(enumerate(brute_removed(texts, 200)))


def test_stretches_over_small_parts_hold_the_same_windows(monkeypatch):
    raw = np.frombuffer((b"abcd" * 300 + bytes(range(32, 120)) * 9), np.uint8)
    for part in (64, 1000, 1 << 20):
        monkeypatch.setattr(substring_dedup, "PART", part)
        places = [i for _, _, first, n, _ in substring_dedup.stretches(raw, 200) for s, k in zip(first, n) for i in range(s, s + k)]
        assert places == list(range(len(raw) - 199))


def test_multikey_order_is_lexicographic():
    draw = np.random.default_rng(0)
    columns = [draw.integers(0, 4, 500) for _ in range(4)]
    order = substring_dedup.multikey_order(columns)
    rows = np.stack(columns, 1)[order].tolist()
    assert rows == sorted(rows)


def test_hot_keys_are_compared_across_bucket_boundaries(spark):
    n = 4000
    rows = [(5, 5, i, 0, 1) for i in range(n)] + [(7, i % 2, i, 1, 1) for i in range(6)] + [(9, 1, 0, 2, 1)]
    kind = substring_dedup.RECORD
    table = spark.createDataFrame(rows, kind).repartition(4)
    dealer = substring_dedup.Dealer(table, 1)
    assert dealer.size > 1
    dealt = table.mapInPandas(
        lambda frames: (f.assign(_bucket=dealer.buckets(*(f[c].to_numpy(np.int64) for c in substring_dedup.COLUMNS[:4]))) for f in frames),
        f"{kind}, _bucket int",
    )
    flags = {}
    for r in substring_dedup.sorted_neighbours(dealt, dealer).collect():
        flags[r["_doc"], r["_at"]] = flags.get((r["_doc"], r["_at"]), 0) | r["_flags"]
    ordered = sorted(rows)
    for i, r in enumerate(ordered):
        want = 0
        for j, lead, same in ((i - 1, 1, 2), (i + 1, 4, 8)):
            if 0 <= j < len(ordered) and ordered[j][0] == r[0]:
                want |= lead | (same if ordered[j][1] == r[1] else 0)
        assert flags.get((r[2], r[3]), 0) == want


def simhash_of(text, k=3):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_simhash_links_equal_brute_force(docs, empty, texts):
    prints = [simhash_of(r[1]) for r in texts]
    edges = [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3]
    part = groups(len(prints), edges)
    least = {}
    for g, r in zip(part, texts):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = [(r[0], f"{p:016x}", least.get(g)) for r, p, g in zip(texts, prints, part)]
    got = simhash.linked_documents(docs, "doc_id", "text").collect()
    assert by_id(got) == by_id(want)
    assert simhash.linked_documents(empty, "doc_id", "text").count() == 0


@pytest.mark.parametrize("heavy", [False, True])
def test_trie_join_loses_no_link(spark, heavy):
    draw = np.random.default_rng(1)
    base = draw.integers(0, 2**64, 120, dtype=np.uint64)
    values = set(base.tolist())
    for b in base.tolist()[:60] + [int(base[0])] * 200:
        values.add(b ^ sum(1 << int(k) for k in draw.choice(24 if b == int(base[0]) else 64, draw.integers(1, 6), replace=False)))
    array = np.array(sorted(values), np.uint64)
    table = spark.createDataFrame([(int(x),) for x in array.view(np.int64)], "_fp bigint").repartition(3)
    got = simhash.fingerprint_links(table, 3, 8 if heavy else 1 << 16).collect()
    at = {int(x): i for i, x in enumerate(array.view(np.int64))}
    near = np.argwhere(np.bitwise_count(array[:, None] ^ array[None]) <= 3)
    assert groups(len(array), [(at[r["u"]], at[r["v"]]) for r in got]) == groups(len(array), near[near[:, 0] < near[:, 1]].tolist())
    assert all((int(array[at[r["u"]]]) ^ int(array[at[r["v"]]])).bit_count() <= 3 for r in got)


def test_equal_keys_are_walked_in_halves():
    keys = np.full(300, 5 << 32, np.uint64)
    links = simhash.trie_links(keys, None, 0, 0, lambda x, y: np.abs(x - y) == 1, 3, 32)
    assert groups(300, links) == [0] * 300 and len(links) == 299


def test_near_copies_leave_one_row(docs, empty, texts):
    kept = simhash.without_near_copies(docs, "doc_id", "text")
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    # Exact copies (0, 41, 42), a near copy (3, 43) and all texts without words (30, 31, 32) leave one.
    assert ids[0] == 1 and not ids[41] and not ids[42] and not ids[43] and ids[2] == 1 and ids[30] == 1 and not ids[31]
    clean = [i for i in range(30) if len(texts[i][1].split()) > 20]
    assert all(ids[i] == 1 for i in clean)
    assert simhash.without_near_copies(empty, "doc_id", "text").count() == 0


def test_similar_texts_meet_and_others_do_not():
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    limit = int(simhash.DIFFERING * 64 * simhash.WORDS)
    near = far = 0
    for t in range(60):
        one = [draw.choice(words) for _ in range(200)]
        two, three = list(one), list(one)
        for i in draw.sample(range(200), 2):
            two[i] = draw.choice(words)  # about 10 of 196 shingles differ on either side
        for i in draw.sample(range(200), 40):
            three[i] = draw.choice(words)
        a, b, c = (np.frombuffer(simhash.wide_fingerprint(" ".join(x), 5), np.uint64) for x in (one, two, three))
        near += np.bitwise_count(a ^ b).sum() <= limit
        far += np.bitwise_count(a ^ c).sum() <= limit
    assert near >= 59 and far == 0


def test_mixing_targets_and_draws(docs, empty, texts):
    got = mixing.mix_sources(docs, "doc_id", "text", "source").collect()
    again = mixing.mix_sources(docs.repartition(2), "doc_id", "text", "source").collect()
    assert by_id(got) == by_id(again)
    sizes, taken, targets = Counter(), Counter(), {}
    source = {(r[0], len(WORDS.findall(r[1] or ""))): r[2] for r in texts}
    for r in got:
        s = source[r["doc_id"], r["size"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        targets[s] = r["target"]
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = dict(zip(names, itertools.cycle((5.0, 2.0, 1.0))))
    left, open_, want = float(sum(sizes.values())), set(names), {}
    while True:
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
            open_.remove(s)
    longest = max(r["size"] for r in got)
    for s in names:
        assert targets[s] == pytest.approx(want[s])
        assert abs(taken[s] - targets[s]) <= longest
    assert mixing.mix_sources(empty, "doc_id", "text", "source").count() == 0


def test_mixed_documents_repeat_rows_as_planned(docs):
    plan = {}
    for r in mixing.mix_sources(docs, "doc_id", "text", "source").collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["taken"]
    rows = mixing.mixed_documents(docs, "doc_id", "text", "source")
    assert rows.columns == docs.columns
    seen = Counter()
    for r in rows.collect():
        seen[r["doc_id"]] += len(WORDS.findall(r["text"] or ""))
    assert {k: v for k, v in plan.items() if v} == {k: v for k, v in seen.items() if v}


def test_equal_rows_at_the_cutoff_are_taken_as_far_as_they_fit(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [(7, same, "a", 1)] * 400 + [(None, same, None, 2)] * 300 + [(i, f"{same} {i}", "b", 3) for i in range(200)] + [(i, "x", "c", 4) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _mix_k int").repartition(7)
    got = mixing.mix_sources(df, "doc_id", "text", "source").collect()
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        source = "a" if r["doc_id"] == 7 and r["size"] == 10 else None if r["doc_id"] is None else "b" if r["size"] == 11 else "c"
        taken[source] += r["taken"]
        target[source] = r["target"]
        assert r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"]
    assert len(target) == 4 and all(abs(taken[s] - target[s]) <= 6 for s in target)
    mixed = mixing.mixed_documents(df, "doc_id", "text", "source")
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += len(r["text"].split())
        assert r["_mix_k"] == {"a": 1, None: 2, "b": 3, "c": 4}[r["source"]]
    assert words == taken


def test_packing_holds_every_id_once(docs, empty, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    want = Counter()
    ids = {}
    for i, text, *_ in texts:
        own = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        ids.setdefault(i, own)
        want[i] += len(own)
    got = packing.pack_documents(docs, "doc_id", "text", PATH, 2048, 1, 8).collect()
    total, padded = Counter(), 0
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        total[r["doc_id"]] += r["length"]
    assert total == want
    for _, pieces in itertools.groupby(sorted(got, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in pieces:
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= 2048
        padded += 2048 - at if at & (at - 1) else 0
    assert padded <= 0.02 * sum(want.values())
    assert packing.pack_documents(empty, "doc_id", "text", PATH).count() == 0


def test_tournament_finds_the_first_bin_with_room():
    draw = random.Random(3)
    lengths = [draw.randint(1, 5000) for _ in range(300)]
    pieces = packing.pack_group(lengths, 2048)
    for item, n in enumerate(lengths):
        own = sorted((s, k) for i, s, k, _, _ in pieces if i == item)
        assert sum(k for _, k in own) == n and all(a + k == b for (a, k), (b, _) in zip(own, own[1:]))
    tree, room = packing.Tournament(50, 100), [100] * 50
    for _ in range(200):
        need = draw.randint(1, 60)
        if max(room) < need:
            break
        at = next(i for i, r in enumerate(room) if r >= need)
        assert tree.first(need) == at
        tree.take(at, need)
        room[at] -= need


SHAPES = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute_spans(text):
    out = []
    for kind, shape in enumerate(SHAPES):
        for m in re.finditer(shape, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            fits = [True, all(int(p) <= 255 for p in m[0].split(".") if kind == 1), 14 <= len(digits) <= 19 and luhn, 10 <= len(digits) <= 15]
            if fits[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_shapes_equal_plain_patterns():
    draw = random.Random(4)
    signs = ["@", ".", "-", " ", "+", "(", ")", "a", "B", "é", "%", "1", "25", "255", "256", "4111111111111111", "\n", "x@y.z", "1.2.3.4"]
    for _ in range(4000):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 24)))
        assert personal_data.base_spans(text) == brute_spans(text), text
    assert personal_data.base_spans("a" * 200_000) == [] and personal_data.base_spans("1" * 200_000) == []


def test_bootstrap_finds_unseen_identifiers(spark, docs, empty):
    lines = [f"please write to the member contact: user{i}@mail.example.org today, about nothing" for i in range(12)]
    lines += [f"please write to the member contact: QX-{7000 + i} today, about nothing" for i in range(3)]
    lines += ["the year 2024-2025 was warm and the parts 12345678 are gone", "no figures at all in here"]
    rows = [(i, t, "s", "k", 1) for i, t in enumerate(lines)] + [(None, None, None, None, None)]
    got = {r["doc_id"]: r for r in personal_data.find_personal_data(spark.createDataFrame(rows, SCHEMA), "doc_id", "text").collect()}
    assert len(got) == len(rows)
    for i in range(12, 15):
        start = lines[i].index("QX-")
        assert got[i]["spans"] == f"id:{start}:{start + 7}"
        assert got[i]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[0]["n_email"] == 1 and got[0]["spans"].startswith("email:") and got[15]["spans"] == "" and got[None]["spans"] == ""
    assert personal_data.find_personal_data(docs, "doc_id", "text").count() == docs.count()
    assert personal_data.find_personal_data(empty, "doc_id", "text").count() == 0


def test_bootstrap_learns_patterns_from_what_it_found(spark):
    lines = [f"please write to the member contact: user{i}@mail.example.org today, about nothing" for i in range(40)]
    known = [f"QX-{7001 + i}" for i in range(8)]
    lines += [f"please write to the member contact: {x} today, about nothing" for x in known]
    lines += [f"stored under the old employee no: {x} since spring" for x in known]
    lines += ["stored under the old employee no: ZK-4410 since spring", "the parts 12345678 are gone"]
    rows = [(i, t, "s", "k", 1) for i, t in enumerate(lines)]
    got = {r["doc_id"]: r["spans"] for r in personal_data.find_personal_data(spark.createDataFrame(rows, SCHEMA), "doc_id", "text").collect()}
    for i, x in zip(range(40, 57), [*known, *known, "ZK-4410"]):
        start = lines[i].index(x)
        assert got[i] == f"id:{start}:{start + 7}", lines[i]
    assert got[57] == ""


def test_redaction_replaces_spans_and_keeps_rows(spark):
    rows = [(1, "mail a.b@c.de now +1 (555) 555-1234 end", "s", "k", 1), (2, None, "s", "k", 1), (3, "", "s", "k", 1), (4, "clean", None, "k", 1)]
    out = {r["doc_id"]: r["text"] for r in personal_data.redact(spark.createDataFrame(rows, SCHEMA), "text").collect()}
    assert out == {1: "mail <EMAIL> now <PHONE> end", 2: None, 3: "", 4: "clean"}


def test_components_of_paths_and_stars(spark):
    from creekline.llm.components import components

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and got[201] == 200
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_packing_remembers_ids_from_task_to_task():
    from creekline.llm import packing
    from creekline.llm.common import worker_tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    found = packing.worker_ids(path)["water"]
    assert np.frombuffer(found, "<u4").tolist() == worker_tokenizer(path).encode_whole("water")
    # A later task of the worker asks the same memory.
    assert dict.get(packing.worker_ids(path), "water") == found
