"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

The trie's nodes are ranges of the sorted distinct fingerprints. Pairs of nodes are walked down
together, adding a bit to the pair's error wherever the two branches part; a pair whose error
exceeds the budget is dropped with all below it.

The walk is dealt out by node pairs: the top levels of the trie are cut into blocks, and each pair
of blocks within the budget is one group. Blocks with too many fingerprints are cut some levels deeper.
Each group returns a spanning forest of the links it found, not all pairs, so a large group of
copies costs as many rows as it has members.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creekline.llm.common import prepare_workers, plain, shielded
from creekline.llm.components import components
from creekline.sources.sinks import staged

BUDGET = 3
#: Fingerprints of a block, about; levels that are cut at least and at most.
BLOCK = 1 << 16
LEAST_LEVELS, MOST_LEVELS = 6, 16
#: Node pairs in hand at once, and pairs of leaves that are compared rather than split further.
IN_HAND, LEAVES = 1 << 16, 64


def fingerprint(text: str, shingle: int, seed: int = 42) -> int:
    """Bits set in over half the hashes of the text's word shingles, unsigned; no words: 0."""
    words = text.encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    votes, n = np.zeros(64, np.int64), 0
    while some := list(itertools.islice(parts, 1 << 15) if not isinstance(parts, list) else parts):
        hashes = np.array([xxhash.xxh64_intdigest(x, seed) for x in some], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(some)
        if isinstance(parts, list):
            break
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def with_fingerprints(df: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """``_key, _fp`` (a signed long) per row; null texts are empty, whole texts are hashed."""
    prepare_workers(df.sparkSession)
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prints = np.array([fingerprint(plain(x), shingle) for x in frame["_text"]], np.uint64)
            yield pd.DataFrame({"_key": frame["_key"], "_fp": prints.view(np.int64)})

    return rows.mapInPandas(run, f"_key {dict(rows.dtypes)['_key']}, _fp bigint")


def _masks(bits: int, budget: int) -> list[int]:
    return [sum(1 << b for b in own) for k in range(budget + 1) for own in itertools.combinations(range(bits), k)]


class _Links:
    """Components of the places 0..n-1, and the links that joined them."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        a, b = self.label[x], self.label[y]
        new = np.flatnonzero(a != b)
        if not len(new):
            return
        low, high = np.minimum(a[new], b[new]), np.maximum(a[new], b[new])
        _, first = np.unique(low * len(self.label) + high, return_index=True)
        parent: dict[int, int] = {}

        def find(v: int) -> int:
            while (up := parent.get(v, v)) != v:
                parent[v] = parent.get(up, up)
                v = up
            return v

        for i in first.tolist():
            p, q = find(int(low[i])), find(int(high[i]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                self.links.append((int(x[new[i]]), int(y[new[i]])))
        move = np.arange(len(self.label))
        for v in parent:
            move[v] = find(v)
        self.label = move[self.label]


def trie_links(
    left: np.ndarray, right: np.ndarray | None, depth: int, error: int, near: Callable, budget: int = BUDGET, width: int = 64
) -> list[tuple[int, int]]:
    """A spanning forest of the links between two sorted arrays of keys (high ``width`` bits count).

    ``right`` None: within ``left``. All keys of a side share their first ``depth`` bits, which differ
    between the sides in ``error`` places. Places count through left, then right; ``near(x, y)``
    says of arrays of places which pairs are links.
    """
    own = right is None
    joined = left if own else np.concatenate([left, right])
    shift = 0 if own else len(left)
    other = left if own else right
    if not len(left) or not len(other):
        return []
    found = _Links(len(joined))
    stack = [(depth, np.array([[0, len(left), 0, len(other), error]]))]
    while stack:
        level, nodes = stack.pop()
        if len(nodes) > IN_HAND:
            stack += [(level, nodes[i : i + IN_HAND]) for i in range(0, len(nodes), IN_HAND)]
            continue
        # Two nodes that lie in one component have nothing left to tell.
        runs = np.concatenate([[0], np.cumsum(found.label[1:] != found.label[:-1])])
        a0, a1, b0, b1, e = nodes.T
        settled = (runs[a0] == runs[a1 - 1]) & (runs[b0 + shift] == runs[b1 - 1 + shift]) & (found.label[a0] == found.label[b0 + shift])
        nodes = nodes[~settled]
        if not len(nodes):
            continue
        a0, a1, b0, b1, e = nodes.T
        leaf = (a1 - a0) * (b1 - b0) <= LEAVES
        if leaf.any():
            x0, nx, y0, ny = a0[leaf], (a1 - a0)[leaf], b0[leaf], (b1 - b0)[leaf]
            size = nx * ny
            which = np.repeat(np.arange(len(size)), size)
            k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            x, y = x0[which] + k // ny[which], y0[which] + k % ny[which] + shift
            if own:
                x, y = x[x < y], y[x < y]
            linked = near(x, y)
            found.add(x[linked], y[linked])
            nodes = nodes[~leaf]
            if not len(nodes):
                continue
            a0, a1, b0, b1, e = nodes.T
        if level < width:
            bit = np.uint64(63 - level)
            # Where the branch of the 1 bit starts: the node's prefix, then a 1, then zeros.
            am = np.searchsorted(left, ((left[a0] >> bit) | np.uint64(1)) << bit)
            bm = np.searchsorted(other, ((other[b0] >> bit) | np.uint64(1)) << bit)
            parted = e + 1
        else:  # equal keys: halves, which differ in no bit
            am, bm, parted = (a0 + a1) // 2, (b0 + b1) // 2, e
        mirror = (am, a1, b0, bm, parted)
        if own:  # a node with itself parts only once
            twin = a0 == b0
            mirror = tuple(v[~twin] for v in mirror)
        children = [(a0, am, b0, bm, e), (am, a1, bm, b1, e), (a0, am, bm, b1, parted), mirror]
        below = np.concatenate([np.stack(child, 1) for child in children])
        below = below[(below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 4] <= budget)]
        if len(below):
            stack.append((level + 1, below))
    return found.links


def _deal(keys: np.ndarray, levels: int, deeper: dict[int, int], budget: int) -> Iterator[tuple[int, int, int, bool, slice]]:
    """Node pairs that the sorted ``keys`` take part in: depth, both nodes, whether as the second, and which keys."""
    if not len(keys):
        return
    heads = (keys >> np.uint64(64 - levels)).astype(np.int64) if levels else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
    masks = [(m, m.bit_count()) for m in _masks(levels, budget)]
    for s, end in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
        head = int(heads[s])
        for mask, error in masks:
            extra = max(deeper.get(head, 0), deeper.get(head ^ mask, 0))
            depth, low = levels + extra, (keys[s:end] >> np.uint64(64 - levels - extra)).astype(np.int64) if extra else None
            subs = [(head, s, end)]
            if extra:
                cuts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])).tolist()
                subs = [(int(low[c]), s + c, s + d) for c, d in zip(cuts, [*cuts[1:], end - s], strict=True)]
            for mine, c, d in subs:
                for inner in _masks(extra, budget - error) if extra else [0]:
                    theirs = mine ^ (mask << extra) ^ inner
                    yield depth, min(mine, theirs), max(mine, theirs), mine > theirs, slice(c, d)


def _levels(total: int, least: int, block: int) -> int:
    return min(MOST_LEVELS, max(least, math.ceil(math.log2(max(1, total) / block))))


def _heavy(prints: DataFrame, key: str, levels: int, block: int) -> dict[int, int]:
    """Blocks with over twice their due and how many levels deeper they are cut; one row per block, 2^16 at most."""
    if not levels:
        return {}
    top = F.shiftrightunsigned(key, 64 - levels).cast("int")
    sizes = prints.groupBy(top.alias("b")).count().filter(F.col("count") > 2 * block).collect()
    return {r["b"]: min(12, math.ceil(math.log2(r["count"] / block))) for r in sizes}


def fingerprint_links(prints: DataFrame, budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """``u, v``: links that join all distinct ``_fp`` at ``budget`` or fewer differing bits.

    No link between different fingerprints is lost: every pair of trie nodes within the budget is
    walked by exactly one group, and a group's forest joins what its links join.
    """
    levels = _levels(prints.count(), LEAST_LEVELS, block)
    deeper = _heavy(prints, "_fp", levels, block)
    prepare_workers(prints.sparkSession)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = np.sort(np.concatenate([np.zeros(0, np.uint64), *(f["_fp"].to_numpy(np.int64).view(np.uint64) for f in frames)]))
        rows = ((depth, a, b, second, keys[own].tobytes()) for depth, a, b, second, own in _deal(keys, levels, deeper, budget))
        while part := list(itertools.islice(rows, 2000)):
            yield pd.DataFrame(part, columns=["_depth", "_a", "_b", "_second", "_values"])

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        depth, a, b = (int(group[c].iloc[0]) for c in ("_depth", "_a", "_b"))
        sides = [np.sort(np.frombuffer(b"".join(group["_values"][group["_second"] == s]), np.uint64)) for s in (False, True)]
        joined = np.concatenate(sides)

        def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.bitwise_count(joined[x] ^ joined[y]) <= budget

        links = trie_links(sides[0], None if a == b else sides[1], depth, (a ^ b).bit_count(), near, budget)
        at = np.array(links, np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": joined[at[:, 0]].view(np.int64), "v": joined[at[:, 1]].view(np.int64)})

    dealt = prints.mapInPandas(deal, "_depth int, _a bigint, _b bigint, _second boolean, _values binary")
    return dealt.groupBy("_depth", "_a", "_b").applyInPandas(walk, "u bigint, v bigint")


def linked_documents(df: DataFrame, key: str, text: str, shingle: int = 3, budget: int = BUDGET) -> DataFrame:
    """``key, fingerprint, component_id`` for every row of ``df``.

    ``component_id`` is the least key of all documents reachable over links (``budget`` or fewer
    differing bits), itself included; null only where no key of a component is known.
    Null and empty texts have fingerprint
    zero and link like any other. Repeated rows each give a row; other columns are not read.
    """
    rows = staged(with_fingerprints(df, key, text, shingle), "fingerprints")
    distinct = staged(rows.groupBy("_fp").agg(F.min("_key").alias("_least")), "distinct-fingerprints")
    links = staged(fingerprint_links(distinct.select("_fp"), budget), "links")
    roots = components(links)
    rooted = distinct.join(roots, distinct["_fp"] == roots["node"], "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("_root"))
    rooted = staged(rooted, "roots")
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    classes = rooted.join(least, "_root").select(F.col("_fp").alias("_f"), "component_id")
    joined = rows.join(classes, rows["_fp"] == classes["_f"])
    hex_ = F.lower(F.lpad(F.hex("_fp"), 16, "0"))
    return joined.select(F.col("_key").alias(key), hex_.alias("fingerprint"), "component_id")


# Near copies of whole documents: a wide fingerprint, whose parts are keys of as many tries.

#: 32-bit keys of a wide fingerprint, and words of 64 bits that hold them.
TABLES, WORDS = 8, 4
#: Most differing bits, as a share, of a link. Shingle sets that are similar by 0.8 have a cosine of 8/9,
#: so 0.151 of their bits differ; a standard deviation more is let pass.
DIFFERING = 0.173
WIDE_BLOCK = 1 << 17


def wide_fingerprint(text: str, shingle: int) -> bytes:
    """256 bits: majority of several mixes of the hashes of the text's distinct shingles."""
    words = text.encode().lower().split()
    if not words:
        return bytes(8 * WORDS)
    parts = {b" ".join(words)} if len(words) < shingle else set(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in parts), np.uint64, len(parts))
    votes = np.zeros((WORDS, 64), np.int64)
    for at in range(0, len(hashes), 1 << 14):
        own = hashes[at : at + (1 << 14)]
        for k in range(WORDS):
            mixed = (own ^ (own >> np.uint64(29 + k))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(30)
            votes[k] += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * votes > len(parts), axis=1).tobytes()


def _node(wide: bytes) -> int:
    """A wide fingerprint's name as a node: 64 hashed bits, as a signed long."""
    return xxhash.xxh64_intdigest(wide, 1) - (1 << 63)


def wide_links(prints: DataFrame, budget: int = BUDGET, block: int = WIDE_BLOCK) -> DataFrame:
    """``u, v`` (nodes): links between distinct ``_wide`` that differ in at most DIFFERING of their bits.

    A pair is met if one of its TABLES keys is within ``budget``; the bits of the whole fingerprint decide.
    """
    levels = _levels(prints.count(), 2, block)
    limit = int(DIFFERING * 64 * WORDS)
    prepare_workers(prints.sparkSession)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide = np.frombuffer(b"".join(b"".join(f["_wide"]) for f in frames), np.uint64).reshape(-1, WORDS)
        for table in range(TABLES):
            keys = _table_keys(wide, table)
            order = np.argsort(keys, kind="stable")
            rows = (
                (table, depth, a, b, second, wide[order[own]].tobytes())
                for depth, a, b, second, own in _deal(keys[order], levels, {}, budget)
            )
            while part := list(itertools.islice(rows, 500)):
                yield pd.DataFrame(part, columns=["_table", "_depth", "_a", "_b", "_second", "_values"])

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        table, depth, a, b = (int(group[c].iloc[0]) for c in ("_table", "_depth", "_a", "_b"))
        sides, keys = [], []
        for second in (False, True):
            wide = np.frombuffer(b"".join(group["_values"][group["_second"] == second]), np.uint64).reshape(-1, WORDS)
            key = _table_keys(wide, table)
            order = np.argsort(key, kind="stable")
            sides.append(wide[order])
            keys.append(key[order])
        joined = np.concatenate(sides)

        def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.bitwise_count(joined[x] ^ joined[y]).sum(1, dtype=np.int64) <= limit

        links = trie_links(keys[0], None if a == b else keys[1], depth, (a ^ b).bit_count(), near, budget, 32)
        ends = [[_node(joined[i].tobytes()) for i in pair] for pair in links]
        return pd.DataFrame(ends, columns=["u", "v"], dtype="int64")

    kinds = "_table int, _depth int, _a bigint, _b bigint, _second boolean, _values binary"
    dealt = prints.mapInPandas(deal, kinds)
    return dealt.groupBy("_table", "_depth", "_a", "_b").applyInPandas(walk, "u bigint, v bigint")


def _table_keys(wide: np.ndarray, table: int) -> np.ndarray:
    """The table's 32 bits, as the high half of a key."""
    word = wide[:, table // 2]
    return (word << np.uint64(32)) if table % 2 else (word >> np.uint64(32)) << np.uint64(32)


def without_near_copies(df: DataFrame, key: str, text: str, shingle: int = 5) -> DataFrame:
    """One row of each group of near copies: the one with the least key (null keys last), then text hash.

    Copies are linked by the share of equal bits of wide fingerprints of five-word shingles, which
    estimates a similarity of 0.8. Groups are what links reach. All null and empty texts are one group.
    Columns are those of ``df``, whatever their names; of rows equal in key and text one stays. An empty table
    gives no rows, and long texts are read whole.
    """
    return shielded(df, lambda rows, of: _without_near_copies(rows, of[key], of[text], shingle))


def _without_near_copies(df: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    prepare_workers(df.sparkSession)
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = dict(rows.dtypes)["_key"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            wide = [wide_fingerprint(plain(x), shingle) for x in frame["_text"]]
            yield pd.DataFrame({"_key": frame["_key"], "_hash": frame["_hash"], "_wide": wide, "_node": np.array([_node(x) for x in wide], np.int64)})

    hashed = rows.withColumn("_hash", F.xxhash64("_text"))
    prints = staged(hashed.mapInPandas(run, f"_key {kind}, _hash bigint, _wide binary, _node bigint"), "wide-fingerprints")
    distinct = staged(prints.groupBy("_node").agg(F.first("_wide").alias("_wide")), "distinct-wide")
    roots = components(staged(wide_links(distinct.select("_wide")), "links"))
    order = F.struct(F.col("_key").isNull().alias("n"), F.col("_key").alias("k"), F.col("_hash").alias("h"))
    least = prints.groupBy("_node").agg(F.min(order).alias("_least"))
    rooted = least.join(roots, least["_node"] == roots["node"], "left").groupBy(F.coalesce("root", "_node").alias("_r")).agg(F.min("_least").alias("_least"))
    kept = staged(rooted.select(F.col("_least.k").alias("_kept_key"), F.col("_least.h").alias("_kept_hash")), "kept")
    marked = df.withColumn("_own_hash", F.xxhash64(F.col(text)))
    same = F.col(key).eqNullSafe(F.col("_kept_key")) & (F.col("_own_hash") == F.col("_kept_hash"))
    return marked.join(kept, same, "left_semi").dropDuplicates([key, "_own_hash"]).select(*df.columns)
