"""Removal of byte strings that occur more than once, by sorting suffixes.

A suffix array of every byte would be some hundred times the input. Suffixes are therefore sampled by
content: of each 200-byte window the leading K bytes of one suffix count, the one with the
least fingerprint, so equal windows sample equal suffixes. Neighbouring windows that sample the
same fingerprint form a stretch. A stretch is sorted by the fingerprint of its suffix's leading bytes,
then by that of all its bytes.

Sampled splitters deal the sorted order out to buckets, by leading bytes first and by place last,
so that a string with very many copies is spread over several buckets. A bucket is sorted by multikey
quicksort and each suffix compared with its neighbours. Splitters are suffixes of the data: a
bucket starts with its splitter, so the one before it can compare across the boundary.

A stretch equal to a neighbour is repeated as a whole. One that shares only leading bytes is opened: its
windows go through the same sort. All other stretches are unique. Fingerprints have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creekline.llm.common import prepare_workers, plain
from creekline.sources.sinks import staged

#: Leading bytes whose fingerprint samples a suffix of a window.
LEADING = 80
#: Bytes of a text that are in hand at once; a longer text is gone through in overlapping parts.
PART = 1 << 20
#: Records of a bucket, about, and documents that splitters are sampled from, about.
BUCKET, SAMPLED = 400_000, 4_000
#: Records of the sample that splitters are taken from, about.
SPLITTERS_FROM = 20_000

_START = np.random.default_rng(20)
_TABLE = _START.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}

#: What the sort tells of a record: same leading key, or same whole key, as the one before or after.
LEAD_BEFORE, SAME_BEFORE, LEAD_AFTER, SAME_AFTER, KNOWN = 1, 2, 4, 8, 16
RECORD = "_a bigint, _b bigint, _doc bigint, _at int, _n int"
COLUMNS = ["_a", "_b", "_doc", "_at", "_n"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n + 1`` of each."""
    if not _POWERS or len(_POWERS["up"]) <= n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size + 1, np.uint64(base))
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _sums(raw: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(raw))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[raw] * up[: len(raw)])])


def _prints(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the bytes from ``start`` to before ``end``, wherever they stand."""
    return _mixed((sums[end] - sums[start]) * _POWERS["down"][start])


def _all_prints(sums: np.ndarray, width: int) -> np.ndarray:
    n = len(sums) - width
    return _mixed((sums[width:] - sums[:-width]) * _POWERS["down"][:n])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    step, least = 1, x
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    n = len(x) - width + 1
    return np.minimum(least[:n], least[width - step : width - step + n])


def stretches(raw: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]]:
    """Per part of a text: leading key, whole key, start and number of windows of each stretch, and
    the (start, number) of windows that are repeated within their own stretch."""
    span = window - LEADING + 1
    for at in range(0, len(raw) - window + 1, PART):
        part = raw[at : at + PART + window - 1]
        sums = _sums(part)
        lead = _all_prints(sums, LEADING)
        least = _sliding_least(lead, span)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [len(least)]]) - 1
        key = least[first]
        whole = _prints(sums, first, last + window)
        # Windows of a stretch can only be equal if its sampled suffix is not one and the same.
        own = []
        moved = np.zeros(len(first), bool)
        for block in range(0, len(first), 4096):
            some = slice(block, block + 4096)
            seen = lead[first[some, None] + np.arange(span)] == key[some, None]
            moved[some] = last[some] > first[some] + seen.argmax(1)
        for i in np.flatnonzero(moved):
            s, e = int(first[i]), int(last[i])
            prints = _prints(sums, np.arange(s, e + 1), np.arange(s, e + 1) + window)
            _, where, count = np.unique(prints, return_inverse=True, return_counts=True)
            own += [(at + s + a, n) for a, n in _intervals(np.flatnonzero(count[where] > 1))]
        yield key, whole, first + at, last - first + 1, own


def _intervals(places: np.ndarray) -> list[tuple[int, int]]:
    """Sorted places as (start, number) of gapless ones."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    starts = places[np.concatenate([[0], cut + 1])]
    ends = places[np.concatenate([cut, [len(places) - 1]])]
    return list(zip(starts.tolist(), (ends - starts + 1).tolist(), strict=True))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def suffix_records(docs: DataFrame, window: int, dealt: Dealer | None = None) -> DataFrame:
    """One record per stretch of every text of ``docs`` (``_doc, _text``); windows repeated within
    their own stretch come as records with ``_n`` below 0. ``dealt`` adds each record's bucket."""
    prepare_workers(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = _Block()
            for doc, text in zip(frame["_doc"], frame["_text"], strict=True):
                raw = np.frombuffer(plain(text).encode(), np.uint8)
                for key, whole, first, n, inside in stretches(raw, window):
                    out.add(_signed(key), _signed(whole), doc, first, n)
                    if inside:
                        at, k = np.array(inside).T
                        out.add(np.full(len(at), doc), np.zeros(len(at), np.int64), doc, at, -k)
            yield out.frame(dealt)

    return docs.mapInPandas(run, RECORD + (", _bucket int" if dealt else ""))


class _Block:
    """Records of a batch, column by column."""

    def __init__(self) -> None:
        self.columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in COLUMNS]

    def add(self, a: np.ndarray, b: np.ndarray, doc, at: np.ndarray, n: np.ndarray) -> None:
        doc = np.broadcast_to(np.int64(doc), len(a)) if np.isscalar(doc) else doc
        for column, x in zip(self.columns, (a, b, doc, at, n), strict=True):
            column.append(x)

    def frame(self, dealt: Dealer | None) -> pd.DataFrame:
        joined = [np.concatenate(x) for x in self.columns]
        out = pd.DataFrame({c: x if c[1] in "abd" and c != "_at" else x.astype(np.int32) for c, x in zip(COLUMNS, joined, strict=True)})
        return out.assign(_bucket=dealt.buckets(*joined[:4])) if dealt else out


class Dealer:
    """Buckets of the sorted order, between splitters that are records themselves."""

    def __init__(self, sample: DataFrame, total: int):
        spark = sample.sparkSession
        wanted = max(1, -(-total // BUCKET), int(spark.conf.get("spark.sql.shuffle.partitions")))
        # A share of the sample by hash: the driver sees about SPLITTERS_FROM records, whatever there are.
        part = max(1, min(1_000_000, 1_000_000 * SPLITTERS_FROM // max(1, sample.count())))
        thin = F.pmod(F.xxhash64(*COLUMNS[:4], F.lit(8)), F.lit(1_000_000)) < F.lit(part)
        picked = sample.filter(thin).select(*COLUMNS).toArrow()
        keys = [picked[c].to_numpy().astype(np.int64) for c in COLUMNS]
        order = multikey_order(keys[:4])
        at = np.unique(np.linspace(0, len(order), wanted + 1).astype(int)[1:-1])
        # Splitters keep their number of windows: the bucket before reports on them too.
        split = np.unique(np.stack(keys, 1)[order[at]], axis=0) if len(order) else np.zeros((0, 5), np.int64)
        self.size = len(split) + 1
        self.shared = spark.sparkContext.broadcast(split)

    def buckets(self, *keys: np.ndarray) -> np.ndarray:
        """Number of splitters not after each record."""
        split = self.shared.value
        low, high = np.searchsorted(split[:, 0], keys[0], "left"), np.searchsorted(split[:, 0], keys[0], "right")
        rest = np.flatnonzero(low < high)
        if len(rest):  # the leading key is a splitter's own: the other keys decide
            turn = np.concatenate([np.zeros(len(split), np.int64), np.ones(len(rest), np.int64)])
            order = multikey_order([*(np.concatenate([split[:, k], keys[k][rest]]) for k in range(4)), turn])
            before = np.cumsum(order < len(split))
            place = np.empty(len(order), np.int64)
            place[order] = before
            low[rest] = place[len(split) :]
        return low.astype(np.int32)


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order of the rows by the first column; within equal ones by the second, and so on."""
    order = np.argsort(columns[0], kind="quicksort")
    group = np.cumsum(np.concatenate([[0], columns[0][order][1:] != columns[0][order][:-1]]))
    for column in columns[1:]:
        tied = np.bincount(group, minlength=1)[group] > 1
        rest = np.flatnonzero(tied)
        if not len(rest):
            break
        order[rest] = order[rest][np.lexsort((column[order[rest]], group[rest]))]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (column[order][1:] != column[order][:-1])])
        group = np.cumsum(new) - 1
    return order


def sorted_neighbours(records: DataFrame, dealer: Dealer) -> DataFrame:
    """``_doc, _at, _n, _flags`` of the records that share a key with a neighbour of the sorted order.

    ``records`` carry the bucket that ``dealer`` gave them. A record may come twice, with flags of
    either side. Records with ``_n`` below 0 take no part and come back as known.
    """
    shared = dealer.shared

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        if not parts:
            return
        frame = pd.concat(parts)
        number = int(frame["_bucket"].iloc[0])
        known = frame["_n"].to_numpy() < 0
        if known.any():
            yield frame.loc[known, ["_doc", "_at"]].assign(_n=-frame["_n"][known], _flags=np.int32(KNOWN))
        a, b, doc, at, n = (frame[c].to_numpy(np.int64)[~known] for c in COLUMNS)
        order = multikey_order([a, b, doc, at])
        a, b, doc, at, n = (x[order] for x in (a, b, doc, at, n))
        split = shared.value
        if number < len(split):  # the next bucket starts with its splitter
            a, b, doc, at, n = (np.append(x, s) for x, s in zip((a, b, doc, at, n), split[number], strict=True))
        lead = a[1:] == a[:-1]
        same = lead & (b[1:] == b[:-1])
        flags = np.zeros(len(a), np.int32)
        flags[1:] += (LEAD_BEFORE * lead + SAME_BEFORE * same).astype(np.int32)
        flags[:-1] += (LEAD_AFTER * lead + SAME_AFTER * same).astype(np.int32)
        kept = flags > 0
        yield pd.DataFrame({"_doc": doc[kept], "_at": at[kept].astype(np.int32), "_n": n[kept].astype(np.int32), "_flags": flags[kept]})

    return records.repartitionById(dealer.size, F.col("_bucket")).mapInPandas(compare, "_doc bigint, _at int, _n int, _flags int")


def opened_windows(docs: DataFrame, window: int, dealt: Dealer | None = None) -> DataFrame:
    """Records of the windows of stretches that share leading bytes only.

    ``docs``: ``_doc, _z, _ats, _ns``. A window in question has its place and ``_n`` 1; one that is known
    to be repeated, and is there only for others to be compared with, has ``_n`` 0.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = _Block()
            for doc, packed, ats, ns in zip(frame["_doc"], frame["_z"], frame["_ats"], frame["_ns"], strict=True):
                raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
                for at, n, flags in _merged(ats, ns):
                    repeated = bool(flags & (SAME_BEFORE | SAME_AFTER))
                    ends_class = flags & (LEAD_BEFORE | SAME_BEFORE) == LEAD_BEFORE or flags & (LEAD_AFTER | SAME_AFTER) == LEAD_AFTER
                    if repeated and not ends_class:
                        continue  # the class's first or last stretch stands for it
                    for s in range(at, at + n, PART):
                        sums = _sums(raw[s : min(at + n, s + PART) + window - 1])
                        prints, place, count = np.unique(_all_prints(sums, window), return_index=True, return_counts=True)
                        asked = (count == 1) & (not repeated)
                        out.add(_signed(prints), np.zeros(len(prints), np.int64), np.where(asked, doc, 0), np.where(asked, place + s, 0), asked.astype(np.int64))
            yield out.frame(dealt)

    return docs.mapInPandas(run, RECORD + (", _bucket int" if dealt else ""))


def _merged(ats: np.ndarray, ns: np.ndarray) -> list[tuple[int, int, int]]:
    """Start, number and flags of a document's stretches; a stretch's flags of both sides are put together."""
    found: dict[int, list[int]] = {}
    for packed, n in zip(ats.tolist(), ns.tolist(), strict=True):
        own = found.setdefault(packed // 32, [0, 0])
        own[0] = max(own[0], n)
        own[1] |= packed % 32
    return [(at, n, flags) for at, (n, flags) in sorted(found.items())]


def remove_repeats(df: DataFrame, key: str, text: str, window: int = 200) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``df``.

    Texts are UTF-8 bytes (null: empty). Each byte that lies in a ``window``-byte string that also
    starts anywhere else, in the same text or another, is removed; strings are judged on the input.
    Strings never cross texts, and shorter texts lose nothing. Rows equal in key and text are two
    texts, and so lose all if long enough. Null keys are allowed; other columns are not read.
    """
    prepare_workers(df.sparkSession)
    docs = df.select(F.col(key).alias("_key"), F.xxhash64(F.col(key), F.col(text)).alias("_doc"), F.col(text).alias("_text"))
    kind = dict(docs.dtypes)["_key"]
    long_ = docs.select("_doc", "_text").filter(F.octet_length("_text") >= window)
    total = max(1, docs.count())
    share = max(1, min(1_000_000, 1_000_000 * SAMPLED // total))
    chosen = F.pmod(F.xxhash64("_doc", F.lit(9)), F.lit(1_000_000)) < F.lit(share)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=3)
        for frame in frames:
            yield frame.drop(columns="_text").assign(_z=[press.compress(plain(x).encode()) for x in frame["_text"]])

    # Splitters come from a sample of documents; what is sorted are the suffixes of all.
    sample = staged(suffix_records(long_.filter(chosen), window).filter("_n > 0"), "suffix-sample")
    dealer = Dealer(sample, sample.count() * 1_000_000 // share)
    judged = staged(sorted_neighbours(suffix_records(long_, window, dealer), dealer), "suffixes")
    shared = judged.filter(F.col("_flags") < KNOWN)
    open_ = shared.groupBy("_doc").agg(
        F.collect_list(F.col("_at").cast("bigint") * 32 + F.col("_flags")).alias("_ats"), F.collect_list("_n").alias("_ns"),
        F.min(F.col("_flags").bitwiseAND(SAME_BEFORE | SAME_AFTER)).alias("_least"), F.max(_ends_class()).alias("_ends"),
    ).filter("_least = 0 or _ends")
    open_ = staged(open_.drop("_least", "_ends"), "shared-suffixes")

    def to_open(some: DataFrame) -> DataFrame:
        packed = some.mapInPandas(pack, "_doc bigint, _z binary")
        return packed.join(open_, "_doc").select("_doc", "_z", "_ats", "_ns")

    few = staged(opened_windows(to_open(long_.filter(chosen)), window), "window-sample")
    window_dealer = Dealer(few, few.count() * 1_000_000 // share)
    again = sorted_neighbours(opened_windows(to_open(long_), window, window_dealer), window_dealer).filter("_n > 0")
    whole = F.col("_flags").bitwiseAND(SAME_BEFORE | SAME_AFTER | KNOWN) > 0
    repeated = judged.filter(whole & (F.col("_n") > 0)).select("_doc", "_at", "_n").unionByName(again.select("_doc", "_at", "_n"))
    spans = repeated.groupBy("_doc").agg(F.collect_list("_at").alias("_ats"), F.collect_list("_n").alias("_ns"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = zip(frame["_z"], frame["_ats"], frame["_ns"], strict=True)
            out = pd.DataFrame([_kept(zstandard.decompress(z), ats, ns, window) for z, ats, ns in rows], columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            out.insert(0, "_key", frame["_key"].to_numpy())
            yield out

    packed = docs.mapInPandas(pack, f"_key {kind}, _doc bigint, _z binary")
    joined = packed.join(spans, "_doc", "left").select("_key", "_z", "_ats", "_ns")
    done = joined.mapInPandas(cut, f"_key {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return done.withColumnRenamed("_key", key)


def _ends_class() -> Column:
    """A stretch at an end of its class of equal ones, next to another class with the same leading bytes."""
    flags = F.col("_flags")
    return (flags.bitwiseAND(LEAD_BEFORE | SAME_BEFORE) == LEAD_BEFORE) | (flags.bitwiseAND(LEAD_AFTER | SAME_AFTER) == LEAD_AFTER)


def _kept(raw: bytes, ats: np.ndarray | None, ns: np.ndarray | None, window: int) -> tuple[int, int, int, str]:
    """Sizes and digest of a text without the windows that start in ``ats``, ``ns`` of them from each."""
    if ats is None:
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest()
    change = np.zeros(len(raw) + 1, np.int32)
    starts = np.asarray(ats, np.int64)
    ends = starts + np.asarray(ns, np.int64) - 1 + window
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    gone = np.cumsum(change[:-1]) > 0
    n_spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return len(raw), int(gone.sum()), n_spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()
