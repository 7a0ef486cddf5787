"""Packing by first-fit decreasing over a tournament tree, in randomised groups of documents.

Documents are dealt to groups by a hash of their row, so groups are random, of like size and the
same on every run. Each group is packed on its own, in one task, with memory for one group: full
sequences are cut off first, the rest go by first-fit decreasing. A tournament tree over the bins
holds the largest free room below each node, so the first bin with room is found in log time.
What is still free is filled by cutting documents of the emptiest bins, and the last bin of a
group is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creekline.llm.common import _Cache, prepare_workers, plain, worker_tokenizer

#: Documents of a group, on average and at most.
GROUP_ROWS = 1024
#: A group's sequences are numbered from its number times this.
PER_GROUP = 1 << 32
#: Free room that is left to padding rather than filled by a cut.
SMALL_ROOM = 8
#: Chunks whose ids a worker remembers.
REMEMBERED = 1_000_000

PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Tournament:
    """First bin with enough room: each node knows the largest room below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1
        while self.leaves < max(bins, 1):
            self.leaves *= 2
        self.most = [room] * (2 * self.leaves)

    def first(self, need: int) -> int:
        """The leftmost bin with room for ``need``; there is one bin per item, so one fits."""
        at = 1
        while at < self.leaves:
            at = 2 * at if self.most[2 * at] >= need else 2 * at + 1
        return at - self.leaves

    def take(self, bin_: int, size: int) -> None:
        at = bin_ + self.leaves
        self.most[at] -= size
        while at > 1:
            at //= 2
            self.most[at] = max(self.most[2 * at], self.most[2 * at + 1])


def pack_group(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of all pieces; sequences are numbered from 0."""
    bins: list[list[tuple[int, int, int]]] = []  # pieces: item, start, length
    rests = []
    for item, n in enumerate(lengths):
        full = n // capacity
        bins += [[(item, i * capacity, capacity)] for i in range(full)]
        if n % capacity:
            rests.append((item, full * capacity, n % capacity))
    rests.sort(key=lambda x: (-x[2], x[0]))
    tree = Tournament(len(rests), capacity)
    loose: list[list[tuple[int, int, int]]] = [[] for _ in rests]
    for piece in rests:
        at = tree.first(piece[2])
        tree.take(at, piece[2])
        loose[at].append(piece)
    loose = [x for x in loose if x]
    # The emptiest bins give their pieces, cut as needed, to the others' free room.
    free = [capacity - sum(p[2] for p in x) for x in loose]
    order = sorted(range(len(loose)), key=lambda i: (free[i], i))
    low, high = 0, len(order) - 1
    while low < high:
        to, of = order[low], order[high]
        if free[to] <= SMALL_ROOM:
            low += 1
        elif not loose[of]:
            high -= 1
        else:
            item, start, n = loose[of].pop()
            part = min(n, free[to])
            loose[to].append((item, start + n - part, part))
            free[to] -= part
            free[of] += part
            if part < n:
                loose[of].append((item, start, n - part))
    last = order[high] if order else 0
    bins += [x for i, x in enumerate(loose) if x and i != last]
    if loose and loose[last]:
        if free[last] <= SMALL_ROOM:
            bins.append(loose[last])
        else:
            bins += _powers(loose[last])
    out = []
    for sequence, pieces in enumerate(bins):
        offset = 0
        for item, start, n in pieces:
            out.append((item, start, n, sequence, offset))
            offset += n
    return out


def _powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces cut into sequences with lengths that are the powers of two of their sum."""
    total, out, left = sum(p[2] for p in pieces), [], list(pieces)
    for bit in reversed(range(total.bit_length())):
        size, sequence = total & (1 << bit), []
        while size:
            item, start, n = left.pop(0)
            part = min(n, size)
            sequence.append((item, start, part))
            size -= part
            if part < n:
                left.insert(0, (item, start + part, n - part))
        if sequence:
            out.append(sequence)
    return out


@functools.lru_cache(maxsize=2)
def worker_ids(path: str) -> _Cache:
    """A chunk's ids as little-endian bytes, remembered from one task of a worker to the next."""
    tokenizer = worker_tokenizer(path)
    encode = tokenizer.encode_chunk if tokenizer.isolates else tokenizer.encode_whole
    return _Cache(lambda chunk: np.array(encode(chunk), "<u4").tobytes(), REMEMBERED)


def pack_documents(
    df: DataFrame, key: str, text: str, path: str, capacity: int = 2048, end_id: int = 1, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """One row per piece of every document of ``df``.

    Columns: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset``. A document is
    its ids and then ``end_id``; a null text is empty and still has the end id. Keys may be null
    or repeated: each row is a document. An empty table gives no rows. Only these two columns are
    read, so others cannot clash. Texts are shuffled once, to their group.
    """
    prepare_workers(df.sparkSession)
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = dict(rows.dtypes)["_key"]
    groups = max(1, -(-rows.count() // group_rows))
    dealt = rows.withColumn("_hash", F.xxhash64("_key", "_text")).withColumn(
        "_group", F.pmod(F.xxhash64("_hash", F.lit(7)), F.lit(groups))
    )
    # Partitions hold many groups; the number follows the session's setting.
    sorted_ = dealt.repartition(F.col("_group")).sortWithinPartitions("_group", "_hash")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, cache = worker_tokenizer(path), worker_ids(path)
        end = end_id.to_bytes(4, "little")
        at, part, keys, ids = None, 0, [], []

        def packed() -> pd.DataFrame:
            out = []
            for item, start, n, sequence, offset in pack_group([len(x) // 4 for x in ids], capacity):
                own = ids[item]
                crc = zlib.crc32(own[4 * start : 4 * (start + n)])
                out.append((keys[item], start, n, crc, len(own) // 4, at * PER_GROUP + part + sequence, offset))
            return pd.DataFrame(out, columns=["_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]).astype({"_key": object})

        for frame in frames:
            for own_key, value, group in zip(frame["_key"].astype(object), frame["_text"], frame["_group"], strict=True):
                if keys and (group != at or len(keys) >= 2 * group_rows):
                    # A group that is too large, as with many equal rows, is packed in parts.
                    done = packed()
                    yield done
                    part = int(done["sequence_id"].max()) - at * PER_GROUP + 1 if group == at else 0
                    keys, ids = [], []
                at = int(group)
                keys.append(None if pd.isna(own_key) else own_key)
                ids.append(b"".join(map(cache.__getitem__, tokenizer.chunks(plain(value)))) + end)
        if keys:
            yield packed()

    return sorted_.mapInPandas(run, f"_key {kind}, {PIECES}").withColumnRenamed("_key", key)
