"""Token counts by a two-tier lookup in the map tasks.

Tier one is a broadcast table of the lengths (in tokens) of the most frequent chunks, a bounded
number of short strings. Tier two is each Python worker's cache, which has the tokenizer
encode a chunk the first time the worker meets it. No chunk is ever shuffled: the frequent table comes
from counts that every task sums over its own rows and cuts to its most frequent ones.

The tables decide only how fast a count is found, never its value.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creekline.llm.common import ChunkTokenizer, _Cache, prepare_workers, plain, worker_tokenizer

#: Entries of the broadcast table and the longest string in it: at most about 3 MB.
FREQUENT = 32_768
LONGEST = 48
#: Distinct chunks that a task counts before it drops the rarer half of them.
COUNTED = 200_000
#: Lengths that a worker remembers besides the broadcast ones.
REMEMBERED = 500_000


def frequent_lengths(df: DataFrame, text: str, path: str, size: int = FREQUENT) -> dict[str, int]:
    """Token lengths of the most frequent chunks; every row is counted where it lies."""
    prepare_workers(df.sparkSession)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, counts = worker_tokenizer(path), Counter()
        for frame in frames:
            for value in frame["_text"]:
                counts.update(tokenizer.chunks(plain(value)))
                if len(counts) > COUNTED:
                    counts = Counter(dict(counts.most_common(COUNTED // 2)))
        top = [(k, n) for k, n in counts.most_common(size) if len(k) <= LONGEST]
        if top:
            yield pd.DataFrame({"_chunk": [k for k, _ in top], "_n": [n for _, n in top]})

    partial = df.select(F.col(text).alias("_text")).mapInPandas(count, "_chunk string, _n bigint")
    top = partial.groupBy("_chunk").agg(F.sum("_n").alias("_n")).orderBy(F.desc("_n"), "_chunk").limit(size)
    tokenizer = ChunkTokenizer(path)
    return {row["_chunk"]: len(tokenizer.encode_chunk(row["_chunk"])) for row in top.collect()}


def count_tokens(df: DataFrame, key: str, text: str, path: str, limit: int) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every row of ``df``.

    A null text counts as empty: no bytes, no tokens. Keys may be null or repeated; each row
    gives one row. Other columns are not read, so their names cannot clash. Texts are never
    cut; special strings inside a text are handled as the library handles them by default.
    """
    lengths = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, text, path))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = worker_tokenizer(path)
        cache = _Cache(lambda chunk: len(tokenizer.encode_chunk(chunk)), REMEMBERED, lengths.value)
        if not tokenizer.isolates:
            cache = _Cache(lambda chunk: len(tokenizer.encode_whole(chunk)), 0)
        for frame in frames:
            texts = [plain(x) for x in frame["_text"]]
            yield pd.DataFrame({
                "_key": frame["_key"],
                "n_bytes": [len(x.encode()) for x in texts],
                "n_tokens": [sum(map(cache.__getitem__, tokenizer.chunks(x))) for x in texts],
            })

    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    counted = rows.mapInPandas(run, f"_key {dict(rows.dtypes)['_key']}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("_key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
