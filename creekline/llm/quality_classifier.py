"""Quality from trusted good texts and unlabelled ones alone: positive-unlabelled learning.

Only marks of good texts are learnt from; no text is ever trusted to be bad. Every other text is a mix of good and
bad ones, and the share of good ones, the class prior, is estimated first: a first scorer tells trusted texts from
unlabelled ones, and on texts it has not seen the smallest ratio of the two kinds' shares above a threshold, with
its margin of error, is the largest share of good texts that the unlabelled ones can hold. The final scorer then
minimises the risk written by that prior, whose part for bad texts (unlabelled less prior times trusted) cannot be
negative for any true scorer: where a batch makes it so, the step goes the other way, so nothing is learnt by heart.

A text is a row of numbers (shares of distinct and repeated words and lines, of kinds of characters, lengths), each
cut into bins by quantiles; a scorer adds one weight per bin. Shards of the sample take passes from a common start
and are averaged, and so the driver sees weights, counts per score and cuts, of fixed sizes.

Nulls and the like: a null text is the empty text, and both have a score of their own like any other. Null keys and
null marks teach nothing; a key marked twice counts once, as good if either mark says so. Without any trusted or
unlabelled text every score is a half. Repeated rows and ties stay rows with equal scores, an empty table gives no
rows, and the added column replaces none: the caller names it. Long texts are read whole, in linear time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creekline.llm.common import plain, prepare_workers
from creekline.sources.sinks import staged

#: Rows of each kind that a scorer is fitted on, at most (about; chosen by hash of the key).
FIT_ROWS = 20_000
#: Rows per shard, rounds of averaging, passes of a shard in a round, rows per batch.
SHARD_ROWS, ROUNDS, PASSES, BATCH = 10_000, 4, 15, 256
STEP, DECAY = 0.05, 1e-4
#: Bins per number of a text.
BINS = 16
#: Scores are counted in this many equal bins for the prior, whose margin of error fails one time in 1 / DOUBT.
SCORE_BINS, DOUBT = 1000, 0.1
#: Characters whose share of a text is a number of its own.
SIGNS = b".,!?#*$%&|<>{}[]()/\\@:;-_=+'\""
NUMBERS = 16 + len(SIGNS)


@dataclass
class Scorer:
    """One weight per number of a text and bin; ``cuts[j]`` parts number j's bins."""

    cuts: list[np.ndarray]
    weights: np.ndarray
    bias: float = 0.0
    prior: float = 0.5

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum([0, *[len(c) + 1 for c in self.cuts]])

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        starts = self.starts
        return np.stack([np.searchsorted(c, numbers[:, j], "right") + starts[j] for j, c in enumerate(self.cuts)], 1)

    def scores(self, slots: np.ndarray) -> np.ndarray:
        return _share(self.weights[slots].sum(1) + self.bias)


def _share(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def numbers_of(text: str) -> list[float]:
    """A whole text's numbers."""
    data = np.frombuffer(text.encode(), np.uint8)
    of = np.bincount(data, minlength=256)
    n, words = len(data) + 1, text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    word_counts = Counter(words)
    w, rows = len(words) + 1, len(lines) + 1
    return [
        math.log1p(len(words)), math.log1p(len(lines)), n / w, w / rows,
        len(word_counts) / w, len(set(lines)) / rows, len(set(zip(words, words[1:]))) / w,
        max(word_counts.values(), default=0) / w, sum(map(str.__eq__, words, words[1:])) / w,
        of[65:91].sum() / n, of[97:123].sum() / n, of[48:58].sum() / n, of[128:].sum() / n,
        (of[9] + of[10] + of[32]) / n, max(map(len, word_counts), default=0), sum(len(x) for x in lines if x.isupper()) / n,
        *(of[np.frombuffer(SIGNS, np.uint8)] / n).tolist(),
    ]


def _numbers(texts: pd.Series) -> np.ndarray:
    return np.array([numbers_of(plain(x)) for x in texts], float).reshape(len(texts), NUMBERS)


def train(scorer: Scorer, slots: np.ndarray, trusted: np.ndarray, prior: float, seed: int) -> Scorer:
    """A few passes of AdaGrad from ``scorer`` on the non-negative risk at ``prior``."""
    weights, bias = scorer.weights.copy(), scorer.bias
    moved, moved_bias = np.full(len(weights), 1e-3), 1e-3
    good, mixed = np.flatnonzero(trusted), np.flatnonzero(~trusted)
    if not len(good) or not len(mixed):
        return scorer
    draw = np.random.default_rng(seed)
    parts = max(1, min(len(mixed) // BATCH, len(good)))
    for _ in range(PASSES):
        draw.shuffle(good)
        draw.shuffle(mixed)
        for k in range(parts):
            g, u = slots[good[k::parts]], slots[mixed[k::parts]]
            of_good, of_mixed = _share(weights[g].sum(1) + bias), _share(weights[u].sum(1) + bias)
            bad_risk = prior * np.log1p(-of_good).mean() - np.log1p(-of_mixed).mean()
            pull_u, pull_g = of_mixed / len(u), -prior * of_good / len(g)
            if bad_risk >= 0:
                pull_g = pull_g - prior * (1 - of_good) / len(g)
            else:
                pull_u, pull_g = -pull_u, -pull_g
            width = slots.shape[1]
            step = np.bincount(u.ravel(), np.repeat(pull_u, width), len(weights)) + np.bincount(g.ravel(), np.repeat(pull_g, width), len(weights)) + DECAY * weights
            step_bias = pull_u.sum() + pull_g.sum()
            moved += step**2
            moved_bias += step_bias**2
            weights -= STEP * step / np.sqrt(moved)
            bias -= STEP * step_bias / moved_bias**0.5
    return Scorer(scorer.cuts, weights, float(bias), prior)


def fit_shards(table: DataFrame, scorer: Scorer, prior: float, rows: int) -> Scorer:
    """Rounds of passes over shards of ``table``, averaged by their rows."""
    shards = max(1, math.ceil(rows / SHARD_ROWS))
    dealt = table.repartitionById(shards, F.pmod(F.col("_draw"), F.lit(shards)).cast("int"))

    def passes(start: Scorer, turn: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = list(frames)  # a shard: about SHARD_ROWS rows
            frame = pd.concat(held) if held else None
            if frame is not None and len(frame):
                done = train(start, start.slots(np.stack(frame["_numbers"])), frame["_trusted"].to_numpy(bool), prior, turn)
                yield pd.DataFrame({"n": [len(frame)], "bias": [done.bias], "weights": [done.weights]})

        return run

    for turn in range(ROUNDS):
        parts = dealt.mapInPandas(passes(scorer, turn), "n bigint, bias double, weights array<double>").collect()
        n = sum(p["n"] for p in parts)
        if n:
            scorer = Scorer(scorer.cuts, sum(p["n"] / n * np.array(p["weights"]) for p in parts), sum(p["n"] / n * p["bias"] for p in parts), prior)
    return scorer


def class_prior(good: np.ndarray, mixed: np.ndarray) -> float:
    """The share of good texts among the mixed ones, from both kinds' counts by rising score.

    Above any threshold the mixed texts hold at least the good ones' part: prior times the good texts' share. So
    every threshold's ratio bounds the prior from above, and the one with the least bound, margin included, tells.
    """
    if not good.sum() or not mixed.sum():
        return 0.5
    of_good, of_mixed = (x[::-1].cumsum() / x.sum() for x in (good, mixed))
    margin = sum(math.sqrt(math.log(4 / DOUBT) / 2 / x.sum()) for x in (good, mixed))
    best = ((of_mixed + margin) / np.maximum(of_good, 1e-9)).argmin()
    return float(np.clip(of_mixed[best] / of_good[best], 0.02, 0.98))


def _counted_scores(table: DataFrame, scorer: Scorer) -> tuple[np.ndarray, np.ndarray]:
    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            s = scorer.scores(scorer.slots(np.stack(frame["_numbers"])))
            yield pd.DataFrame({"_trusted": frame["_trusted"], "bin": np.minimum((s * SCORE_BINS).astype(int), SCORE_BINS - 1)})

    found = table.mapInPandas(scored, "_trusted boolean, bin int").groupBy("_trusted", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    out = np.zeros((2, SCORE_BINS), int)
    for r in found:
        out[int(r["_trusted"]), r["bin"]] = r["n"]
    return out[1], out[0]


def _thinned(rows: DataFrame, key: Column, seed: int, most: int) -> DataFrame:
    """About ``most`` rows of all, by hash of the key."""
    part = min(1.0, most / max(1, rows.count()))
    return rows.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < F.lit(math.ceil(part * 1_000_000)))


def fit_scorer(documents: DataFrame, trusted: DataFrame, key: str, text: str, fit_rows: int = FIT_ROWS) -> Scorer:
    """A scorer from all documents as the mixed kind and those whose key is in ``trusted`` as the good one.

    Both kinds are thinned to about ``fit_rows`` rows; a trusted text may be drawn as a mixed one too.
    """
    spark = documents.sparkSession
    prepare_workers(spark)
    keys = trusted.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct()
    texts = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    # At most about fit_rows keys, so the broadcast is bounded and the texts stay where they are.
    good = texts.join(F.broadcast(_thinned(keys, F.col("_key"), 5, fit_rows)), "_key")
    mixed = _thinned(texts, F.col("_key"), 7, fit_rows)

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"_trusted": frame["_trusted"], "_draw": frame["_draw"], "_numbers": list(_numbers(frame["_text"]))})

    # Rows of null or equal keys differ in their texts' hash.
    draw = F.xxhash64("_key", "_text", F.lit(19)).alias("_draw")
    rows = good.select(F.lit(True).alias("_trusted"), draw, "_text").unionAll(mixed.select(F.lit(False).alias("_trusted"), draw, "_text"))
    table = staged(rows.mapInPandas(measured, "_trusted boolean, _draw bigint, _numbers array<double>"), "quality-numbers")
    kinds = {r["_trusted"]: r["n"] for r in table.groupBy("_trusted").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return Scorer([np.zeros(0)] * NUMBERS, np.zeros(NUMBERS))
    levels = [k / BINS for k in range(1, BINS)]
    cuts = table.select(*[F.percentile(F.col("_numbers")[j], F.array(*map(F.lit, levels))).alias(f"c{j}") for j in range(NUMBERS)]).first()
    fresh = Scorer([np.unique(np.array(c, float)) for c in cuts], np.zeros(0))
    fresh.weights = np.zeros(fresh.starts[-1])
    half = F.pmod(F.shiftright(F.col("_draw"), 20), F.lit(2)) == 0
    first = fit_shards(table.filter(half), fresh, 0.5, sum(kinds.values()) // 2)
    prior = class_prior(*_counted_scores(table.filter(~half), first))
    return fit_shards(table, fresh, prior, sum(kinds.values()))


def with_quality(df: DataFrame, text: str, scorer: Scorer, score: str = "score") -> DataFrame:
    """``df`` with the probability that a text is good as a column ``score`` (which replaces one of that name)."""
    prepare_workers(df.sparkSession)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(scorer.scores(scorer.slots(_numbers(texts))))

    return df.withColumn(score, probability(F.col(text)))
