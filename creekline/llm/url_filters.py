"""URL filter: host rules first, then a ratio of two character language models.

Two variable-order Markov models, one of accepted and one of rejected URLs, give every character a
probability from its longest known context, interpolated down to shorter ones (Witten-Bell). A
URL's score is the difference of its log-likelihoods, divided by its length. A logistic curve
fitted on URLs kept out of the models turns the score into a probability of rejection.

All labelled URLs are counted, each where it lies. Contexts are hashed to a fixed number of slots, so
the models that are broadcast have one size whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creekline.llm.common import prepare_workers, plain
from creekline.sources.sinks import staged

#: Longest context in bytes, and slots per order: 2 models x 5 orders x 3 arrays x 0.5 MB.
ORDER = 4
SLOTS = 1 << 17
#: Bars of the score histogram that the calibration is fitted on, and the scores' range.
BARS, RANGE = 2000, 10.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and where there is no ``://``."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as its index from 0; null if none does. Ties: the first given."""
    ordered = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), i))
    found = F.lit(None).cast("int")
    for i in reversed(ordered):
        rule = rules[i]
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(i)).otherwise(found)
    return found


def _grams(urls: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Per character: its URL, the context slot of every order, and the byte itself."""
    raw = [plain(u).encode() + b"\x03" for u in urls]
    width = np.fromiter((len(x) for x in raw), np.int64, len(raw))
    owner = np.repeat(np.arange(len(raw)), width)
    joined = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    place = np.arange(len(joined)) - np.repeat(np.cumsum(width) - width, width)
    context, slots = np.zeros(len(joined), np.uint64), []
    for order in range(ORDER + 1):
        if order:
            before = np.zeros_like(joined)
            before[order:] = joined[:-order]
            before[place < order] = 2  # before the URL's start
            context = context * np.uint64(257) + before + np.uint64(1)
        slots.append(_slot(context + np.uint64(order << 48)))
    return owner, slots, joined


def _slot(key: np.ndarray) -> np.ndarray:
    mixed = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(SLOTS)).astype(np.int64)


def _gram_slot(slot: np.ndarray, sign: np.ndarray) -> np.ndarray:
    return _slot(slot.astype(np.uint64) * np.uint64(256) + sign.astype(np.uint64))


def fit_models(labelled: DataFrame) -> np.ndarray:
    """Float array (class, kind, order, slot); kinds: count of a gram, of a context, distinct signs after it.

    ``labelled`` has ``_url`` and ``_class`` (0 accepted, 1 rejected). Every row is counted. What
    reaches the driver is one row at most per class, kind, order and slot.
    """
    prepare_workers(labelled.sparkSession)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, part in frame.groupby("_class"):
                _, slots, signs = _grams(list(part["_url"]))
                for order, slot in enumerate(slots):
                    seen, n = np.unique(slot * 256 + signs.astype(np.int64), return_counts=True)
                    yield pd.DataFrame({
                        "_class": int(name), "_order": order, "_slot": seen // 256, "_n": n,
                        "_gram": _gram_slot(seen // 256, seen % 256),
                    })

    counted = labelled.mapInPandas(count, "_class int, _order int, _slot bigint, _n bigint, _gram bigint")
    cells = staged(counted.groupBy("_class", "_order", "_slot", "_gram").agg(F.sum("_n").alias("_n")), "url-grams")
    grams = cells.groupBy("_class", "_order", F.col("_gram").alias("_slot")).agg(
        F.sum("_n").alias("_n"), F.lit(0).cast("bigint").alias("_signs")
    )
    contexts = cells.groupBy("_class", "_order", "_slot").agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_signs"))
    model = np.zeros((2, 3, ORDER + 1, SLOTS), np.float32)
    for table, kind in ((grams, 0), (contexts, 1)):
        own = table.toArrow()
        at = [own[x].to_numpy() for x in ("_class", "_order", "_slot", "_n", "_signs")]
        model[at[0], kind, at[1], at[2]] = at[3]
        if kind:
            model[at[0], 2, at[1], at[2]] = at[4]
    return model


def ratio(model: np.ndarray, urls: Sequence[str]) -> np.ndarray:
    """Mean log-likelihood difference per byte, rejected less accepted, of each URL."""
    owner, slots, signs = _grams(urls)
    logs = []
    for own in model:
        p = np.full(len(signs), 1 / 257)
        for order, slot in enumerate(slots):
            n, kinds = own[1, order, slot], own[2, order, slot]
            gram = own[0, order, _gram_slot(slot, signs)]
            mixed = (np.minimum(gram, n) + kinds * p) / np.maximum(n + kinds, 1)
            p = np.where(n > 0, mixed, p)
        logs.append(np.log(np.maximum(p, 1e-12)))
    size = np.bincount(owner, minlength=len(urls))
    return np.bincount(owner, logs[1] - logs[0], minlength=len(urls)) / np.maximum(size, 1)


def calibrate(bars: Sequence[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of the rejection probability from (score, class, count) bars; a pseudo-count on either side keeps both finite."""
    score = np.array([x[0] for x in bars] + [1.0, -1.0])
    label = np.array([x[1] for x in bars] + [1, 0], float)
    count = np.array([x[2] for x in bars] + [1, 1], float)
    # Both classes weigh the same: how many URLs the rules happen to name says nothing about the rest.
    for name in (0, 1):
        count[label == name] /= count[label == name].sum()
    theta = np.array([1.0, 0.0])
    basis = np.stack([score, np.ones_like(score)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(basis @ theta, -30, 30)))
        slope = basis.T @ (count * (p - label)) + 1e-3 * theta
        curve = (basis * (count * p * (1 - p))[:, None]).T @ basis + 1e-3 * np.eye(2)
        theta = theta - np.linalg.solve(curve, slope)
    return float(max(theta[0], 1e-6)), float(theta[1])


def _scored(df: DataFrame, model: np.ndarray) -> DataFrame:
    """``df`` with ``_score`` added; ``_url`` must be among its columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    prepare_workers(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(_score=ratio(shared.value, list(frame["_url"])) if len(frame) else [])

    kinds = ", ".join(f"{name} {kind}" for name, kind in df.dtypes)
    return df.mapInPandas(run, f"{kinds}, _score double")


def filter_urls(df: DataFrame, key: str, url: str, rules: Sequence[Rule]) -> DataFrame:
    """``key, host, path, rule, verdict, score, p_reject`` for every row of ``df``.

    A rule's verdict stands. Elsewhere the models decide: ``block`` where the calibrated
    probability of rejection is over a half. The rules' own URLs are what the models learn from,
    but for a fifth by hash, which calibrates them. Null, empty and odd URLs have empty host and
    path, fit no rule and are scored as the empty text. With no URL that a rule fits, both models are
    empty, every score is 0 and all are allowed. Repeated rows and keys each give a row; other
    columns are not read.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(url).alias("_url"))
    host, path = url_parts(F.col("_url"))
    rows = rows.withColumns({"_host": host, "_path": path})
    rows = rows.withColumn("_rule", matching_rule(F.col("_host"), F.col("_path"), rules))
    rejects = [i for i, r in enumerate(rules) if r.verdict == "block"]
    named = rows.filter(F.col("_rule").isNotNull()).select(
        "_url", F.col("_rule").isin(rejects).cast("int").alias("_class"),
        (F.pmod(F.xxhash64("_url", F.lit(5)), F.lit(5)) == 0).alias("_kept_out"),
    )
    model = fit_models(named.filter("not _kept_out").select("_url", "_class"))
    held = _scored(named.filter("_kept_out").select("_url", "_class"), model)
    bar = F.floor((F.greatest(F.least("_score", F.lit(RANGE)), F.lit(-RANGE)) + RANGE) * (BARS / (2 * RANGE)))
    bars = held.groupBy(bar.alias("_bar"), "_class").agg(F.count(F.lit(1)).alias("_n")).collect()
    slope, offset = calibrate([((r["_bar"] + 0.5) * (2 * RANGE / BARS) - RANGE, r["_class"], r["_n"]) for r in bars])
    p = 1 / (1 + F.exp(-(F.col("_score") * F.lit(slope) + F.lit(offset))))
    texts = F.array(*[F.lit(r.text) for r in rules]) if rules else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array().cast("array<string>")
    return _scored(rows, model).select(
        F.col("_key").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.get(texts, F.col("_rule")).alias("rule"),
        F.coalesce(F.get(verdicts, F.col("_rule")), F.when(p > 0.5, "block").otherwise("allow")).alias("verdict"),
        F.col("_score").alias("score"), p.alias("p_reject"),
    )
