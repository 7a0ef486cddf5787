"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms, hashed to a fixed number of slots. The machine gives each slot
a weight and a short vector; a text's score adds the weights and the inner products of all pairs of its
terms' vectors, so pairs such as an insult beside a group's name count for more than their parts.

Fitting is iterative parameter mixing: shards of labelled rows take a few passes of AdaGrad each from the
same start, and the driver averages their parameters (a fixed size) before the next round.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creekline.llm.common import _Cache, prepare_workers, plain
from creekline.sources.sinks import staged

#: Slots of the hashed terms, and length of a slot's vector.
SLOTS, FACTORS = 1 << 18, 4
#: Labelled rows that the machine is fitted on, at most (about; chosen by hash).
FIT_ROWS = 40_000
#: Shards, rounds of mixing, and passes of a shard over its rows in a round.
SHARDS, ROUNDS, PASSES = 4, 6, 4
STEP, DECAY, BATCH = 0.3, 1e-5, 64
#: Lengths of the beginnings of a word that are terms too, and what is stripped from a word's ends.
BEGINNINGS, EDGES = (4, 5, 6), ".,;:!?\"'()[]|*#%&$"
#: Labelled texts that a slot must occur in, and standard errors by which its share of toxic texts must
#: differ from the other texts' share. All other slots would only teach single texts by heart.
LEAST_TEXTS, LEAST_ERRORS = 4, 4.5
#: Terms that a worker remembers the slot of.
REMEMBERED = 300_000


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    #: Slots that it was fitted on, sorted, in the order of its weights; None: all. Texts are cut to these before
    #: they are scored, as the scale of the vectors goes by the number of a text's slots.
    learnt: np.ndarray | None = None

    def told(self, slots: np.ndarray) -> np.ndarray:
        """Where the machine holds those of a text's sorted slots that it was fitted on."""
        return slots if self.learnt is None else _places(slots, self.learnt)

    @staticmethod
    def fresh(learnt: np.ndarray | None = None) -> Machine:
        """Starts alike for a slot whichever others are fitted; only fitted slots are held."""
        vectors = np.random.default_rng(11).normal(0, 0.02, (SLOTS, FACTORS)).astype(np.float32)
        vectors = vectors if learnt is None else vectors[learnt]
        return Machine(-1.0, np.zeros(len(vectors), np.float32), vectors, learnt)


def _places(slots: np.ndarray, learnt: np.ndarray) -> np.ndarray:
    if not len(learnt):
        return slots[:0]
    at = np.searchsorted(learnt, slots)
    at[at == len(learnt)] = 0
    return at[learnt[at] == slots].astype(np.int32)


def _term_slots(chunk: str) -> tuple[int, ...]:
    """Slots of a word and of its beginnings, as endings vary with grammar."""
    term = chunk.strip(EDGES)
    parts = {term, *(f"{term[:n]}-" for n in BEGINNINGS if len(term) > n)} if term else ()
    return tuple(zlib.crc32(x.encode()) % SLOTS for x in parts)


def term_cache() -> _Cache:
    return _Cache(_term_slots, REMEMBERED)


def terms(text: str, cache: _Cache) -> np.ndarray:
    """Distinct slots of the whole text's terms, in order."""
    found: set[int] = set()
    found.update(*map(cache.__getitem__, set(text.lower().split())))
    return np.sort(np.fromiter(found, np.int32, len(found)))


def _forward(machine: Machine, slots: np.ndarray, first: np.ndarray, owner: np.ndarray, scale: np.ndarray):
    """Raw score of each text, and what the gradient needs again."""
    own = machine.vectors[slots] * scale[owner, None]
    total = np.add.reduceat(own, first)
    squares = np.add.reduceat(own * own, first)
    linear = np.add.reduceat(machine.weights[slots], first)
    return machine.bias + linear + 0.5 * (total * total - squares).sum(1), own, total


def _batch(texts: list[np.ndarray]):
    """An empty text holds slot 0 with no weight, as ``reduceat`` needs one entry for each."""
    width = np.array([len(x) for x in texts])
    scale = (1 / np.sqrt(np.maximum(width, 1))).astype(np.float32)
    return width, scale


def raw_scores(machine: Machine, texts: list[np.ndarray]) -> np.ndarray:
    width, scale = _batch(texts)
    out = np.full(len(texts), machine.bias)
    full = np.flatnonzero(width)
    if len(full):
        slots = np.concatenate([texts[i] for i in full])
        owner = np.repeat(np.arange(len(full)), width[full])
        first = np.cumsum(width[full]) - width[full]
        out[full] = _forward(machine, slots, first, owner, scale[full])[0]
    return out


def train(machine: Machine, texts: list[np.ndarray], labels: np.ndarray, seed: int) -> Machine:
    """A few passes of AdaGrad from ``machine`` over these rows."""
    weights, vectors, bias = machine.weights.copy(), machine.vectors.copy(), machine.bias
    moved_w, moved_v, moved_b = np.full(len(weights), 1e-3, np.float32), np.full(vectors.shape, 1e-3, np.float32), 1e-3
    # Texts without any slot move the bias alone: a share of them goes with every batch.
    full = np.array([len(x) > 0 for x in texts], bool)
    rows = np.flatnonzero(full)
    bare, bare_toxic = int((~full).sum()), float(labels[~full].sum())
    if not len(rows):
        share = (float(labels.sum()) + 0.5) / (len(labels) + 1)
        return Machine(float(np.log(share / (1 - share))), weights, vectors, machine.learnt)
    order = np.random.default_rng(seed)
    for _ in range(PASSES):
        order.shuffle(rows)
        for at in range(0, len(rows), BATCH):
            pick = rows[at : at + BATCH]
            own_texts = [texts[i] for i in pick]
            width, scale = _batch(own_texts)
            slots, owner = np.concatenate(own_texts), np.repeat(np.arange(len(pick)), width)
            score, own, total = _forward(Machine(bias, weights, vectors), slots, np.cumsum(width) - width, owner, scale)
            error = ((1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[pick]) / len(pick)).astype(np.float32)
            seen, place = np.unique(slots, return_inverse=True)
            step_w = np.bincount(place, error[owner], len(seen)).astype(np.float32) + DECAY * weights[seen]
            pull = error[owner, None] * scale[owner, None] * (total[owner] - own)
            step_v = np.stack([np.bincount(place, pull[:, k], len(seen)) for k in range(FACTORS)], 1).astype(np.float32) + DECAY * vectors[seen]
            moved_w[seen] += step_w**2
            moved_v[seen] += step_v**2
            part = len(pick) / len(rows)
            step_b = float(error.sum()) * len(pick) + part * (bare / (1 + np.exp(-bias)) - bare_toxic)
            step_b /= len(pick) + part * bare
            moved_b += step_b**2
            weights[seen] -= STEP * step_w / np.sqrt(moved_w[seen])
            vectors[seen] -= STEP * step_v / np.sqrt(moved_v[seen])
            bias -= STEP * step_b / moved_b**0.5
    return Machine(bias, weights, vectors, machine.learnt)


def telling_slots(table: DataFrame, kinds: dict[int, int]) -> np.ndarray:
    """Slots that tell the labels apart, sorted; every labelled row is counted, tasks add up their own first."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, SLOTS), np.int64)
        for frame in frames:
            for slots, label in zip(frame["_slots"], frame["_label"], strict=True):
                sums[label][np.frombuffer(slots, np.int32)] += 1
        seen = np.flatnonzero(sums.sum(0))
        yield pd.DataFrame({"_slot": seen.astype(np.int32), "_clean": sums[0][seen], "_toxic": sums[1][seen]})

    counts = table.mapInPandas(count, "_slot int, _clean bigint, _toxic bigint").groupBy("_slot").agg(
        F.sum("_clean").alias("_clean"), F.sum("_toxic").alias("_toxic")
    )
    clean, toxic = F.lit(float(kinds[0])), F.lit(float(kinds[1]))
    rate = (F.col("_clean") + F.col("_toxic")) / (clean + toxic)
    error = F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-12)) * (1 / clean + 1 / toxic))
    differs = F.abs(F.col("_toxic") / toxic - F.col("_clean") / clean) >= LEAST_ERRORS * error
    kept = counts.filter((F.col("_clean") + F.col("_toxic") >= LEAST_TEXTS) & differs).select("_slot").collect()
    return np.array(sorted(r["_slot"] for r in kept), np.int32)


def _shard_pass(shared, turn: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)  # a shard: its part of about FIT_ROWS rows, cut to telling slots
        frame = pd.concat(held) if held else pd.DataFrame({"_slots": []})
        if len(frame):
            texts = [np.frombuffer(x, np.int32) for x in frame["_slots"]]
            done = train(shared.value, texts, frame["_label"].to_numpy(np.float32), turn)
            yield pd.DataFrame({"n": [len(frame)], "bias": [done.bias], "weights": [done.weights.tobytes()], "vectors": [done.vectors.tobytes()]})

    return run


def fit(labelled: DataFrame, key: str, text: str, label: str) -> Machine:
    """A machine from the rows of ``labelled`` with a label of 0 or 1; all others are left out.

    ``bounded_labels`` keeps their number within bounds. Unless both labels occur, the machine
    scores by its starting bias.
    """
    prepare_workers(labelled.sparkSession)
    # Shards by key: equal texts must not meet in one.
    shard = F.pmod(F.xxhash64(F.col(key), F.lit(13)), F.lit(SHARDS)).cast("int")
    rows = labelled.select(F.col(text).alias("_text"), F.col(label).cast("int").alias("_label"), shard.alias("_shard")).filter("_label in (0, 1)")

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = term_cache()
        for frame in frames:
            yield frame.drop(columns="_text").assign(_slots=[terms(plain(x), cache).tobytes() for x in frame["_text"]])

    kind = "_label int, _shard int, _slots binary"
    table = staged(rows.mapInPandas(hashed, kind), "toxic-terms")
    kinds = {r["_label"]: r["n"] for r in table.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return Machine.fresh(np.zeros(0, np.int32))
    telling = telling_slots(table, kinds)
    # What is sent to the shards and comes back is as large as the telling slots are many.
    machine = Machine.fresh(telling)

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(_slots=[_places(np.frombuffer(x, np.int32), telling).tobytes() for x in frame["_slots"]])

    # Every round deals these out to the shards again, so they hold what is learnt from and no more.
    table = staged(table.mapInPandas(told, kind), "telling-terms").repartitionById(SHARDS, "_shard")
    for turn in range(ROUNDS):
        shared = labelled.sparkSession.sparkContext.broadcast(machine)
        parts = table.mapInPandas(_shard_pass(shared, turn), "n bigint, bias double, weights binary, vectors binary").collect()
        share = np.array([p["n"] for p in parts], float)
        share /= share.sum()
        machine = Machine(
            float(sum(s * p["bias"] for s, p in zip(share, parts, strict=True))),
            sum(np.float32(s) * np.frombuffer(p["weights"], np.float32) for s, p in zip(share, parts, strict=True)),
            sum(np.float32(s) * np.frombuffer(p["vectors"], np.float32).reshape(-1, FACTORS) for s, p in zip(share, parts, strict=True)),
            telling,
        )
        shared.destroy()
    return machine


def with_scores(df: DataFrame, text: str, machine: Machine, score: str = "score") -> DataFrame:
    """``df`` with the probability of toxicity added. A null text is empty; the empty text has the
    machine's base rate. Every row stays, repeated ones too."""
    shared = df.sparkSession.sparkContext.broadcast(machine)
    prepare_workers(df.sparkSession)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = term_cache()
        for texts in batches:
            raw = raw_scores(shared.value, [shared.value.told(terms(plain(x), cache)) for x in texts])
            yield pd.Series(1 / (1 + np.exp(-np.clip(raw, -30, 30))))

    return df.withColumn(score, probability(F.col(text)))


def bounded_labels(labels: DataFrame, key: str, label: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One label per key (the larger, if they differ), thinned by hash to about ``fit_rows`` keys."""
    one = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias(label))
    total = max(1, one.count())
    part = min(1.0, fit_rows / total)
    return one.filter(F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(1_000_000)) < F.lit(int(part * 1_000_000)))


def fit_machine(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> Machine:
    """A machine from the documents whose key has a label; the labels that are joined are bounded."""
    sample = bounded_labels(labels, key, label).select(F.col(key).alias("_labelled"), F.col(label).alias("_label_in"))
    # At most about FIT_ROWS rows of a key and a number: safe to broadcast, and texts stay where they are.
    rows = documents.join(F.broadcast(sample), F.col(key) == F.col("_labelled"))
    return fit(rows, "_labelled", text, "_label_in")
