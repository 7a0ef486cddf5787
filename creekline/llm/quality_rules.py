"""Weak supervision over quality rules, in DataFrame functions alone.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation estimates, without
labels, how often each rule casts each vote on good and on bad texts and how many texts are good; the
posterior probability that a text is good then takes the place of "all rules must pass".

Votes are grouped before anything is estimated: m rules give 3^m patterns at most, so a step of
the estimation sums over a small table, whatever the corpus. Texts are read once; what the
rules need of them is written as a narrow table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creekline.sources.sinks import staged

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Rounds of estimation, the least evidence of a bad vote, bounds of the share of good texts, and where the evidence of a vote of -1, 0, 1 starts.
ROUNDS = 25
LEAST = 0.5
PRIOR_LEAST, PRIOR_MOST = 0.5, 0.98
START = (-5.0, 0.0, 0.3)


def words_of(text: Column) -> Column:
    """Words between ASCII white space; null gives none."""
    spaced = F.coalesce(text, F.lit(""))
    for sign in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(sign), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def _times(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign)))


def with_text_features(df: DataFrame, text: str) -> DataFrame:
    """``df`` (columns of whose names none may start with ``_q``) with the features of a whole text."""
    bare = F.col("_qtext")
    df = df.withColumn("_qtext", F.coalesce(F.col(text), F.lit(""))).withColumn("_qwords", words_of(bare))
    lines = F.filter(F.split(bare, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    hashes = F.transform("_qwords", lambda x: F.xxhash64(x))
    df = df.withColumns({"_qlines": lines, "_qhashes": hashes, "_qn": F.size("_qwords")})
    windows = F.when(
        F.col("_qn") >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.col("_qn") - WINDOW),
            lambda i: F.xxhash64(*[F.get(F.col("_qhashes"), i + k) for k in range(WINDOW)]),
        ),
    )
    df = df.withColumn("_qwindows", windows)
    # Only texts with a repeated window pay for finding where it stands.
    repeated = F.size(F.array_distinct("_qwindows")) < F.size("_qwindows")
    ordered = F.when(repeated, F.sort_array(F.transform("_qwindows", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
    df = df.withColumn("_qsorted", ordered)

    def same(i: Column, j: Column) -> Column:
        return F.coalesce(F.get(F.col("_qsorted"), i)["h"] == F.get(F.col("_qsorted"), j)["h"], F.lit(False))

    twice = F.transform("_qsorted", lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["p"]))
    df = df.withColumn("_qtwice", F.sort_array(F.filter(twice, lambda x: x.isNotNull())))
    # Windows overlap: each adds the words past the end of the one before.
    covered = F.aggregate(
        "_qtwice", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end")),
    )["n"]
    big = lambda c: c.cast("bigint")
    return df.withColumns({
        "n_words": big(F.col("_qn")),
        "word_chars": big(F.length(F.array_join("_qwords", ""))),
        "n_symbols": big(reduce(lambda a, b: a + b, [_times(bare, s) for s in SYMBOLS])),
        "n_dup_lines": big(F.size("_qlines") - F.size(F.array_distinct("_qlines"))),
        "n_repeat_words": big(F.coalesce(covered, F.lit(0))),
        "_q_lines": big(F.size("_qlines")),
        "_q_distinct": big(F.size(F.array_distinct("_qhashes"))),
        "_q_shouts": big(_times(bare, "!")),
        "_q_capitals": big(F.length(bare) - F.length(F.regexp_replace(bare, "[A-Z]", ""))),
    }).drop("_qtext", "_qwords", "_qlines", "_qhashes", "_qwindows", "_qsorted", "_qtwice", "_qn")


def base_failed() -> Column:
    """Too few words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, -1)
    return (vote if good is None else vote.when(good, 1)).otherwise(0).cast("tinyint")


def rules() -> dict[str, Column]:
    """The rules' votes over the features. Rules about one kind of junk can only vote bad: that a
    text has no symbols says little for it."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    length = F.col("word_chars") / n
    return {
        "v_length": _vote(F.col("n_words") < 10, F.col("n_words") >= 40),
        "v_word_length": _vote((length < 2) | (length > 15), length.between(3, 10)),
        "v_symbols": _vote(F.col("n_symbols") > 0.2 * n),
        "v_lines": _vote(F.col("n_dup_lines") > 0.3 * F.col("_q_lines")),
        "v_repeats": _vote(F.col("n_repeat_words") > 0.15 * n),
        "v_variety": _vote((F.col("_q_distinct") < 0.2 * n) & n.between(30, 1000)),
        "v_capitals": _vote((F.col("_q_capitals") > 0.4 * F.col("word_chars")) & (n >= 10)),
        "v_shouts": _vote(F.col("_q_shouts") > 0.2 * n),
    }


@dataclass(frozen=True)
class Estimate:
    """``evidence[rule]``: log-odds of "good" that a vote of -1, 0, 1 adds; ``odds``: those before any vote."""

    evidence: dict[str, list[float]]
    odds: float


def posterior(found: Estimate) -> Column:
    """Probability of "good" from the votes, each by what it has turned out to be worth."""
    total = F.lit(found.odds)
    for name, (bad, none, good) in found.evidence.items():
        total = total + F.when(F.col(name) < 0, bad).when(F.col(name) > 0, good).otherwise(none)
    return 1 / (1 + F.exp(-total))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(array: Column, each) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + each(x))


def _round(patterns: Column, state: Column, rules_: int) -> Column:
    """One step: posterior of every pattern, then each vote's rate among good and among bad texts.

    An abstention adds no evidence, and no vote counts for its contrary: rules are better than chance,
    which is what tells the two classes apart.
    """

    def judge() -> Column:
        return F.transform(patterns, lambda x: F.struct(
            x["n"].alias("n"), x["v"].alias("v"),
            (1 / (1 + F.exp(-F.aggregate(
                F.zip_with(x["v"], state["e"], lambda v, e: F.get(e, v + 1)), state["o"], lambda a, b: a + b
            )))).alias("g"),
        ))

    def maximise(judged: Column) -> Column:
        good = _total(judged, lambda x: x["n"] * x["g"])
        bad = _total(judged, lambda x: x["n"] * (1 - x["g"]))

        def worth(sums: Column) -> Column:
            def rate(j: Column, vote: Column) -> Column:
                cast = lambda side: _total(judged, lambda x: F.when(F.get(x["v"], j) == vote, x["n"] * side(x["g"])).otherwise(0.0))
                # A pseudo-vote of each kind keeps votes that nobody cast at no evidence.
                among_good = (cast(lambda g: g) + 1.0) / (sums["g"] + 3.0)
                among_bad = (cast(lambda g: 1 - g) + 1.0) / (sums["b"] + 3.0)
                return F.log(among_good) - F.log(among_bad)

            prior = F.greatest(F.lit(PRIOR_LEAST), F.least(F.lit(PRIOR_MOST), (sums["g"] + 1.0) / (sums["g"] + sums["b"] + 2.0)))
            return F.struct(
                F.transform(F.sequence(F.lit(0), F.lit(rules_ - 1)), lambda j: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda v: F.when(v == 0, 0.0).when(v < 0, F.least(rate(j, v), F.lit(-LEAST))).otherwise(F.greatest(rate(j, v), F.lit(0.0))))).alias("e"),
                F.log(prior / (1 - prior)).alias("o"),
            )

        return _let(F.struct(good.alias("g"), bad.alias("b")), worth)

    return _let(judge(), maximise)


def estimate(votes: DataFrame, names: Sequence[str], rounds: int = ROUNDS) -> Estimate:
    """Each rule's accuracy among good and among bad texts, and the share of good ones, by
    expectation-maximisation (both classes have a rate for each vote and rule).

    All rows of ``votes`` count; they are summed to at most 3^m patterns first, and all rounds run over
    those in one expression. An empty table leaves votes without evidence.
    """
    pattern = F.array(*[F.col(name).cast("int") for name in names])
    patterns = votes.groupBy(pattern.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    start = F.struct(
        F.array_repeat(F.array(*[F.lit(x) for x in START]), len(names)).alias("e"), F.lit(math.log(4.0)).alias("o")
    )
    found = (
        patterns.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("_patterns"))
        .select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: _round(F.col("_patterns"), s, len(names))).alias("s"))
        .select("s.e", "s.o").first()
    )
    return Estimate(dict(zip(names, found["e"], strict=True)), found["o"])


def judge_quality(df: DataFrame, key: str, text: str, threshold: float = 0.5) -> DataFrame:
    """``key``, the five base features, ``base_failed``, ``kept``, ``p_good`` and every vote, per row.

    ``kept`` is false where the base fails, else whether the posterior reaches ``threshold``.
    A null text has no words and fails the base. Every row gives a row, also with null or
    repeated keys; other columns are not read. Texts are never cut.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    votes = rules()
    judged = with_text_features(rows, "_text").withColumns(votes).drop("_text", "_q_lines", "_q_distinct", "_q_shouts", "_q_capitals")
    table = staged(judged, "quality")
    found = estimate(table, list(votes))
    return table.withColumn("base_failed", base_failed()).withColumn("p_good", posterior(found)).select(
        F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("p_good") >= threshold)).alias("kept"), "p_good", *votes,
    )
