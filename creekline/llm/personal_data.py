"""Personal data: fixed shapes first, then identifiers found by the company they keep.

E-mail and IP addresses, card and phone numbers have shapes of their own. They seed a bootstrap:
the words around them are lexical patterns, and a pattern that mostly surrounds known entities
also names what else stands in its place. Spark scores the graph of patterns and instances in turns:
a pattern by the confidence of its distinct instances, an instance by that of its patterns. What patterns
of high confidence surround is found, whatever it looks like, if it has some digits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creekline.llm.common import prepare_workers, plain, shielded
from creekline.sources.sinks import staged

#: Kinds in their order; the last is what the bootstrap finds.
KINDS = ("email", "ip", "card", "phone", "id")
#: Rounds of scoring, least confidence of a pattern and of an instance, least distinct instances of a pattern.
ROUNDS, SURE, SUPPORT = 3, 0.75, 4
#: Characters around an entity in which its context words are looked for; least length and digits of a candidate.
LEFT, RIGHT, LEAST_LENGTH, LEAST_DIGITS = 120, 60, 6, 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its start only: where that fails, its later digits fail too.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_EDGES = ".,;:!?\"'()[]{}<>*#|"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted; failing matches are dropped without another try."""
    spans = [(s, 0, e) for s, e in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 40:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    spans.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _candidates(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Digit-bearing strings between white space, without base spans, punctuation and a name before ``=`` or ``:``."""
    done, k = 0, 0
    for m in _DIGITS.finditer(text):
        if m.start() < done:
            continue
        start, end = m.start(), m.end()
        while start > done and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        done = end
        while k < len(spans) and spans[k][2] <= start:
            k += 1
        if any(s < end and start < e for s, _, e in spans[k : k + 8]):
            continue
        cut = max(text.rfind("=", start, m.start()), text.rfind(":", start, m.start())) + 1
        start = max(start, cut)
        while start < end and text[start] in _EDGES:
            start += 1
        while end > start and text[end - 1] in _EDGES:
            end -= 1
        if end - start >= LEAST_LENGTH and sum(c.isdigit() for c in text[start:end]) >= LEAST_DIGITS:
            yield start, end


def patterns_around(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a place: the two words before it, and a word on either side."""
    before = text[max(0, start - LEFT) : start].lower().split()[-2:]
    after = text[end : end + RIGHT].lower().split()[:1]
    found = []
    if len(before) == 2:
        found.append(f"{before[0]} {before[1]} _")
    if before and before[-1][-1] in ":=":
        found.append(f"{before[-1]} _")
    if before and after:
        found.append(f"{before[-1]} _ {after[0]}")
    return found


SCANNED = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, _base string"
PLACES = "_places array<struct<s:int,e:int,seed:boolean,what:bigint,like:array<string>>>"


def scan(rows: DataFrame) -> DataFrame:
    """Base counts, digest, spans and every place that has a pattern, in place of the column ``_text`` of ``rows``."""
    prepare_workers(rows.sparkSession)
    kept = [(name, kind) for name, kind in rows.dtypes if name != "_text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for value in frame["_text"]:
                text = plain(value)
                spans = base_spans(text)
                counts = [sum(kind == k for _, kind, _ in spans) for k in range(4)]
                seen = [(s, e, True) for s, _, e in spans] + [(s, e, False) for s, e in _candidates(text, spans)]
                places = []
                for s, e, seed in seen:
                    if like := patterns_around(text, s, e):
                        what = xxhash.xxh64_intdigest(text[s:e].encode(), 6) - (1 << 63)
                        places.append({"s": s, "e": e, "seed": seed, "what": what, "like": like})
                base = listed(spans)
                out.append((*counts, hashlib.sha256(base.encode()).hexdigest(), base, places))
            new = pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "_base", "_places"])
            yield pd.concat([frame[[name for name, _ in kept]].reset_index(drop=True), new], axis=1)

    return rows.mapInPandas(run, ", ".join(f"{name} {kind}" for name, kind in kept) + f", {SCANNED}, {PLACES}")


def score_graph(graph: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Patterns and instances of high confidence, from distinct edges ``_like, _what, _seed``.

    A pattern is supported by instances that are sure by now, seeds or found in an earlier round alike, so
    each round reaches one step further from the seeds.
    """
    known = graph.groupBy("_what").agg(F.max(F.col("_seed").cast("double")).alias("_sure"))
    known = staged(known, "instances")
    for _ in range(rounds):
        judged = graph.join(known, "_what").groupBy("_like").agg(
            F.count(F.lit(1)).alias("_n"), F.sum("_sure").alias("_held"), F.sum((F.col("_sure") >= SURE).cast("int")).alias("_known")
        )
        # One doubtful instance more than was seen keeps small patterns modest.
        judged = judged.filter(F.col("_known") >= SUPPORT).withColumn("_p", F.col("_held") / (F.col("_n") + 1))
        patterns = staged(judged.select("_like", "_p"), "patterns")
        noisy_or = 1 - F.exp(F.sum(F.log1p(-F.least("_p", F.lit(0.999)))))
        reached = graph.join(patterns, "_like").groupBy("_what").agg(noisy_or.alias("_new"))
        known = staged(known.join(reached, "_what", "left").select(
            "_what", F.when(F.col("_sure") == 1, 1.0).otherwise(F.coalesce("_new", F.lit(0.0))).alias("_sure")
        ), "instances")
    return patterns.filter(F.col("_p") >= SURE), known.filter(F.col("_sure") >= SURE)


def found_spans(scanned: DataFrame) -> DataFrame:
    """``_row, _found``: (start, end) that the bootstrap adds to a text; a staged ``scan`` is its input."""
    places = scanned.select("_row", F.explode("_places").alias("p")).select(
        "_row", F.col("p.s").alias("_s"), F.col("p.e").alias("_e"), F.col("p.seed").alias("_seed"), F.col("p.what").alias("_what"), F.explode("p.like").alias("_like")
    )
    places = staged(places, "places")
    graph = staged(places.groupBy("_like", "_what").agg(F.max("_seed").alias("_seed")), "pattern-graph")
    patterns, instances = score_graph(graph)
    new = places.filter("not _seed").join(patterns.select("_like"), "_like").join(instances.select("_what"), "_what", "left_semi")
    return new.select("_row", "_s", "_e").distinct().groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_s", "_e"))).alias("_found"))


def find_personal_data(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row of ``df``.

    Counts and digest are of the base kinds; ``spans`` lists these and what the bootstrap adds (kind
    ``id``), by start, then kind. A null text is empty. Without seeds nothing is added. Keys may
    be null or repeated; other columns are not read; whole texts are searched.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    scanned = staged(scan(rows), "scanned")
    merged = scanned.join(found_spans(scanned), "_row", "left")
    found = F.coalesce("_found", F.array().cast("array<struct<_s:int,_e:int>>"))

    def part(x, i):
        return F.element_at(F.split(x, ":"), i)

    base = F.filter(F.split("_base", ","), lambda x: x != "")
    order = F.array(*[F.lit(k) for k in KINDS])
    every = F.concat(
        F.transform(base, lambda x: F.struct(part(x, 2).cast("int").alias("s"), F.array_position(order, part(x, 1)).cast("int").alias("k"), part(x, 3).cast("int").alias("e"))),
        F.transform(found, lambda x: F.struct(x["_s"].alias("s"), F.lit(len(KINDS)).alias("k"), x["_e"].alias("e"))),
    )
    text_of = F.transform(F.array_sort(every), lambda x: F.concat_ws(":", F.get(order, x["k"] - 1), x["s"].cast("string"), x["e"].cast("string")))
    return merged.select(F.col("_key").alias(key), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(text_of, ",").alias("spans"))


def redact(df: DataFrame, text: str) -> DataFrame:
    """``df`` with every span of personal data in ``text`` replaced by its kind in angle brackets.

    Where spans overlap, the stretch that they cover is replaced once, by the first one's kind.
    Null texts stay null, empty ones empty; long ones are read whole. The number of rows, their order aside, and all
    other columns stay, whatever their names; repeated rows stay repeated, and an empty table gives no rows.
    """
    return shielded(df, lambda rows, of: _redacted(rows, of[text]))


def _redacted(df: DataFrame, text: str) -> DataFrame:
    rows = staged(df.withColumn("_row", F.monotonically_increasing_id()), "to-redact")
    scanned = staged(scan(rows.select("_row", F.col(text).alias("_text"))), "scanned")
    spans = scanned.join(found_spans(scanned), "_row", "left").filter((F.col("_base") != "") | F.col("_found").isNotNull())
    spans = spans.select("_row", "_base", F.transform("_found", lambda x: F.concat_ws(":", x["_s"].cast("string"), x["_e"].cast("string"))).alias("_more"))

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, base: pd.Series, more: pd.Series) -> pd.Series:
        return pd.Series([_replaced(t, b, m) for t, b, m in zip(texts, base, more, strict=True)], dtype=object)

    prepare_workers(df.sparkSession)
    joined = rows.join(spans, "_row", "left")
    return joined.withColumn(text, replaced(F.col(text), F.col("_base"), F.col("_more"))).select(*df.columns)


def _replaced(text: str | None, base: str | None, more) -> str | None:
    if text is None or (not base and more is None):
        return text
    spans = []
    for item in (base or "").split(","):
        if item:
            kind, start, end = item.split(":")
            spans.append((int(start), KINDS.index(kind), int(end)))
    for item in [] if more is None else more:
        start, end = item.split(":")
        spans.append((int(start), len(KINDS) - 1, int(end)))
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]
