"""Audit of how text filters interact: what each removes, in every order they could run in.

Filters that run one after another hide each other's work. A set of filters that has already run is a state of a
lattice, and running one more is an edge to the next state. What an edge removes depends on its two states alone,
never on the order that led there, so documents are counted once per edge: by the set of filters that each one
fails, which is at most 2^n counts a part, whatever the number of documents. Counting the paths forward from the
empty set and backward from the full one says in how many orders an edge is taken. These counts weight the edges for
the Shapley value, and the steps of every single order are read from the same edges.

Nulls, empty tables and the like: a null text is the empty text, a null part the empty string. Two documents without
a key are neither smaller nor larger than any other, so such a document never counts as a copy and makes none.
Rows repeated with one key are not copies of each other, as neither key is smaller. A label table may repeat a key:
one mark suffices. Extra columns are not read, so their names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creekline.llm.common import WHITE

#: The five filters of ``text_failures`` and ``with_copies``, in the order of their bits.
LETTERS = "ABCDE"
#: Orders are listed one by one, so filters are few.
MOST_FILTERS = 6


@dataclass(frozen=True)
class Edge:
    """Running filter ``index`` after those in ``state`` (a set of bits)."""

    state: int
    index: int
    #: Orders that reach the state, and orders that lead on from the next one to the full set.
    reaching: int
    leaving: int

    @property
    def paths(self) -> int:
        return self.reaching * self.leaving


def lattice(n: int) -> list[Edge]:
    """All edges of the lattice of sets of ``n`` filters, with their path counts."""
    full = (1 << n) - 1
    reaching, leaving = [0] * (full + 1), [0] * (full + 1)
    reaching[0] = leaving[full] = 1
    for state in range(full + 1):  # a set comes after all of its subsets
        for i in range(n):
            if not state >> i & 1:
                reaching[state | 1 << i] += reaching[state]
    for state in range(full, -1, -1):
        for i in range(n):
            if not state >> i & 1:
                leaving[state] += leaving[state | 1 << i]
    return [Edge(s, i, reaching[s], leaving[s | 1 << i]) for s in range(full + 1) for i in range(n) if not s >> i & 1]


def orders_through(letters: str) -> dict[tuple[int, int], list[str]]:
    """The orders that take each edge (state, filter)."""
    found: dict[tuple[int, int], list[str]] = {}
    for order in map("".join, permutations(letters)):
        state = 0
        for letter in order:
            at = letters.index(letter)
            found.setdefault((state, at), []).append(order)
            state |= 1 << at
    return found


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: too few words, too few distinct ones, too many capitals, or markup signs."""
    words = F.array_remove(F.split(text, f"[{WHITE}]+"), "")

    def judged(word: Column) -> Column:
        n, distinct = F.size(word), F.size(F.array_distinct(word))
        return F.when(n < 50, 1).otherwise(0) + F.when(100 * distinct < 65 * n, 2).otherwise(0)

    # One lambda over a list of one keeps the words from being made once for every use.
    of_words = F.transform(F.array(words), judged)[0]
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return (
        of_words
        + F.when(100 * capitals > 5 * F.length(text), 4).otherwise(0)
        + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
    ).cast("int")


def failure_counts(documents: DataFrame, labels: DataFrame, key: str, text: str, part: str, good: str, toxic: str) -> DataFrame:
    """``part, failed, n, n_good, n_toxic``: documents by the set of filters that they fail.

    Copies are found by a digest of the whole text, table-wide. Rows are first summed per key and digest, so neither a
    text nor a key that a third of all rows share ends up in one task: what is left of it is one row a part.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(
        F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(body, 256)).alias("digest"), text_failures(body).alias("failed"),
    )
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("marked")).agg(
        F.coalesce(F.max(F.col(good) == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col(toxic) == 1), F.lit(False)).alias("toxic")
    )
    traits = ["digest", "part", "failed", "good", "toxic"]
    marked = rows.join(marks, rows["id"] == marks["marked"], "left").select(
        "id", "digest", "part", "failed", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    )
    by_key = marked.groupBy("id", *traits).agg(F.count(F.lit(1)).alias("n"))
    named = F.col("id").isNotNull()
    by_text = by_key.groupBy(*traits).agg(
        F.sum("n").alias("n"), F.sum(F.when(named, F.col("n")).otherwise(0)).alias("named"),
        F.min(F.when(named, F.struct("id", "n"))).alias("first"),
    )
    least = F.min("first.id").over(Window.partitionBy("digest"))
    copies = F.col("named") - F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = by_text.withColumn("least", least).withColumn("copies", copies).select(
        "part", "good", "toxic",
        F.inline(F.array(
            F.struct(F.col("failed"), (F.col("n") - F.col("copies")).alias("n")),
            F.struct(F.col("failed").bitwiseOR(F.lit(16)).alias("failed"), F.col("copies").alias("n")),
        )),
    )
    return split.filter("n > 0").groupBy("part", "failed").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(f"n_{c}") for c in ("good", "toxic")]
    )


def edge_counts(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Per part and edge of the lattice: what stays, what goes, and the edge's share of the Shapley value."""
    edges = lattice(len(letters))
    if len(letters) > MOST_FILTERS:
        raise ValueError(f"orders of more than {MOST_FILTERS} filters are too many to list")
    listed = F.array(*[
        F.struct(F.lit(k).alias("edge"), F.lit(e.state).alias("state"), F.lit(1 << e.index).alias("bit"), F.lit(e.paths).cast("long").alias("paths"))
        for k, e in enumerate(edges)
    ])
    met = counts.select("*", F.inline(listed))
    failed, state, bit = F.col("failed"), F.col("state"), F.col("bit")
    fails, earlier = failed.bitwiseAND(bit) != 0, failed.bitwiseAND(state) != 0
    def total(which: Column, n: str) -> Column:
        return F.sum(F.when(which, F.col(n)).otherwise(0)).cast("long")

    per_edge = met.groupBy("part", "edge", "state", "bit", "paths").agg(
        total(~earlier & ~fails, "n").alias("kept"), total(~earlier & fails, "n").alias("removed"),
        total(earlier & fails, "n").alias("redundant"), total(failed == bit, "n").alias("unique_fails"),
        total(~earlier & fails, "n_good").alias("good_lost"), total(~earlier & fails, "n_toxic").alias("toxic_lost"),
    )
    shares = F.sum(F.col("removed") * F.col("paths")).over(Window.partitionBy("part", "bit"))
    return per_edge.withColumn("shapley", shares)


def order_steps(edges: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order and step, read from the counts of ``edge_counts``."""
    through = orders_through(letters)
    listed = F.array(*[F.array(*map(F.lit, through[e.state, e.index])) for e in lattice(len(letters))])
    return edges.withColumn("filter_order", F.explode(F.element_at(listed, F.col("edge") + 1))).select(
        "part", "filter_order", (F.bit_count("state") + 1).cast("int").alias("step"),
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def audit_filters(documents: DataFrame, labels: DataFrame, key: str, text: str, part: str, good: str, toxic: str) -> DataFrame:
    """All orders of the five filters over ``documents``, step by step and part by part; zeros are rows too."""
    return order_steps(edge_counts(failure_counts(documents, labels, key, text, part, good, toxic)))


def audit_sql() -> str:
    """The same in SQL, order by order: every document is judged at every step of every order."""
    return r"""
WITH judged AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), failures AS (
  SELECT j.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN j.doc_id > min(j.doc_id) OVER (PARTITION BY body) THEN 'E' ELSE '' END AS failed
  FROM judged j LEFT JOIN marks m ON j.doc_id = m.doc_id
), cells AS (
  SELECT part, failed, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM failures GROUP BY part, failed
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step:step] AS f, filter_order[1:step - 1] AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), met AS (
  SELECT part, filter_order, step, f, n, n_good, n_toxic, contains(failed, f) AS fails, failed = f AS alone,
    earlier <> '' AND regexp_matches(failed, '[' || CASE WHEN earlier = '' THEN '_' ELSE earlier END || ']') AS gone
  FROM cells, steps
), counted AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND fails THEN n_good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""
