"""Mixing sources to target weights (operator 2) by subset-sum budget fitting.

A source with budget T and size S gives every document floor(T / S) times, and
the rest of the budget once more to a part of them. That part is fitted on the
counts of documents by exact length alone: from the longest length down, each
gives its even share, which leaves a rest below the longest length; a
bounded-knapsack search over the documents still free then fills the rest to
the word where it can. Last, each length picks that many documents by a seeded
hash of their id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, few_rows, saved

#: Words that the even shares leave to the knapsack search.
RESERVE = 1 << 15
#: Documents that one task orders by hash at a time; larger groups of one length are cut into slots of about this many.
SLOT = 5_000


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0))


def budgets(sizes: list[tuple[str | None, int]], weight: Callable[[int], int] = lambda i: 1 + i % 3, times: int = 3) -> dict[str | None, float]:
    """Target of each source: all words shared by weight, none above ``times`` its size, the excess shared again.

    Sources stand in order of code point, NULL last; ``weight`` takes the place in that order.
    """
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weights = {name: weight(i) for i, (name, _) in enumerate(ordered)}
    cap, left, out = {name: times * size for name, size in ordered}, float(sum(n for _, n in sizes)), {}
    free = [name for name, _ in ordered]
    while free:
        total = sum(weights[n] for n in free)
        share = {n: left * weights[n] / total for n in free}
        over = [n for n in free if share[n] > cap[n]]
        if not over:
            return out | share
        for n in over:
            out[n] = float(cap[n])
            left -= cap[n]
        free = [n for n in free if n not in out]
    return out


def knapsack(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length come nearest to the budget from below, at most ``free`` of each."""
    first = np.full(budget + 1, -1, np.int32)  # the length that first reached a sum, and how often it was used for it
    times = np.zeros(budget + 1, np.int32)
    first[0] = len(lengths)
    for i, (size, n) in enumerate(zip(lengths.tolist(), free.tolist())):
        if size <= 0 or size > budget or n <= 0:
            continue
        before = first >= 0
        for k in range(1, min(n, budget // size) + 1):
            new = np.flatnonzero(before[:budget + 1 - k * size] & (first[k * size:] < 0)) + k * size
            first[new], times[new] = i, k
            if first[budget] >= 0 or not len(new):
                break
        if first[budget] >= 0:
            break
    at, out = int(np.flatnonzero(first >= 0)[-1]), np.zeros(len(lengths), np.int64)
    while at:
        i, k = int(first[at]), int(times[at])
        out[i] += k
        at -= k * int(lengths[i])
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their words come to ``budget``."""
    order = np.argsort(-lengths, kind="stable")
    size, count = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    words = int((size * count).sum())
    if budget >= words:
        return counts.copy()
    aim, taken, seen, take = max(0, budget - RESERVE), 0, 0, np.zeros(len(size), np.int64)
    for i, (s, c) in enumerate(zip(size.tolist(), count.tolist())):
        if s > 0 and words:
            seen += s * c
            take[i] = max(0, min(c, (aim * seen // words - taken) // s))
            taken += int(take[i]) * s
    take += knapsack(size, count - take, budget - taken)
    out = np.zeros_like(take)
    out[order] = take
    return out


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, times: int = 3,
        weight: Callable[[int], int] = lambda i: 1 + i % 3, carry: bool = False) -> DataFrame:
    """(id, size, source_size, target, taken) for each row; ``carry`` gives the input's row as a struct ``_row`` and ``repeats`` instead.

    ``taken`` is ``size`` times the number of times the row is used. Rows of
    size 0 take 0. NULL sources are one source, last in order. A NULL text has
    size 0. Rows of one source and length are ordered by a seeded hash of id
    and text, and of equal ones just as many are taken as the length still
    owes, so repeated and NULL ids do not move a source off its target. The same input
    gives the same result on every run. An empty table gives no rows.
    """
    spark, keys = df.sparkSession, ["_src", "_none", "size"]
    marks = [F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_src"), F.col(source_col).isNull().alias("_none"),
             word_count(text_col).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("_h")]
    rows = saved(df.select(F.col(id_col).cast("long").alias("_id"), *marks), "sizes")
    lengths = rows.groupBy(*keys).agg(F.count("*").alias("docs"))

    sources = lengths.groupBy("_src", "_none").agg(F.sum(F.col("size") * F.col("docs")).alias("words")).collect()  # a row a source
    sizes = [(None if r["_none"] else r["_src"], r["words"]) for r in sources]
    targets = budgets(sizes, weight, times)
    goal = [(name or "", name is None, words, targets[name]) for name, words in sizes]

    def plan(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("size", kind="stable")
        total, target = int(table["source_size"].iloc[0]), float(table["target"].iloc[0])
        whole = min(times, int(target // total)) if total else 0
        rest = 0 if whole >= times or not total else min(total, round(target) - whole * total)
        return table.assign(whole=whole, extra=fit(table["size"].to_numpy(), table["docs"].to_numpy(), max(0, rest)) if total else 0)

    goals = few_rows(spark, goal, "_src string, _none boolean, source_size long, target double")
    shares = saved(lengths.join(goals, ["_src", "_none"]).groupBy("_src", "_none").applyInPandas(
        plan, "_src string, _none boolean, size long, docs long, source_size long, target double, whole long, extra long"), "shares")

    # The hash up to which a length gives its documents once more. Slots are ranges of the hash: those before the
    # border give all, those behind it none, and only the slot on it is put in order.
    slot = F.floor((F.col("_h").cast("double") + 2.0**63) / 2.0**64 * F.ceil(F.col("docs") / SLOT))
    placed = rows.join(shares.where("extra > 0 and extra < docs").select(*keys, "docs", "extra"), keys).withColumn("_slot", slot)
    counts = placed.groupBy(*keys, "_slot").agg(F.count("*").alias("here"), F.first("extra").alias("extra"))
    before = F.coalesce(F.sum("here").over(Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    on = counts.select(*keys, "_slot", "here", (F.col("extra") - before).alias("give")).where("give > 0 and give <= here")
    inside = Window.partitionBy(*keys, "_slot").orderBy("_h")
    owed = F.col("give") - F.rank().over(inside) + 1  # of the rows with the border's hash
    borders = placed.join(on, [*keys, "_slot"]).select(*keys, "_h", "give", F.row_number().over(inside).alias("_place"), owed.alias("_owed")).where(
        "_place = give").select(*keys, F.col("_h").alias("_border"), "_owed")
    border = F.when(F.col("extra") >= F.col("docs"), F.lit(2**63 - 1)).otherwise(F.col("_border"))
    table = saved(shares.join(borders, keys, "left").select(*keys, "source_size", "target", "whole", border.alias("_border"), "_owed"), "borders")

    # Rows with the border's own hash are numbered only where there are more of them than the length still owes.
    equal = rows.join(table.where("_owed is not null"), keys).where("_h = _border").groupBy(*keys).agg(F.count("*").alias("n"), F.first("_owed").alias("owed"))
    tied = saved(equal.where("n > owed").select(*keys, F.lit(True).alias("_tied")), "ties")

    def with_times(df: DataFrame) -> DataFrame:
        if tied.isEmpty():
            below = F.coalesce(F.col("_h") <= F.col("_border"), F.lit(False))
            return df.join(table, keys).withColumn("_again", F.col("whole") + below.cast("long"))
        met = df.join(table.join(tied, keys, "left"), keys)
        on_border = F.coalesce(F.col("_tied") & (F.col("_h") == F.col("_border")), F.lit(False))
        number = F.row_number().over(Window.partitionBy(*keys, "_h", F.when(~on_border, F.monotonically_increasing_id())).orderBy("_h"))
        below = F.when(on_border, number <= F.col("_owed")).otherwise(F.coalesce(F.col("_h") <= F.col("_border"), F.lit(False)))
        return met.withColumn("_again", F.col("whole") + below.cast("long"))

    if carry:
        full = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *marks)
        return with_times(full).select("_row", F.col("_again").alias("repeats"))
    return with_times(rows).select(
        F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("_again")).alias("taken"))


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """The rows that the mix takes, each as often as it takes them, with the input's columns, whatever their names."""
    out = mix(df, carry=True, **options).where(F.col("repeats") > 0)
    again = F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))
    return out.select("_row", again.alias("_again")).select("_row.*")
