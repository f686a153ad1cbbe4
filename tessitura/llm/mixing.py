"""Mixing sources to target weights by balanced sampling (the cube method).

Every document has an expected number of copies: its source's target divided
by its source's size.  The whole part is taken for sure; the fractional part is
an inclusion probability.  The flight phase moves the probabilities of three
documents at a time along the null-space of the two balancing constraints
(tokens and documents), so both totals stay exactly as they were while at least
one probability reaches 0 or 1 per move.  Blocks of a source fly on their own
(a source that holds a third of all rows is many blocks); the at most two open
documents of each block meet in the next round, until one block per source is
left.  Its last open documents are the landing problem, settled by trying the
few remaining outcomes.

Defined results: null or empty text has size 0; a null source is a source of its
own, sorted last; rows are units of their own, so a repeated doc_id is drawn
once per row; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import itertools
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize, read, register

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_UNITS = 8192
SEED = 20240229


def word_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size: the number of white-space separated words of the whole text."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_no, n_docs, source_size, target: one row per source.

    Weights repeat over the sources in code-point order.  A target stops at
    ``cap`` times its source's size and the excess goes to the others by
    weight.  Written in closed form: with sources sorted by cap / weight, the
    level of the first source that stays below its cap is everyone's level.
    The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").cast("long").alias("source_size"))
    w_all = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("source_no"), F.lit(len(weights))) + 1).cast("int"))
    numbered = per.withColumn("source_no", F.row_number().over(w_all) - 1).withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), "source_no")
    before, rest, every = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    goal = F.sum("source_size").over(every) * F.lit(float(share))
    leveled = numbered.withColumn("_level", (goal - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
    open_level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "source_no", "_level"))).over(every)["_level"]
    return leveled.select("source", "source_no", "n_docs", "source_size", F.least(F.col("_cap"), F.coalesce(open_level, F.lit(float("inf"))) * F.col("_w")).alias("target"))


def flight(sizes: Sequence[float], probs: Sequence[float], rng: random.Random) -> tuple[list[float], list[int]]:
    """Move ``probs`` to 0 or 1 in units taken in the given order, keeping sum(p) and sum(p * size); returns (p, open units)."""
    p = list(probs)
    eps = 1e-9
    active: list[int] = []
    for nxt in range(len(p)):
        if p[nxt] <= eps or p[nxt] >= 1 - eps:
            p[nxt] = float(round(p[nxt]))
            continue
        active.append(nxt)
        while len(active) == 3 or len(active) == 2 and sizes[active[0]] == sizes[active[1]]:
            if len(active) == 2:
                u = (1.0, -1.0)
            else:
                a, b, c = (sizes[i] for i in active)
                u = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
            up = down = float("inf")
            for i, d in zip(active, u):
                if d > 0:
                    up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
                elif d < 0:
                    up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
            step = up if rng.random() * (up + down) < down else -down
            still = []
            for i, d in zip(active, u):
                p[i] += step * d
                if p[i] <= eps or p[i] >= 1 - eps:
                    p[i] = float(round(p[i]))
                else:
                    still.append(i)
            active = still
    return p, active


def landing(sizes: Sequence[float], p: list[float], open_units: list[int], movable: Sequence[int]) -> list[float]:
    """Settle the at most two open units: the outcome closest in tokens, then in documents, then the first.

    What rounding them leaves is then evened out by a few swaps of other units'
    outcomes, each the one that brings the token total closest to its value.
    """
    total = sum(x * s for x, s in zip(p, sizes))
    want = sum(p[i] * sizes[i] for i in open_units)
    count = sum(p[i] for i in open_units)
    best = min(itertools.product((0.0, 1.0), repeat=len(open_units)), key=lambda o: (abs(sum(x * sizes[i] for x, i in zip(o, open_units)) - want), abs(sum(o) - count), o))
    for i, x in zip(open_units, best):
        p[i] = x
    if open_units:
        off = total - sum(x * s for x, s in zip(p, sizes))
        for _ in range(16):
            i = min(movable, key=lambda i: (abs(off - (1 - 2 * p[i]) * sizes[i]), i), default=None)
            if i is None or abs(off - (1 - 2 * p[i]) * sizes[i]) >= abs(off):
                break
            off -= (1 - 2 * p[i]) * sizes[i]
            p[i] = 1.0 - p[i]
    return p


def spare_units(sizes: Sequence[float]) -> set[int]:
    """A few units of doubling sizes that a block leaves open: with them the last round can even out what rounding costs.

    ``sizes`` are sorted from large to small.
    """
    rising = [-s for s in sizes]
    found = {bisect.bisect_left(rising, -(1 << k)) for k in range(10)}
    return {i for i in found if i < len(sizes) and sizes[i] > 0} if len(sizes) > 100 else set()


def _fly(last: bool):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        # large documents first: what stays open, and so the landing error, is small
        pdf = pdf.sort_values(["size", "_h", "_row"], ascending=[False, True, True], kind="stable")
        sizes = pdf["size"].tolist()
        start = pdf["_p"].tolist()
        rng = random.Random(f"{SEED}:{key[0]}:{key[1]}:{len(pdf)}")
        flying = [i for i in range(len(sizes)) if i not in spare] if (spare := set() if last else spare_units(sizes)) else range(len(sizes))
        p = list(start)
        moved, left = flight([sizes[i] for i in flying], [start[i] for i in flying], rng)
        for i, x in zip(flying, moved):
            p[i] = x
        if last:
            p = landing(sizes, p, left, [i for i, x in enumerate(start) if 1e-9 < x < 1 - 1e-9])
        return pdf.assign(_p=p)[["_row", "doc_id", "source_no", "size", "_whole", "_p", "_h"]]

    return run


_FLOWN = "_row long, doc_id string, source_no int, size long, _whole int, _p double, _h long"


def cube_sample(units: DataFrame, block_units: int = BLOCK_UNITS) -> DataFrame:
    """Balanced draw.  ``units``: _row, doc_id, source_no, size, _whole, _p (probability), _h (order key), n_units per source.

    Returns the rows with ``_p`` in {0, 1}.  Every round groups the open rows of
    a source into blocks of about ``block_units``; a block leaves at most two
    open, so a few rounds are enough for any input.
    """
    spark = units.sparkSession
    n = units.agg(F.max("n_units")).first()[0] or 0
    cols = [c.split()[0] for c in _FLOWN.split(", ")]
    current, done, no = units, [], 0
    while True:
        n_blocks = F.ceil(F.col("n_units") / F.lit(block_units)).cast("long")
        blocked = current.withColumn("_block", F.pmod(F.xxhash64("_h", F.lit(no)), n_blocks))
        last = n <= block_units
        flown = blocked.groupBy("source_no", "_block").applyInPandas(_fly(last), _FLOWN)
        if last:
            done.append(flown.select(*cols))
            break
        flown = materialize(flown, f"mix-round{no}")
        open_row = (F.col("_p") > 0) & (F.col("_p") < 1)
        done.append(flown.where(~open_row).select(*cols))
        left = flown.where(open_row)
        counts = left.groupBy("source_no").agg(F.count(F.lit(1)).alias("n_units"))
        counts = materialize(counts, f"mix-left{no}")
        n = counts.agg(F.max("n_units")).first()[0] or 0
        current = left.join(checked_broadcast(counts, counts.count()), "source_no")
        no += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block_units: int = BLOCK_UNITS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: how often the mix takes each document.

    The word count runs once; what moves afterwards is one narrow row per
    document.
    """
    sized = materialize(word_sizes(docs).withColumn("_row", F.monotonically_increasing_id()), "mix-sizes")
    targets = materialize(source_targets(sized, weights, share, cap), "mix-targets")
    n_sources = targets.count()
    id_type = sized.schema["doc_id"].dataType  # ids travel as text: pandas has no integer column with nulls
    t = checked_broadcast(targets.withColumnRenamed("source", "_source"), n_sources)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate + F.lit(1e-12))
    units = sized.join(t, F.col("source").eqNullSafe(F.col("_source"))).select(
        "_row", F.col("doc_id").cast("string").alias("doc_id"), F.col("source_no").cast("int").alias("source_no"), "size", whole.cast("int").alias("_whole"),
        F.greatest(rate - whole, F.lit(0.0)).alias("_p"), F.xxhash64("doc_id", "size", "source").alias("_h"), F.col("n_docs").alias("n_units"),
    )
    drawn = cube_sample(units, block_units)
    copies = (F.col("_whole") + F.col("_p").cast("int")).cast("int")
    t2 = checked_broadcast(targets.select(F.col("source_no").cast("int").alias("source_no"), "source", "source_size", "target"), n_sources)
    return drawn.join(t2, "source_no").select(F.col("doc_id").cast(id_type).alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


@register("op10_mixing")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: sources weigh 5, 2, 1 repeating and share 150 % of all words, at most twice a source."""
    return mix_sources(spark, read(spark, sf_dir, "documents"))
