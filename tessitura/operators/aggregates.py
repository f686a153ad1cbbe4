"""Report aggregates: label frequencies, counts by class, row counts (A-3, A-4, A-5, A-11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_frequencies(df: DataFrame, list_col: str, label_col: str = "label") -> DataFrame:
    """A-3 / L-2: ``(label, count, total)`` of exploded labels; sort with :func:`sort_frequencies`.

    ``total`` (the title line of the report) is a window over the small
    per-label result, not over data rows.
    """
    counts = df.select(F.explode(list_col).alias(label_col)).where(F.col(label_col).isNotNull()).groupBy(label_col).agg(
        F.count(F.lit(1)).alias("count")
    )
    return counts.withColumn("total", F.sum("count").over(Window.partitionBy()).cast("long"))


def sort_frequencies(df: DataFrame, label_col: str = "label") -> DataFrame:
    """L-2: count descending, then label."""
    return df.orderBy(F.desc("count"), F.asc(label_col))


def counts_by(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A-4: counts per each column alone and the total, in one pass (GROUPING SETS).

    Output: ``dimension`` (column name or ``'*'``), ``value``, ``count``.
    """
    sets = [[c] for c in columns] + [[]]
    g = df.groupingSets(sets, *columns).agg(F.count(F.lit(1)).alias("count"), *[F.grouping(c).alias(f"_g_{c}") for c in columns])
    dim = F.lit("*")
    val = F.lit(None).cast("string")
    for c in reversed(columns):
        dim = F.when(F.col(f"_g_{c}") == 0, F.lit(c)).otherwise(dim)
        val = F.when(F.col(f"_g_{c}") == 0, F.col(c).cast("string")).otherwise(val)
    return g.select(dim.alias("dimension"), val.alias("value"), F.col("count").cast("long").alias("count"))


def row_counts(df: DataFrame, **conditions) -> DataFrame:
    """A-5: total rows and ``count_if`` per named condition, one aggregate."""
    aggs = [F.count(F.lit(1)).alias("rows")] + [F.count_if(c).alias(name) for name, c in conditions.items()]
    return df.agg(*aggs)


def best_by_metric(history: DataFrame, maximize: bool = True) -> DataFrame:
    """A-11: per (run, split, metric) the best value and the epoch it was reached (first on ties)."""
    v = F.col("value") if maximize else -F.col("value")
    best = history.groupBy("run", "split", "metric").agg(
        F.max_by(F.struct("epoch", "value"), F.struct(v, -F.col("epoch"))).alias("_b"),
        F.count(F.lit(1)).alias("epochs"),
    )
    return best.select("run", "split", "metric", F.col("_b.value").alias("best_value"), F.col("_b.epoch").alias("best_epoch"), "epochs")


def epochs_since_best(history: DataFrame, maximize: bool = True) -> DataFrame:
    """M-15 stop rule input: per epoch, epochs since the running best (window max per run/metric)."""
    v = F.col("value") if maximize else -F.col("value")
    w = Window.partitionBy("run", "split", "metric").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    runbest = history.withColumn("_v", v).withColumn("_best", F.max("_v").over(w))
    improved = F.when(F.col("_v") >= F.col("_best"), F.col("epoch"))
    out = runbest.withColumn("_last_best", F.max(improved).over(w))
    return out.withColumn("since_best", F.col("epoch") - F.col("_last_best")).drop("_v", "_best", "_last_best")


def top_runs(history: DataFrame, metric: str, split: str = "val", k: int = 2, maximize: bool = True) -> DataFrame:
    """M-15: keep the ``k`` best runs by the monitored metric (best epoch value per run)."""
    best = best_by_metric(history.where((F.col("metric") == metric) & (F.col("split") == split)), maximize)
    order = F.desc("best_value") if maximize else F.asc("best_value")
    return best.orderBy(order, F.asc("run")).limit(k)
