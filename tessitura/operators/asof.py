"""As-of join: every row of one table gets the other table's latest row not after it.

Both tables are put on one time line per key.  The line is cut into stretches
of near-equal numbers of rows (:func:`quantile_block`); the last row of the
other table is carried forward inside a stretch by a window, and from stretch to
stretch by a window over one row per stretch.  So a key that holds a large
share of all rows is worked on by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ordering import quantile_block


def latest_not_after(left: DataFrame, right: DataFrame, by: Sequence[str], time_col: str, payload: Sequence[str], right_time: str | None = None, out_col: str = "latest") -> DataFrame:
    """``left`` with ``out_col``: a struct of ``payload`` from the last row of ``right`` with the same ``by`` and a time not after the row's.

    Of right rows with one key and time the largest payload counts.  Null keys
    and times match nothing.  The time line is written once, as its borders and
    its windows read it (a job runs when this is called).
    """
    at = right_time or time_col
    known = right.where(F.col(at).isNotNull() & ~F.greatest(*[F.col(c).isNull().cast("int") for c in by], F.lit(0)).cast("boolean"))
    offers = known.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(at).alias("_at")).agg(F.max(F.struct(*payload)).alias("_row"))
    asks = left.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(time_col).alias("_at"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_keep"))
    line = materialize(offers.unionByName(asks, allowMissingColumns=True), "asof-line")
    key = F.struct(*[f"_k{i}" for i in range(len(by))], quantile_block(line, "_at").alias("b"))
    placed = line.withColumn("_blk", key).repartition("_blk")
    # offers come before asks of the same time
    inside = Window.partitionBy("_blk").orderBy("_at", F.col("_keep").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_in", F.last("_row", ignorenulls=True).over(inside))
    ends = placed.groupBy("_blk").agg(F.max_by("_row", F.when(F.col("_row").isNotNull(), F.col("_at"))).alias("_end"))
    earlier = Window.partitionBy(*[f"_blk._k{i}" for i in range(len(by))]).orderBy("_blk.b").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("_blk", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    found = placed.where(F.col("_keep").isNotNull()).join(carry, "_blk")
    usable = F.col("_at").isNotNull()
    return found.select(*[F.col("_keep")[c].alias(c) for c in left.columns], F.when(usable, F.coalesce("_in", "_carry")).alias(out_col))
