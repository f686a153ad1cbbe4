"""Exact dense row indexes without a single-partition sort.

Many operators need "the i-th row of a group in some order" (exact splits,
batches, task suites, the last 10 answers of a worker, streaks).  A plain
``row_number()`` over the whole group sorts the group in one task, which
breaks when one group holds a large share of all rows.

:func:`dense_index` splits every group into *blocks* with a block key that
is monotone in the sort order (a day, a hash prefix, an id range).  Per-block
counts are a small table; a running sum over it gives each block's start
offset, and ``row_number`` only runs inside one block.  The result is the
exact 0-based position of every row in its group, and no task ever holds
more than one block.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._compat import col_of
from ..session import bounded_broadcast


def dense_index(
    df: DataFrame,
    order_cols: Sequence,
    block: Column,
    partition_cols: Sequence[str] = (),
    idx_col: str = "idx",
    total_col: str | None = None,
    block_bound: int | None = None,
    block_col: str | None = None,
) -> DataFrame:
    """Add ``idx_col``: 0-based position of each row in its partition, ordered by ``order_cols``.

    ``block`` must be non-decreasing in ``order_cols`` within a partition and
    ``order_cols`` must be a total order (add a unique tiebreak).  Nulls are
    values like any other and come first.  The rows are shuffled once, by
    (partition, block), for both the counts and the positions.  When
    ``block_bound`` is given (e.g. 16**k for a hex prefix) and there are no
    partition columns, the block table has a proven size and is broadcast.
    With ``block_col`` the block key is kept under that name, so later
    windows on (partition, block) reuse this partitioning without a shuffle.
    """
    parts = list(partition_cols)
    orders = [col_of(c) for c in order_cols]
    # one struct key: unlike its fields it is never null, so rows with a null block or partition column stay
    keyed = df.withColumn("_pk", F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(parts)], block.alias("blk"))).repartition("_pk")
    counts = keyed.groupBy("_pk").agg(F.count(F.lit(1)).alias("_n"))
    groups = [F.col(f"_pk.p{i}") for i in range(len(parts))]
    w_run = Window.partitionBy(*groups).orderBy("_pk.blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w_run), F.lit(0)).cast("long"))
    keep = ["_pk", "_off"]
    if total_col:
        offsets = offsets.withColumn(total_col, F.sum("_n").over(Window.partitionBy(*groups)).cast("long"))
        keep.append(total_col)
    offsets = offsets.select(*keep)
    if block_bound is not None and not parts:
        offsets = bounded_broadcast(offsets, block_bound)
    joined = keyed.join(offsets, "_pk")
    out = joined.withColumn(idx_col, (F.col("_off") + F.row_number().over(Window.partitionBy("_pk").orderBy(*orders)) - 1).cast("long"))
    if block_col:
        out = out.withColumn(block_col, F.col("_pk.blk"))
    return out.drop("_off", "_pk")


def range_block(df: DataFrame, col: str, n_blocks: int = 4096) -> Column:
    """Block key for an order by a number: its range cut into ``n_blocks`` equal stretches.

    Least and greatest value come from a scalar subquery, so the block table
    has at most ``n_blocks`` rows (and one for null) however sparse the values are.
    For evenly spread values; :func:`quantile_block` holds for any.
    """
    x = F.col(col).cast("double")
    lo, hi = df.select(F.min(x)).scalar(), df.select(F.max(x)).scalar()
    return F.least(F.floor((x - lo) / F.greatest(hi - lo, F.lit(1.0)) * n_blocks), F.lit(n_blocks - 1)).cast("long")


def order_number(df: DataFrame, col: str) -> Column:
    """A number that does not decrease in the order of ``col``: numbers and times as they are, text by the
    seven bytes that follow the prefix common to all values (found by their least and greatest)."""
    kind = df.schema[col].dataType
    c = F.col(col)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return epoch_micros(df, col).cast("double")
    if not isinstance(kind, T.StringType):
        return c.cast("double")
    lo, hi = df.agg(F.min(c), F.max(c)).first()
    shared = len(os.path.commonprefix([lo or "", hi or ""]))
    rest = F.encode(F.substring(c, shared + 1, 1 << 30), "UTF-8")
    return F.conv(F.rpad(F.hex(F.substring(rest, 1, 7)), 14, "0"), 16, 10).cast("double")


def count_below(borders: Sequence[float], x: Column) -> Column:
    """How many of the ascending ``borders`` are below ``x``, by binary search."""
    n = len(borders)
    if n == 0:
        return F.lit(0).cast("long")
    listed = F.array(*[F.lit(float(b)) for b in borders])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    hop = lambda at, step: F.when((at + step <= n) & (F.try_element_at(listed, at + step) < x), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), hop).cast("long")


def quantile_block(df: DataFrame, col: str, n_blocks: int = 1024) -> Column:
    """Block key for an order by a column of any type: ``n_blocks`` stretches of near-equal numbers of rows.

    The borders are quantiles from a mergeable sketch: every partition makes a
    small summary, Spark merges them, and the driver gets ``n_blocks`` numbers (a
    job runs when this is called; error a tenth of a block).  Outliers cannot
    crowd the rest into one block; equal values always share one.  Null is a
    block of its own.
    """
    x = order_number(df, col)
    ranks = [k / n_blocks for k in range(1, n_blocks)]
    found = df.agg(F.percentile_approx(x, ranks, 10 * n_blocks)).first()[0]
    borders = sorted(set(found or ()))
    return F.when(F.col(col).isNotNull(), F.coalesce(count_below(borders, x), F.lit(0).cast("long")))


def hex_block(key: Column, digits: int = 3) -> Column:
    """Block key for an order by a hex digest: its first ``digits`` characters."""
    return F.substring(key, 1, digits)


def epoch_micros(df: DataFrame, col: str) -> Column:
    """Microseconds since 1970-01-01 of a time column, independent of the session time zone.

    ``TIMESTAMP_NTZ`` is wall-clock time: its distance from the NTZ epoch is
    taken directly, so a 24 h window means 24 wall-clock hours whatever the
    session zone (no daylight-saving shifts).  ``TIMESTAMP`` uses ``unix_micros``.
    """
    dtype = dict(df.dtypes)[col]
    if dtype == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    return F.unix_micros(F.col(col).cast("timestamp"))


def day_block(micros: Column, days: int = 1) -> Column:
    """Block key for an order by time in microseconds: UTC day number divided by ``days``."""
    return F.floor(micros / F.lit(86_400_000_000 * days)).cast("long")


def near_equal_parts(idx, n, k) -> Column:
    """Part number of 0-based row ``idx`` when ``n`` rows are cut into ``k`` near-equal parts.

    Same sizes as NumPy ``array_split`` and SQL ``ntile``: the first ``n % k``
    parts hold one row more.
    """
    idx, n, k = col_of(idx), col_of(n), col_of(k)
    q = F.floor(n / k)
    r = n - q * k
    big = r * (q + 1)
    return F.when(idx < big, F.floor(idx / (q + 1))).otherwise(r + F.floor((idx - big) / q)).cast("long")
