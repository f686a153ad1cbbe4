"""Exact seeded splits, batches and random partners (R-1..R-3) without a global sort.

Rows are ordered by ``md5(seed:key)``, a uniform order that any engine with
md5 can reproduce.  Positions come from :func:`dense_index` with the first
hex digits of the digest as block key, so the block table has at most
``16**digits`` rows (a proven bound: it is broadcast) and each window task
holds one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._compat import col_of
from ..schemas import BATCH_SIZE, SPLIT_SEED, TEST_SPLIT
from .ordering import dense_index, hex_block, near_equal_parts, quantile_block


def shuffle_key(key, seed: int, epoch: int | None = None) -> Column:
    parts = [F.lit(str(seed))] + ([F.lit(str(epoch))] if epoch is not None else []) + [col_of(key).cast("string")]
    return F.md5(F.concat_ws(":", *parts))


def shuffled_index(df: DataFrame, key: str, seed: int = SPLIT_SEED, epoch: int | None = None, digits: int = 4, idx_col: str = "idx", total_col: str = "n") -> DataFrame:
    """Exact dense position of every row in the seeded shuffle order (ties by key)."""
    h = shuffle_key(key, seed, epoch)
    with_h = df.withColumn("_h", h)
    out = dense_index(with_h, [F.col("_h"), F.col(key)], hex_block(F.col("_h"), digits), idx_col=idx_col, total_col=total_col, block_bound=16 ** digits)
    return out.drop("_h")


def exact_split(df: DataFrame, key: str, test_size: float = TEST_SPLIT, seed: int = SPLIT_SEED, digits: int = 4) -> DataFrame:
    """R-1: test = first ``ceil(test_size * n)`` rows of the shuffle; labels stay on their rows."""
    idx = shuffled_index(df, key, seed, digits=digits)
    cut = F.ceil(F.col("n") * F.lit(test_size))
    return idx.withColumn("split", F.when(F.col("idx") < cut, F.lit("test")).otherwise(F.lit("train"))).drop("n")


def batches(df: DataFrame, key: str, size: int = BATCH_SIZE, seed: int = SPLIT_SEED, epoch: int | None = None, drop_last: bool = True, digits: int = 4) -> DataFrame:
    """R-2: seeded mini-batches of ``size``; the short last batch is dropped or kept."""
    idx = shuffled_index(df, key, seed, epoch, digits=digits)
    out = idx.withColumn("batch", F.floor(F.col("idx") / F.lit(size)).cast("long"))
    if drop_last:
        out = out.where(F.col("batch") < F.floor(F.col("n") / F.lit(size)))
    return out.drop("n")


def random_partner(df: DataFrame, key: str, seed: int = 0, exclude_self: bool = False, digits: int = 4) -> DataFrame:
    """R-3: a reproducible random partner row for every row (may be itself unless ``exclude_self``).

    The partner index is ``pmod(h, n)`` (``n-1`` and a shift when excluding
    self) over dense positions; the lookup is an equi-join on the index.
    """
    idx = shuffled_index(df, key, seed=seed, digits=digits, idx_col="_pidx", total_col="_n")
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("partner"), F.lit(str(seed)), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")
    if exclude_self:
        raw = F.pmod(h, F.greatest(F.col("_n") - 1, F.lit(1)))
        target = F.when(raw >= F.col("_pidx"), raw + 1).otherwise(raw)
    else:
        target = F.pmod(h, F.col("_n"))
    left = idx.withColumn("_target", target)
    right = idx.select(F.col("_pidx").alias("_target"), F.col(key).alias("partner_" + key))
    return left.join(right, "_target", "left").drop("_target", "_pidx", "_n")


def n_parts(df: DataFrame, key: str, n: int, n_blocks: int = 1024) -> DataFrame:
    """W-8: cut the rows, ordered by ``key``, into ``n`` near-equal consecutive parts (``array_split`` sizes).

    Positions come from a dense index over ``n_blocks`` stretches of near-equal
    numbers of rows, so the only whole-table steps are a quantile sketch and a
    count per block, however the keys are spread.
    """
    idx = dense_index(df, [F.col(key)], quantile_block(df, key, n_blocks), idx_col="_i", total_col="_n")
    return idx.withColumn("batch", near_equal_parts("_i", "_n", F.lit(n))).drop("_i", "_n")
