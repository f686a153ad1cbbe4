"""Keyed tables that are upserted in place (U-2, U-3): only the folders of touched keys are rewritten.

A keyed table is Parquet split by ``bucket``, a hash of the key.  An upsert
reads the buckets that the new rows fall into, merges them with any function of
(old rows, new rows), writes the result to the shared folder, and from there
overwrites exactly these buckets (Spark's dynamic partition overwrite, committed
when the whole job has ended).  The files of all other buckets stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .tables import read_or_empty

N_BUCKETS = 64
BUCKET = "bucket"


def bucket_of(keys: Sequence[str], n_buckets: int = N_BUCKETS):
    """Bucket number of a key of one or more columns (nulls count as a value)."""
    return F.pmod(F.xxhash64(*keys), F.lit(n_buckets)).cast("int")


def _put(rows: DataFrame, path: str, keys: Sequence[str], mode: str) -> None:
    out = rows.repartition(BUCKET).sortWithinPartitions(BUCKET, *keys)
    out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def replace_rows(keys: Sequence[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Merge rule: a new row takes the place of the old row with its key (nulls are values); new keys are unique."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        n = new.select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = [old[k].eqNullSafe(n[f"_{k}"]) for k in keys]
        return old.join(n, same, "left_anti").unionByName(new.select(*old.columns))

    return merge


def create_keyed(rows: DataFrame, path: str, keys: Sequence[str], n_buckets: int = N_BUCKETS) -> None:
    """A new keyed table at ``path``."""
    _put(rows.withColumn(BUCKET, bucket_of(keys, n_buckets)), path, keys, "overwrite")


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows with their bucket; none when nothing was written yet."""
    full = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    return read_or_empty(spark, path, full)


def read_keyed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table's rows without the bucket; an empty table of ``schema`` when nothing was written yet."""
    return _stored(spark, path, schema).select(*schema.fieldNames())


def upsert_keyed(
    spark: SparkSession,
    path: str,
    new: DataFrame,
    keys: Sequence[str],
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    schema: T.StructType,
    n_buckets: int = N_BUCKETS,
    new_keys: Sequence[str] | None = None,
) -> list[int]:
    """U-2 / U-3: ``merge(old, new)`` over the buckets that ``new`` touches; returns these buckets.

    ``merge`` gets the stored rows of the touched buckets and all new rows, and
    returns rows of ``schema`` whose keys are among theirs.  ``new_keys``: the
    key's columns in ``new`` when they have other names.
    """
    new = materialize(new, "upsert-new")  # read for its buckets and for the merge
    touched = sorted(r[0] for r in new.select(bucket_of(new_keys or keys, n_buckets)).distinct().collect())  # at most n_buckets numbers
    if not touched:
        return []
    old = _stored(spark, path, schema).where(F.col(BUCKET).isin(touched)).select(*schema.fieldNames())
    merged = merge(old, new).select(*schema.fieldNames()).withColumn(BUCKET, bucket_of(keys, n_buckets))
    # the result is complete before the first old file goes, so a lost executor costs nothing
    _put(materialize(merged, "upsert-merged"), path, keys, "overwrite")
    return touched
