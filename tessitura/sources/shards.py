"""Feature shard store (S-6, S-7, S-8, J-9, X-9, X-11, F-11).

One Parquet table partitioned by ``bucket = pmod(track_id, 20)``, rows sorted
by track inside each file so row-group statistics skip other tracks.  Reads
for a set of ids put ``bucket`` into the predicate and the join key: a literal
id list prunes partitions statically; for an id table the requested buckets
(at most 20 values) are fetched first and applied as a literal partition
filter.  No file per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import shard_of
from ..schemas import N_SHARDS

REQUIRED = ("track_id", "chunk")


class MissingColumnError(ValueError):
    pass


def missing_column_message(path: str, column: str) -> str:
    """S-6: the message for a store that lacks a required column."""
    return f"Feature store {path} has no column '{column}'"


def write_store(features: DataFrame, path: str, mode: str = "append", n_shards: int = N_SHARDS) -> None:
    """S-6 / X-11: append feature rows ``(track_id, chunk, ...)`` to the store at ``path``."""
    out = features.withColumn("bucket", shard_of("track_id", n_shards))
    (
        out.repartition("bucket", "track_id")
        .sortWithinPartitions("bucket", "track_id", "chunk")
        .write.mode(mode)
        .partitionBy("bucket")
        .parquet(path)
    )


def read_store(spark: SparkSession, path: str, required: Iterable[str] = REQUIRED) -> DataFrame:
    """S-6 read with the schema check of the reference's dump loader."""
    df = spark.read.parquet(path)
    for c in required:
        if c not in df.columns:
            raise MissingColumnError(missing_column_message(path, c))
    return df


def lookup_ids(store: DataFrame, ids: list[int], n_shards: int = N_SHARDS) -> DataFrame:
    """S-7: rows of a few known ids; the literal bucket list prunes partitions before any file is opened."""
    buckets = sorted({i % n_shards for i in ids})
    return store.where(F.col("bucket").isin(buckets) & F.col("track_id").isin(list(ids)))


def lookup_table(store: DataFrame, ids: DataFrame, key: str = "track_id", n_shards: int = N_SHARDS) -> DataFrame:
    """S-8 / J-3: rows whose id is in ``ids``: semi join on (bucket, id).

    The set of requested buckets has at most ``n_shards`` values, so it is
    fetched first and applied as a literal partition filter: only the
    requested shard folders are listed and read.
    """
    req = ids.select(F.col(key).alias("track_id")).distinct().withColumn("bucket", shard_of("track_id", n_shards))
    buckets = sorted(r[0] for r in req.select("bucket").distinct().limit(n_shards).collect())
    return store.where(F.col("bucket").isin(buckets)).join(req, ["bucket", "track_id"], "left_semi")


def exists(store: DataFrame, ids: DataFrame, key: str = "track_id", n_shards: int = N_SHARDS) -> DataFrame:
    """S-7 ``dump_file_exists`` for many ids: ``(track_id, exists)``."""
    have = store.select("bucket", "track_id").distinct().withColumn("_hit", F.lit(True))
    req = ids.select(F.col(key).alias("track_id")).distinct().withColumn("bucket", shard_of("track_id", n_shards))
    return req.join(have, ["bucket", "track_id"], "left").select("track_id", F.coalesce("_hit", F.lit(False)).alias("exists"))


def load_or_extract(
    spark: SparkSession,
    path: str,
    requested: DataFrame,
    extract: Callable[[DataFrame], DataFrame],
    key: str = "track_id",
    n_shards: int = N_SHARDS,
) -> tuple[DataFrame, DataFrame]:
    """J-9 / X-9: hits from the store, misses extracted by ``extract(ids)`` and appended; returns
    ``(features for every id that has them, ids still missing)``.

    The misses are written before they are read back, which also cuts the
    lineage of the extraction.
    """
    req = requested.select(F.col(key).alias("track_id")).distinct()
    keyed = req.withColumn("bucket", shard_of("track_id", n_shards))
    by = ["bucket", "track_id"]
    misses = keyed.join(read_store(spark, path).select(*by), by, "left_anti")
    # written only if still absent when the write runs, so a repeated call adds nothing twice
    write_store(extract(misses.select("track_id")), path, mode="append", n_shards=n_shards)
    store = read_store(spark, path)
    found = lookup_table(store, req)
    left = keyed.join(store.select(*by), by, "left_anti").select("track_id")
    return found, left


def shard_report(requested: DataFrame, found: DataFrame, key: str = "track_id", n_shards: int = N_SHARDS) -> DataFrame:
    """A-5 ``print_batch_info``: per shard, ids requested and ids found, one aggregate."""
    req = requested.select(F.col(key).alias("track_id")).distinct()
    hit = found.select("track_id").distinct().withColumn("_hit", F.lit(1))
    j = req.join(hit, "track_id", "left").withColumn("bucket", shard_of("track_id", n_shards))
    return j.groupBy("bucket").agg(F.count(F.lit(1)).alias("requested"), F.count("_hit").alias("found"))


def attach_labels(features: DataFrame, labels: DataFrame, key: str = "track_id") -> tuple[DataFrame, DataFrame]:
    """J-8: one row per (track, chunk) with the track's labels (inner join), and the
    labelled tracks that have no features (anti join, the report)."""
    rows = features.join(labels, key, "inner")
    missing = labels.select(key).distinct().join(features.select(key).distinct(), key, "left_anti")
    return rows, missing
