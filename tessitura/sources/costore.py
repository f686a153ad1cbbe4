"""Feature store whose files are already partitioned for joins by track (S-8, J-3, J-8, J-9, X-9, X-11).

The store is a bucketed Parquet table: a row's file follows from the hash that
Spark's joins use, so a join by track id shuffles the other side only, and the
store is read bucket by bucket without an exchange.  The id column carries a
Parquet Bloom filter, and rows are sorted by id, so a read of a few ids skips
the row groups that cannot hold them.

The table is known to the session's catalog; the files alone (path and number of
buckets) are enough to register it again in another session with
:func:`open_store`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shards import REQUIRED, MissingColumnError, missing_column_message

ORDER = ("track_id", "chunk")


@dataclass(frozen=True)
class CoStore:
    """A bucketed feature table: its name, the folder of its files, the number of buckets."""

    spark: SparkSession
    table: str
    path: str
    n_buckets: int
    key: str = "track_id"

    def write(self, features: DataFrame, mode: str = "append") -> None:
        """X-11: append feature rows ``(track_id, chunk, ...)``; one shuffle by track, one file per bucket and write."""
        spread = features.repartition(self.n_buckets, self.key)
        writer = spread.write.format("parquet").mode(mode).bucketBy(self.n_buckets, self.key).sortBy(*ORDER).option("path", self.path)
        # a dictionary-coded column gets no Bloom filter
        bloom = {"bloom.filter.enabled": "true", "bloom.filter.adaptive.enabled": "true", "enable.dictionary": "false"}
        for name, value in bloom.items():
            writer = writer.option(f"parquet.{name}#{self.key}", value)
        writer.saveAsTable(self.table)

    def read(self) -> DataFrame:
        """S-6 read with the check for required columns."""
        df = self.spark.read.table(self.table)
        for c in REQUIRED:
            if c not in df.columns:
                raise MissingColumnError(missing_column_message(self.path, c))
        return df

    def beside(self, rows: DataFrame) -> DataFrame:
        """``rows`` dealt out like the store's files, whatever the session's number of shuffle partitions."""
        return rows.repartition(self.n_buckets, self.key)

    def ids(self, ids: DataFrame, key: str | None = None) -> DataFrame:
        return self.beside(ids.select(F.col(key or self.key).alias(self.key))).distinct()

    def rows_of(self, ids: list[int]) -> DataFrame:
        """Rows of a few known ids: buckets are pruned by the literals, row groups by their statistics and Bloom filters."""
        return self.read().where(F.col(self.key).isin(list(ids)))

    def lookup(self, requested: DataFrame, key: str | None = None) -> DataFrame:
        """S-8 / J-3: rows whose id is requested (semi join, the store is not shuffled)."""
        return self.read().join(self.ids(requested, key), self.key, "left_semi")

    def misses(self, requested: DataFrame, key: str | None = None) -> DataFrame:
        """Requested ids without a row (anti join, the store is not shuffled)."""
        return self.ids(requested, key).join(self.read().select(self.key), self.key, "left_anti")

    def attach(self, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """J-8: one row per (track, chunk) with the track's labels, and the labelled tracks without features."""
        return self.read().join(self.beside(labels), self.key), self.misses(labels)

    def fill(self, requested: DataFrame, extract: Callable[[DataFrame], DataFrame], key: str | None = None) -> tuple[DataFrame, DataFrame]:
        """J-9 / X-9: ids without rows go through ``extract(ids)`` and are appended; returns the rows of all
        requested ids that have some, and the ids still missing.

        Ids are taken as missing by what the table holds when the append runs, so a repeated call adds nothing twice.
        """
        self.write(extract(self.misses(requested, key)))
        return self.lookup(requested, key), self.misses(requested, key)


def create_store(spark: SparkSession, table: str, path: str, features: DataFrame, n_buckets: int | None = None) -> CoStore:
    """A new store at ``path`` with ``features``; buckets default to the session's shuffle partitions, which joins keep to."""
    store = CoStore(spark, table, path, n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    store.write(features, "overwrite")
    return store


def open_store(spark: SparkSession, table: str, path: str, n_buckets: int) -> CoStore:
    """The store whose files lie at ``path``, registered under ``table`` in this session."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    order = ", ".join(ORDER)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({ORDER[0]}) SORTED BY ({order}) INTO {n_buckets} BUCKETS LOCATION '{path}'")
    return CoStore(spark, table, path, n_buckets)
