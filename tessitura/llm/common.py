"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

# A table may be hinted as broadcast only after its rows were counted and stayed below this bound.
BROADCAST_ROWS = 200_000


def register(name: str, oracle: str | None = None):
    """Decorator: add a query (and its DuckDB SQL, if there is one) to this folder's registry."""

    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checked_broadcast(df: DataFrame, n_rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the counted ``n_rows`` stay below ``bound``; otherwise the plan keeps its shuffle join."""
    return F.broadcast(df) if n_rows <= bound else df


def id_remainder(col: str = "doc_id"):
    """crc32 of the id written as text, modulo 5: the fold number used by the train / held-out splits."""
    return (F.crc32(F.col(col).cast("string")) % 5).cast("int")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand whole texts to Python a thousand rows at a time (Spark's default is ten thousand), unless the session asks for fewer.

    A worker holds one batch and what is made of it, so this bounds its memory.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


__all__ = ["QUERIES", "ORACLES", "register", "read", "checked_broadcast", "id_remainder", "materialize", "shuffle_width", "small_batches", "BROADCAST_ROWS"]
