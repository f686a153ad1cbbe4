"""Feature sets under opaque handles (S-7): a set is saved under a name of 16 letters and read back by it.

All sets lie in one Parquet table ``(handle, position, values)`` that is split
by a prefix of the handle, so a read by handles opens only their folders and
skips row groups by the sorted handle.  A second table lists the handles that
were given out, which tells an unknown handle from a set without features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HANDLE_LENGTH = 16
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOUND, EMPTY, UNKNOWN = "found", "empty", "unknown"


def handle_of(*seed) -> Column:
    """16 letters from the digest of ``seed``: 13 hex digits make 9 letters, so two parts are cut from it.

    Deterministic, so a task that is run again gives the same handle; seed it
    with something secret or random to make handles hard to guess.
    """
    digest = F.sha2(F.concat_ws("\u0001", *seed), 256)
    letters = F.array(*[F.lit(c) for c in LETTERS])

    def part(start: int, n: int) -> list[Column]:
        number = F.conv(F.substring(digest, start, 13), 16, 10).cast("long")
        return [F.element_at(letters, (F.pmod(F.floor(number / F.lit(float(len(LETTERS) ** k))).cast("long"), F.lit(len(LETTERS))) + 1).cast("int")) for k in range(n)]

    return F.concat(*part(1, 8), *part(14, 8))


def _prefix(handle) -> Column:
    return F.substring(F.lower(handle), 1, 1)


def save_sets(sets: DataFrame, path: str, values_col: str = "features", seed_cols: tuple[str, ...] = ("track_id",), salt: str = "") -> DataFrame:
    """Save every row's list of feature vectors under a new handle; returns the rows with ``handle``.

    A null list and an empty list are sets without features.
    """
    named = sets.withColumn("handle", handle_of(F.lit(salt), *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in seed_cols]))
    given = named.select("handle", _prefix(F.col("handle")).alias("prefix")).distinct()
    given.repartition("prefix").sortWithinPartitions("handle").write.mode("append").partitionBy("prefix").parquet(f"{path}/handles")
    vectors = named.select(_prefix(F.col("handle")).alias("prefix"), "handle", F.posexplode(values_col).alias("position", "values"))
    vectors.repartition("prefix", "handle").sortWithinPartitions("prefix", "handle", "position").write.mode("append").partitionBy("prefix").parquet(f"{path}/sets")
    return named


def read_sets(spark: SparkSession, path: str, handles: DataFrame, handle_col: str = "handle", values_col: str = "features") -> DataFrame:
    """``(handle, state, features)`` for the requested handles.

    ``state`` is ``found``, ``empty`` (the set has no features) or ``unknown``
    (no set was saved under the handle); ``features`` is null unless found.  A
    set's vectors are gathered in one row, as they were saved.
    """
    asked = handles.select(F.col(handle_col).alias("handle")).distinct().withColumn("prefix", _prefix(F.col("handle")))
    by = ["prefix", "handle"]
    # the prefixes are letters: at most 26 values, fetched first so that only their folders are listed and read
    letters = [r["prefix"] for r in asked.select("prefix").distinct().where(F.col("prefix").rlike("^[a-z]$")).limit(len(LETTERS)).collect()]
    given = spark.read.schema("handle string, prefix string").parquet(f"{path}/handles").where(F.col("prefix").isin(letters)).select(*by).distinct().withColumn("_given", F.lit(True))
    stored = spark.read.parquet(f"{path}/sets").where(F.col("prefix").isin(letters))
    rows = stored.join(asked, by, "left_semi").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("position", "values"))).alias("_rows"))
    found = asked.join(given, by, "left").join(rows, by, "left")
    state = F.when(F.col("_rows").isNotNull(), FOUND).when(F.col("_given"), EMPTY).otherwise(UNKNOWN)
    return found.select("handle", state.alias("state"), F.transform("_rows", lambda r: r["values"]).alias(values_col))


def read_set(spark: SparkSession, path: str, handle: str) -> DataFrame:
    """One set's vectors in order; no rows when it is unknown or empty."""
    stored = spark.read.parquet(f"{path}/sets")
    return stored.where((F.col("prefix") == handle[:1].lower()) & (F.col("handle") == handle)).orderBy("position").select("position", "values")
