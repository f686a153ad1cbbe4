"""Feature-array queries over ``embeddings`` (values = frames, first 10 values = scores)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..sources.tables import read_table
from .registry import register

EMB_SQL = "SELECT vec_id AS track_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings"


def embedding_rows(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("track_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label"))


@register(
    "features_chunks",
    ("X-2", "X-8"),
    f"""
WITH e AS ({EMB_SQL}), c AS (SELECT track_id, v, unnest(range(0, len(v) // 10)) AS chunk FROM e)
SELECT track_id, CAST(chunk AS INTEGER) AS chunk, CAST(len(list_slice(v, chunk * 10 + 1, chunk * 10 + 10)) AS INTEGER) AS n_values,
       round(list_sum(list_slice(v, chunk * 10 + 1, chunk * 10 + 10)), 4) AS total
FROM c
""",
)
def q_chunks(spark, sf_dir):
    from ..operators.features import explode_chunks

    e = embedding_rows(spark, sf_dir).withColumn("chunks", arrays.equal_chunks("v", 10))
    ex = explode_chunks(e, "chunks")
    return ex.select("track_id", "chunk", F.size("values").alias("n_values"), F.round(arrays.array_sum("values"), 4).alias("total"))


POWER_SQL = "list_transform(v, lambda x: CASE WHEN abs(x) < 0.02 THEN 0.0 ELSE x * x END)"


def _log_sum_sql(n: int) -> str:
    return f"list_sum(list_transform(list_resize({POWER_SQL}, {n}, 0.0), lambda x: ln(CASE WHEN x = 0 THEN 1e-6 ELSE x END)))"


@register(
    "features_log_power",
    ("X-3", "X-4"),
    f"""
WITH e AS ({EMB_SQL})
SELECT track_id, round({_log_sum_sql(72)}, 3) AS log_sum_padded, round({_log_sum_sql(50)}, 3) AS log_sum_cut,
       CAST(len(list_filter({POWER_SQL}, lambda x: x = 0)) AS INTEGER) AS n_floor
FROM e
""",
)
def q_log_power(spark, sf_dir):
    e = embedding_rows(spark, sf_dir)
    power = F.transform("v", lambda x: F.when(F.abs(x) < 0.02, F.lit(0.0)).otherwise(x * x))
    e = e.withColumn("p", power)
    padded = arrays.log_floor(arrays.pad_truncate("p", 72))
    cut = arrays.log_floor(arrays.pad_truncate("p", 50))
    return e.select(
        "track_id",
        F.round(arrays.array_sum(padded), 3).alias("log_sum_padded"),
        F.round(arrays.array_sum(cut), 3).alias("log_sum_cut"),
        F.size(F.filter("p", lambda x: x == 0)).alias("n_floor"),
    )


@register(
    "features_first_chunk",
    ("X-7",),
    f"""
WITH e AS ({EMB_SQL})
SELECT track_id, round(list_sum(list_slice(v, 1, 10)), 4) AS first_total, CAST(100 AS INTEGER) AS zeros_len, CAST(0 AS DOUBLE) AS zeros_total FROM e
""",
)
def q_first_chunk(spark, sf_dir):
    e = embedding_rows(spark, sf_dir)
    f10 = arrays.first_or_zeros(arrays.equal_chunks("v", 10), 10)
    f100 = arrays.first_or_zeros(arrays.equal_chunks("v", 100), 100)
    return e.select(
        "track_id",
        F.round(arrays.array_sum(f10), 4).alias("first_total"),
        F.size(f100).alias("zeros_len"),
        F.round(arrays.array_sum(f100), 4).alias("zeros_total"),
    )


@register(
    "features_mean_pool",
    ("A-10",),
    f"""
WITH e AS ({EMB_SQL}), f AS (SELECT track_id, unnest(range(len(v))) AS i, unnest(v) AS x FROM e)
SELECT track_id, CAST(i % 8 AS INTEGER) AS dim, round(avg(x), 5) AS mean FROM f GROUP BY track_id, i % 8
""",
)
def q_mean_pool(spark, sf_dir):
    e = embedding_rows(spark, sf_dir)
    pooled = arrays.mean_over_time(arrays.reshape("v", 8))
    return e.select("track_id", F.posexplode(pooled).alias("dim", "mean")).select("track_id", "dim", F.round("mean", 5).alias("mean"))


@register(
    "features_training_matrix",
    ("X-10", "M-5", "X-4"),
    f"""
WITH e AS ({EMB_SQL})
SELECT track_id, repeat('0', label) || '1' || repeat('0', 9 - label) AS multihot,
       CAST(len(list_resize(v, 70, 0.0)) AS INTEGER) AS n_values, list_resize(v, 70, 0.0)[1] AS x_first, list_resize(v, 70, 0.0)[64] AS x_last,
       list_resize(v, 70, 0.0)[65] AS x_pad, round(list_sum(list_transform(range(64), lambda i: (i + 1) * v[i + 1])), 5) AS x_weighted FROM e
""",
)
def q_training_matrix(spark, sf_dir):
    from ..operators.features import training_matrix

    e = embedding_rows(spark, sf_dir)
    labels = e.select("track_id", F.array(F.col("label").cast("string")).alias("labels"))
    m = training_matrix(e.select("track_id", F.col("v").alias("values")), labels, [str(i) for i in range(10)], 70)
    weighted = F.aggregate(F.zip_with("x", F.sequence(F.lit(1), F.size("x")), lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return m.select(
        "track_id", F.array_join("y", "").alias("multihot"), F.size("x").alias("n_values"),
        F.col("x")[0].alias("x_first"), F.col("x")[63].alias("x_last"), F.col("x")[64].alias("x_pad"), F.round(weighted, 5).alias("x_weighted"),
    )
