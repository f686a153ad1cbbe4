"""Split, batch and partner queries over ``orders`` / ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import split
from ..sources.tables import read_table
from .registry import register

IDX_SQL = """
SELECT o_orderkey AS ym_track_id,
       row_number() OVER (ORDER BY md5('{seed}:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS idx,
       count(*) OVER () AS n
FROM orders
"""


def order_ids(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ym_track_id"))


@register(
    "split_exact",
    ("R-1",),
    f"""
WITH i AS ({IDX_SQL.format(seed=2021)})
SELECT ym_track_id, idx, CASE WHEN idx < ceil(n * 0.1) THEN 'test' ELSE 'train' END AS split FROM i
""",
)
def q_split(spark, sf_dir):
    return split.exact_split(order_ids(spark, sf_dir), "ym_track_id", 0.1, 2021)


@register(
    "split_batches",
    ("R-2",),
    f"""
WITH i AS ({IDX_SQL.format(seed="2021:3")})
SELECT ym_track_id, idx, CAST(idx // 9 AS BIGINT) AS batch FROM i WHERE idx // 9 < n // 9
""",
)
def q_batches(spark, sf_dir):
    return split.batches(order_ids(spark, sf_dir), "ym_track_id", size=9, seed=2021, epoch=3, drop_last=True)


@register(
    "split_random_partner",
    ("R-3", "P-16", "P-17"),
    """
WITH i AS (SELECT p_partkey AS ym_track_id,
                  row_number() OVER (ORDER BY md5('5:' || CAST(p_partkey AS VARCHAR)), p_partkey) - 1 AS idx,
                  count(*) OVER () AS n FROM part),
     t AS (SELECT ym_track_id, idx, n,
                  CAST(('0x' || substr(md5('partner:5:' || CAST(ym_track_id AS VARCHAR)), 1, 15))::UBIGINT % (n - 1) AS BIGINT) AS raw FROM i),
     u AS (SELECT ym_track_id, CASE WHEN raw >= idx THEN raw + 1 ELSE raw END AS target FROM t)
SELECT u.ym_track_id, i.ym_track_id AS partner_ym_track_id,
       'https://covers.example/' || CAST(u.ym_track_id AS VARCHAR) || '_gen.jpg' AS image_first,
       'https://covers.example/' || CAST(i.ym_track_id AS VARCHAR) || '_gen.jpg' AS image_second,
       'audio/' || CAST(u.ym_track_id AS VARCHAR) || '.mp3' AS audio_path
FROM u JOIN i ON u.target = i.idx
""",
)
def q_partner(spark, sf_dir):
    parts = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ym_track_id"))
    pairs = split.random_partner(parts, "ym_track_id", seed=5, exclude_self=True)
    cover = lambda c: F.concat(F.lit("https://covers.example/"), F.col(c).cast("string"), F.lit("_gen.jpg"))
    return pairs.select(
        "ym_track_id", "partner_ym_track_id",
        cover("ym_track_id").alias("image_first"),
        cover("partner_ym_track_id").alias("image_second"),
        F.concat(F.lit("audio/"), F.col("ym_track_id").cast("string"), F.lit(".mp3")).alias("audio_path"),
    )


@register(
    "split_feature_batches",
    ("W-8",),
    """
WITH i AS (SELECT o_orderkey AS ym_track_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders),
     q AS (SELECT *, n // 10 AS q, n % 10 AS r FROM i)
SELECT ym_track_id, CAST(CASE WHEN idx < r * (q + 1) THEN idx // (q + 1) ELSE r + (idx - r * (q + 1)) // q END AS BIGINT) AS batch FROM q
""",
)
def q_feature_batches(spark, sf_dir):
    out = split.n_parts(order_ids(spark, sf_dir), "ym_track_id", 10)
    return out.select("ym_track_id", "batch")
