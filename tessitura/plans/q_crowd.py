"""Crowd queries over ``lineitem`` bound as answers (see bindings)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lists import join_list
from ..functions.paths import track_url_pattern, track_key
from ..operators import crowd
from ..schemas import EMOTIONS
from ..sources.tables import read_table
from .bindings import ANSWER_ORDER, ANSWER_ORDER_SQL, ANSWERS_SQL, BASE_URL, ORDER_TRACKS_SQL, answers, order_tracks, sql_list
from .registry import register

URL_RE = track_url_pattern(BASE_URL)
CUTOFF = "1998-01-01"

VOTE_SQL = f"""
SELECT TRY_CAST(NULLIF(regexp_extract(audio_path, '{URL_RE}', 1), '') AS BIGINT) AS ym_track_id,
       emotion, CAST("NO" AS BIGINT) AS "NO", CAST("YES" AS BIGINT) AS "YES",
       CASE WHEN "YES" + "NO" = 0 THEN NULL ELSE CAST("YES" AS DOUBLE) / CAST("YES" + "NO" AS DOUBLE) END AS rate
FROM (SELECT emotion, audio_path,
             count(*) FILTER (WHERE result = 'NO') AS "NO",
             count(*) FILTER (WHERE result = 'YES') AS "YES"
      FROM answers {{where}} GROUP BY emotion, audio_path)
"""


def _vote_sql(where: str = "") -> str:
    return VOTE_SQL.replace("{where}", where)


def vote(spark, sf_dir, where=None):
    a = answers(spark, sf_dir)
    if where is not None:
        a = a.where(where)
    return crowd.majority_vote(a, base_url=BASE_URL)


@register("crowd_vote", ("A-1", "F-5", "L-1", "S-12"), f"WITH answers AS ({ANSWERS_SQL}) {_vote_sql()}")
def q_vote(spark, sf_dir):
    return crowd.sort_by_rate(vote(spark, sf_dir))


CONFIRMED_SQL = f"""
WITH answers AS ({ANSWERS_SQL}),
     votes AS ({_vote_sql()}),
     conf AS (SELECT ym_track_id,
                     string_agg(emotion, '|' ORDER BY coalesce(list_position({sql_list(EMOTIONS)}, emotion), 1000), emotion) AS emotions,
                     count(*) AS n_emotions
              FROM (SELECT DISTINCT ym_track_id, emotion FROM votes WHERE rate >= 1.0 AND ym_track_id IS NOT NULL)
              GROUP BY ym_track_id)
SELECT o.o_orderkey AS ym_track_id, o.o_orderpriority AS priority,
       coalesce(c.emotions, '') AS emotions, coalesce(c.n_emotions, 0) AS n_emotions
FROM orders o LEFT JOIN conf c ON o.o_orderkey = c.ym_track_id
"""


def confirmed_emotions(spark, sf_dir):
    """Flagship: vote -> confirm (rate >= 1) -> apply to every track (left join)."""
    votes = vote(spark, sf_dir)
    conf = crowd.confirmed_labels(votes)
    tracks = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ym_track_id"), F.col("o_orderpriority").alias("priority")
    )
    out = crowd.apply_confirmed(tracks, conf)
    return out.select(
        "ym_track_id", "priority",
        join_list("emotions").alias("emotions"),
        F.size("emotions").cast("long").alias("n_emotions"),
    )


register("crowd_confirmed_emotions", ("A-1", "A-2", "J-13", "F-2"), CONFIRMED_SQL)(confirmed_emotions)


@register(
    "crowd_assignments_upsert",
    ("U-2", "W-2"),
    f"""
WITH answers AS ({ANSWERS_SQL}),
     old AS ({_vote_sql(f"WHERE submitted_at < TIMESTAMP '{CUTOFF}'")}),
     new AS ({_vote_sql(f"WHERE submitted_at >= TIMESTAMP '{CUTOFF}'")})
SELECT ym_track_id, emotion, "NO", "YES", rate FROM (SELECT *, 1 AS ver FROM new UNION ALL SELECT *, 0 FROM old)
QUALIFY row_number() OVER (PARTITION BY ym_track_id, emotion ORDER BY ver DESC, rate IS NULL DESC, rate, "YES", "NO") = 1
""",
)
def q_upsert(spark, sf_dir):
    ts = F.col("submitted_at")
    old = vote(spark, sf_dir, ts < F.lit(CUTOFF).cast("timestamp_ntz"))
    new = vote(spark, sf_dir, ts >= F.lit(CUTOFF).cast("timestamp_ntz"))
    return crowd.upsert_assignments(old, new)


@register(
    "crowd_assignment_keys",
    ("U-2",),
    f"""
WITH answers AS ({ANSWERS_SQL}), votes AS ({_vote_sql()}), tracks AS ({ORDER_TRACKS_SQL})
SELECT CAST(t.ym_album_id AS VARCHAR) || ':' || CAST(v.ym_track_id AS VARCHAR) || ':' || v.emotion AS key, count(*) AS n_rows
FROM votes v JOIN tracks t USING (ym_track_id) GROUP BY ALL
""",
)
def q_assignment_keys(spark, sf_dir):
    """The text key of every assignment whose track is known."""
    votes = vote(spark, sf_dir).select("ym_track_id", "emotion")
    known = votes.join(order_tracks(spark, sf_dir).select("ym_track_id", "ym_album_id"), "ym_track_id")
    return known.groupBy(track_key("ym_album_id", "ym_track_id", "emotion").alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))


@register(
    "crowd_unassigned_tracks",
    ("J-1",),
    f"""
WITH answers AS ({ANSWERS_SQL}), votes AS ({_vote_sql()}), tracks AS ({ORDER_TRACKS_SQL})
SELECT ym_track_id, priority FROM tracks t
WHERE NOT EXISTS (SELECT 1 FROM votes v WHERE v.ym_track_id = t.ym_track_id)
""",
)
def q_unassigned(spark, sf_dir):
    return crowd.unassigned(order_tracks(spark, sf_dir), vote(spark, sf_dir)).select("ym_track_id", "priority")


@register(
    "crowd_assigned_tracks",
    ("J-2",),
    f"""
WITH answers AS ({ANSWERS_SQL}), votes AS ({_vote_sql()}), tracks AS ({ORDER_TRACKS_SQL})
SELECT ym_track_id, priority FROM tracks t
WHERE EXISTS (SELECT 1 FROM votes v WHERE v.ym_track_id = t.ym_track_id)
""",
)
def q_assigned(spark, sf_dir):
    return crowd.assigned(order_tracks(spark, sf_dir), vote(spark, sf_dir)).select("ym_track_id", "priority")


ANSWER_KEY = ["worker_id", "l_orderkey", "l_linenumber", "l_partkey"]
ANSWER_KEY_SQL = ", ".join(ANSWER_KEY)


@register(
    "crowd_income_24h",
    ("W-4",),
    f"""
WITH answers AS ({ANSWERS_SQL}),
     w AS (SELECT {ANSWER_KEY_SQL},
                  sum(CAST(reward AS DECIMAL(20, 4))) OVER (PARTITION BY worker_id ORDER BY submitted_at NULLS FIRST
                                    RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS income
           FROM answers)
SELECT {ANSWER_KEY_SQL}, round(CAST(income AS DOUBLE), 4) AS income_24h, income >= 20.0 AS restricted FROM w
""",
)
def q_income(spark, sf_dir):
    out = crowd.income_last_24h(answers(spark, sf_dir))
    return out.select(*ANSWER_KEY, F.round("income_24h", 4).alias("income_24h"), "restricted")


@register(
    "crowd_skipped_in_row",
    ("W-5",),
    f"""
WITH answers AS ({ANSWERS_SQL}),
     a AS (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY {ANSWER_ORDER_SQL}) - 1 AS pos,
                  status = 'SKIPPED' AS skip FROM answers),
     b AS (SELECT *, max(CASE WHEN NOT skip THEN pos END) OVER (PARTITION BY worker_id ORDER BY pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_ok FROM a)
SELECT {ANSWER_KEY_SQL},
       CAST(CASE WHEN skip THEN pos - coalesce(last_ok, -1) ELSE 0 END AS BIGINT) AS skipped_in_row,
       CASE WHEN skip THEN pos - coalesce(last_ok, -1) ELSE 0 END >= 10 AS restricted
FROM b
""",
)
def q_skipped(spark, sf_dir):
    a = answers(spark, sf_dir)
    out = crowd.skipped_in_row(a, F.col("status") == "SKIPPED", ANSWER_ORDER)
    return out.select(*ANSWER_KEY, "skipped_in_row", "restricted")


@register(
    "crowd_majority_agreement",
    ("W-6",),
    f"""
WITH answers AS ({ANSWERS_SQL}),
     c AS (SELECT emotion, audio_path, result, count(*) AS n FROM answers WHERE result IN ('YES', 'NO') GROUP BY ALL),
     m AS (SELECT emotion, audio_path, max(result) AS majority FROM c WHERE n >= 3 GROUP BY ALL HAVING count(*) = 1),
     s AS (SELECT a.*, CAST(a.result = m.majority AS INTEGER) AS correct FROM answers a JOIN m USING (emotion, audio_path)),
     w AS (SELECT {ANSWER_KEY_SQL}, correct,
                  count(*) OVER h AS n_recent, avg(correct) OVER h * 100.0 AS pct,
                  row_number() OVER (PARTITION BY worker_id ORDER BY {ANSWER_ORDER_SQL}) AS n_total
           FROM s WINDOW h AS (PARTITION BY worker_id ORDER BY {ANSWER_ORDER_SQL} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT {ANSWER_KEY_SQL}, correct, n_recent, round(pct, 4) AS correct_pct, n_total,
       n_total >= 4 AND pct < 75 AS restricted
FROM w
""",
)
def q_majority(spark, sf_dir):
    out = crowd.majority_agreement(answers(spark, sf_dir), ANSWER_ORDER)
    return out.select(*ANSWER_KEY, "correct", "n_recent", F.round("correct_pct", 4).alias("correct_pct"), "n_total", "restricted")


@register(
    "crowd_task_suites",
    ("P-15", "W-7", "F-7"),
    f"""
WITH t AS ({ORDER_TRACKS_SQL}),
     i AS (SELECT emotion, ym_track_id, '{BASE_URL}' || audio_path AS audio_path,
                  row_number() OVER (PARTITION BY emotion ORDER BY ym_track_id) - 1 AS idx,
                  count(*) OVER (PARTITION BY emotion) AS n FROM t),
     k AS (SELECT *, CAST(ceil(n / 20.0) AS BIGINT) AS k FROM i),
     q AS (SELECT *, n // k AS q, n % k AS r FROM k)
SELECT emotion, ym_track_id, audio_path, idx AS task_idx,
       CAST(CASE WHEN idx < r * (q + 1) THEN idx // (q + 1) ELSE r + (idx - r * (q + 1)) // q END AS BIGINT) AS suite
FROM q
""",
)
def q_suites(spark, sf_dir):
    t = order_tracks(spark, sf_dir)
    tasks = crowd.task_projection(t, BASE_URL, keep=["ym_track_id"])
    out = crowd.task_suites(tasks, order_cols=["ym_track_id"])
    return out.select("emotion", "ym_track_id", "audio_path", "task_idx", "suite")


WORKERS_SQL = """
SELECT CAST(c_custkey AS VARCHAR) AS worker_id, c_nationkey AS region,
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'RU' ELSE 'EN' END AS language,
       CASE WHEN c_acctbal < 3000 THEN 'BROWSER' WHEN c_acctbal < 8000 THEN 'TOLOKA_APP' ELSE 'OTHER' END AS client,
       round(100.0 - abs(c_acctbal) / 100.0, 2) AS skill
FROM customer
"""
BOUND_REGIONS = [1, 3, 5, 7, 11, 13, 17, 19, 23]


def workers(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("worker_id"),
        F.col("c_nationkey").alias("region"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD"), F.lit("RU")).otherwise(F.lit("EN")).alias("language"),
        F.when(F.col("c_acctbal") < 3000, F.lit("BROWSER")).when(F.col("c_acctbal") < 8000, F.lit("TOLOKA_APP"))
        .otherwise(F.lit("OTHER")).alias("client"),
        F.round(F.lit(100.0) - F.abs(F.col("c_acctbal")) / 100.0, 2).alias("skill"),
    )


@register(
    "crowd_eligible_workers",
    ("P-18", "P-19"),
    f"""
WITH w AS ({WORKERS_SQL})
SELECT * FROM w WHERE region IN ({", ".join(map(str, BOUND_REGIONS))}) AND language IN ('RU')
  AND client IN ('TOLOKA_APP', 'BROWSER') AND skill >= 90
""",
)
def q_workers(spark, sf_dir):
    return crowd.eligible_workers(workers(spark, sf_dir), regions=BOUND_REGIONS)
