"""Quantile blocks, the two-level income scan, as-of joins."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessitura.operators import artists, crowd, split
from tessitura.operators.asof import latest_not_after
from tessitura.operators.ordering import dense_index, quantile_block


def _sizes(df, col, n):
    return [r["count"] for r in df.groupBy(quantile_block(df, col, n).alias("b")).count().collect()]


def test_an_outlier_does_not_crowd_the_rest(spark):
    df = spark.range(1, 50_001).unionByName(spark.createDataFrame([(2**62,)], "id long"))
    sizes = _sizes(df, "id", 64)
    assert sum(sizes) == 50_001 and max(sizes) <= 2 * sum(sizes) / 64


@pytest.mark.parametrize("make", [
    lambda i: F.concat(F.lit("https://static.tracks.example/audio/"), F.lpad(i.cast("string"), 9, "0"), F.lit(".mp3")),
    lambda i: F.date_add(F.lit("1970-01-01").cast("date"), (i % 9000).cast("int")),
    lambda i: F.timestamp_micros(i * i),
    lambda i: F.exp(i / 5000),
])
def test_text_times_and_skewed_numbers_are_cut_evenly_and_in_order(spark, make):
    df = spark.range(20_000).select(make(F.col("id")).alias("v"))
    cut = df.withColumn("b", quantile_block(df, "v", 32)).groupBy("b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).orderBy("b").collect()
    assert len(cut) >= 28 and max(r.n for r in cut) <= 2 * 20_000 / 32
    assert all(a.hi < b.lo for a, b in zip(cut, cut[1:]))


def test_blocks_of_odd_tables(spark):
    for values in ([], [None], [None, None, "", "a", "a"], ["same"] * 5, ["b", "ba", "bé", "b\U0001f600"]):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        got = dense_index(df, ["v"], quantile_block(df, "v", 8), idx_col="i").orderBy("i").collect()
        want = sorted(values, key=lambda v: (v is not None, (v or "").encode()))
        assert [r.v for r in got] == want and [r.i for r in got] == list(range(len(values)))


def test_parts_with_an_outlier_id(spark):
    df = spark.range(1, 1001).unionByName(spark.createDataFrame([(2**62,)], "id long"))
    got = {r.id: r.batch for r in split.n_parts(df, "id", 10, 64).collect()}
    want = [k for k in range(10) for _ in range(101 if k == 0 else 100)]
    assert [got[i] for i in sorted(got)] == want


def test_text_ordered_suites(spark):
    df = spark.createDataFrame([("happy", f"u{i:03d}") for i in range(44)] + [("sad", "u1")], "emotion string, audio_path string")
    got = crowd.task_suites(df).orderBy("emotion", "task_idx").collect()
    assert [r.suite for r in got if r.emotion == "happy"] == [0] * 15 + [1] * 15 + [2] * 14
    assert [r.audio_path for r in got if r.emotion == "happy"] == sorted(f"u{i:03d}" for i in range(44))


def test_income_of_a_hot_worker(spark):
    rng = random.Random(3)
    start = datetime(2021, 5, 1)
    rows = [(i, "hot", start + timedelta(seconds=rng.randrange(86_400)), 0.01) for i in range(3000)]
    rows += [(3000 + i, "hot", start, 0.5) for i in range(400)]  # one moment holds many answers
    rows += [(4000 + i, rng.choice(["a", "b", None]), start + timedelta(hours=rng.randrange(200)), rng.choice([None, 1.25])) for i in range(300)]
    rows += [(5000, "hot", None, 2.0), (5001, "hot", None, 3.0), (5002, "x", start, 20.0)]
    df = spark.createDataFrame(rows, "answer_id long, worker_id string, submitted_at timestamp_ntz, reward double").repartition(4)
    got = {r.answer_id: (round(r.income_24h, 4), r.restricted) for r in crowd.income_last_24h(df).collect()}
    assert len(got) == len(rows)
    day = timedelta(hours=24)
    for i, w, t, _ in rows:
        if t is None:
            want = sum(r[3] or 0 for r in rows if r[1] == w and r[2] is None)
        elif i % 37 == 0 or i >= 4000:
            want = sum(r[3] or 0 for r in rows if r[1] == w and r[2] is not None and t - day <= r[2] <= t)
        else:
            continue
        assert got[i] == (round(want, 4), round(want, 4) >= 20.0), i


def test_income_blocks_are_even(spark):
    start = datetime(2021, 5, 1)
    df = spark.range(20_000).select(F.col("id").alias("answer_id"), F.lit("hot").alias("w"), (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pmod(F.col("id") * 4.3, F.lit(86_400)))).alias("at"))
    from tessitura.operators.ordering import epoch_micros

    times = df.select(epoch_micros(df, "at").alias("at"))
    sizes = sorted(_sizes(times, "at", 64))
    assert max(sizes) < 2 * sizes[len(sizes) // 2]


def test_latest_not_after(spark):
    rng = random.Random(9)
    left = [(i, rng.choice(["a", "b", "hot", None]), rng.choice([None, *range(100)])) for i in range(400)]
    right = [(rng.choice(["a", "hot", "hot", None]), rng.choice([None, *range(0, 100, 3)]), f"p{rng.randrange(50)}") for _ in range(150)]
    got = {r.id: r.latest for r in latest_not_after(spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "k string, at long, p string"), ["k"], "t", ["p"], right_time="at").collect()}
    assert len(got) == 400
    for i, k, t in left:
        fits = [(x[1], x[2]) for x in right if k is not None and t is not None and x[0] == k and x[1] is not None and x[1] <= t]
        assert (got[i].p if got[i] else None) == (max(fits)[1] if fits else None), (i, k, t)
    empty = spark.createDataFrame([], "k string, at long, p string")
    assert latest_not_after(spark.createDataFrame(left, "id long, k string, t long"), empty, ["k"], "t", ["p"], right_time="at").where("latest is not null").count() == 0


def test_the_newest_answer_counts(spark):
    row = "<row><code>100</code><answer>valid</answer><country>{}</country></row>"
    data = [("x", "musicovery", "search", row.format("zz"), 1), ("x", "musicovery", "search", row.format("aa"), 5), ("x", "musicovery", "search", row.format("mm"), None),
            ("y", "musicovery", "search", row.format("b"), 3)]
    df = spark.createDataFrame(data, "artist_name string, source string, kind string, body string, received long")
    assert {r.artist_name: r.artist_country for r in artists.parse_search_info(df).collect()} == {"x": "aa", "y": "b"}
    asks = spark.createDataFrame([(1, "x", 0), (2, "x", 1), (3, "x", 4), (4, "x", 9), (5, "z", 9), (6, "x", None)], "id long, artist_name string, at long")
    got = {r.id: (r.status, r.artist_country) for r in artists.answers_as_of(asks, df, "at").collect()}
    assert got == {1: (None, None), 2: ("ok", "zz"), 3: ("ok", "zz"), 4: ("ok", "aa"), 5: (None, None), 6: (None, None)}
