"""Crowd operators: vote edge cases, confirm, upsert, suites, worker windows vs brute force."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessitura.operators import crowd
from tessitura.operators.ordering import dense_index, near_equal_parts, range_block

from .conftest import rows

BASE = "https://s.example/static/"
ANS = "emotion string, audio_path string, result string"


def test_vote_cases(spark):
    data = [
        ("happy", BASE + "a/12:345.mp3", "YES"),
        ("happy", BASE + "a/12:345.mp3", "YES"),
        ("happy", BASE + "a/12:345.mp3", "NO"),
        ("happy", BASE + "a/777.mp3", "YES"),  # only YES
        ("happy", BASE + "a/888.mp3", "NO"),  # only NO
        ("happy", BASE + "a/999.mp3", None),  # neither
        ("happy", BASE + "notmp3.txt", "YES"),  # no match
        ("happy", "https://other.example/a/5.mp3", "YES"),  # other base
    ]
    df = spark.createDataFrame(data, ANS)
    got = crowd.majority_vote(df, base_url=BASE).collect()
    by_id = {(r.ym_track_id, r.NO, r.YES): r.rate for r in got}
    assert math.isclose(by_id[(345, 1, 2)], 2 / 3)
    assert by_id[(777, 0, 1)] == 1.0
    assert by_id[(888, 1, 0)] == 0.0
    assert by_id[(999, 0, 0)] is None
    assert (None, 0, 1) in by_id  # no match and other base give null track ids
    assert len(got) == 6


def test_confirm_and_apply(spark):
    a = spark.createDataFrame(
        [(1, "sadness", 0, 3, 1.0), (1, "happy", 0, 3, 1.0), (1, "fear", 1, 2, 2 / 3), (2, "zzz", 0, 1, 1.0)],
        "ym_track_id long, emotion string, NO long, YES long, rate double",
    )
    conf = crowd.confirmed_labels(a)
    got = dict((r.ym_track_id, r.emotions) for r in conf.collect())
    assert got == {1: ["happy", "sadness"], 2: ["zzz"]}  # vocabulary order, unknown last
    tracks = spark.createDataFrame([(1,), (2,), (3,)], "ym_track_id long")
    applied = dict((r.ym_track_id, r.emotions) for r in crowd.apply_confirmed(tracks, conf).collect())
    assert applied[3] == []


def test_upsert_new_wins_and_is_idempotent(spark):
    schema = "ym_track_id long, emotion string, NO long, YES long, rate double"
    old = spark.createDataFrame([(1, "happy", 1, 1, 0.5), (2, "happy", 0, 1, 1.0)], schema)
    new = spark.createDataFrame([(1, "happy", 0, 3, 1.0), (3, "fear", 2, 0, 0.0)], schema)
    once = crowd.upsert_assignments(old, new)
    assert rows(once) == [(1, "happy", 0, 3, 1.0), (2, "happy", 0, 1, 1.0), (3, "fear", 2, 0, 0.0)]
    twice = crowd.upsert_assignments(once, new)
    assert rows(twice) == rows(once)


@settings(max_examples=25, deadline=None)
@given(n=st.integers(1, 300), per=st.integers(1, 40))
def test_near_equal_parts_match_array_split(spark, n, per):
    k = math.ceil(n / per)
    expected = np.concatenate([np.full(len(p), i) for i, p in enumerate(np.array_split(np.arange(n), k))])
    pdf = pd.DataFrame({"idx": np.arange(n)})
    # evaluate the same expression through Spark on a small literal table
    df = spark.createDataFrame(pdf).withColumn("n", F.lit(n)).withColumn("k", F.lit(k))
    got = [r.p for r in df.select("idx", near_equal_parts("idx", "n", "k").alias("p")).orderBy("idx").collect()]
    assert got == list(expected)


def test_array_split_sizes_45_44(spark):
    for n in (45, 44):
        df = spark.range(n).withColumn("emotion", F.lit("x"))
        out = crowd.task_suites(df, order_cols=["id"], per_suite=20)
        sizes = sorted(r[1] for r in out.groupBy("suite").count().collect())
        assert sizes == sorted(len(p) for p in np.array_split(np.arange(n), 3))


def test_dense_index_blocks_equal_row_number(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "v": rng.permutation(500)})
    df = spark.createDataFrame(pdf)
    out = dense_index(df, ["v"], F.floor(F.col("v") / 37), partition_cols=["g"], idx_col="i").toPandas()
    exp = pdf.sort_values("v").assign(i=lambda x: x.groupby("g").cumcount())
    m = out.merge(exp, on=["g", "v"], suffixes=("", "_e"))
    assert (m.i == m.i_e).all() and len(m) == 500


def test_dense_index_keeps_null_keys(spark):
    df = spark.createDataFrame([("a", 5), (None, 7), ("a", None), (None, None), (None, 3), ("a", 1)], "g string, v int")
    got = rows(dense_index(df, ["v"], F.floor(F.col("v") / 4), partition_cols=["g"], idx_col="i", total_col="n").fillna({"g": "-", "v": -1}), "g", "v", "i", "n")
    assert got == [("-", -1, 0, 3), ("-", 3, 1, 3), ("-", 7, 2, 3), ("a", -1, 0, 3), ("a", 1, 1, 3), ("a", 5, 2, 3)]
    wide = dense_index(df, ["v"], range_block(df, "v", 4), idx_col="i").where("v = 7").first().i
    assert wide == 5


def test_upsert_keeps_the_last_row_in_rate_order(spark):
    cols = "ym_track_id long, emotion string, NO long, YES long, rate double"
    old = spark.createDataFrame([(1, "happy", 9, 1, 0.1), (2, "happy", 1, 3, 0.75), (2, "happy", 1, 1, 0.5), (None, "sad", 0, 2, 1.0)], cols)
    new = spark.createDataFrame([(1, "happy", 0, 3, 1.0), (1, "happy", 2, 2, 0.5), (None, "sad", 0, 0, None), (None, "sad", 1, 0, 0.0)], cols)
    assert {(r.ym_track_id, r.rate) for r in crowd.upsert_assignments(old, new).collect()} == {(1, 0.5), (2, 0.5), (None, None)}


def test_answers_without_worker_or_time_stay(spark):
    base = dt.datetime(2024, 1, 1)
    data = [(i, None if i % 3 == 0 else "w", None if i % 4 == 0 else base + dt.timedelta(hours=i), "SKIPPED" if i % 5 else "SUBMITTED", 1.5, "u", "YES", "happy") for i in range(24)]
    df = spark.createDataFrame(data, "answer_id long, worker_id string, submitted_at timestamp, status string, reward double, audio_path string, result string, emotion string")
    order = ["submitted_at", "answer_id"]
    income = {r.answer_id: r.income_24h for r in crowd.income_last_24h(df).collect()}
    runs = {r.answer_id: r.skipped_in_row for r in crowd.skipped_in_row(df, F.col("status") == "SKIPPED", order).collect()}
    agree = {r.answer_id: r.n_total for r in crowd.majority_agreement(df, order, chunk=12).collect()}
    assert len(income) == len(runs) == len(agree) == 24
    for worker in (None, "w"):
        mine = sorted((d for d in data if d[1] == worker), key=lambda d: (d[2] is not None, d[2] or base, d[0]))
        run = 0
        for k, d in enumerate(mine):
            run = run + 1 if d[3] == "SKIPPED" else 0
            assert runs[d[0]] == run and agree[d[0]] == k + 1
            same = [x for x in mine if (x[2] is None) == (d[2] is None) and (d[2] is None or d[2] - dt.timedelta(days=1) <= x[2] <= d[2])]
            assert income[d[0]] == 1.5 * len(same)


def _answers_fixture(spark, seed=3, n=400):
    rng = np.random.default_rng(seed)
    base = dt.datetime(2024, 1, 1)
    pdf = pd.DataFrame({
        "answer_id": np.arange(n),
        "worker_id": rng.choice(["w1", "w2", "w3"], n, p=[0.6, 0.3, 0.1]),
        "submitted_at": [base + dt.timedelta(hours=float(h)) for h in np.sort(rng.uniform(0, 24 * 6, n))],
        "status": rng.choice(["SKIPPED", "SUBMITTED"], n, p=[0.6, 0.4]),
        "reward": rng.uniform(0, 3, n).round(2),
        "audio_path": [f"{BASE}a/{t}.mp3" for t in rng.integers(0, 40, n)],
        "result": rng.choice(["YES", "NO"], n),
        "emotion": "happy",
    })
    return pdf, spark.createDataFrame(pdf)


def test_income_24h_brute_force(spark):
    pdf, df = _answers_fixture(spark)
    got = crowd.income_last_24h(df).select("answer_id", "income_24h").toPandas().set_index("answer_id")["income_24h"]
    for _, r in pdf.sample(60, random_state=0).iterrows():
        w = pdf[(pdf.worker_id == r.worker_id) & (pdf.submitted_at <= r.submitted_at) & (pdf.submitted_at >= r.submitted_at - dt.timedelta(days=1))]
        assert math.isclose(got[r.answer_id], w.reward.sum(), rel_tol=1e-9, abs_tol=1e-9)


def test_skipped_in_row_brute_force(spark):
    pdf, df = _answers_fixture(spark)
    got = crowd.skipped_in_row(df, F.col("status") == "SKIPPED", ["submitted_at", "answer_id"]).select("answer_id", "skipped_in_row").toPandas()
    got = got.set_index("answer_id")["skipped_in_row"]
    for _, g in pdf.sort_values(["submitted_at", "answer_id"]).groupby("worker_id"):
        run = 0
        for _, r in g.iterrows():
            run = run + 1 if r.status == "SKIPPED" else 0
            assert got[r.answer_id] == run


def test_majority_agreement_brute_force(spark):
    pdf, df = _answers_fixture(spark)
    got = crowd.majority_agreement(df, ["submitted_at", "answer_id"], chunk=16).toPandas().set_index("answer_id")
    counts = pdf.groupby(["emotion", "audio_path", "result"]).size().reset_index(name="c")
    maj = counts[counts.c >= 3].groupby(["emotion", "audio_path"]).filter(lambda x: len(x) == 1)
    s = pdf.merge(maj[["emotion", "audio_path", "result"]].rename(columns={"result": "majority"}), on=["emotion", "audio_path"])
    s["correct"] = (s.result == s.majority).astype(int)
    for _, g in s.sort_values(["submitted_at", "answer_id"]).groupby("worker_id"):
        hist = []
        for _, r in g.iterrows():
            hist.append(r.correct)
            last = hist[-10:]
            assert got.loc[r.answer_id, "n_recent"] == len(last)
            assert math.isclose(got.loc[r.answer_id, "correct_pct"], 100.0 * sum(last) / len(last))
            assert got.loc[r.answer_id, "n_total"] == len(hist)
    assert len(got) == len(s)


def test_eligible_workers(spark):
    w = spark.createDataFrame(
        [("a", 225, "RU", "BROWSER", 95.0), ("b", 225, "EN", "BROWSER", 95.0), ("c", 1, "RU", "BROWSER", 95.0), ("d", 149, "RU", "TOLOKA_APP", 80.0)],
        "worker_id string, region int, language string, client string, skill double",
    )
    assert [r.worker_id for r in crowd.eligible_workers(w).collect()] == ["a"]
    assert sorted(r.worker_id for r in crowd.eligible_workers(w, min_skill=None).collect()) == ["a", "d"]
