"""Golden values taken from the reference's own unit tests and docstrings (portable literals)."""

from __future__ import annotations

import math

from tessitura.functions import arrays
from tessitura.functions.scores import argmax, multi_hot_from_indices, one_hot, topk_indices
from tessitura.operators import metrics


def scores_df(spark, data):
    return spark.createDataFrame([(i, [float(x) for x in s]) for i, s in enumerate(data)], "row_id long, s array<double>")


def test_top1_one_hot_and_index(spark):
    df = scores_df(spark, [[0.1, 0.2, 0.7], [0.5, 0.5, 0.0], [0.3, 0.5, 0.2]])
    out = df.select("row_id", argmax("s").alias("i")).select("row_id", "i", one_hot("i", 3).alias("oh")).orderBy("row_id").collect()
    assert [r.i for r in out] == [2, 0, 1]
    assert [r.oh for r in out] == [[0, 0, 1], [1, 0, 0], [0, 1, 0]]


def test_top2_multi_hot_and_indices(spark):
    df = scores_df(spark, [[0.1, 0.2, 0.7, 0.5], [0.5, 0.5, 0.0, 0.0]])
    out = df.select("row_id", topk_indices("s", 2).alias("t")).orderBy("row_id")
    got = out.select("t", multi_hot_from_indices("t", 4).alias("mh")).collect()
    assert [r.mh for r in got] == [[0, 0, 1, 1], [1, 1, 0, 0]]
    assert [r.t for r in got] == [[2, 3], [0, 1]]


def test_top3_of_three_is_all(spark):
    df = scores_df(spark, [[0.3, 0.5, 0.2]])
    got = df.select(multi_hot_from_indices(topk_indices("s", 3), 3).alias("mh")).first().mh
    assert got == [1, 1, 1]


def test_topk_accuracy(spark):
    data = [[0.1, 0.2, 0.7, 0.5], [0.5, 0.5, 0.0, 0.0]]
    df = spark.createDataFrame([(d, l) for d, l in zip(data, [2, 0])], "s array<double>, label int")
    assert metrics.topk_accuracy(df, "s", "label", (2,)).first()[0] == 1.0
    df = spark.createDataFrame([(d, l) for d, l in zip(data, [2, 2])], "s array<double>, label int")
    assert metrics.topk_accuracy(df, "s", "label", (1,)).first()[0] == 0.5


def test_equal_chunks_drop_tail(spark):
    df = spark.createDataFrame([(list(range(10)),)], "v array<int>")
    c3 = df.select(arrays.equal_chunks("v", 3).alias("c")).first().c
    c2 = df.select(arrays.equal_chunks("v", 2).alias("c")).first().c
    assert c3 == [[0, 1, 2], [3, 4, 5], [6, 7, 8]]
    assert c2 == [[0, 1], [2, 3], [4, 5], [6, 7], [8, 9]]
    short = spark.createDataFrame([([1, 2],)], "v array<int>").select(arrays.equal_chunks("v", 3).alias("c")).first().c
    assert short == []


def test_pad_truncate_and_log_floor(spark):
    df = spark.createDataFrame([([0.0, 1.0],)], "v array<double>")
    got = df.select(arrays.log_floor(arrays.pad_truncate("v", 3)).alias("x")).first().x
    assert got[1] == 0.0
    assert math.isclose(got[0], math.log(1e-6)) and math.isclose(got[2], math.log(1e-6))
    cut = df.select(arrays.pad_truncate("v", 1).alias("x")).first().x
    assert cut == [0.0]

