"""Splits, text keywords and features: sizes, brute-force TF-IDF, mel blocks vs whole signal."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessitura.operators import features, split, text


def test_exact_split_sizes_and_dense_index(spark):
    df = spark.range(10007).withColumnRenamed("id", "k")
    out = split.exact_split(df, "k", 0.1, 2021).cache()
    assert out.where(F.col("split") == "test").count() == 1001
    idx = sorted(r.idx for r in out.select("idx").collect())
    assert idx == list(range(10007))
    out.unpersist()


@settings(max_examples=8, deadline=None)
@given(n=st.integers(1, 200), size=st.integers(1, 20), drop=st.booleans())
def test_batches_sizes(spark, n, size, drop):
    df = spark.range(n).withColumnRenamed("id", "k")
    got = split.batches(df, "k", size=size, drop_last=drop).groupBy("batch").count().collect()
    sizes = sorted(r[1] for r in got)
    full, rest = divmod(n, size)
    exp = [size] * full + ([] if drop or rest == 0 else [rest])
    assert sizes == sorted(exp)


def test_random_partner_exclude_self(spark):
    df = spark.range(300).withColumnRenamed("id", "k")
    out = split.random_partner(df, "k", seed=3, exclude_self=True).collect()
    assert len(out) == 300 and all(r.k != r.partner_k and r.partner_k is not None for r in out)
    again = split.random_partner(df, "k", seed=3, exclude_self=True).collect()
    assert sorted(tuple(r) for r in out) == sorted(tuple(r) for r in again)


DOCS = [
    (1, "The cat sat on the mat.\nThe cat is fat"),
    (2, "A dog and a cat played; the dog won"),
    (3, "\n"),
    (4, "Éclair été éclair ÉTÉ été"),
]


def test_clean_text_and_lyrics_path(spark):
    df = spark.createDataFrame(DOCS, "track_id long, text string")
    out = {r.track_id: r.lyrics_path for r in text.attach_lyrics(df.select("track_id"), df).collect()}
    assert out[3] is None and out[1] == "lyrics/1.txt"


def test_tokens_equal_regex(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    split_toks = [r.t for r in df.orderBy("doc_id").select(text.tokens("text").alias("t")).collect()]
    rx = [r.t for r in df.orderBy("doc_id").select(F.regexp_extract_all(F.lower(text.clean_text("text")), F.lit(text.TOKEN_RE), 0).alias("t")).collect()]
    assert split_toks == rx


def test_tfidf_brute_force(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = {(r.doc_id, r.rank): (r.keyword, r.weight) for r in text.tfidf_keywords(df, top=3).collect()}
    toks = {d: re.findall(r"[^\W\d_]{3,}", t.lower()) for d, t in DOCS}
    toks = {d: t for d, t in toks.items() if t}
    n = len(toks)
    dfreq = Counter(w for t in toks.values() for w in set(t))
    for d, t in toks.items():
        c = Counter(t)
        scored = sorted(((-(c[w] / len(t)) * math.log(n / dfreq[w]), w) for w in c))[:3]
        for rank, (neg, w) in enumerate(scored, 1):
            kw, wt = got[(d, rank)]
            assert kw == w and math.isclose(wt, -neg, abs_tol=1e-12)


def test_vocabulary_and_restriction(spark):
    kw = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.2, 2), (2, "b", 0.4, 1), (3, "c", 0.1, 1)], "doc_id long, keyword string, weight double, rank int")
    vocab = text.keyword_vocabulary(kw, size=2)
    assert [(r.keyword, r.idx) for r in vocab.orderBy("idx").collect()] == [("b", 0), ("a", 1)]
    lab = {r.doc_id: r.labels for r in text.restrict_to_vocabulary(kw, vocab, size=2).collect()}
    assert lab == {1: ["b", "a"], 2: ["b"]}


def test_log_mel_blocks_equal_whole_signal(spark):
    rng = np.random.default_rng(0)
    sigs = {1: rng.standard_normal(10000), 2: rng.standard_normal(4096 * 3), 3: rng.standard_normal(700)}
    block = 4096
    data = [(t, b, [float(v) for v in y[b * block:(b + 1) * block]]) for t, y in sigs.items() for b in range((len(y) + block - 1) // block)]
    pcm = spark.createDataFrame(data, "track_id long, block int, samples array<float>")
    out = features.log_mel(pcm, block_size=block).toPandas().sort_values(["track_id", "frame"])
    for t, y in sigs.items():
        ref = features.whole_signal_log_mel(np.asarray(y, dtype=np.float32).astype(np.float64))
        got = np.stack(out[out.track_id == t].mel.values)
        assert got.shape == ref.shape
        assert np.abs(got - ref).max() < 1e-4
    counts = {r.track_id: r.n_frames for r in features.frame_counts(pcm).collect()}
    assert counts == {t: 1 + len(y) // 1024 for t, y in sigs.items()}


def test_mel_filterbank_properties():
    m = features.mel_filterbank()
    assert m.shape == (128, 1025)
    assert (m >= 0).all() and (m.sum(axis=1) > 0).all()
    peaks = m.argmax(axis=1)
    assert (np.diff(peaks) >= 0).all()


def test_chunk_frames_drops_tail(spark):
    frames = spark.createDataFrame([(1, f, [0.0]) for f in range(10)], "track_id long, frame int, mel array<float>")
    out = features.chunk_frames(frames, 3)
    assert sorted(r.chunk for r in out.select("chunk").distinct().collect()) == [0, 1, 2]
    assert out.count() == 9


def test_first_seconds(spark):
    pcm = spark.createDataFrame([(1, 0, [0.0] * 8), (1, 1, [0.0] * 8), (1, 2, [0.0] * 3)], "track_id long, block int, samples array<float>")
    out = features.first_seconds(pcm, 10, sr=1, block_size=8)
    assert sorted((r.block, len(r.samples)) for r in out.collect()) == [(0, 8), (1, 2)]


@pytest.mark.parametrize("n", [0, 5])
def test_first_or_zeros(spark, n):
    from tessitura.functions.arrays import equal_chunks, first_or_zeros

    df = spark.createDataFrame([([1.0] * n,)], "v array<double>")
    got = df.select(first_or_zeros(equal_chunks("v", 5), 5).alias("c")).first().c
    assert got == ([1.0] * 5 if n else [0.0] * 5)


def test_keyphrases_use_every_word(spark):
    from tessitura.operators.keyphrases import keyphrases

    docs = spark.createDataFrame([(1, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(80))), (2, "alpha beta gamma")],
                                 "doc_id long, text string")
    out = keyphrases(docs, n=100, alias_threshold=1.01).collect()
    assert sum(1 for r in out if r.doc_id == 1) == 80  # all 80 distinct words are candidates


def test_append_equals_a_full_recompute(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta gamma"), (2, "beta gamma delta"), (3, "alpha alpha epsilon"), (4, None), (5, "zeta alpha")], "doc_id long, text string")
    full = {(r.doc_id, r.keyword): round(r.weight, 9) for r in text.tfidf_keywords(docs).collect()}
    for first in ([1, 2], [3], []):
        known = docs.where(F.col("doc_id").isin(first))
        terms = text.term_counts(known)
        stored = text.document_frequencies(terms)
        existing = text.top_keywords(text.weigh(terms, stored))
        got = text.append_missing_keywords(existing, docs, stored, origin_col="origin").where("origin = 'new'")
        assert {(r.doc_id, r.keyword): round(r.weight, 9) for r in got.collect()} == {k: w for k, w in full.items() if k[0] not in first}


def test_resample_matches_linear_interpolation(spark):
    rng = np.random.default_rng(4)
    y = {1: rng.normal(size=1000).astype(np.float32), 2: rng.normal(size=7).astype(np.float32), 3: rng.normal(size=64).astype(np.float32)}
    pcm = spark.createDataFrame([(t, b, y[t][b * 64 : (b + 1) * 64].tolist()) for t in y for b in range(-(-len(y[t]) // 64))], "track_id long, block int, samples array<float>")
    for sr_in, sr_out in ((22050, 16000), (16000, 22050), (8000, 8000), (48000, 11025)):
        got = {}
        for r in features.resample(pcm, sr_in, sr_out, 64).orderBy("track_id", "block").collect():
            assert r.block == len(got.setdefault(r.track_id, [])) // 64
            got[r.track_id] += r.samples
        for t, s in y.items():
            at = np.arange(-(-len(s) * sr_out // sr_in)) * sr_in / sr_out
            assert np.allclose(got[t], np.interp(at, np.arange(len(s)), s), atol=1e-5)


def test_joint_keyword_model_separates(spark):
    from tessitura.operators import ml

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    rows_in = [(i, [float(a) for a in v], [n for n, k in (("a", 0), ("b", 1), ("c", 2)) if v[k] > 0]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows_in, "track_id long, v array<double>, labels array<string>")
    w = ml.train_multilabel(df, "v", "labels", ["a", "b", "c"], rounds=40)
    got = {r.track_id: {p.label: p.p for p in r.p} for r in ml.score_multilabel(df, "v", w, ["a", "b", "c"]).collect()}
    right = [(got[i][n] > 0.5) == (n in labels) for i, _, labels in rows_in for n in "abc"]
    assert np.mean(right) > 0.95
    empty = df.where("false")
    assert ml.train_multilabel(empty, "v", "labels", ["a"]).shape == (1, 1)


def test_supplied_linear_model(spark):
    from tessitura.operators import ml

    model = spark.createDataFrame([(1, [0.0, 1.0]), (0, [1.0, 0.5])], "label int, w array<double>")
    df = spark.createDataFrame([(1, [2.0, 4.0])], "id long, v array<double>")
    assert ml.linear_scores(df, "v", ml.load_linear(model)).first().scores == [4.0, 4.0]
