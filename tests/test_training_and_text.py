"""Phrases, corpus vectors, quasi-Newton training, band-limited resampling."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.operators import features, keyphrases, ml, phrases, quasi_newton, vectors
from tessitura.session import materialize, scratch_path

TEXTS = [
    "The support vector machine learns. A support vector machine, and the vector machine!",
    "support vector machine; Support Vector Machine -- of the machine\nnew york city",
    "new york city is new york, and New York 2 city ab cd",
    None, "", "... 12 ab", "élan vital élan vital élan vital über alles élan vital",
]


def _runs(text):
    out = []
    for piece in re.split(r"[^\w ]+|[\d_]+", re.sub("[\n ]", " ", text or "").strip().lower()):
        run = []
        for w in piece.split(" "):
            if len(w) >= 3:
                run.append(w)
            elif w:
                out.append(run)
                run = []
        out.append(run)
    return out


def _plain_phrases(texts, least):
    tf = defaultdict(Counter)
    for d, t in enumerate(texts):
        for run in _runs(t):
            for k in range(1, 5):
                for i in range(len(run) - k + 1):
                    tf[d][" ".join(run[i : i + k])] += 1
    f, df = Counter(), Counter()
    for c in tf.values():
        f.update(c)
        df.update(c.keys())
    f = {p: n for p, n in f.items() if n >= least}
    around = defaultdict(list)
    for p, n in f.items():
        w = p.split()
        for q in {" ".join(w[i : i + k]) for k in range(1, len(w)) for i in range(len(w) - k + 1)}:
            around[q].append(n)
    c = {p: math.log2(len(p.split()) + 1) * (n - (sum(around[p]) / len(around[p]) if p in around else 0)) for p, n in f.items()}
    return tf, f, df, c


def test_phrases_against_plain_counting(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, phrase string")
    tf, f, df, c = _plain_phrases(TEXTS, 2)
    ranked, best = phrases.corpus_keyphrases(docs, least=2)
    got = {r.phrase: r for r in ranked.collect()}
    assert {p: r.f for p, r in got.items()} == f and {p: r.df for p, r in got.items()} == {p: df[p] for p in f}
    assert all(abs(got[p].cvalue - c[p]) < 1e-9 for p in f)
    assert "support vector machine" in got and got["support vector"].n_around == 1
    n = sum(1 for x in tf.values() if x)
    for d, t in enumerate(TEXTS):
        length = sum(map(len, _runs(t)))
        want = sorted((-round(k / length * math.log(n / df[p]) * c[p] / f[p], 9), p) for p, k in tf[d].items() if p in f)[:10]
        mine = [(-r.weight, r.phrase) for r in best.where(F.col("doc_id") == d).orderBy("rank").collect()]
        assert [p for _, p in mine] == [p for _, p in want]
        assert all(abs(a[0] - b[0]) < 2e-9 for a, b in zip(mine, want))


def test_phrases_of_nothing(spark):
    ranked, best = phrases.corpus_keyphrases(spark.createDataFrame([], "doc_id long, text string"))
    assert ranked.count() == 0 and best.count() == 0


# ------------------------------------------------------------------ vectors
def _corpus(spark, n=120):
    rng = np.random.default_rng(5)
    topics = [["sun", "beach", "sand", "wave", "surf"], ["rain", "storm", "wind", "cloud", "thunder"], ["love", "heart", "kiss", "tender", "sweet"]]
    texts = []
    for i in range(n):
        words = topics[i % 3] + ["the", "and"]
        texts.append(" ".join(rng.choice(words, 40)))
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(n, None), (n + 1, "rare")], "doc_id long, text string")


def test_vectors_equal_a_plain_factorisation(spark):
    docs = _corpus(spark)
    toks = [re.findall(r"[^\W\d_]{3,}", r.text or "") for r in docs.collect()]
    vocab = sorted(w for w, n in Counter(w for t in toks for w in t).items() if n >= 5)
    at = {w: i for i, w in enumerate(vocab)}
    n = np.zeros((len(vocab), len(vocab)))
    for t in toks:
        for i, w in enumerate(t):
            for d in range(1, vectors.WINDOW + 1):
                if i + d < len(t) and w in at and t[i + d] in at:
                    n[at[w], at[t[i + d]]] += 1
                    n[at[t[i + d]], at[w]] += 1
    with np.errstate(divide="ignore"):
        m = np.maximum(np.log(n * n.sum() / np.outer(n.sum(1), n.sum(0))), 0)
    m[n == 0] = 0
    counts = materialize(vectors.co_occurrences(docs), "t-co")
    cells = materialize(vectors.ppmi(counts), "t-ppmi")
    mine = np.zeros_like(m)
    for r in cells.collect():
        mine[at[r.word], at[r.other]] = r.x
    assert np.abs(mine - m).max() < 1e-9
    rank, extra = 4, 3
    signs = {r.word: np.array(r.v) for r in vectors.start_signs(cells, rank + extra).collect()}
    y = m @ np.array([signs[w] for w in vocab])
    for _ in range(vectors.POWER):
        y = m @ np.linalg.qr(y)[0]
    q = np.linalg.qr(y)[0]
    values, u = np.linalg.eigh(q.T @ m @ q)
    top = np.argsort(-np.abs(values))[:rank]
    plain = q @ u[:, top] * np.sqrt(np.abs(values[top]))
    got = {r.word: np.array(r.v) for r in vectors.factorise(cells, rank, extra).collect()}
    assert sorted(got) == vocab
    mat = np.array([got[w] for w in vocab])
    cos = lambda a: (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (a / np.linalg.norm(a, axis=1, keepdims=True)).T
    assert np.abs(cos(mat) - cos(plain)).max() < 1e-6
    c = cos(mat)
    assert c[at["sun"], at["beach"]] > 0.8 > c[at["sun"], at["storm"]]  # words of one topic lie together


def test_vectors_of_nothing(spark):
    assert vectors.train_vectors(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _mmr_brute(words, weights, vecs, n, beta, thr):
    v = np.array(vecs, dtype=float)
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    d = (np.maximum(np.array(weights), 0)[:, None] * v).sum(0)
    d = d / max(np.linalg.norm(d), 1e-12)
    sd, s = np.round(v @ d, 9), np.round(v @ v.T, 9)
    pool, chosen, out = list(range(len(words))), [], []
    while pool and len(chosen) < n:
        score = {p: sd[p] if not chosen else round(beta * sd[p] - (1 - beta) * max(s[p, c] for c in chosen), 9) for p in pool}
        b = max(pool, key=lambda p: (score[p], -p))
        pool.remove(b)
        aliases = [p for p in pool if s[b, p] >= thr]
        pool = [p for p in pool if p not in aliases]
        chosen.append(b)
        out.append((len(chosen), words[b], "|".join(sorted(words[a] for a in aliases))))
    return out


def test_keyphrases_against_brute_force_with_ties(spark):
    docs = _corpus(spark, 30)
    trained = vectors.train_vectors(docs, rank=4, extra=3)
    got = defaultdict(list)
    for r in keyphrases.keyphrases(docs, vectors=trained).orderBy("doc_id", "rank").collect():
        got[r.doc_id].append((r.rank, r.keyword, r.aliases))
    v = {r.word: list(r.v) for r in trained.collect()}
    toks = {r.doc_id: re.findall(r"[^\W\d_]{3,}", r.text or "") for r in docs.collect()}
    df = Counter(w for t in toks.values() for w in set(t))
    n = sum(1 for t in toks.values() if t)
    for d, t in toks.items():
        weights = {w: round(k / len(t) * math.log(n / df[w]), 9) for w, k in Counter(t).items()}
        words = sorted(weights, key=lambda w: (-weights[w], w))
        if words:
            assert got[d] == _mmr_brute(words, [weights[w] for w in words], [v.get(w, [0.0] * 4) for w in words], 10, 0.55, 0.7), d
    assert got[31] == [(1, "rare", "")]


# ------------------------------------------------------------------ training
def _data(spark, n=400, dims=5, classes=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    z = x @ rng.normal(size=(dims, classes)) + rng.gumbel(size=(n, classes))
    y = z.argmax(1)
    many = [[int(k) for k in np.flatnonzero(r > 0.5)] for r in z]
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), many[i]) for i in range(n)], "id long, x array<double>, y int, m array<int>")
    return materialize(df.repartition(4), "t-train"), x, y, many


def _newton(x, targets, kind, l2, outputs):
    """Dense optimum with NumPy: plain gradient descent with Newton steps on the numerical Hessian."""
    xb = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros((outputs, xb.shape[1]))
    pen = np.ones_like(w)
    pen[:, -1] = 0

    def value(w):
        z = xb @ w.T
        if kind == "softmax":
            loss = (np.log(np.exp(z).sum(1)) - (z * targets).sum(1)).mean()
            p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        else:
            loss = (np.logaddexp(0, z) - targets * z).sum(1).mean()
            p = 1 / (1 + np.exp(-z))
        return loss + l2 / 2 * (w * pen * w).sum(), ((p - targets).T @ xb) / len(x) + l2 * w * pen, p

    for _ in range(60):
        loss, g, p = value(w)
        size = w.size
        h = np.zeros((size, size))
        for a in range(outputs):
            for b in range(outputs):
                cross = p[:, a] * ((a == b) - p[:, b]) if kind == "softmax" else (p[:, a] * (1 - p[:, a]) if a == b else np.zeros(len(x)))
                h[a * xb.shape[1] : (a + 1) * xb.shape[1], b * xb.shape[1] : (b + 1) * xb.shape[1]] = (xb * cross[:, None]).T @ xb / len(x)
        h += np.diag((l2 * pen).ravel())
        w = w - (np.linalg.pinv(h) @ g.ravel()).reshape(w.shape)
    return value(w)[0]


@pytest.mark.parametrize("kind", ["softmax", "logistic"])
def test_training_reaches_the_optimum(spark, kind):
    df, x, y, many = _data(spark)
    targets = np.zeros((len(x), 3))
    if kind == "softmax":
        targets[np.arange(len(x)), y] = 1
    else:
        for i, k in enumerate(many):
            targets[i, k] = 1
    state = quasi_newton.train_linear(df, kind, 3, l2=1e-2, target_col="y" if kind == "softmax" else "m", tolerance=1e-7)
    assert state.gradient_norm <= 1e-7 and state.round < 100
    assert abs(state.loss - _newton(x, targets, kind, 1e-2, 3)) < 1e-9
    assert all(b <= a for a, b in zip(state.losses, state.losses[1:]))


def test_a_broken_run_goes_on_where_it_stopped(spark):
    df, *_ = _data(spark)
    valid, *_ = _data(spark, 100, seed=4)
    whole = quasi_newton.train_linear(df, "softmax", 3, validation=valid)
    path = scratch_path(spark, "run")
    first = quasi_newton.train_linear(df, "softmax", 3, validation=valid, path=path, max_rounds=4)
    assert first.round == 4 and quasi_newton.load_state(spark, path).round == 4
    second = quasi_newton.train_linear(df, "softmax", 3, validation=valid, path=path)
    assert second.round > 4 and abs(second.loss - whole.loss) < 1e-9
    assert len(second.losses) == second.round + 1 and second.losses[:5] == first.losses
    again = quasi_newton.train_linear(df, "softmax", 3, validation=valid, path=path)  # nothing is left to do
    assert again.round == second.round and np.array_equal(again.w, second.w)
    assert len(whole.best) == 2 and whole.best[0][0] <= whole.best[1][0]


def test_patience_stops_a_run(spark):
    df, x, y, _ = _data(spark, 60, dims=20)
    wrong = materialize(df.withColumn("y", F.pmod(F.col("y") + 1, F.lit(3)).cast("int")), "t-wrong")  # validation only gets worse
    state = quasi_newton.train_linear(df, "softmax", 3, validation=wrong, patience=5, l2=1e-6)
    assert state.since_best == 5 and state.best[0][1] == state.round - 5


def test_training_on_nothing(spark):
    empty = spark.createDataFrame([], "x array<double>, y int")
    assert quasi_newton.train_linear(empty, "softmax", 2).round == 0


def test_label_numbers(spark):
    df = spark.createDataFrame([(["b", "z", "a"],), ([],), (None,)], "l array<string>")
    assert [r[0] for r in df.select(ml.label_numbers("l", ["a", "b"])).collect()] == [[1, 0], [], None]


# ------------------------------------------------------------------ resampling
def _pcm(spark, signals, block):
    rows = [(t, b, [float(v) for v in y[b * block : (b + 1) * block]]) for t, y in signals.items() for b in range(-(-len(y) // block))]
    return spark.createDataFrame(rows, "track_id long, block int, samples array<float>")


def _signal(df):
    out = defaultdict(list)
    for r in df.orderBy("track_id", "block").collect():
        out[r.track_id] += list(r.samples)
    return out


@pytest.mark.parametrize("rates", [(22050, 16000), (16000, 22050), (44100, 22050)])
def test_tones_pass_or_are_damped(spark, rates):
    sr_in, sr_out = rates
    t = np.arange(6000) / sr_in
    low, high = 1000.0, min(sr_in, sr_out) / 2 * 1.05
    got = _signal(features.resample_bandlimited(_pcm(spark, {1: np.sin(2 * np.pi * low * t), 2: np.sin(2 * np.pi * high * t) if high < sr_in / 2 else np.zeros(6000)}, 1024), sr_in, sr_out, 1024))
    n = -(-6000 * sr_out // sr_in)
    assert len(got[1]) == len(got[2]) == n
    inner = slice(300, n - 300)
    want = np.sin(2 * np.pi * low * np.arange(n) / sr_out)
    assert np.abs(np.array(got[1]) - want)[inner].max() < 1e-3
    assert np.abs(np.array(got[2]))[inner].max() < 1e-3  # 60 dB


def test_blocks_do_not_show(spark):
    rng = np.random.default_rng(0)
    y = {1: rng.normal(size=5000), 2: rng.normal(size=1), 3: rng.normal(size=1024), 4: rng.normal(size=1030)}
    small = _signal(features.resample_bandlimited(_pcm(spark, y, 1024), 22050, 16000, 1024))
    large = _signal(features.resample_bandlimited(_pcm(spark, y, 8192), 22050, 16000, 8192))
    for t in y:
        assert len(small[t]) == -(-len(y[t]) * 16000 // 22050)
        assert np.abs(np.array(small[t]) - np.array(large[t])).max() < 1e-6
