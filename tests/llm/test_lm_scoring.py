"""The n-gram trie against dictionaries, base scores against the formula, and the model's own probabilities."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tessitura.llm import lm_scoring as L
from tessitura.llm.ngram_trie import EliasFano, NGramTrie, Quantiser

from ..conftest import SF_SMALL


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (5, 3), (500, 10), (500, 10**12), (3000, 4000)):
        x = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        ef = EliasFano(x)
        assert ef.decode().tolist() == x.tolist()
        for q in np.concatenate([x[:50], rng.integers(0, 2 * top, 50).astype(np.uint64)]).tolist():
            at = ef.find(np.array([q], dtype=np.uint64))[0]
            assert (at >= 0) == (q in x) and (at < 0 or x[at] == q)
    assert sum(a.nbytes for a in EliasFano(np.sort(rng.integers(0, 10**6, 100_000))).arrays()) < 100_000 * 2


def test_trie_of_three_levels():
    rng = np.random.default_rng(3)
    grams = np.unique(rng.integers(0, 30, (4000, 3)), axis=0)
    levels = [np.unique(grams[:, : k + 1], axis=0) for k in range(3)]
    values = [np.log10(rng.random(len(g)) + 1e-3) for g in levels]
    trie = NGramTrie(grams, values, 30)
    for g, v in zip(levels, values):
        assert trie.find(g).tolist() == list(range(len(g)))
        off = np.abs(trie.value(g, 0.0) - v)
        assert np.median(off) < 0.01 and off.max() < 1.0
        assert (trie.find(g[:5] + 1000) == -1).all()
    have = {tuple(g) for g in grams.tolist()}
    probe = rng.integers(0, 30, (2000, 3))
    assert [int(x) >= 0 for x in trie.find(probe)] == [tuple(p) in have for p in probe.tolist()]
    for context in ([], [4], [4, 7], [40]):
        exp = sorted({g[len(context)] for g in have if list(g[: len(context)]) == context})
        assert trie.successors(np.array(context, dtype=np.int64)).tolist() == exp


def test_quantiser():
    few, many = np.array([1.0, 2.0, 2.0, 5.0]), np.random.default_rng(0).normal(size=10_000)
    q = Quantiser(few)
    assert q.book[q.encode(few)].tolist() == few.tolist()
    q = Quantiser(many)
    inner = np.sort(many)[100:-100]
    assert len(q.book) == 256 and np.abs(q.book[q.encode(inner)] - inner).max() < 0.2


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def brute(rows):
    count = Counter(t for i, x in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for t in tokens(x))
    n, v = sum(count.values()), len(count)
    return n, sorted(((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(tokens(x)), sum(t in count for t in tokens(x)), round(sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x)), 6)) for i, x in rows), key=repr)


@pytest.mark.parametrize("shortlist", [L.SHORTLIST, 6])
def test_base_scores(spark, tmp_path, shortlist, monkeypatch):
    monkeypatch.setattr(L, "FLUSH_TOKENS", 300)
    monkeypatch.setattr(L.score_texts, "__defaults__", (L.MU, shortlist))
    rows = [(i, " ".join(f"w{(i * k * 7) % 23}" for k in range(1, 3 + i % 40))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "  \n\t"), (None, "w1 W1 w1"), (5, "again w5"), (103, "Ünïcode \x1c ÄB " * 20), (104, "unseen " * 40_000)]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = L.op4_lm_scoring(spark, str(tmp_path)).collect()
    n, exp = brute(rows)
    assert {r["train_tokens"] for r in got} == {n}
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got), key=repr) == exp
    assert all(r["score"] < 0 for r in got)


def test_probabilities_sum_to_one():
    """p(. | v) over the shortlist, the class of rare words and the unseen ones."""
    words = np.array([1, 300, 301, 302], dtype=np.int64)
    short = L.Shortlist(words, np.array([4, 9, 5, 2]), n=27, v=7, n_docs=4)  # three rare words, 7 tokens
    assert short.number(np.array([301, 999, 1], dtype=np.uint64)).tolist() == [2, L.RARE, 0]
    assert short.lower.sum() == pytest.approx(1.0)
    pairs = np.array([1 << 16 | 2, 1 << 16 | L.RARE, 2 << 16 | 0], dtype=np.uint32)
    trie = L.bigram_trie(pairs, np.array([6, 3, 5]), short.context, L.MU)
    for v in (1, 2, 3, L.RARE, L.BEGIN):
        every = np.array([[v, w] for w in (0, 1, 2, 3, L.RARE)])
        direct = 10.0 ** trie.value(every, -np.inf)
        total = direct.sum() + L.MU / (short.context[v] + L.MU)
        seen = {1: 9, 2: 5}.get(v, 0)
        assert total == pytest.approx((seen + L.MU) / (short.context[v] + L.MU), rel=1e-6)
    # within the class: seen rare words and half a count for each of them and for the unseen
    assert (short.rare_n + 0.5 * short.rare_v + 0.5) / short.rare_total == pytest.approx(1.0)


def test_model_beats_the_base_on_held_out_texts(spark):
    got = L.op4_lm_scoring(spark, SF_SMALL).where("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum()


def test_empty_table(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([], "_row long, text string")
    assert L.score_texts(df, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, "a b")], "_row long, text string")
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in L.score_texts(one, F.lit(False)).collect()] == [(3, 0, 0)]


def exact_scores(rows):
    """log10 of the interpolated bigram model with every word a context and a successor."""
    train = [tokens(x) for i, x in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    one = Counter(t for x in train for t in x)
    two = Counter(p for x in train for p in zip([0, *x], x))
    total, before = sum(one.values()) + 0.5 * (len(one) + 1), {**one, 0: len(train)}

    def p(v, w):
        return (two[v, w] + L.MU * (one[w] + 0.5) / total) / (before.get(v, 0) + L.MU)

    return {i: sum(math.log10(p(v, w)) for v, w in zip([0, *tokens(x)], tokens(x))) for i, x in rows}


@pytest.mark.parametrize("shortlist", [L.SHORTLIST, 6])
def test_scores_of_rare_words(spark, shortlist, monkeypatch):
    """Bigrams of words outside the list count like all others."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(L, "FLUSH_TOKENS", 300)
    rows = [(i, " ".join(f"w{(i * k * 7) % 23} r{(i + k) % 70} q{(i + k) % 70}" for k in range(1, 3 + i % 40))) for i in range(60)]
    rows += [(101, ""), (103, "Ünïcode \x1c ÄB " * 20), (104, "unseen " * 40_000)]
    df = spark.createDataFrame(rows, "_row long, text string").repartition(3)
    got = {r["_row"]: r["score"] for r in L.score_texts(df, F.crc32(F.col("_row").cast("string")) % 5 != 1, L.MU, shortlist).collect()}
    assert got == pytest.approx(exact_scores(rows), rel=1e-6)
