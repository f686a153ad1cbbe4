"""Steps whose shuffles, memory or time must not outgrow the input; results are those of the plain way."""

from __future__ import annotations

import datetime as dt
import time
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tessitura.operators import crowd, features, keyphrases, phrases, text, vectors
from tessitura.plans import q_ml
from tessitura.session import join_hot_keys, materialize

REPEATED = [(1, "alpha beta beta gamma"), (2, "beta gamma"), (2, "beta delta beta"), (3, None), (4, ""), (None, "gamma gamma"), (None, "gamma alpha")]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_of_single_rows_are_not_shuffled(spark):
    once = spark.createDataFrame([(i, f"alpha beta beta w{'x' * i}") for i in range(9)], "doc_id long, text string")
    assert "Exchange" not in plan(text.term_counts(once))
    got = {(r.doc, r.word): (r.tf, r.doc_len) for r in text.term_counts(once).collect()}
    assert got[(5, "beta")] == (2, 4) and got[(0, "alpha")] == (1, 3) and len(got) == 25


def test_terms_of_repeated_documents_are_put_together(spark):
    df = spark.createDataFrame(REPEATED, "doc_id long, text string")
    got = {(r.doc, r.word): r.tf for r in text.term_counts(df).collect()}
    want = Counter((d, w) for d, t in REPEATED for w in (t or "").split())
    assert got == want and text.term_counts(df).count() == len(want)


def test_hot_keys_join_like_any(spark):
    rows = spark.createDataFrame([(i, "abcdefg"[i % (1 + i % 7)]) for i in range(70)] + [(99, None), (98, "z")], "id long, k string")
    table = materialize(spark.createDataFrame([(k, n) for n, k in enumerate("abcdefgh")], "k string, n long"), "t-heat")
    want = sorted(map(tuple, rows.join(table, "k").collect()))
    for bound in (1, 3, 100):
        assert sorted(map(tuple, join_hot_keys(rows, table, "k", "n", bound).collect())) == want


def test_phrases_of_a_long_text_take_linear_time(spark):
    rng = np.random.default_rng(1)
    words = ["".join(chr(97 + x) for x in rng.integers(0, 26, 5)) for _ in range(300)]
    long = " ".join(words[x] for x in rng.integers(0, 300, 60_000))
    df = spark.createDataFrame([(1, long)], "doc_id long, text string")
    begun = time.monotonic()
    counts = phrases.phrase_counts(df, 5)
    n = {r.words: r.n for r in counts.groupBy("words").agg(F.sum("tf").alias("n")).collect()}
    assert n[1] == 60_000 and time.monotonic() - begun < 40  # minutes when every slice copied the text's words


def test_phrase_counts_of_single_rows_are_not_shuffled(spark):
    df = spark.createDataFrame([(i, "new york city is big") for i in range(6)], "doc_id long, text string")
    found = phrases.phrase_counts(df, 5)
    assert "Exchange" not in plan(found)
    assert {(r.phrase, r.words, r.tf, r.doc_len) for r in found.collect()} == {("new", 1, 1, 4), ("york", 1, 1, 4), ("city", 1, 1, 4), ("big", 1, 1, 4), ("new york", 2, 1, 4), ("york city", 2, 1, 4), ("new york city", 3, 1, 4)}


def test_phrases_of_repeated_documents_are_put_together(spark):
    df = spark.createDataFrame(REPEATED, "doc_id long, text string")
    ranked, _ = phrases.corpus_keyphrases(df, least=2)
    got = {r.phrase: (r.f, r.df) for r in ranked.collect()}
    assert got == {"alpha": (2, 2), "beta": (5, 2), "gamma": (5, 3), "beta gamma": (2, 2)}


def _pcm(spark, tracks, block):
    rows = [(t, b, y[b * block : (b + 1) * block].tolist()) for t, y in tracks.items() for b in range(-(-len(y) // block))]
    return spark.createDataFrame(rows, "track_id long, block int, samples array<float>").coalesce(1)


def test_placed_blocks_need_no_shuffle(spark):
    rng = np.random.default_rng(2)
    pcm = _pcm(spark, {t: rng.normal(size=n).astype(np.float32) for t, n in ((1, 9000), (2, 700), (3, 2048 * 3), (5, 2049))}, 2048)
    for step in (lambda p, placed: features.log_mel(p, 2048, placed=placed), lambda p, placed: features.resample_bandlimited(p, 22_050, 16_000, 2048, placed)):
        read, joined = step(pcm, True), step(pcm, False)
        assert "Exchange" not in plan(read) and "Exchange" in plan(joined)
        got, want = (sorted((r[0], r[1], tuple(r[2])) for r in x.collect()) for x in (read, joined))
        assert got == want and len(got) > 4


def test_batches_made_in_python_are_bounded():
    text_rows = pa.RecordBatch.from_pydict({"doc_id": list(range(400)), "text": ["x" * 30_000] * 400})
    sizes = [len(b.column(2).flatten()) for b in features._text_to_blocks(4096)(iter([text_rows]))]
    assert sum(sizes) == 400 * 30_000 and max(sizes) <= features.PACKED + 4096
    blocks = next(features._text_to_blocks(4096)(iter([text_rows])))
    frames = [len(b.column(2).flatten()) for b in features._blocks_to_frames(4096, 2048, 64, 128, 22_050, placed=True)(iter([blocks]))]
    assert len(frames) > 1 and max(frames) <= features.PACKED + 4096


def test_tones_and_texts_of_repeated_ids_are_joined(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "id long, t string")
    (once, placed), (again, not_placed) = q_ml.placed_parts(df, "id")
    assert [r.t for r in once.collect()] == ["a"] and sorted(r.t for r in again.collect()) == ["b", "c", "d"]
    assert placed and not not_placed and len(q_ml.placed_parts(df.where("t = 'a'"), "id")) == 1


def test_income_of_busy_workers_is_cut_into_stretches(spark):
    rng = np.random.default_rng(4)
    base = dt.datetime(2024, 1, 1)
    data = [(n, [None, "a", "b", "c"][int(rng.choice(4, p=[0.1, 0.7, 0.1, 0.1]))], None if n % 17 == 0 else base + dt.timedelta(hours=int(rng.integers(0, 96))), float(rng.integers(0, 9))) for n in range(300)]
    df = spark.createDataFrame(data, "id long, worker_id string, submitted_at timestamp, reward double")
    want = {n: sum(r for _, v, s, r in data if v == w and (s is None if t is None else s is not None and t - dt.timedelta(days=1) <= s <= t)) for n, w, t, _ in data}
    for busy in (10, 60, 1 << 20):
        assert {r.id: r.income_24h for r in crowd.income_last_24h(df, busy_times=busy).collect()} == want


def test_income_of_other_workers_stays_in_one_stretch(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(str(n % 3), base + dt.timedelta(hours=n), 1.0) for n in range(90)], "worker_id string, submitted_at timestamp, reward double")
    # no table of borders is made, so no value is looked up in one
    assert "aggregate(" not in plan(crowd.income_last_24h(df))


def test_cells_of_frequent_words_meet_their_rows_without_a_shuffle(spark, monkeypatch):
    """A product shuffles the sums, and the cells of words that are not frequent; whatever is frequent, the vectors and keyphrases are the same."""
    rng = np.random.default_rng(2)
    words = np.array([f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)])
    odds = 1 / np.arange(1, 61)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 50, p=odds / odds.sum()))) for i in range(80)] + [(80, None), (81, "lonely")], "doc_id long, text string")
    got = {}
    for bound in (1 << 17, 7, 1):
        monkeypatch.setattr(vectors, "HOT_WORDS", bound)
        monkeypatch.setattr(keyphrases, "HOT_WORDS", bound)
        cells = materialize(vectors.ppmi(materialize(vectors.co_occurrences(docs), "t-co")), "t-ppmi")
        assert cells.where("NOT cold").select("other").distinct().count() <= bound
        hot = vectors.hot_words(cells)
        thin = materialize(vectors.start_signs(cells, 8), "t-thin")
        y = vectors.product(cells, thin, 8, hot)
        dense = {r.word: np.array(r.v) for r in y.collect()}
        signs, plain = {r.word: np.array(r.v) for r in thin.collect()}, {}
        for r in cells.collect():
            plain[r.word] = plain.get(r.word, 0) + r.x * signs[r.other]
        assert sorted(dense) == sorted(plain) and all(np.abs(dense[k] - plain[k]).max() < 1e-9 for k in plain)
        if bound == 1 << 17:
            near = cells.where(~F.col("cold"))
            assert near.count() == cells.count()
        trained = vectors.train_vectors(docs, rank=4, extra=3)
        got[bound] = sorted((r.doc_id, r.rank, r.keyword, round(r.score, 6), r.aliases) for r in keyphrases.keyphrases(docs, vectors=trained).collect())
    assert got[7] == got[1 << 17] == got[1] and len(got[1]) > 80


def test_vectors_of_frequent_words_are_not_sent_with_every_document(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "alpha beta gamma delta") for i in range(30)] + [(30, "alpha only")], "doc_id long, text string")
    wide = materialize(spark.createDataFrame([(w, [float(k)] * 24) for k, w in enumerate(["alpha", "beta", "gamma", "delta"])], "word string, v array<double>"), "t-wide")

    def carried(*_):
        def run(batches):
            for pdf in batches:
                sent = [float(sum(c["v"] is not None for c in cands)) for cands in pdf["cands"]]
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "rank": [len(c) for c in pdf["cands"]], "keyword": "", "score": sent, "aliases": ""})

        return run

    monkeypatch.setattr(keyphrases, "_mmr_batches", carried)
    got = {r.doc_id: (r["rank"], r.score) for r in keyphrases.keyphrases(docs, vectors=wide).collect()}
    assert got == {**{i: (4, 0.0) for i in range(30)}, 30: (2, 0.0)}


def test_training_counts_pairs_in_packed_cells(spark, monkeypatch):
    """Pairs are no rows of their own; stretches, buckets and ranges of any size make the matrix of the plain tables."""
    rng = np.random.default_rng(7)
    words = np.array([f"term{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(50)])
    odds = 1 / np.arange(1, 51)
    rows = [(i, " ".join(rng.choice(words, 40, p=odds / odds.sum()))) for i in range(60)] + [(60, None), (61, ""), (62, "seldom seen"), (None, "terma" * 3 + " termaa termaa termaa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cells = materialize(vectors.ppmi(materialize(vectors.co_occurrences(docs), "t-co")), "t-ppmi")
    plain = {r.word: np.array(r.v) for r in vectors.product(cells, vectors.start_signs(cells, 8), 8, vectors.hot_words(cells)).collect()}
    for limits in ({}, {"RANGE_WORDS": 7, "STRETCH": 50, "BUCKET_CELLS": 200}):
        for name, value in limits.items():
            monkeypatch.setattr(vectors, name, value)
        packed = vectors.PackedCells(docs)
        assert packed.size >= 40 and packed.table.select("kind").distinct().count() == 1 + -(-packed.size // packed.range)
        n = sum(len(vectors._unpack_cells(r.codes, r.n)[0]) for r in packed.table.where("kind >= 0").collect())
        assert n >= cells.count() and (limits or packed.table.where("kind >= 0").count() < n / 10)
        got = {r["name"]: np.array(r.v) for r in packed.product(packed.start_signs(8), 8).join(packed.names, "word").collect()}
        assert sorted(got) == sorted(plain) and all(np.abs(got[k] - plain[k]).max() < 1e-9 for k in plain)
        packed.drop()


def test_candidates_of_few_documents_are_held_at_a_time(monkeypatch):
    """A batch is worked off some documents at a time; frequent words have the worker's vector, others their own or none."""
    kind = pa.list_(pa.struct([("neg_weight", pa.float64()), ("keyword", pa.string()), ("at", pa.int32()), ("v", pa.list_(pa.float64()))]))
    hot = np.arange(6.0).reshape(2, 3)
    docs = [[{"neg_weight": -2.0, "keyword": "a", "at": 1, "v": None}, {"neg_weight": -1.0, "keyword": "b", "at": -1, "v": [9.0, 8.0, 7.0]}, {"neg_weight": -0.5, "keyword": "c", "at": -1, "v": None}], [], [{"neg_weight": 0.0, "keyword": "a", "at": 0, "v": None}]]
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, 7]), pa.array(docs, kind)], names=["doc_id", "cands"])
    monkeypatch.setattr(keyphrases, "DOCS", 2)
    frames = list(keyphrases._documents([batch, batch.slice(1)], hot))
    assert [f["doc_id"].tolist() for f in frames] == [[5, 6], [7], [6, 7]]
    c = frames[0]["cands"][0]
    assert list(c) == docs[0] and c.vectors.tolist() == [[3.0, 4.0, 5.0], [9.0, 8.0, 7.0], [0.0, 0.0, 0.0]]
    assert [len(c) for f in frames for c in f["cands"]] == [3, 0, 1, 0, 1]
    assert frames[2]["cands"][1].vectors.tolist() == [[0.0, 1.0, 2.0]]
