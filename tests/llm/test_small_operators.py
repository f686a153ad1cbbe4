"""Chat formatting, token counts, nearest neighbours, URL filter, source mixing and toxicity on small inputs."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessitura.llm import ann, chat, mixing, token_counts, toxicity, url_filter

from ..conftest import SF_MID, SF_SMALL

# ---- chat formatting

_TEXT = st.lists(st.sampled_from([*"ab<|\\n>\n é", "<|im_end|>", "<|im_start|>", "\\|", "🎈"]), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), _TEXT), _TEXT), max_size=6))
def test_format_reads_back(turns):
    text, spans = chat.format_turns(turns)
    assert chat.parse_turns(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert text.count("<|im_end|>") == len(turns)


def _tree(spark):
    rows = [
        ("t", "r", None, "user", "q", 0.0), ("t", "a", "r", "assistant", "a1", 1.0), ("t", "b", "r", "assistant", "b1", 5.0), ("t", "b2", "b", "user", "b2", 0.0),
        ("t", "b3", "b2", "assistant", "b3", 0.1), ("u", "x", "missing", "user", None, None), ("v", "c1", "c2", "user", "loop", 9.0), ("v", "c2", "c1", "user", "loop", 9.0),
        ("w", None, None, "user", "lost", 1.0), ("u", "x", "missing", "user", "twice", 1.0),
    ]
    rows += [("long", f"l{i:03}", f"l{i - 1:03}" if i else None, "user", str(i), 0.0) for i in range(70)]
    return spark.createDataFrame(rows, "tree string, node string, parent string, role string, text string, score double")


def test_reply_trees(spark):
    got = {(r["tree"], r["branch_rank"]): r for r in chat.format_trees(_tree(spark), per_tree=None).collect()}
    assert set(got) == {("t", 1), ("t", 2), ("u", 1), ("long", 1)}
    assert [t for _, t in chat.parse_turns(got["t", 1]["formatted"])] == ["q", "b1", "b2", "b3"]
    assert [t for _, t in chat.parse_turns(got["t", 2]["formatted"])] == ["q", "a1"]
    assert [t for _, t in chat.parse_turns(got["long", 1]["formatted"])] == [str(i) for i in range(70)]
    assert chat.parse_turns(got["u", 1]["formatted"]) == [("user", "")]
    assert got["t", 1]["branch_score"] == pytest.approx(5.1 / 4)
    assert {r["tree"] for r in chat.format_trees(_tree(spark)).collect()} == {"t", "u", "long"}


def test_conversations_with_nulls_and_ties(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (None, None, None, None), (None, 2, "assistant", "z"), (2, 3, "", "")]
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, node string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat.op5_chat_format(spark, str(tmp_path)).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in got.items()} == {1: (3, 1), None: (2, 1), 2: (1, 0), -1: (2, 34)}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\n\nassistant\nb\n").hexdigest()
    assert got[None]["loss_sha256"] == hashlib.sha256(b"z").hexdigest()


# ---- token counts


def _counts(spark, tmp_path, texts, record, parts, split=None):
    path = str(tmp_path / "flat")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    if split:
        conf.set("mapreduce.input.fileinputformat.split.maxsize", str(split))
    try:
        token_counts.write_token_files(spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts), path, record_tokens=record)
        return token_counts.scan_token_files(spark, path, record).toPandas()
    finally:
        conf.unset("mapreduce.input.fileinputformat.split.maxsize")


@pytest.mark.parametrize("record,split", [(16, 64), (4096, None), (7, 14)])
def test_token_counts_round_trip(spark, tmp_path, record, split):
    rng = random.Random(record)
    texts = [None, "", "word", "x" * 3000, "é日本 " * 40] + ["".join(rng.choice("ab c\n.é") for _ in range(rng.randrange(200))) for _ in range(40)]
    enc = token_counts.encoder(token_counts.VOCABULARY)
    got = _counts(spark, tmp_path, texts, record, 3, split)
    assert Counter(got["n_tokens"]) == Counter(len(enc.encode_ordinary(t or "")) for t in texts)
    assert all(sorted(g["doc_no"]) == list(range(len(g))) for _, g in got.groupby("file_no"))


def test_unterminated_and_empty_files(spark, tmp_path):
    end, pad = token_counts.END_OF_DOCUMENT, token_counts.PAD
    (tmp_path / "f").mkdir()
    np.array([5, 6, end, 7, end, end, 8, 9], dtype=">u2").tofile(tmp_path / "f" / "a.bin")
    np.array([1, 2, 3, 4, 5, 6, 7, pad], dtype=">u2").tofile(tmp_path / "f" / "b.bin")
    np.array([pad, pad], dtype=">u2").tofile(tmp_path / "f" / "c.bin")
    got = token_counts.scan_token_files(spark, str(tmp_path / "f"), 2).orderBy("file_no", "doc_no").collect()
    assert [tuple(r) for r in got] == [(0, 0, 2), (0, 1, 1), (0, 2, 0), (0, 3, 2), (1, 0, 7)]


def test_long_texts_are_encoded_in_pieces():
    enc = token_counts.encoder(token_counts.VOCABULARY)
    text = ("Some words, 12 of them!  and 'll more\n\n" * 60) + "é" * 100
    pieces = list(token_counts._pieces(text, 50))
    assert "".join(pieces) == text and len(pieces) > 10
    assert [t for p in pieces for t in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


# ---- nearest neighbours


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        key = ann.hilbert_keys(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        walk = grid[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def _brute_near(rows, k):
    valid = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in valid:
        if q % 20 == 0:
            out[q] = sorted(((-float(v @ w), i) for i, w in valid if i != q))[:k]
    return out


def test_small_search_is_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * (1 + i % 3)]) for i in range(300)]
    rows += [(1000 + i, rows[20][1]) for i in range(60)]
    rows += [(400, None), (420, [0.0] * 4), (440, [1.0, None, 0.0, 1.0]), (460, [1.0, float("nan"), 0.0, 1.0]), (480, [1.0, float("inf"), 0.0, 0.0]), (500, [1.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, gid double").repartition(4)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    exp = _brute_near(rows, 20)
    assert set(got) == set(exp)
    for q, best in exp.items():
        assert [x[0] for x in got[q]] == list(range(1, 21))
        assert [x[2] for x in got[q]] == pytest.approx([-s for s, _ in best], abs=1e-12)
        assert [x[1] for x in got[q]] == [i for _, i in best] or q == 20 or q >= 1000


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.0)]
    assert ann.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_recall(spark):
    x = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF_MID}/embeddings.parquet'").df()
    m = np.array(x["embedding"].tolist(), dtype=np.float64)
    ids = x["vec_id"].to_numpy()
    got = ann.op8_ann(spark, SF_MID).toPandas().groupby("query_id")["vec_id"].apply(set)
    found = 0
    for q, have in got.items():
        s = m @ m[ids == q][0]
        s[ids == q] = -9
        found += len(have & set(ids[np.lexsort((ids, -s))[:20]]))
    assert found / (20 * len(got)) >= 0.9


# ---- URL filter


def test_urls(spark):
    urls = [
        "http://Theron.Example.com/en/3?x=1", "https://www.example.com/en/9#t", "http://a.www.example.com/en/", "https://example.com/de/1", "http://m.x.net/es/1", "http://x.net/fr/2.html", "http://net/fr/",
        "http://example.com", "ftp://spam-farm.example.org/en/1", "http://spam-farm.test/?q=http://a.com/", None, "no scheme", "", "http://xcom/a", "https://com/a", "http://user@h.org:80/p/q#f", "http://cheap-pills.example.org/x",
    ]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark, df).collect()}
    by = {u: got[i] for i, u in enumerate(urls)}
    assert [by[urls[k]]["rule"] for k in range(7)] == ["example.com/en/", "www.example.com/en/", "www.example.com/en/", "com/", "net/es/", "net/fr/", "net/fr/"]
    assert [by[urls[k]]["verdict"] for k in range(7)] == ["block", "allow", "allow", "allow", "block", "block", "block"]
    assert (by["http://example.com"]["host"], by["http://example.com"]["path"], by["http://example.com"]["rule"]) == ("example.com", "", None)
    assert (by[None]["host"], by[None]["path"], by["no scheme"]["host"]) == ("", "", "")
    assert (by[urls[15]]["host"], by[urls[15]]["path"]) == ("user@h.org:80", "/p/q")
    assert (by[urls[9]]["host"], by[urls[9]]["path"]) == ("spam-farm.test", "/")
    assert by["http://xcom/a"]["rule"] is None and by["https://com/a"]["rule"] == "com/"
    assert by[urls[8]]["verdict"] == "block" and by[urls[16]]["verdict"] == "block"
    assert url_filter.judge_urls(spark, df.where("false")).count() == 0


def test_url_classifier_separates_held_out_hosts():
    w = url_filter.fit_logistic(url_filter.LABELLED_URLS)
    score = lambda u: w[url_filter.ngram_ids(*url_filter._split(u))].sum() + w[-1]
    assert min(map(score, ["m.casino-win.test/en/1", "www.cheap-pills.org/a", "spam-farm.org/de/4", "adult-x.org/fr/1"])) > 0
    assert max(map(score, ["blog.thand.example.org/en/5", "news.city.test/today", "www.tion.example.org/de/77.html"])) < 0


# ---- mixing


def _targets(sizes):
    """Reference: deal by weight, clamp, reshare until none is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return {**target, **share}
        target.update({s: 2.0 * sizes[s] for s in over})
        free -= over
    return target


@pytest.mark.parametrize("block", [8192, 200])
def test_mix(spark, block):
    rng = random.Random(block)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(int(rng.paretovariate(1.1) * 8) % 3000)), rng.choice(["a", "b", "B", "é", None] + ["hot"] * 5)) for i in range(2500)]
    rows += [(None, "x y", "a"), (7, None, "b"), (7, None, "b"), (9000, "", "zero")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, size int").repartition(5)
    runs = [mixing.mix_sources(spark, df, block_units=block).toPandas() for _ in range(2)]
    got = runs[0]
    key = lambda p: sorted(map(tuple, p.astype(object).where(p.notna(), None).values.tolist()), key=repr)
    assert key(got) == key(runs[1]) and len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    exp = _targets(dict(sizes))
    for source, g in got.groupby("source", dropna=False):
        source = None if source != source else source
        assert g["source_size"].iloc[0] == sizes[source] and g["target"].iloc[0] == pytest.approx(exp[source])
        assert abs(g["taken"].sum() - exp[source]) <= max(0.01 * exp[source], 3)
        n, rate = len(g), exp[source] / sizes[source] if sizes[source] else 0
        assert abs(g["copies"].sum() - n * rate) <= 25
    assert (got["taken"] <= 2 * got["size"]).all()


def test_flight_keeps_totals():
    rng = random.Random(5)
    sizes = [rng.randrange(1, 1000) for _ in range(500)]
    p0 = [0.37] * 500
    p, left = mixing.flight(sizes, p0, random.Random(1))
    assert len(left) <= 2 and all(0 <= x <= 1 for x in p)
    assert sum(x in (0.0, 1.0) for x in p) >= 498
    assert sum(p) == pytest.approx(sum(p0)) and sum(x * s for x, s in zip(p, sizes)) == pytest.approx(0.37 * sum(sizes))
    # inclusion probabilities hold on average
    often = np.mean([mixing.landing(sizes[:40], *mixing.flight(sizes[:40], p0[:40], random.Random(k)), range(40)) for k in range(600)], axis=0)
    assert abs(often.mean() - 0.37) < 0.02 and often.min() > 0.2 and often.max() < 0.55


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(spark, empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix_sources(spark, blank).collect()] == [0, 0]


# ---- toxicity


def test_held_out_accuracy(spark):
    got = toxicity.op3_toxicity(spark, SF_MID).toPandas()
    lab = duckdb.sql(f"SELECT doc_id, toxic FROM '{SF_MID}/labels.parquet'").df()
    assert len(got) == 1000 and got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    m = got[got["held_out"]].merge(lab)
    assert (m["predicted"] == m["toxic"]).mean() > 0.93
    assert ((m["predicted"] == 1) & (m["toxic"] == 0)).sum() <= 2


def test_offending_sentences_are_located():
    rng = random.Random(2)
    words = [f"word{i}" for i in range(200)]
    say = lambda: " ".join(rng.choice(words) for _ in range(8)) + ". "
    texts, labels = [], []
    for i in range(300):
        s = [say() for _ in range(rng.randrange(1, 12))]
        if i % 4 == 0:
            s.insert(rng.randrange(len(s) + 1), f"you {rng.choice(['grobian', 'grobianisch', 'lump'])} there. ")
        texts.append("".join(s))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit_noisy_or(texts, labels)
    score, found = model.score("All is fine. You lump over there! Good bye.")
    hot = [(a, b) for a, b, p in found if p >= 0.5]
    assert score > 0.9 and ["All is fine. You lump over there! Good bye."[a:b] for a, b in hot] == ["You lump over there!"]
    assert model.score("grobianen")[0] > 0.5  # an unseen form of a known stem
    assert model.score(texts[1])[0] < 0.1 and model.score(None) == (model.leak, []) and model.score("")[0] < 0.1


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x", None), (2, "y\n" * 50_000, "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (2, 5)], "doc_id long, toxic int")
    model = toxicity.fit_on(docs, labels)
    assert toxicity.score_documents(docs, model).count() == 4
    kept = toxicity.drop_toxic(docs, toxicity.NoisyOrModel())
    assert kept.columns == docs.columns and kept.count() == 4
    assert toxicity.score_documents(docs.where("false"), model).count() == 0
    none = toxicity.fit_on(docs.where("false"), labels.where("false"))
    assert none.leak == 0.0


def test_sample_is_bounded(spark):
    docs, labels = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    assert toxicity.training_sample(docs, labels, max_docs=10).count() <= 10
