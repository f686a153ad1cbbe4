"""Phrase counts and scores against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessitura.llm import collocations as C


def plain(rows, least, top, cover=(80, 100)):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3, 4):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        candidates = {p: n for p, n in c.items() if len(p) > 1 and n >= least}
        around = Counter()
        for p, n in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i : i + k]] = max(around[p[i : i + k]], n)
        rows = []
        for p, a in candidates.items():
            if p in around and cover[1] * around[p] >= cover[0] * a:
                continue
            s, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), a, c[p[:k]], c[p[k:]], total[lang], s))
        out += [(lang, i + 1, r[2].decode(), *r[3:]) for i, r in enumerate(sorted(rows)[:top])]
    return sorted(out)


def result(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def words(rng, n):
    vocabulary = ["the", "The", "of", "a", "cat", "sat", "mat", "é", "中", "x-y", "on"]
    weights = [9, 2, 7, 6, 3, 2, 2, 1, 1, 1, 4]
    return "".join(rng.choices(vocabulary, weights)[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "\x85 "]) for _ in range(n))


@pytest.mark.parametrize("piece", [7, 500_000])
def test_against_plain_counting(spark, piece, monkeypatch):
    monkeypatch.setattr(C, "SLICE", piece * 20)
    monkeypatch.setattr(C, "BUCKET_PHRASES", 300)
    monkeypatch.setattr(C, "FOLD_PHRASES", 200)
    rng = random.Random(4)
    rows = [(rng.choice(["en", "en", "fr", None]), words(rng, rng.choice([1, 5, 40, 300]))) for _ in range(120)]
    rows += [("en", None), ("fr", ""), ("en", " .,; "), ("xx", "only once here"), ("en", "same passage of many words stands here")] * 40
    df = spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], "doc_id long, lang string, text string, n long").repartition(5)
    got = result(C.collocations(df, least=30, top=25))
    assert got == plain(rows, 30, 25)
    assert any(r[0] == "und" for r in got)


def test_empty_and_rare(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert C.collocations(spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")).count() == 0


def test_trie_holds_every_phrase_and_no_other():
    rng = np.random.default_rng(2)
    kinds = rng.integers(1, 2**63, 3000).astype(np.uint64)
    n, hub = 20_000, kinds[0]
    length = rng.integers(2, 5, n)
    keys = kinds[rng.integers(0, len(kinds), (n, 4))]
    keys[rng.random(n) < 0.3, 0] = hub  # one word starts a third of all
    keys[np.arange(4) >= length[:, None]] = 0
    keys, at = np.unique(keys, axis=0, return_index=True)
    length = length[at]
    trie = C.DoubleArrayTrie(keys, length, np.arange(len(keys)))
    assert len(trie.check) < 6 * len(keys) + 20_000
    counts = np.zeros(len(keys), dtype=np.int64)
    flat = keys[keys > 0]
    joined = np.ones(len(flat), dtype=bool)
    joined[np.concatenate([[0], np.cumsum(length)[:-1]])] = False
    trie.count(flat, joined, counts)
    listed = {tuple(k[:m]): i for i, (k, m) in enumerate(zip(keys.tolist(), length.tolist()))}
    want = np.zeros(len(keys), dtype=np.int64)
    for k, m in zip(keys.tolist(), length.tolist()):
        for x in range(m):
            for y in range(x + 2, m + 1):
                if tuple(k[x:y]) in listed:
                    want[listed[tuple(k[x:y])]] += 1
    assert (counts == want).all()
