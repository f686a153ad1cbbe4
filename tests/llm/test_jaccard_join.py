"""Components of linked shingle sets, by brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tessitura.llm import jaccard_join as J
from tessitura.llm.components import connected_components


def brute(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    names = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[find(i)] = min(names.get(find(i), doc), doc)
    return sorted(((doc, len(s), names.get(find(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=repr)


def _rows():
    rng = random.Random(4)
    say = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    rows, at = [], 0
    for size in (5, 9, 14, 30, 60, 200, 400):
        for _ in range(5):
            base = say(size)
            for _ in range(rng.randrange(1, 7)):
                w = list(base)
                for _ in range(rng.randrange(0, 1 + size // 25)):
                    w[rng.randrange(len(w))] = f"x{rng.randrange(999)}"
                rows.append((at, " ".join(w)))
                at += 1
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "one  Two"), (907, "two one"), (None, rows[0][1]), (None, ""), (3, rows[40][1])]
    # a chain of texts, each a little different from the one before
    w = say(120)
    for k in range(12):
        rows.append((950 + k, " ".join(w)))
        w[k * 9] = f"y{k}"
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,num,tile", [(3, 90, 4_000_000), (5, 80, 300)])
def test_components_match_brute_force(spark, n, num, tile):
    rows = _rows()
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, node int").repartition(4)
    got = J.jaccard_components(df, n, (num, 100), tile)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, n, num, 100)


def test_empty_table(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blocks_with_a_hot_key_send_one_entry():
    nodes = np.arange(1000, dtype=np.int64)
    keys, low, a, b = J._star(np.full(1000, 7, dtype=np.uint64), nodes)
    assert keys.tolist() == [7] and low.tolist() == [0] and len(a) == 999 and set(a) == {0}


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (50, 100)])
def test_partners_lie_in_the_next_band(num, den):
    bands = J.Bands(num, den)
    for n in range(bands.least, 3000):
        assert bands.of(bands.largest_partner(n)) - bands.of(n) in (0, 1)
        # overlap of the smaller set with the largest union that still links
        union = n * den // num
        assert union - -(-union * num // den) <= bands.differ(n)
        assert bands.parts(bands.of(n)) >= bands.differ(n) + 2


def test_connected_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 50)]
    parent = {x: x for ab in links for x in ab}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    used = {x for a, b in links if a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in used}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_rows_without_an_id_and_a_chained_cluster(spark):
    rng = random.Random(8)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for g in range(200):  # 1,000 rows without an id, in groups of copies and near copies
        base = say(60)
        for k in range(5):
            w = list(base)
            if k > 2:
                w[rng.randrange(60)] = "other"
            rows.append((None, " ".join(w)))
    passage = " ".join(say(70))
    for k in range(150):  # unrelated texts that a long common passage chains into one candidate cluster
        rows.append((5000 + k, " ".join(say(25)) + " " + passage))
    rows += [(7, " ".join(say(40)))] * 300  # one id, equal rows
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = J.jaccard_components(df, 3, (90, 100), 2000)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 3, 90, 100)
    kept = J.keep_first_rows(df, 3, (90, 100))
    names = brute(rows, 3, 90, 100)
    # every component keeps one row: rows with an id by their component, rows without one by their group of five
    with_id = len({c for d, _, c in names if d is not None})
    assert kept.where("doc_id is not null").count() == with_id
    assert kept.where("doc_id is null").count() >= 200
