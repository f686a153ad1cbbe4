"""Windows of benchmark items, by brute force."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tessitura.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, length=10):
    wins = {}
    for item, text in items:
        w = split(text)
        for a in range(max(len(w) - length, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[a : a + length]), set()).add(item)
    out = []
    for i, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(k) for k in wins}:
            for a in range(len(w) - n + 1):
                k = tuple(w[a : a + n])
                if k in wins:
                    hit.update(range(a, a + n))
                    found |= wins[k]
        found.discard(None)
        out.append((i, len(w), len(hit), sorted(map(str, found))))
    return sorted(out, key=repr)


def _case():
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(["the", "of", "a", "And", "Élan", "x9", "rare%d" % rng.randrange(400)]) for _ in range(n))
    items = [(i, say(rng.randrange(4, 40))) for i in range(12)] + [(12, None), (13, ""), (14, "..."), (10, say(12)), (None, say(15)), (15, "The of"), (16, "zz-top")]
    items.append((17, items[3][1]))
    docs = [(i, say(60)) for i in range(20)]
    docs += [(100 + i, say(7) + ", " + items[i][1].upper() + "! " + say(5)) for i in range(12)]
    docs += [(200, None), (201, ""), (None, items[5][1]), (100, "zz top"), (202, (items[2][1] + " ") * 3), (203, items[16][1] + say(3) + " the of"), (204, "of the of the"), (205, items[-4][1] if items[-4][1] else "")]
    return docs, items


def test_contamination_matches_brute_force(spark):
    docs, items = _case()
    d = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, words string, win int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_contamination(d, b).select("doc_id", "n_words", "n_hit", "items").collect()
    assert sorted(((r[0], r[1], r[2], list(r[3])) for r in got), key=repr) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = _case()
    no_docs = spark.createDataFrame([], "doc_id long, text string")
    no_items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(docs[:3], "doc_id long, text string")
    assert D.find_contamination(no_docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert [r["n_hit"] for r in D.find_contamination(some, no_items).collect()] == [0, 0, 0]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "red quick fox runs"), (3, "red a b c d fox runs"), (4, "runs")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "red fox runs")], "item_id long, text string")
    windows = D.benchmark_windows(bench)
    index = D.build_index(docs, windows)
    exact = {r["doc"] for r in D.phrase_candidates(windows, index).collect()}
    near = lambda s: {r["doc"] for r in D.proximity_candidates(windows, index, s).collect()}
    assert 1 in exact and 3 not in near(1)
    assert near(0) == {1} and near(1) == {1, 2} and near(4) == {1, 2, 3}


def test_main_path_is_native(spark):
    docs, items = _case()
    found = D.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_words(spark):
    texts = ["A-b c3", "É Éa", "  ", None, "x\x00y~z"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(D.words(F.col("text")).alias("w"))
    assert [list(r["w"]) for r in df.collect()] == [split(t) for t in texts]
