"""The pipeline's stages, each against a brute-force version on its own input, and the whole run."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessitura.llm import queries, toxicity

from ..conftest import SF_SMALL
from .test_decontaminate import brute as brute_windows
from .test_jaccard_join import brute as brute_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows that go into and come out of every stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, SF_SMALL).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append((name, before, docs.columns, [tuple(r) for r in docs.collect()]))
    return {name: rest for name, *rest in out}


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard", "suffix_dedup", "decontaminate", "mix"]
    for name, (_, columns, rows) in stages.items():
        assert rows and (name == "mix" or columns == COLUMNS)


def test_toxicity_stage(spark, stages):
    before, _, after = stages["toxicity"]
    model = toxicity.fit_on(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    assert sorted(after) == sorted(r for r in before if model.score(r[1])[0] < 0.5)
    assert 0.8 * len(before) < len(after) < len(before)


def test_jaccard_stage(stages):
    before, _, after = stages["jaccard"]
    groups = brute_components([(r[0], r[1]) for r in before], 5, 80, 100)
    keep = {doc for doc, _, component in groups if doc == component}
    assert sorted(after) == sorted(r for r in before if r[0] in keep) and len(after) < len(before)


def test_one_row_of_each_group_stays(spark):
    """Repeated rows and null ids leave one row, and a row that shares its id with a linked one stays."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, one), (1, one), (1, one), (None, one + " end"), (2, one), (2, "unlike all others"), (None, two), (None, two), (None, two + " end"), (5, three + " end"), (4, three), (4, three + " more"), (8, ""), (8, ""), (9, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    out = corpus_pipeline.keep_one_of_each_group(spark, docs, SF_SMALL)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    for group, ids in ((one, [1]), (two, [None]), (three, [4])):
        assert [i for i, x in got if x and x.startswith(group)] == ids
    assert sorted(((i, x) for i, x in got if not x or x.startswith("unlike")), key=repr) == sorted([(2, "unlike all others"), (8, ""), (8, ""), (9, None)], key=repr)


def test_suffix_stage(stages):
    before, _, after = stages["suffix_dedup"]
    raws = {r[0]: r[1].encode() for r in before}
    first = {}
    for i, raw in raws.items():
        for a in range(len(raw) - 49):
            s = raw[a : a + 50]
            first[s] = min(first.get(s, i), i)
    got = {r[0]: r for r in after}
    for r in before:
        raw, gone = raws[r[0]], bytearray(len(raws[r[0]]))
        for a in range(len(raw) - 49):
            if first[raw[a : a + 50]] < r[0]:
                gone[a : a + 50] = b"\1" * 50
        at, kept = 0, []
        for ch in r[1]:
            n = len(ch.encode())
            if not all(gone[at : at + n]):
                kept.append(ch)
            at += n
        assert got[r[0]] == (r[0], "".join(kept), r[2], r[3], len(kept))


def test_decontamination_stage(spark, stages):
    before, _, after = stages["decontaminate"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {doc for doc, _, n_hit, _ in brute_windows([(r[0], r[1]) for r in before], items) if n_hit}
    assert hit and sorted(after) == sorted(r for r in before if r[0] not in hit)


def test_decontamination_by_row(spark):
    """A null id does not save a contaminated row, and a shared id does not drop a clean one."""
    window = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").where("length(text) > 200").first()["text"]
    rows = [(None, "before " + window), (None, "clean"), (7, window + " after"), (7, "also clean"), (8, None), (9, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_contaminated(spark, docs, SF_SMALL)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([rows[1], rows[3], rows[4], rows[5]], key=repr)


def test_mix_stage(stages):
    before, columns, after = stages["mix"]
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in before}
    rows = [dict(zip(columns, r)) for r in after]
    assert {r["doc_id"]: r["size"] for r in rows} == size
    assert all(r["taken"] == r["copies"] * r["size"] and r["copies"] <= 2 for r in rows)
    assert abs(sum(r["taken"] for r in rows) - 1.5 * sum(size.values())) < 0.05 * sum(size.values())


def test_odd_documents(spark):
    """Nulls, empty and repeated rows, and further columns with clashing names pass all stages."""
    rows = [(1, None, "en", "s", None, 1.0), (2, "", None, None, 0, 2.0), (None, "some words " * 30, "en", "s", 5, None), (3, "a", "en", "s", 1, 0.0), (3, "a", "en", "s", 1, 0.0), (4, "very long " * 30_000, "de", "t", 9, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        assert name == "mix" or out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() >= 4
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_SMALL).count() == 0


def test_registered_queries(spark):
    names = sorted(queries.QUERIES)
    assert sorted(n.split("_")[0] for n in names) == sorted(f"op{i}" for i in range(1, 14))
    assert set(queries.ORACLES) <= set(names)
    assert corpus_pipeline.run(spark, SF_SMALL).select(F.sum("taken")).first()[0] > 0
