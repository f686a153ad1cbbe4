"""Alignment of two tokenizations against a plain version that uses the two libraries and Python sets."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessitura.llm import token_alignment as A
from tessitura.llm.piece_bpe import model_path
from tests.conftest import SF_SMALL

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

ALPHABET = list("abcdeth  inge  \n\t\r;{}'s'll()>*/éèñ的中文  　 \x85\x1c​😀AB123…”")


def byte_chars():
    kept = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or 174 <= b < 256]
    moved = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


def plain(texts):
    a = tokenizers.Tokenizer.from_file(A.tokenizer_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=model_path())
    chars, docs = byte_chars(), []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        x, y = a.encode(" " + t, add_special_tokens=False), b.encode(t)
        xs = [bytes(chars[c] for c in a.id_to_token(i)) for i in x.ids]
        ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if b"".join(xs) != (" " + t).encode() or b"".join(ys) != (" " + t).encode():
            docs.append(None)
            continue
        ea, eb = np.cumsum([len(v) for v in xs]).tolist(), np.cumsum([len(v) for v in ys]).tolist()
        links, groups, i, j, ga, gb = [], [], 0, 0, [], []
        sa, sb = [0] + ea, [0] + eb
        for p in range(len(ea)):
            for q in range(max(0, np.searchsorted(eb, sa[p], side="right") - 1), len(eb)):
                if sb[q] >= ea[p]:
                    break
                if max(sa[p], sb[q]) < min(ea[p], eb[q]):
                    links.append((x.ids[p], y[q]))
        common = sorted(set(ea) & set(eb))
        for c in common:
            while i < len(ea) and ea[i] <= c:
                ga.append(str(x.ids[i]))
                i += 1
            while j < len(eb) and eb[j] <= c:
                gb.append(str(y[j]))
                j += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
            ga, gb = [], []
        docs.append((len(ea), len(eb), groups, links))
    counts = Counter(p for d in docs if d for p in set(d[3]))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((d[0], d[1], len(d[2]), len(d[3]), sum(counts[p] == best[p[0]] for p in d[3]), sum(counts[p] for p in d[3]), ";".join(d[2])))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def test_merge_path_against_all_pairs():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 40, 300):
        for steps in (1, 3, 64):
            size = n * 3 + 1
            a = np.unique(np.append(rng.integers(1, size, n), size))
            b = np.unique(np.append(rng.integers(1, size, n), size))
            i, j, group = A.merge_path(a, b, steps)
            sa, sb = np.concatenate([[0], a[:-1]]), np.concatenate([[0], b[:-1]])
            want = [(p, q) for p in range(len(a)) for q in range(len(b)) if max(sa[p], sb[q]) < min(a[p], b[q])]
            assert sorted(zip(i.tolist(), j.tolist())) == want
            common = np.array(sorted(set(a.tolist()) & set(b.tolist())))
            assert group.tolist() == np.searchsorted(common, np.minimum(a[i], b[j])).tolist()
    assert len(A.merge_path(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))[0]) == 0


@pytest.mark.parametrize("block", [64, 1 << 21])
def test_against_the_libraries(spark, block, monkeypatch):
    rng = random.Random(11)
    texts = ["", None, " ", "\n", "a▁b", "<|endoftext|> and </s>", "x" * 3000, "a b " * 500, "  two", "it's we'll  go\n\n so", "same words", "same words"]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.choice([1, 3, 10, 60, 300]))) for _ in range(400)]
    monkeypatch.setattr(A, "BLOCK_BYTES", block)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, groups string").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in A.align_tokens(df).collect()}
    want = plain(texts)
    assert [got[i] for i in range(len(texts))] == want


def test_query_over_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d.doc_id for d in docs], plain([d.text for d in docs])))
    for r in A.op11_token_alignment(spark, SF_SMALL).collect():
        *numbers, groups = want[r.doc_id]
        assert [r[c] for c in COLUMNS[:-1]] == numbers
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_odd_tables(spark):
    assert A.align_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (None, "a b", "z"), (2, None, "w")], "doc_id long, text string, n_a string")
    out = sorted(A.align_tokens(rows).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.n_a, r.count_sum) for r in out] == [(1, 2, 6), (1, 2, 6), (2, 0, 0), (None, 2, 6)]


def test_a_task_holds_few_blocks(spark, monkeypatch):
    """Blocks are written in row groups of bounded bytes, not by the hundred; each is finished by itself, with the answers of its own pairs."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(300)) for _ in range(120)]
    path = str(spark.sparkContext._jsc.sc().getCheckpointDir().get()).removeprefix("file:") + "/few-blocks"
    monkeypatch.setattr(A, "scratch_path", lambda *_: path)
    monkeypatch.setitem(A.ROW_GROUPS, "parquet.block.size", str(1 << 14))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")  # every row is a block
    try:
        out = A.align_tokens(df)
    finally:
        spark.conf.set(name, before)
    groups = [m.row_group(i).num_rows for f in sorted(os.listdir(path)) if f.endswith(".parquet") for m in [pq.ParquetFile(f"{path}/{f}").metadata] for i in range(m.num_row_groups)]
    assert sum(groups) == 120 and max(groups) <= 10
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts)
