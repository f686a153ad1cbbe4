"""Suffix arrays against sorting, and suffix-array dedup against a brute-force cut."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tessitura.llm import suffix_dedup as S
from tessitura.llm.suffix_array import classify, common_prefixes, suffix_array


def _strings():
    rng = np.random.default_rng(5)
    for trial in range(120):
        n, k = int(rng.integers(1, 200)), int(rng.integers(1, 6))
        base = rng.integers(1, k + 1, n)
        if trial % 3 == 0:
            base = np.tile(base[: max(1, n // 7)], 9)[:n]
        yield np.append(base, 0).astype(np.int64)


@pytest.mark.parametrize("deep", ["scan", "double"])
def test_suffix_array_is_the_sorted_order(deep):
    for t in _strings():
        text = t.tolist()
        assert suffix_array(t, deep).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    big = np.append(np.random.default_rng(1).integers(1, 4, 6000), 0).astype(np.int64)
    assert (suffix_array(big, deep) == suffix_array(big, "scan")).all()


def test_common_prefixes():
    for most in (1, 3, 7, 50):
        for t in _strings():
            sa, text = suffix_array(t), t.tolist()
            got = common_prefixes(t, sa, most)
            for i in range(1, len(text)):
                a, b = text[sa[i - 1] :], text[sa[i] :]
                n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                assert got[sa[i]] == min(n, most)


def test_types():
    assert classify(np.array([2, 1, 1, 3, 0])).tolist() == [False, True, True, False, True]


def brute_cut(rows, length=50):
    """[(n_bytes, n_removed, n_spans, sha256)] per row, straight from the definition."""
    raws = [((1 << 63) - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, raw in raws:
        for a in range(len(raw) - length + 1):
            s = raw[a : a + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for a in range(len(raw) - length + 1):
            if first[raw[a : a + length]] < i:
                gone[a : a + length] = b"\1" * length
        spans = sum(1 for a in range(len(gone)) if gone[a] and (a == 0 or not gone[a - 1]))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return out


def _rows():
    rng = random.Random(3)
    words = ["alpha", "béta", "gamma", "δέλτα", "eps", "zeta", "日本", "theta"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    passage, other = say(14), say(9)
    rows = [(i, say(30)) for i in range(12)]
    rows += [(20 + i, say(i) + " " + passage + " " + say(5)) for i in range(6)]
    rows += [(30, passage), (31, passage[:60]), (32, passage + passage), (33, other + passage + other), (34, "a" * 400), (35, "a" * 130 + "b" + "a" * 49), (36, "b" * 49), (37, "b" * 49)]
    rows += [(40, rows[3][1]), (41, rows[3][1]), (40, rows[4][1] + "x"), (42, None), (43, ""), (None, rows[5][1]), (None, passage + " end"), (-7, rows[6][1])]
    rows += [(50, (say(900) + passage + say(400)))]
    return rows


FIELDS = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
SCHEMA = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _run(spark, rows, **extra):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.cut_documents(df.repartition(5), S._digest, SCHEMA, FIELDS, **extra)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_dedup_matches_brute_force(spark):
    rows = _rows()
    exp = sorted(((i, *cut) for (i, _), cut in zip(rows, brute_cut(rows))), key=repr)
    assert _run(spark, rows) == exp


def test_entries_of_several_documents_vouch_for_their_neighbours(spark):
    """The smaller document has the larger one's anchor with both sides alike, and elsewhere, with one side alike, the string they share."""
    rng = random.Random(8)
    say = lambda n: "".join(chr(rng.randrange(97, 123)) for _ in range(n))
    rows = []
    for k in range(60):
        s = say(160)
        _, first, last, _, _ = S.anchors(np.frombuffer(s.encode(), np.uint8), np.array([0, 160]))
        at = int(np.flatnonzero(last >= 60)[0])
        # mostly the anchor is the end of its first window or the start of its last one
        i = int(last[at] if k % 2 else first[at])
        p = i if k % 2 else i + 38
        rows += [(2 * k, say(30) + s[p - 19 : p + 31] + say(40) + s[i : i + 50] + say(40)), (2 * k + 1, s)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(tuple(r) for r in S.cut_documents(df, S._digest, SCHEMA, FIELDS).collect())
    assert got == sorted((i, *cut) for (i, _), cut in zip(rows, brute_cut(rows)))


def test_dedup_of_hot_groups_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BATCH_BYTES", 400)
    monkeypatch.setattr(S, "HOT_BATCHES", 1)
    rows = _rows()
    data = [r[1].encode() for r in rows if r[1] and len(r[1].encode()) >= 50]
    size = np.array([len(d) for d in data])
    buf = np.frombuffer(b"".join(data), np.uint8)
    best = S.window_minima(size, buf, np.arange(len(data)), 50)
    seen, exp = {}, []
    for i, d in enumerate(data):
        for a in range(len(d) - 49):
            seen[d[a : a + 50]] = min(seen.get(d[a : a + 50], i), i)
    for d in data:
        exp += [seen[d[a : a + 50]] for a in range(len(d) - 49)]
    assert best.tolist() == exp
    # the same through a shard whose groups exceed the batch size
    ends = np.cumsum(size)
    row = (0, 0, np.zeros(len(data), np.uint64).tobytes(), S._narrow(np.arange(len(data))), np.full(len(data), 2, np.int64).tobytes(), size.astype(np.int32).tobytes(), buf.tobytes())
    batch = pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=S._SENT_NAMES)
    of = {int(c): i for i, c in enumerate(S._content_hashes(buf, size, 50).view(np.int64))}
    got = np.full(int((size - 49).sum()), -1, dtype=np.int64)
    start = np.cumsum(size - 49) - (size - 49)
    for b in S._shard_results(50)([batch]):
        for c, run, least in zip(*(col.to_pylist() for col in b.columns)):
            got[start[of[c]] + (run >> 32) : start[of[c]] + (run >> 16 & 0xFFFF) + 1] = least
    last = {d: i for i, d in enumerate(data)}  # equal fragments are one; the map above names the last
    exp = [x for i, d in enumerate(data) for x in (exp[start[i] : start[i] + len(d) - 49] if last[d] == i else [-1] * (len(d) - 49))]
    assert got.tolist() == exp and ends[-1] == len(buf)


def test_long_texts_are_scanned_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    buf = rng.integers(97, 105, 9000).astype(np.uint8)
    off = np.array([0, len(buf)])
    whole = S.anchors(buf, off)
    monkeypatch.setattr(S, "_PIECE", 1000)
    cut = S.anchors(buf, off)
    cover = lambda x: [(a, int(e)) for f, l, e in zip(*x[1:4]) for a in range(f, l + 1)]
    assert cover(cut) == cover(whole)


def test_empty_table_and_columns(spark):
    assert _run(spark, []) == []
    df = spark.createDataFrame([(1, "x" * 80, 5, "a"), (2, "x" * 80 + "é", None, "b"), (3, None, 7, None)], "doc_id long, text string, bucket int, _key string")
    out = S.dedup_texts(df)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, "x" * 80, 5, "a"), (2, "é", None, "b"), (3, "", 7, None)]


def test_whole_characters():
    raw = "aéb".encode()
    assert S.whole_characters(raw, [(2, 4)]) == "aé"
    assert S.whole_characters(raw, [(1, 2)]) == "aéb"
    assert S.whole_characters(raw, [(0, 3)]) == "b"


def _packed_fragments(buckets, each, alphabet=4):
    """One sent row per bucket, with ``each`` fragments of 60 bytes, of which every second one comes again as a later document's."""
    rng = np.random.default_rng(3)
    for b in range(buckets):
        anchor = np.sort(rng.integers(0, 1 << 20, each).astype(np.uint64)) + np.uint64(b << 24)
        text = rng.integers(97, 97 + alphabet, (each, 60)).astype(np.uint8)
        text[1::2], anchor[1::2] = text[::2], anchor[::2]
        row = (0, b, S._planes(anchor), S._narrow(rng.integers(0, 1000, each)), np.ones(each, dtype=np.int64).tobytes(), np.full(each, 60, dtype=np.int32).tobytes(), text.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, S._SENT_TYPES)], names=S._SENT_NAMES)


def _peak_mb(run):
    tracemalloc.start()
    try:
        n = sum(b.num_rows for b in run())
        return n, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_shard_holds_a_few_buckets_at_a_time(monkeypatch):
    """Memory beyond the packed rows themselves does not grow with the buckets of a task, and what is found stays."""
    shard = S._shard_results(50)
    few = _peak_mb(lambda: shard(_packed_fragments(4, 20_000)))
    many = _peak_mb(lambda: shard(_packed_fragments(32, 20_000)))
    assert many[0] > 7 * few[0]
    assert many[1] - few[1] < 28 * 20_000 * 100 / 1e6 * 1.5  # the packed rows of 28 more buckets, about 82 bytes a fragment

    rows = lambda: sorted(r for b in shard(_packed_fragments(6, 300)) for r in zip(*(c.to_pylist() for c in b.columns)))
    whole = rows()
    monkeypatch.setattr(S, "FLUSH_BYTES", 1)
    monkeypatch.setattr(S, "GATHER_BYTES", 70)
    assert whole and rows() == whole


def test_entries_are_answered_a_few_buckets_at_a_time(monkeypatch):
    rng = np.random.default_rng(4)

    def sent(buckets, each, step):
        for b in range(buckets):
            e = np.sort((rng.integers(0, 1 << 20, each).astype(np.uint64) << np.uint64(16)) + np.uint64(b << 44))
            yield S._entry_batch([(0, b, S._planes(e), S._narrow(np.arange(each))), (0, b, S._planes(e[::step].copy()), S._narrow(np.arange(each)[::step] + each))])

    answer = S._answer_anchors(8)
    few, many = _peak_mb(lambda: answer(sent(4, 100_000, 50))), _peak_mb(lambda: answer(sent(40, 100_000, 50)))
    assert many[1] - few[1] < 36 * 102_000 * 12 / 1e6 * 2

    def pairs():
        nonlocal rng
        rng = np.random.default_rng(4)
        return sorted(p for b in answer(sent(6, 500, 3)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()) for p in zip(np.frombuffer(x, np.uint64).tolist(), S._wide(y, len(x) // 8).tolist()))

    whole = pairs()
    monkeypatch.setattr(S, "FLUSH_ENTRIES", 1)
    assert whole and pairs() == whole


def test_buckets_are_even(spark):
    """Anchors are the smallest of many hashes; their buckets hold about as many all the same, and so do the tasks."""
    rng = np.random.default_rng(9)
    text = bytes(rng.integers(97, 123, 400_000).astype(np.uint8)).decode()
    texts = [text[i : i + 4000] for i in range(0, len(text), 4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), pa.array(texts)], names=["id", "text"])
    sizes = [len(x) // 8 for b in S._send_anchors(50, 16)([batch]) for kind, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist()) if kind != 1]
    assert len(sizes) == 16 and max(sizes) < 1.3 * np.mean(sizes)

    # pairs known inside a block: blocks with other texts begin with other buckets
    first = set()
    for k in range(0, 100, 4):
        two = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([texts[k]] * 2)], names=["id", "text"])
        first |= {bucket for b in S._send_anchors(50, 16)([two]) for kind, bucket in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if kind == 1}
    assert len(first) > 8

    docs = spark.createDataFrame(list(enumerate(texts + texts[:50])), "doc_id long, text string")
    cut = S.cut_documents(docs.withColumn("text", F.concat("text", F.lit(" and "), F.col("doc_id").cast("string"))), S._digest, SCHEMA, FIELDS)
    assert cut.where("n_removed > 0").count() == 50
