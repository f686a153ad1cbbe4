"""Encoding and decoding against the library, on odd texts and on whole tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessitura.llm import piece_bpe as P
from tests.conftest import SF_SMALL

sentencepiece = pytest.importorskip("sentencepiece")

ALPHABET = list("abcdeth  inge  \n\t\r;{}()>*/éèñ的我是中文字符▁▁  　😀</s>\x00\x01AB12345'\"")
ODD = [
    "", None, " ", "  ", "   a", "▁", "▁▁a", " " * 100, " " * 5001 + "x", "the " * 3000, "ab" * 5000, "a" * 20000, "thethe" * 3000, "\n\n\n", "x", "éé" * 3000, "的" * 9000,
    " " * 17, " " * 33, "a" + " " * 31 + "b", "<0x41>", "<s> </s> <unk>", "�", "tail ",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.model_path())


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary(P.model_path())


def encoded(texts, vocabulary):
    out = []
    for ids, counts in P.encode_column(pa.array(texts, pa.string()), vocabulary):
        ends = np.cumsum(counts)
        out += [ids[a:b].tolist() for a, b in zip(ends - counts, ends)]
    return out


def odd_texts():
    rng = random.Random(7)
    return ODD + ["".join(rng.choice(ALPHABET) for _ in range(rng.choice([1, 2, 3, 5, 10, 40, 200, 1000]))) for _ in range(1500)]


def test_ids_are_the_librarys(library, vocabulary):
    texts = odd_texts()
    assert encoded(texts, vocabulary) == library.encode([t or "" for t in texts], num_threads=1)


def test_small_stretches_and_cache(library, vocabulary, monkeypatch):
    texts = odd_texts()[:400]
    monkeypatch.setattr(P, "CHUNK_BYTES", 100)
    monkeypatch.setattr(P, "CACHE_WORDS", 50)
    monkeypatch.setattr(P, "LONG_SYMBOLS", 4)
    P._tables.clear()
    assert encoded(texts, vocabulary) == library.encode([t or "" for t in texts], num_threads=1)
    P._tables.clear()


def test_equal_hashes_are_told_apart(vocabulary, library, monkeypatch):
    monkeypatch.setattr(P, "span_hashes", lambda buf, starts, ends, values: np.zeros(len(starts), dtype=np.uint64))
    P._tables.clear()
    texts = ["one two three four", "five one", "two two"]
    assert encoded(texts, vocabulary) == library.encode(texts)
    P._tables.clear()


def test_decoding(library, vocabulary):
    texts = odd_texts()
    ids = library.encode([t or "" for t in texts], num_threads=1)
    rng = random.Random(3)
    ids += [[rng.choice([3 + 0xC3, 3 + 0xA9, 3 + 0xFF, 300, 13, 1, 2, 29871, 29871, 259]) for _ in range(rng.randrange(6))] for _ in range(300)]
    out = P._texts_of(pa.array(ids, pa.list_(pa.int32())), vocabulary).to_pylist()
    want = [library.decode(x) if x else "" for x in ids]
    assert out == want


def test_query_over_a_whole_table(spark, library):
    rows = P.op12_sentencepiece(spark, SF_SMALL).toPandas().set_index("doc_id").sort_index()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id").sort_index()
    import hashlib

    ids = library.encode([t or "" for t in docs.text], num_threads=1)
    assert rows.n_tokens.tolist() == [len(x) for x in ids]
    assert rows.ids_sha256.tolist() == [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]
    assert rows.decoded_sha256.tolist() == [hashlib.sha256(library.decode(x).encode()).hexdigest() for x in ids]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, ids string")
    assert P.encode_texts(empty).count() == 0
    rows = spark.createDataFrame([(1, None, "x"), (None, "a b", None), (1, "", "y"), (1, "a b", "z")], "doc_id long, text string, decoded string")
    out = P.decode_ids(P.encode_texts(rows)).orderBy(F.col("doc_id").asc_nulls_last(), "text").collect()
    assert [(r.doc_id, r.text, r.decoded) for r in out] == [(1, None, ""), (1, "", ""), (1, "a b", "a b"), (None, "a b", "a b")]
    assert [len(r.ids) for r in out] == [0, 0, 2, 2]
