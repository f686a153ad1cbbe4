"""Alignment of two tokenizations of the same texts by merge-path partitioning.

A (byte-level BPE) and B (SentencePiece) cut a text's bytes at different places.
Both lists of token ends are sorted, so the overlapping pairs are the steps of a
merge.  The merge is divided by diagonals: a binary search on every diagonal
(all diagonals at once) finds how far A and B have come after a given number of
steps, which makes pieces of equal work.  All pieces walk their steps in
lockstep, emit the overlaps they meet and count the common ends; a prefix sum of
these counts stitches the pieces, so a group that crosses a border has one number.

Neither tokenizer reaches across a space or line break that follows a character
that is no white space.  A block of texts is cut there into words; its distinct
words are encoded and merged once, and a document is the list of its words.

How many documents hold an id pair is counted by buckets of A's ids: a block sends
each bucket its distinct pairs with their documents, the bucket's task adds them up block by
block, then answers every block with the totals of its pairs.  So nothing is collected or
broadcast but the two vocabularies, whose size is that of their files, and one
task holds one bucket's distinct pairs (at most its ids times B's ids), never a list of documents.

Defined results: null and empty texts, and texts whose B bytes differ (U+2581
inside), have no tokens: zeros and an empty list of groups, and count nowhere.  Repeated rows count as
documents of their own, and are answered row by row; a null id stays null.  Other columns are left behind.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .bytescan import BYTE_VALUE, span_hashes, text_chunks
from .common import read, register, shuffle_width, small_batches
from .piece_bpe import Vocabulary, WordTable, model_path, ragged, spaced, word_signs
from .token_counts import PATTERN

BLOCK_BYTES = 1 << 21
PIECE_STEPS = 64  # steps of the merge that one piece walks
LEAST_BUCKETS = 64
FOLD_PAIRS = 1 << 21  # pairs that a bucket holds before it adds them up
# A row is a whole block, some MB: a task writes and reads a few of them at a time, where by default it would hold a hundred.
ROW_GROUPS = {"compression": "zstd", "parquet.block.size": str(1 << 24), "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


class ByteLevel:
    """Byte-level BPE read from a tokenizer JSON file; the order of ids is that of the merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, special = spec["model"], {t["content"] for t in spec.get("added_tokens", ())}
        kept = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]
        moved = [b for b in range(256) if b not in set(kept)]
        byte_of = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(moved)}
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        order = [vocab[m] for m in merges]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or order != sorted(order):
            raise ValueError("a byte-level BPE tokenizer whose ids follow its merges is needed")
        self.ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
        self.size, self.key = max(vocab.values()) + 1, uuid.uuid4().hex
        self.token_len = np.zeros(self.size, dtype=np.int64)
        for t, i in self.ranks.items():
            self.token_len[i] = len(t)
        self._core = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_core": None}

    def encode_spans(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self._core is None:
            import tiktoken

            self._core = tiktoken.Encoding(self.key, pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        raw, encode = buf.tobytes(), self._core.encode_ordinary
        lists = [encode(raw[a:b].decode()) for a, b in zip(starts.tolist(), ends.tolist())]
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(counts.sum())), counts


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """First bytes of texts, and spaces and line breaks that follow a character that is surely no white space."""
    start = (buf == 0x20) | (buf == 0x0A)
    p = np.flatnonzero(start)
    b1, b2, b3 = (buf[np.maximum(p - k, 0)] for k in (1, 2, 3))
    white = (b1 <= 0x20) | (b1 == 0x7F)
    wide = ((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))) | ((b3 == 0xE1) & ((b2 == 0x9A) | (b2 == 0xA0))) | ((b3 == 0xE2) & ((b2 == 0x80) | (b2 == 0x81))) | ((b3 == 0xE3) & (b2 == 0x80))
    start[p[white | ((b1 >= 0x80) & wide)]] = False
    start[off[:-1][off[:-1] < off[1:]]] = True
    return np.flatnonzero(start)


def merge_path(a_end: np.ndarray, b_end: np.ndarray, steps: int = PIECE_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping pairs of two tilings of one stretch of bytes, given by their ends, in order.

    Returns the tokens of A, the tokens of B and the pair's group: groups are cut where both end.
    """
    n, m = len(a_end), len(b_end)
    total = n + m
    if total == 0:
        return (np.zeros(0, dtype=np.int64),) * 3
    diagonal = np.arange(0, total, steps)
    lo, hi = np.maximum(0, diagonal - m), np.minimum(diagonal, n)
    while (lo < hi).any():
        mid = (lo + hi) >> 1
        open_ = lo < hi
        ahead = a_end[np.minimum(mid, n - 1)] <= b_end[np.clip(diagonal - 1 - mid, 0, m - 1)]
        lo, hi = np.where(open_ & ahead, mid + 1, lo), np.where(open_ & ~ahead, mid, hi)
    i, j = lo, diagonal - lo
    far = max(int(a_end[-1]), int(b_end[-1])) + 1
    a, b = np.append(a_end, far), np.append(b_end, far)
    a_start, b_start = np.concatenate([[0], a_end]), np.concatenate([[0], b_end])
    pieces = len(diagonal)
    at_a, at_b = np.empty((pieces, steps), dtype=np.int64), np.empty((pieces, steps), dtype=np.int64)
    meets, borders = np.empty((pieces, steps), dtype=bool), np.empty((pieces, steps), dtype=bool)
    for k in range(steps):
        ai, bj = a[i], b[j]
        at_a[:, k], at_b[:, k] = i, j
        meets[:, k] = (i < n) & (j < m) & (a_start[i] < bj) & (b_start[j] < ai)
        take_a = ai <= bj
        # where both end, A's token is taken first and B's ends the group
        borders[:, k] = ~take_a & (i > 0) & (a_start[i] == bj)
        i, j = np.minimum(i + take_a, n), np.minimum(j + ~take_a, m)
    inside = (np.arange(pieces * steps) < total).reshape(pieces, steps)
    meets &= inside
    borders &= inside
    within = np.cumsum(borders, axis=1) - borders
    before = np.cumsum(borders.sum(axis=1)) - borders.sum(axis=1)
    return at_a[meets], at_b[meets], (within + before[:, None])[meets]


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. size - 1 in rows of 8 bytes, and how many each has."""
    text = [str(k) for k in range(size)]
    return np.frombuffer("".join(t.ljust(8) for t in text).encode(), dtype=np.uint8).reshape(size, 8), np.fromiter(map(len, text), dtype=np.int64, count=size)


class Alignment:
    """The merge of a list of words: links, groups, and each word's groups as text."""

    def __init__(self, pair: "TokenizerPair", a_ids: np.ndarray, a_counts: np.ndarray, b_ids: np.ndarray, b_counts: np.ndarray):
        words = len(a_counts)
        self.a_ids, self.b_ids, self.a_counts, self.b_counts = a_ids, b_ids, a_counts, b_counts
        i, j, group = merge_path(np.cumsum(pair.a.token_len[a_ids]), np.cumsum(pair.b.piece_len[b_ids]))
        self.word = np.repeat(np.arange(words), a_counts)[i]
        self.code = a_ids[i].astype(np.int64) * pair.b.size + b_ids[j]
        self.n_links = np.bincount(self.word, minlength=words)
        ends = np.concatenate([group[1:] != group[:-1], [True]]) if len(group) else np.zeros(0, dtype=bool)
        self.n_groups = np.bincount(self.word[ends], minlength=words)
        group_a, group_b = np.empty(len(a_ids), dtype=np.int64), np.empty(len(b_ids), dtype=np.int64)
        group_a[i], group_b[j] = group, group
        self.group_a, self.group_b = group_a, group_b

    def texts(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2`` of every word."""
        ids = np.concatenate([self.a_ids, self.b_ids])
        if len(ids) == 0:
            return [b""] * len(self.a_counts)
        part = np.concatenate([2 * self.group_a, 2 * self.group_b + 1])
        order = np.argsort(part, kind="stable")
        ids, part = ids[order], part[order]
        table, widths = _digit_table(int(ids.max()) + 1)
        rows, width = table[ids], widths[ids]
        last = np.append(part[1:] != part[:-1], True)
        rows[np.arange(len(ids)), width] = np.where(last, np.where(part % 2 == 0, ord("|"), ord(";")), ord(","))
        raw = rows[np.arange(8) <= width[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(width + 1)])[np.concatenate([[0], np.cumsum(self.a_counts + self.b_counts)])].tolist()
        return [raw[x : y - 1] for x, y in zip(ends[:-1], ends[1:])]


_digit_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _digit_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    have = max(_digit_tables, default=0)
    if have < size:
        _digit_tables.clear()
        have = 1 << (size - 1).bit_length()
        _digit_tables[have] = _digits(have)
    return _digit_tables[have]


class TokenizerPair:
    """Both vocabularies and, in a worker, the words met so far."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b, self.tables = ByteLevel(a_path), Vocabulary(b_path), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": None}

    def encode_words(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """A's and B's ids and counts of every span, and whether their bytes agree with the span's; others have no ids."""
        if self.tables is None:
            self.tables = (WordTable(self.a), WordTable(self.b))
        found = []
        for table in self.tables:
            slot = table.look_up(buf, starts, ends)
            found.append((table.flat[ragged(table.start[slot], table.count[slot])], table.count[slot]))
        (a_ids, a_counts), (b_ids, b_counts) = found
        size = ends - starts
        word_b = np.repeat(np.arange(len(size)), b_counts)
        same = np.bincount(word_b, weights=self.b.piece_len[b_ids], minlength=len(size)).astype(np.int64) == size
        same &= np.bincount(np.repeat(np.arange(len(size)), a_counts), weights=self.a.token_len[a_ids], minlength=len(size)).astype(np.int64) == size
        kept = b_ids[same[word_b]]
        mine = self.b.piece_bytes[ragged(self.b.piece_off[kept], self.b.piece_len[kept])]
        differ = np.flatnonzero(mine != buf[ragged(starts[same], size[same])])
        which = np.flatnonzero(same)
        same[which[np.searchsorted(np.cumsum(size[same]), differ, side="right")]] = False
        return a_ids[np.repeat(same, a_counts)], np.where(same, a_counts, 0), b_ids[np.repeat(same, b_counts)], np.where(same, b_counts, 0), same


def _narrow(x: np.ndarray, size: int) -> bytes:
    return x.astype(np.uint16 if size <= 1 << 16 else np.uint32).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    """Numbers written by ``_narrow``; ``n`` of them tell their width."""
    return np.frombuffer(raw, dtype=np.uint16 if len(raw) == 2 * n else np.uint32).astype(np.int64)


def _code_order(code: np.ndarray, b_size: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pair codes by bucket and code, and every link's place among them."""
    span = np.int64(1) << 45
    key, place = np.unique((code // b_size % buckets) * span + code, return_inverse=True)
    return key, place


def _block_rows(pair: TokenizerPair, buckets: int, names: list[str]):
    """Partition function over (id, text): one row per block of documents."""

    def block(ids: pa.Array, buf: np.ndarray, off: np.ndarray, number: int) -> pa.RecordBatch:
        n_docs = len(off) - 1
        starts = word_starts(buf, off)
        ends = np.append(starts[1:], len(buf))
        doc = np.searchsorted(off, starts, side="right") - 1
        h, sign = span_hashes(buf, starts, ends, BYTE_VALUE), word_signs(buf, starts, ends)
        _, first, use = np.unique(h, return_index=True, return_inverse=True)
        wrong = np.flatnonzero(sign[first][use] != sign)
        use[wrong] = len(first) + np.arange(len(wrong))
        first = np.concatenate([first, wrong])
        a_ids, a_counts, b_ids, b_counts, same = pair.encode_words(buf, starts[first], ends[first])
        bad = np.bincount(doc, weights=~same[use], minlength=n_docs) > 0
        use, doc = use[~bad[doc]], doc[~bad[doc]]
        aligned = Alignment(pair, a_ids, a_counts, b_ids, b_counts)
        key, place = _code_order(aligned.code, pair.b.size, buckets)
        # documents that hold a pair: distinct (document, word), their links, distinct again
        held = np.unique(doc * np.int64(len(first)) + use)
        links = np.cumsum(aligned.n_links) - aligned.n_links
        word = held % max(len(first), 1)
        n = aligned.n_links[word]
        pairs = np.unique(np.repeat(held // max(len(first), 1), n) * np.int64(max(len(key), 1)) + place[ragged(links[word], n)])
        docs = np.bincount(pairs % max(len(key), 1), minlength=len(key))
        bucket = key >> 45
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        code = key & ((np.int64(1) << 45) - 1)
        sent = [{"bucket": k, "codes": code[x:y].tobytes(), "docs": docs[x:y].astype(np.int32).tobytes()} for k, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if y > x]
        row = [
            pa.array([number], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, n_docs], pa.int32()), ids),
            pa.array([np.bincount(doc, minlength=n_docs).astype(np.int32).tobytes()], pa.binary()),
            pa.array([_narrow(use, len(first))], pa.binary()),
            pa.array([a_counts.astype(np.int32).tobytes()], pa.binary()),
            pa.array([b_counts.astype(np.int32).tobytes()], pa.binary()),
            pa.array([_narrow(a_ids, pair.a.size)], pa.binary()),
            pa.array([_narrow(b_ids, pair.b.size)], pa.binary()),
            pa.array([sent], pa.list_(pa.struct([("bucket", pa.int32()), ("codes", pa.binary()), ("docs", pa.binary())]))),
        ]
        return pa.RecordBatch.from_arrays(row, names=names)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo, hi, buf, off in text_chunks(b.column(1), BLOCK_BYTES):
                buf, off = spaced(buf, off)
                yield block(b.column(0).slice(lo, hi - lo), buf, off, number)
                number += 1

    return run


def _fold(codes: list[np.ndarray], docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(at, weights=np.concatenate(docs), minlength=len(code)).astype(np.int64)


def _sum_pairs(b_size: int):
    """Partition function over (bucket, codes, docs), sorted by bucket: each bucket's pairs with their documents and whether they are their A id's best."""

    def finish(bucket, codes, docs):
        code, total = _fold(codes, docs)
        a = code // b_size
        starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        best = np.repeat(np.maximum.reduceat(total, starts), np.diff(starts, append=len(code)))
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([code.tobytes()], pa.binary()), pa.array([(2 * total + (total == best)).tobytes()], pa.binary())], names=["bucket", "codes", "docs"])

    def run(batches):
        now, codes, docs, n = None, [], [], 0
        for b in batches:
            for bucket, code, doc in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if bucket != now:
                    if now is not None:
                        yield finish(now, codes, docs)
                    now, codes, docs, n = bucket, [], [], 0
                codes.append(np.frombuffer(code.as_py(), dtype=np.int64))
                docs.append(np.frombuffer(doc.as_py(), dtype=np.int32))
                n += len(codes[-1])
                if n > FOLD_PAIRS:
                    code, total = _fold(codes, docs)
                    codes, docs, n = [code], [total], len(code) // 2
        if now is not None:
            yield finish(now, codes, docs)

    return run


def _answer(batches):
    """(bucket, block, codes, totals) sorted by bucket and block: the totals (block -1) come first, then every block's pairs are looked up."""
    known = totals = None
    for b in batches:
        out = []
        for bucket, block, code, total in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
            code = np.frombuffer(code.as_py(), dtype=np.int64)
            if block < 0:
                known, totals = code, np.frombuffer(total.as_py(), dtype=np.int64)
            else:
                out.append((block, bucket, totals[np.searchsorted(known, code)].tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["block", "bucket", "totals"])


def _document_rows(pair: TokenizerPair, buckets: int, names: list[str]):
    """Function of one block and the answers of its pairs: one row per document."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = {c: block.column(c).combine_chunks()[0] for c in block.column_names}
        raw = {c: x.as_py() for c, x in row.items() if c not in ("block", "ids")}
        words, a_counts, b_counts = (np.frombuffer(raw[c], dtype=np.int32).astype(np.int64) for c in ("words", "a_counts", "b_counts"))
        use = _wide(raw["use"], int(words.sum()))
        a_ids, b_ids = _wide(raw["a_ids"], int(a_counts.sum())), _wide(raw["b_ids"], int(b_counts.sum()))
        told = [np.frombuffer(x, dtype=np.int64) for _, x in sorted(zip(answers.column("bucket").to_pylist(), answers.column("totals").to_pylist()))]
        totals = np.concatenate([np.zeros(0, dtype=np.int64), *told])
        aligned = Alignment(pair, a_ids, a_counts, b_ids, b_counts)
        _, place = _code_order(aligned.code, pair.b.size, buckets)
        n_words = len(a_counts)
        per_word = [a_counts, b_counts, aligned.n_groups, aligned.n_links]
        for x in (totals[place] & 1, totals[place] >> 1):
            run_ = np.concatenate([[0], np.cumsum(x)])
            upto = np.cumsum(aligned.n_links)
            per_word.append(run_[upto] - run_[upto - aligned.n_links])
        ends = np.concatenate([[0], np.cumsum(words)])
        columns = []
        for x in per_word:
            run_ = np.concatenate([[0], np.cumsum(x[use])]) if n_words else np.zeros(1, dtype=np.int64)
            columns.append(np.diff(run_[ends]).astype(np.int64))
        text, use, ends = aligned.texts(), use.tolist(), ends.tolist()
        groups = [b";".join([text[w] for w in use[x:y]]).decode() for x, y in zip(ends[:-1], ends[1:])]
        return pa.Table.from_arrays([row["ids"].values, *map(pa.array, columns), pa.array(groups, pa.string())], names=names)

    return run


def align_tokens(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (``a1,a2|b1;a3|b2``) of every row of ``docs``."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(TokenizerPair(a_path or tokenizer_path(), b_path or model_path()))
    small_batches(spark)
    width = shuffle_width(spark)
    buckets = max(LEAST_BUCKETS, 2 * width)
    b_size = held.value.b.size
    id_field = T.StructField(id_col, docs.schema[id_col].dataType)
    binary = ["words", "use", "a_counts", "b_counts", "a_ids", "b_ids"]
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("ids", T.ArrayType(id_field.dataType)),
            *(T.StructField(c, T.BinaryType()) for c in binary),
            T.StructField("sent", T.ArrayType(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("codes", T.BinaryType()), T.StructField("docs", T.BinaryType())]))),
        ]
    )

    def encode(batches):
        yield from _block_rows(held.value, buckets, schema.names)(batches)

    path = scratch_path(spark, "aligned-blocks")
    written = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("_text")).mapInArrow(encode, schema).write.options(**ROW_GROUPS)
    written.parquet(path)
    blocks = spark.read.parquet(path)

    sent = blocks.select("block", F.inline("sent"))
    by_bucket = sent.select("bucket", "codes", "docs").repartition(width, "bucket").sortWithinPartitions("bucket")
    sums = by_bucket.mapInArrow(_sum_pairs(b_size), "bucket int, codes binary, docs binary")
    asked = sums.select("bucket", F.lit(-1).cast("long").alias("block"), "codes", "docs").unionByName(sent.select("bucket", "block", "codes", F.lit(None).cast("binary").alias("docs")))
    answers = asked.repartition(width, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(_answer, "block long, bucket int, totals binary")

    counts = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    out = T.StructType([id_field, *(T.StructField(c, T.LongType()) for c in counts), T.StructField("groups", T.StringType())])

    def finish(block: pa.Table, told: pa.Table) -> pa.Table:
        return _document_rows(held.value, buckets, out.names)(block, told)

    # a worker is handed one block with its answers at a time, however many there are in its partition
    return blocks.select("block", "ids", *binary).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, out)


@register("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level tokens against pieces over all documents."""
    rows = align_tokens(read(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
