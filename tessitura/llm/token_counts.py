"""Token counts per document from flat, unindexed token files.

A token file is nothing but 16-bit token ids (big-endian), documents closed by an
end-of-document id.  It is scanned in fixed-size records; a record's separators
are found by one vectorised comparison.  A split keeps the lengths of the
documents that end inside it and the open stretches at both ends; a prefix scan
over the splits' summaries (one row per split) stitches the stretches together
and numbers the documents.  No split looks at another's tokens.

``write_token_files`` makes such files from texts with a public byte-pair
vocabulary (a parameter); a file is padded to whole records with a pad id, which
is not counted.

Defined results: null and empty texts are documents of 0 tokens; tokens after a
file's last separator are a document of their own; a file without tokens has no
document.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import checked_broadcast, materialize, read, register

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public split pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Ids above the vocabulary whose big-endian bytes are the UTF-8 characters U+07FF and U+07FE: Spark's text writer
# can put them at the end of a record.
END_OF_DOCUMENT, PAD = 0xDFBF, 0xDFBE
RECORD_TOKENS = 16_384

_encoders: dict[str, object] = {}


def encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _pieces(text: str, most: int = 100_000) -> Iterator[str]:
    """Long texts are encoded in pieces cut before a space that follows a letter or digit, where the pattern always splits."""
    at = 0
    while len(text) - at > most:
        cut = at + most
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalnum()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def write_token_files(texts: DataFrame, path: str, vocabulary: str = VOCABULARY, record_tokens: int = RECORD_TOKENS) -> None:
    """Write the column ``text`` as token files below ``path``, one per partition."""

    def run(batches):
        enc = encoder(vocabulary)
        body, held, n = record_tokens - 1, [], 0

        def records(flush):
            nonlocal held, n
            if n >= body * 16 or flush and n:
                tokens = np.concatenate(held)
                whole = len(tokens) if flush else len(tokens) // body * body
                out = np.full(-(-whole // body) * body, PAD, dtype=">u2")
                out[:whole] = tokens[:whole]
                held, n = [tokens[whole:]], len(tokens) - whole
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in out.reshape(-1, body)], pa.binary())], names=["value"])

        for b in batches:
            for t in b.column(0):
                for piece in _pieces(t.as_py() or ""):
                    ids = np.array(enc.encode_ordinary(piece), dtype=">u2")
                    held.append(ids)
                    n += len(ids)
                held.append(np.array([END_OF_DOCUMENT], dtype=">u2"))
                n += 1
                yield from records(False)
        yield from records(True)

    # a record is its tokens and, as the line separator, one pad id
    rows = texts.select("text").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", chr(0x7FE)).text(path)


def _scan_split(end_id: int, pad: int):
    """Partition function over (record number, bytes): summary of the split, and the lengths of the documents that end in it."""

    def run(part, records):
        first, head, open_, lengths, seen, rows = None, 0, 0, [], 0, []
        for number, raw in records:
            if first is None:
                first = number
            t = np.frombuffer(bytes(raw), dtype=">u2")
            t = t[t != pad]
            ends = np.flatnonzero(t == end_id)
            if len(ends):
                size = np.diff(ends, prepend=-1) - 1
                size[0] += open_
                if seen == 0:
                    head, size = int(size[0]), size[1:]
                seen += len(ends)
                open_ = len(t) - int(ends[-1]) - 1
                lengths.append(size)
                if sum(map(len, lengths)) >= 100_000:
                    rows.append(np.concatenate(lengths))
                    lengths = []
            else:
                open_ += len(t)
        if first is None:
            return
        rows.append(np.concatenate(lengths) if lengths else np.zeros(0, dtype=np.int64))
        total = sum(int(r.sum()) for r in rows)
        yield (part, int(first), seen, head, open_, total, 0, None)
        at = 1
        for r in rows:
            if len(r):
                yield (part, int(first), None, None, None, None, at, r.tolist())
            at += len(r)

    return run


_SPLIT = "part long, first long, ends long, head long, tail long, inner long, at long, lengths array<long>"


def scan_token_files(spark: SparkSession, path: str, record_tokens: int = RECORD_TOKENS, end_id: int = END_OF_DOCUMENT, pad: int = PAD) -> DataFrame:
    """file_no, doc_no, n_tokens for every document below ``path``; files are numbered in the order of their names."""
    records = spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable",
        conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(2 * record_tokens)},
    )
    scanned = materialize(spark.createDataFrame(records.mapPartitionsWithIndex(_scan_split(end_id, pad)), _SPLIT), "flat-scan")
    splits = scanned.where(F.col("ends").isNotNull())
    n_splits = splits.count()
    # the windows below run over one row per split
    splits = splits.withColumn("file_no", F.sum((F.col("first") == 0).cast("long")).over(Window.orderBy("part")) - 1)
    w = Window.partitionBy("file_no").orderBy("first")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = splits.withColumn("sum", F.sum("tail").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.last(F.when(F.col("ends") > 0, F.col("sum") - F.col("tail")), ignorenulls=True).over(before)
    carry = F.coalesce(F.lag("sum").over(w), F.lit(0)) - F.coalesce(since, F.lit(0))
    stitched = upto.withColumn("carry", carry).withColumn("doc_base", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    last = F.col("first") == F.max("first").over(Window.partitionBy("file_no"))
    stitched = stitched.withColumn("rest", F.when(last & ((F.col("tail") + F.when(F.col("ends") == 0, F.col("carry")).otherwise(0)) > 0), F.col("tail") + F.when(F.col("ends") == 0, F.col("carry")).otherwise(0)))
    edges = F.filter(
        F.array(
            F.struct(F.col("doc_base").alias("doc_no"), F.when(F.col("ends") > 0, F.col("carry") + F.col("head")).alias("n_tokens")),
            F.struct((F.col("doc_base") + F.col("ends")).alias("doc_no"), F.col("rest").alias("n_tokens")),
        ),
        lambda x: x["n_tokens"].isNotNull(),
    )
    edge_docs = stitched.select("file_no", F.explode(edges).alias("d")).select("file_no", "d.doc_no", "d.n_tokens")
    bases = checked_broadcast(stitched.select("part", "file_no", "doc_base"), n_splits)
    inner = scanned.where(F.col("lengths").isNotNull()).join(bases, "part").select("file_no", (F.col("doc_base") + F.col("at")).alias("base"), F.posexplode("lengths").alias("i", "n_tokens"))
    return edge_docs.unionByName(inner.select("file_no", (F.col("base") + F.col("i")).alias("doc_no"), "n_tokens"))


@register("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as flat token files and count every document's tokens from the files alone."""
    path = scratch_path(spark, "flat-tokens")
    write_token_files(read(spark, sf_dir, "documents"), path)
    return scan_token_files(spark, path)
