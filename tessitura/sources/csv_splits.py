"""Quoted CSV read by byte splits (S-1 at scale).

Spark reads a CSV whose fields may hold line breaks one file to a task, because a
line break alone does not end a record.  Here the file is read as plain lines,
which Spark splits by bytes, and the record borders are found by the parity of
quotes: a line ends a record when the number of quotes from the start of the
file to its end is even.

1. Quotes are counted per split: one row each.
2. A prefix sum over the splits of a file tells every split whether it starts
   inside a quoted field.
3. Every split puts its lines together to records, from a running sum of
   quotes.  A record that crosses splits leaves one fragment in each of them;
   fragments are few (at most two a split) and are stitched by the split in
   which the record starts.

The records are parsed by Spark's own CSV parser.  Quotes must be those of
quoted fields (a quote inside one is doubled), as CSV writers leave them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE = '"'
_RECORDS = "file string, start long, kind string, record string"
# a record; the first lines of one; the first lines of a header; lines that belong to a record begun in an earlier split
WHOLE, OPEN, HEAD, REST = "whole", "open", "head", "rest"


def lines_by_split(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the text files below ``path`` with the file and the byte at which their split starts; lines of a split keep their order."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def split_parities(lines: DataFrame) -> DataFrame:
    """(file, start, inside, odd): whether a split starts inside a quoted field, and whether it has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    per_split = lines.groupBy("file", "start").agg((F.sum(quotes.cast("long")) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return per_split.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"), (F.col("odd") == 1).alias("odd"))


class _Split:
    """Puts the lines of one split together."""

    def __init__(self, file: str, start: int, inside: bool, header: bool):
        self.file, self.start, self.parity = file, start, int(inside)
        self.begun = not inside  # whether the open lines began in this split
        self.skip = header and start == 0
        self.open: list[str] = []

    def add(self, lines: pa.Array) -> Iterator[tuple[str, pa.Array]]:
        """Records (and the fragment that closes an earlier split's record) that end in these lines."""
        quotes = pc.count_substring(lines, QUOTE).to_numpy(zero_copy_only=False).astype(np.int64)
        total = self.parity + np.cumsum(quotes)
        ends = np.flatnonzero(total % 2 == 0)
        self.parity = int(total[-1] % 2)
        if len(ends) == 0:
            self.open += lines.to_pylist()
            return
        done = int(ends[-1]) + 1
        offsets = pa.array(np.concatenate([[0], ends + 1]).astype(np.int32))
        records = pc.binary_join(pa.ListArray.from_arrays(offsets, lines.slice(0, done)), "\n")
        if self.open or not self.begun:
            first = pa.array(["\n".join([*self.open, records[0].as_py()])], records.type)
            kind = WHOLE if self.begun else REST
            yield from self._emit(kind, first)
            records = records.slice(1)
        self.open, self.begun = lines.slice(done).to_pylist(), True
        if len(records):
            yield from self._emit(WHOLE, records)

    def _emit(self, kind: str, records: pa.Array) -> Iterator[tuple[str, pa.Array]]:
        if self.skip and kind == WHOLE:
            self.skip, records = False, records.slice(1)
        if len(records):
            yield kind, records

    def close(self) -> Iterator[tuple[str, pa.Array]]:
        if self.open:
            yield (REST if not self.begun else HEAD if self.skip else OPEN), pa.array(["\n".join(self.open)], pa.string())


def _records(inside: set[tuple[str, int]], header: bool, kinds: tuple[str, ...]):
    """Partition function over (value, file, start), in file order."""

    def out(split: _Split, found) -> Iterator[pa.RecordBatch]:
        for kind, records in found:
            if kind in kinds:
                n = len(records)
                yield pa.RecordBatch.from_arrays([pa.array([split.file] * n, pa.string()), pa.array([split.start] * n, pa.int64()), pa.array([kind] * n, pa.string()), records.cast(pa.string())], names=["file", "start", "kind", "record"])

    def run(batches):
        now: _Split | None = None
        for b in batches:
            start = b.column(2).to_numpy(zero_copy_only=False)
            coded = b.column(1).dictionary_encode()
            file = coded.indices.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((start[1:] != start[:-1]) | (file[1:] != file[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if hi == lo:
                    continue
                key = (coded.dictionary[int(file[lo])].as_py(), int(start[lo]))
                if now is None or (now.file, now.start) != key:
                    if now is not None:
                        yield from out(now, now.close())
                    now = _Split(*key, key in inside, header)
                yield from out(now, now.add(b.column(0).slice(lo, hi - lo)))
        if now is not None:
            yield from out(now, now.close())

    return run


def csv_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(record): the text of every record of the CSV files below ``path``, headers left out.

    The driver gets one row per split whose border lies inside a quoted field:
    no more than the splits it plans itself.
    """
    lines = lines_by_split(spark, path)
    odd = split_parities(lines).where("inside OR odd").collect()
    inside = {(r["file"], r["start"]) for r in odd if r["inside"]}
    whole = lines.mapInArrow(_records(inside, header, (WHOLE,)), _RECORDS).select("record")
    if not odd:
        return whole
    # only splits with an odd border leave fragments; they are known, so the others' lines do not reach Python
    files = sorted({(r["file"], r["start"]) for r in odd})
    touched = spark.createDataFrame(files, "file string, start long")
    fragments = lines.join(F.broadcast(touched), ["file", "start"], "left_semi").select("value", "file", "start").mapInArrow(_records(inside, header, (OPEN, HEAD, REST)), _RECORDS)
    # in a split the rest of an earlier record comes before the start of the next
    order = Window.partitionBy("file").orderBy("start", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    owned = fragments.withColumn("owner", F.sum((F.col("kind") != REST).cast("long")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", F.col("kind") != REST, "record")))
    stitched = owned.groupBy("file", "owner").agg(F.array_join(F.transform(parts, lambda x: x["record"]), "\n").alias("record"), F.bool_or(F.col("kind") == HEAD).alias("head"))
    return whole.unionByName(stitched.where(~F.col("head")).select("record"))


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, **options) -> DataFrame:
    """Typed rows of the CSV files below ``path``; ``options`` are those of Spark's CSV parser.

    Empty lines between records are skipped, a line end may be ``\\n`` or ``\\r\\n``.
    """
    records = csv_records(spark, path, header).select(F.regexp_replace("record", r"\r\z", "").alias("record")).where("record != ''")
    parsed = records.select(F.from_csv("record", schema.simpleString(), {"escape": QUOTE, "multiLine": "true", **{k: str(v) for k, v in options.items()}}).alias("r"))
    return parsed.select("r.*")
