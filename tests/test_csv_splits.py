"""Quoted CSV read by byte splits against Spark's whole-file reader."""

from __future__ import annotations

import os
import random

import pytest

from tessitura.schemas import TRACKS
from tessitura.session import scratch_path
from tessitura.sources import csv_splits, tables

SCHEMA = "id long, a string, b string"


def _folder(spark, name):
    path = scratch_path(spark, name)
    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local, exist_ok=True)
    return path, local


def _write(local, name, text):
    with open(os.path.join(local, name), "w", encoding="utf-8", newline="") as fh:
        fh.write(text)


def _whole(spark, path, header=True):
    from pyspark.sql.types import _parse_datatype_string

    return spark.read.schema(_parse_datatype_string(SCHEMA)).options(header=header, multiLine=True, escape='"').csv(path)


def _split(spark, path, header=True):
    from pyspark.sql.types import _parse_datatype_string

    return csv_splits.read_quoted_csv(spark, path, _parse_datatype_string(SCHEMA), header)


def _rows(df):
    return sorted(((r.id, r.a, r.b) for r in df.collect()), key=repr)


def _random_csv(rng, n):
    def cell():
        kind = rng.randrange(6)
        if kind == 0:
            return ""
        if kind == 1:
            return "plain é 中"
        body = "".join(rng.choice(['""', "\n", ",", "x", "é", " ", "\n\n", "line"]) for _ in range(rng.randrange(1, 40)))
        return f'"{body}"'

    return "id,a,b\n" + "".join(f"{i},{cell()},{cell()}\n" for i in range(n))


@pytest.mark.parametrize("size", [64, 333, 4096, 1 << 20])
def test_any_split_size_gives_the_same_rows(spark, size):
    rng = random.Random(size)
    path, local = _folder(spark, "csv")
    _write(local, "one.csv", _random_csv(rng, 300))
    _write(local, "two.csv", _random_csv(rng, 7))
    want = _rows(_whole(spark, path))
    assert len(want) == 307
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = csv_splits.lines_by_split(spark, path)
        if size <= 333:
            assert lines.rdd.getNumPartitions() > 20
            assert csv_splits.split_parities(lines).where("inside").count() > 5  # borders inside quoted fields
        assert _rows(_split(spark, path)) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_record_and_a_header_over_many_splits(spark):
    path, local = _folder(spark, "csv-long")
    long = "\n".join(f"line {i}" for i in range(400))
    _write(local, "a.csv", f'"id\n{long}",a,b\n1,"{long}",x\n2,y,"{long}"\n')
    _write(local, "b.csv", "id,a,b\n3,z,\n")
    _write(local, "c.csv", "")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        assert _rows(_split(spark, path)) == sorted([(1, long, "x"), (2, "y", long), (3, "z", None)], key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_line_ends_empty_lines_and_no_header(spark):
    path, local = _folder(spark, "csv-ends")
    _write(local, "a.csv", '1,"a\r\nb",c\r\n\r\n2,,"x"\n\n3,"say ""hi""",\n4,last,line')
    assert _rows(_split(spark, path, header=False)) == [(1, "a\r\nb", "c"), (2, None, "x"), (3, 'say "hi"', None), (4, "last", "line")]


def test_tracks_reader_equals_whole_file_reader(spark):
    rows = []
    for i in range(200):
        row = {f.name: None for f in TRACKS.fields}
        row.update(ym_track_id=i, track_title=[None, "", 'q"\n"', "plain", "a,b\n\n"][i % 5], emotions_maybe=[None, [], ["happy", "sad"]][i % 3])
        rows.append(tuple(row[f.name] for f in TRACKS.fields))
    path = scratch_path(spark, "t-csv-split")
    tables.write_csv(spark.createDataFrame(rows, TRACKS).coalesce(1), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        split = sorted(map(tuple, tables.read_tracks_csv(spark, path).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert split == sorted(map(tuple, tables.read_tracks_csv(spark, path, whole_files=True).collect()), key=repr)
    assert len(split) == 200
