"""Feature store round trip, pruning, fill-misses; the streaming vote equals the batch vote."""

from __future__ import annotations

import pytest

from tessitura.operators import crowd
from tessitura.session import scratch_path
from tessitura.sources import shards
from tessitura.streaming.votes import final_votes, run_votes, vote_stream

from .conftest import rows


def feats(spark, ids):
    return spark.createDataFrame([(i, c, [float(i), float(c)]) for i in ids for c in range(2)], "track_id long, chunk int, mel array<float>")


def test_store_roundtrip_and_lookup(spark):
    path = scratch_path(spark, "t-store")
    shards.write_store(feats(spark, range(50)), path, mode="overwrite")
    store = shards.read_store(spark, path)
    got = shards.lookup_ids(store, [3, 23, 44])
    assert rows(got, "track_id", "chunk") == [(3, 0), (3, 1), (23, 0), (23, 1), (44, 0), (44, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or "bucket" in plan
    ids = spark.createDataFrame([(7,), (99,)], "track_id long")
    assert rows(shards.lookup_table(store, ids), "track_id") == [(7,), (7,)]
    ex = {r.track_id: r.exists for r in shards.exists(store, ids).collect()}
    assert ex == {7: True, 99: False}


def test_store_missing_column(spark):
    path = scratch_path(spark, "t-bad")
    spark.createDataFrame([(1,)], "track_id long").write.parquet(path)
    with pytest.raises(shards.MissingColumnError):
        shards.read_store(spark, path)


def test_load_or_extract(spark):
    path = scratch_path(spark, "t-fill")
    shards.write_store(feats(spark, [0, 2, 4]), path, mode="overwrite")
    req = spark.createDataFrame([(i,) for i in range(6)], "track_id long")

    def extract(ids):  # only odd ids below 5 can be extracted
        return feats(spark, [1, 3]).join(ids, "track_id", "left_semi")

    found, left = shards.load_or_extract(spark, path, req, extract)
    assert sorted({r.track_id for r in found.collect()}) == [0, 1, 2, 3, 4]
    assert rows(left) == [(5,)]
    report = {r.bucket: (r.requested, r.found) for r in shards.shard_report(req, found).collect()}
    assert report[5] == (1, 0) and report[1] == (1, 1)


def test_stream_vote_equals_batch(spark):
    data = [("happy", f"https://b.example/a/{i % 7}.mp3", "YES" if i % 3 else "NO") for i in range(200)]
    df = spark.createDataFrame(data, "emotion string, audio_path string, result string")
    folder = scratch_path(spark, "t-answers")
    df.repartition(3).write.parquet(folder)
    streamed = final_votes(spark, folder, df.schema, base_url="https://b.example/", max_files=1)
    batch = crowd.majority_vote(df, base_url="https://b.example/")
    assert rows(streamed, "ym_track_id", "emotion", "NO", "YES") == rows(batch, "ym_track_id", "emotion", "NO", "YES")



def test_stream_goes_on_from_its_checkpoint(spark):
    df = spark.createDataFrame([("happy", f"https://b.example/a/{i % 5}.mp3", "YES" if i % 3 else "NO") for i in range(90)], "emotion string, audio_path string, result string")
    folder, ckpt = scratch_path(spark, "t-more"), scratch_path(spark, "t-ckpt")
    seen = {}

    def keep(batch, _):
        seen.update({(r.ym_track_id, r.emotion): (r.NO, r.YES) for r in batch.collect()})

    for part in df.randomSplit([0.4, 0.6], seed=1):
        part.write.mode("append").parquet(folder)
        run_votes(vote_stream(spark, folder, df.schema, "https://b.example/"), keep, ckpt)
    batch = {(r.ym_track_id, r.emotion): (r.NO, r.YES) for r in crowd.majority_vote(df, base_url="https://b.example/").collect()}
    assert seen == batch


def test_lookup_prunes_partitions(spark):
    path = scratch_path(spark, "t-prune")
    shards.write_store(feats(spark, range(100)), path, mode="overwrite")
    store = shards.read_store(spark, path)
    static = shards.lookup_ids(store, [3, 23])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in static and "(bucket#" in static
    ids = spark.createDataFrame([(7,), (27,)], "track_id long")
    q = shards.lookup_table(store, ids)
    assert rows(q, "track_id") == [(7,), (7,), (27,), (27,)]
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "(bucket#" in plan
