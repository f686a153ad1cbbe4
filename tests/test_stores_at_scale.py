"""Co-partitioned store, handles, keyed upserts in place."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tessitura.operators import crowd
from tessitura.session import scratch_path
from tessitura.sources import costore, handles, keyed


def _features(spark, ids, chunks=2):
    return spark.range(1).select(F.explode(F.array(*[F.lit(i).cast("long") for i in ids])).alias("track_id")).select("track_id", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")).withColumn("mel", F.array(F.col("track_id").cast("double")))


def _store(spark, ids, n=4):
    path = scratch_path(spark, "co")
    return costore.create_store(spark, "co_" + path.rsplit("-", 1)[1], path, _features(spark, ids), n)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _exchanges_above_scan(plan, table_path):
    """Exchanges on the way from the store's scan to the root, by indentation of the plan tree."""
    lines = plan.splitlines()
    at = next(i for i, l in enumerate(lines) if "FileScan" in l and table_path.split("/")[-1][:12] in l or "Bucketed: true" in l)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    found = []
    for l in reversed(lines[:at]):
        d = len(l) - len(l.lstrip(" :+-"))
        if d < depth:
            depth = d
            if "Exchange" in l:
                found.append(l)
    return found


def test_store_side_is_not_shuffled(spark):
    store = _store(spark, range(1, 60))
    ids = spark.range(10, 30).withColumnRenamed("id", "track_id")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        again = spark.createDataFrame([(2,), (2,)], "track_id long")
        for df in (store.lookup(again), store.lookup(ids), store.attach(ids.withColumn("l", F.lit(1)))[0], store.misses(ids)):
            plan = _plan(df)
            assert "Bucketed: true" in plan, plan
            assert not _exchanges_above_scan(plan, store.path), plan
        assert sorted(r.track_id for r in store.lookup(ids).collect()) == sorted(list(range(10, 30)) * 2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_fill_appends_only_misses(spark):
    store = _store(spark, [1, 2, 3])
    asked = spark.createDataFrame([(2,), (5,), (7,), (5,)], "track_id long")
    extract = lambda ids: _features(spark, [5]).join(ids, "track_id", "left_semi")
    for _ in range(2):
        found, left = store.fill(asked, extract)
        assert sorted(r.track_id for r in found.collect()) == [2, 2, 5, 5]
        assert [r.track_id for r in left.collect()] == [7]
    assert store.read().count() == 8
    again = costore.open_store(spark, store.table + "_again", store.path, store.n_buckets)
    assert sorted(r.track_id for r in again.rows_of([5, 7, 1]).collect()) == [1, 1, 5, 5]
    assert "Bucketed: true" in _plan(again.lookup(asked))


def test_id_column_has_a_bloom_filter(spark):
    far = 1 << 40  # a number that Python hands to the JVM as a long
    store = _store(spark, range(far + 1, far + 2000, 2), n=1)
    local = store.path[len("file:"):] if store.path.startswith("file:") else store.path
    files = [os.path.join(local, f) for f in os.listdir(local) if f.endswith(".parquet")]
    jvm = spark.sparkContext._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    seen = 0
    for f in files:
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f), hadoop)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        for block in reader.getFooter().getBlocks():
            column = next(c for c in block.getColumns() if c.getPath().toDotString() == "track_id")
            bloom = reader.readBloomFilter(column)
            assert bloom is not None
            value = lambda i: bloom.findHash(bloom.hash(i))
            assert value(far + 1) and value(far + 999) and not all(value(far + i) for i in range(2, 2000, 2))
            seen += 1
        reader.close()
    assert seen


def test_handles(spark):
    path = scratch_path(spark, "handles")
    sets = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]]), (2, []), (3, None), (None, [[9.0]])], "track_id long, features array<array<double>>")
    named = {r.track_id: r.handle for r in handles.save_sets(sets, path).collect()}
    assert all(len(h) == 16 and h.isalpha() for h in named.values()) and len(set(named.values())) == 4
    asked = spark.createDataFrame([(h,) for h in named.values()] + [("A" * 16,), ("",), ("no such",)], "handle string")
    got = {r.handle: (r.state, r.features) for r in handles.read_sets(spark, path, asked).collect()}
    assert got[named[1]] == ("found", [[1.0, 2.0], [3.0, 4.0]]) and got[named[None]] == ("found", [[9.0]])
    assert got[named[2]] == got[named[3]] == ("empty", None)
    assert got["A" * 16] == got[""] == got["no such"] == ("unknown", None)
    assert [list(r["values"]) for r in handles.read_set(spark, path, named[1]).collect()] == [[1.0, 2.0], [3.0, 4.0]]
    assert handles.read_set(spark, path, named[2]).count() == 0
    many = spark.range(20_000).select(F.countDistinct(handles.handle_of(F.lit("s"), F.col("id").cast("string"))))
    assert many.first()[0] == 20_000


def _files(path):
    local = path[len("file:"):] if path.startswith("file:") else path
    return {d: sorted(f for f in os.listdir(os.path.join(local, d)) if f.endswith(".parquet")) for d in os.listdir(local) if d.startswith("bucket=")}


def test_upsert_rewrites_only_touched_buckets(spark):
    schema = "ym_track_id long, emotion string, YES long, NO long, rate double"
    old = spark.createDataFrame([(i, "happy", 1, 1, 0.5) for i in range(200)] + [(None, "happy", 0, 0, None)], schema)
    new = spark.createDataFrame([(3, "happy", 3, 0, 1.0), (3, "sad", 2, 0, 1.0), (None, "happy", 5, 0, 1.0)], schema)
    keys, path = ["ym_track_id", "emotion"], scratch_path(spark, "keyed")
    keyed.create_keyed(old, path, keys)
    before = _files(path)
    touched = keyed.upsert_keyed(spark, path, new, keys, crowd.upsert_assignments, old.schema)
    after = _files(path)
    assert 1 <= len(touched) <= 3
    for folder in set(before) | set(after):
        same = before.get(folder) == after.get(folder)
        assert same == (int(folder.split("=")[1]) not in touched)
    want = {(r.ym_track_id, r.emotion): r.rate for r in crowd.upsert_assignments(old, new).collect()}
    got = {(r.ym_track_id, r.emotion): r.rate for r in keyed.read_keyed(spark, path, old.schema).collect()}
    assert got == want and len(got) == 202
    assert keyed.upsert_keyed(spark, path, new.limit(0), keys, crowd.upsert_assignments, old.schema) == []
    assert _files(path) == after
    assert keyed.read_keyed(spark, path + "-none", old.schema).count() == 0
