"""Feature-store queries: embeddings written as chunked features, read back by id."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import catalog, crowd
from ..schemas import TRACKS
from ..session import materialize, scratch_path
from ..sources import handles, keyed, shards
from ..sources.costore import create_store
from ..sources.tables import empty_frame, read_table, tracks_to_csv_frame
from .q_catalog import SPLIT_TS, valid_playlist_rows
from .q_crowd import CUTOFF, vote
from .q_features import EMB_SQL, embedding_rows
from .registry import ORACLES, register


def chunk_features(emb):
    """Extractor: an embedding cut into 8 chunks of 8 values (the store's feature rows)."""
    return emb.select("track_id", F.posexplode(arrays.equal_chunks("v", 8)).alias("chunk", "mel"))


def build_store(spark, sf_dir, where=None):
    path = scratch_path(spark, "features")
    emb = embedding_rows(spark, sf_dir)
    if where is not None:
        emb = emb.where(where)
    shards.write_store(chunk_features(emb), path, mode="overwrite")
    return path


def build_costore(spark, sf_dir, where=None):
    """The same features in files that are partitioned for joins by track."""
    emb = embedding_rows(spark, sf_dir)
    path = scratch_path(spark, "costore")
    return create_store(spark, "features_" + path.rsplit("-", 1)[1], path, chunk_features(emb if where is None else emb.where(where)))


def requested_ids(spark, sf_dir):
    return read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("track_id"))


@register(
    "store_shard_report",
    ("S-6", "S-8", "F-11", "A-5", "J-3"),
    f"""
WITH r AS (SELECT DISTINCT doc_id AS track_id FROM labels),
     e AS ({EMB_SQL})
SELECT CAST(r.track_id % 20 AS INTEGER) AS bucket, count(*) AS requested, count(e.track_id) AS found
FROM r LEFT JOIN e USING (track_id) GROUP BY 1
""",
)
def q_report(spark, sf_dir):
    from ..operators.catalog import with_features

    store = shards.read_store(spark, build_store(spark, sf_dir))
    req = requested_ids(spark, sf_dir)
    found = with_features(req.withColumnRenamed("track_id", "ym_track_id"), shards.lookup_table(store, req))
    return shards.shard_report(req, found.withColumnRenamed("ym_track_id", "track_id"))


@register(
    "store_lookup_labels",
    ("S-8", "J-8", "X-8"),
    f"""
WITH e AS ({EMB_SQL}), c AS (SELECT track_id, unnest(range(8)) AS chunk, v FROM e)
SELECT l.doc_id AS track_id, CAST(c.chunk AS INTEGER) AS chunk, l.quality, l.toxic,
       round(list_sum(list_slice(c.v, c.chunk * 8 + 1, c.chunk * 8 + 8)), 4) AS total
FROM labels l JOIN c ON l.doc_id = c.track_id
""",
)
def q_lookup(spark, sf_dir):
    store = build_costore(spark, sf_dir)
    lab = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("track_id"), "quality", "toxic")
    j, _missing = store.attach(lab)
    return j.select("track_id", "chunk", "quality", "toxic", F.round(arrays.array_sum("mel"), 4).alias("total"))


@register(
    "store_fill_misses",
    ("J-9", "X-9", "X-11", "U-4"),
    f"""
WITH r AS (SELECT DISTINCT doc_id AS track_id FROM labels), e AS ({EMB_SQL})
SELECT r.track_id,
       CASE WHEN e.track_id IS NULL THEN 'missing' WHEN e.label < 5 THEN 'hit' ELSE 'extracted' END AS status,
       CAST(CASE WHEN e.track_id IS NULL THEN 0 ELSE 8 END AS BIGINT) AS n_chunks
FROM r LEFT JOIN e USING (track_id)
""",
)
def q_fill(spark, sf_dir):
    seeded = F.col("label") < 5  # the store starts with the features of classes 0-4
    store = build_costore(spark, sf_dir, where=seeded)
    emb = embedding_rows(spark, sf_dir)
    # ids the store held before the fill (the rows it was built from)
    before = emb.where(seeded).select("track_id").withColumn("_was", F.lit(True))

    def extract(ids):
        return chunk_features(emb.join(ids, "track_id", "left_semi"))

    req = requested_ids(spark, sf_dir)
    found, left = store.fill(req, extract)
    counts = found.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    got = counts.join(before, "track_id", "left").select(
        "track_id", F.when(F.col("_was"), F.lit("hit")).otherwise(F.lit("extracted")).alias("status"), "n_chunks"
    )
    miss = left.select("track_id", F.lit("missing").alias("status"), F.lit(0).cast("long").alias("n_chunks"))
    return got.unionByName(miss)


@register(
    "store_feature_handles",
    ("S-7",),
    f"""
WITH e AS ({EMB_SQL})
SELECT track_id, CASE WHEN label % 5 = 4 THEN 'empty' ELSE 'found' END AS state, CASE WHEN label % 5 <> 4 THEN 8 END::BIGINT AS n_vectors,
       CASE WHEN label % 5 <> 4 THEN round(list_sum(v), 4) END AS total, true AS well_formed FROM e
UNION ALL
SELECT DISTINCT doc_id, 'unknown', NULL::BIGINT, NULL::DOUBLE, true FROM labels WHERE doc_id NOT IN (SELECT track_id FROM e)
""",
)
def q_handles(spark, sf_dir):
    """Features saved under handles (some sets are empty) and read back by handle; other tracks' handles were never given out."""
    path = scratch_path(spark, "handles")
    emb = embedding_rows(spark, sf_dir)
    listed = F.when(F.col("label") % 5 != 4, arrays.equal_chunks("v", 8)).otherwise(F.array().cast("array<array<double>>"))
    saved = handles.save_sets(emb.select("track_id", listed.alias("features")), path).select("track_id", "handle")
    others = requested_ids(spark, sf_dir).distinct().join(emb.select("track_id"), "track_id", "left_anti")
    asked = saved.unionByName(others.withColumn("handle", handles.handle_of(F.lit(""), F.col("track_id").cast("string"))))
    got = asked.join(handles.read_sets(spark, path, asked), "handle")
    total = F.aggregate(F.flatten("features"), F.lit(0.0), lambda a, x: a + x)
    return got.select("track_id", "state", F.when(F.col("state") == handles.FOUND, F.size("features")).cast("long").alias("n_vectors"), F.round(total, 4).alias("total"), F.col("handle").rlike("^[A-Za-z]{16}$").alias("well_formed"))


@register("store_assignments_upsert", ("U-2", "W-2"), ORACLES["crowd_assignments_upsert"])
def q_assignments_in_place(spark, sf_dir):
    """The votes before the cutoff are stored, those after it upserted in place."""
    ts, cut = F.col("submitted_at"), F.lit(CUTOFF).cast("timestamp_ntz")
    old, new = vote(spark, sf_dir, ts < cut), vote(spark, sf_dir, ts >= cut)
    keys, path = ["ym_track_id", "emotion"], scratch_path(spark, "assignments")
    keyed.create_keyed(old, path, keys)
    keyed.upsert_keyed(spark, path, new, keys, crowd.upsert_assignments, old.schema)
    return keyed.read_keyed(spark, path, old.schema).select("ym_track_id", "emotion", "NO", "YES", "rate")


@register("store_playlist_merge", ("U-3", "A-8", "F-2"), ORACLES["catalog_playlist_merge"])
def q_playlist_in_place(spark, sf_dir):
    """The tracks table stored by track; the newer playlists are merged into the buckets of the tracks they name."""
    entries = materialize(valid_playlist_rows(spark, sf_dir).drop("playlist", "reject_reason"), "playlist-entries")
    ts = F.lit(SPLIT_TS).cast("timestamp_ntz")
    old, new = entries.where(F.col("ts") < ts).drop("ts"), entries.where(F.col("ts") >= ts).drop("ts")
    keys, path = ["ym_track_id"], scratch_path(spark, "tracks")
    keyed.create_keyed(catalog.merge_playlist(empty_frame(spark, TRACKS), old), path, keys)
    keyed.upsert_keyed(spark, path, new, keys, catalog.merge_playlist, TRACKS)
    return tracks_to_csv_frame(keyed.read_keyed(spark, path, TRACKS))
