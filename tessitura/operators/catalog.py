"""Catalogue operators: filters, playlist ingest and merge, enrichment joins, dedup, paging.

Fixed-rule steps (genre maps, keep rates) are literal expressions (CASE /
map literals), so they run inside whole-stage codegen with no join at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._compat import col_of
from ..functions.lists import append_distinct, non_empty
from ..functions.paths import cover_template, lower_key
from ..schemas import (
    GENRE_MAP,
    GENRE_MAP_DEFAULT,
    GENRE_MAP_STRICT,
    NARROW_GENRES,
    POPULAR_EMOTION_KEEP,
    POPULAR_GENRE_KEEP,
    UNPOPULAR_GENRES,
)
from ..session import bounded_broadcast
from .ordering import dense_index, quantile_block


# ------------------------------------------------------------------ P-1 .. P-4
def filter_equals(df: DataFrame, column: str, value) -> DataFrame:
    """P-1: ``filter_has_emotion`` / ``filter_has_genre``."""
    return df.where(F.col(column) == F.lit(value))


def filter_member(df: DataFrame, list_col: str, value) -> DataFrame:
    """P-2: the value is a member of the list (exact token, not substring)."""
    return df.where(F.array_contains(F.col(list_col), F.lit(value)))


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P-3: drop rows with a null in ``columns``; array columns must also be non-empty."""
    types = dict(df.dtypes)
    cond = F.lit(True)
    for c in columns:
        cond = cond & (non_empty(c) if types[c].startswith("array") else F.col(c).isNotNull())
    return df.where(cond)


ONE_LABEL, MANY_LABELS, ALL_TRACKS = 1, 2, 3


def select_by_label_count(df: DataFrame, kind: int = MANY_LABELS, list_col: str = "emotions") -> DataFrame:
    """P-4: 1 = exactly one label, 2 = more than one, anything else = all rows with labels."""
    n = F.size(F.col(list_col))
    base = drop_missing(df, [list_col])
    if kind == ONE_LABEL:
        return base.where(n == 1)
    if kind == MANY_LABELS:
        return base.where(n > 1)
    return base


# ------------------------------------------------------------------ P-5 .. P-8, J-7
def filter_genres(df: DataFrame, genres: Sequence[str] = UNPOPULAR_GENRES, keep: bool = True, column: str = "genre") -> DataFrame:
    """P-5: keep (``keep=True``, what the reference does) or drop the listed genres.

    Dropping keeps nulls, like pandas ``~isin``.
    """
    hit = F.col(column).isin(list(genres))
    return df.where(hit) if keep else df.where(~F.coalesce(hit, F.lit(False)))


def genre_map_expr(src, strict: bool = False) -> Column:
    """J-7 as an expression: raw genre -> genre class via a map literal.

    Default mode maps unknown (and null) to ``other``; strict mode raises on a
    non-null unknown key.
    """
    src = col_of(src)
    mapping = GENRE_MAP_STRICT if strict else GENRE_MAP
    lit_map = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    mapped = F.try_element_at(lit_map, src)
    if strict:
        return F.when(src.isNotNull() & mapped.isNull(), F.raise_error(F.concat(F.lit("unknown genre: "), src))).otherwise(mapped)
    return F.coalesce(mapped, F.lit(GENRE_MAP_DEFAULT))


def map_genre(df: DataFrame, src_col: str = "genre", out_col: str = "genre", strict: bool = False) -> DataFrame:
    """J-7 over a table."""
    return df.withColumn(out_col, genre_map_expr(F.col(src_col), strict))


def unknown_genres(df: DataFrame, src_col: str = "genre", strict: bool = True) -> DataFrame:
    """J-7 report: distinct raw genres the map does not know (anti join against the map)."""
    mapping = GENRE_MAP_STRICT if strict else GENRE_MAP
    known = df.sparkSession.createDataFrame([(k,) for k in mapping], "raw string")
    vals = df.select(F.col(src_col).alias("raw")).where(F.col("raw").isNotNull()).distinct()
    return vals.join(bounded_broadcast(known, len(mapping)), "raw", "left_anti")


def drop_narrow_genres(df: DataFrame, source_col: str = "genre", genre_col: str = "genre", narrow: Sequence[str] = NARROW_GENRES) -> DataFrame:
    """P-6: drop null and narrow genres, then map the raw genre (J-7).

    The reference maps a different column (``nation``); which column is mapped
    is the ``source_col`` argument.
    """
    g = F.col(genre_col)
    kept = df.where(g.isNotNull() & ~g.isin(list(narrow)))
    return kept.withColumn(genre_col, genre_map_expr(F.col(source_col)))


def keep_rate_expr(class_col, id_col, rules: Mapping[str, int]) -> Column:
    """R-5 keep-rule predicate: class ``c`` with threshold ``t`` keeps ``pmod(id, 10) <= t``; others all kept.

    A null class is kept (pandas ``!=`` is True for null).
    """
    t = None
    for name, thr in rules.items():
        t = (F.when(col_of(class_col) == F.lit(name), F.lit(thr)) if t is None else t.when(col_of(class_col) == F.lit(name), F.lit(thr)))
    return t.isNull() | (F.pmod(col_of(id_col), F.lit(10)) <= t)


def reduce_popular_genres(df: DataFrame, genre_col: str = "genre", id_col: str = "ym_track_id", rules=POPULAR_GENRE_KEEP) -> DataFrame:
    """P-7."""
    return df.where(keep_rate_expr(genre_col, id_col, rules))


def reduce_popular_emotions(df: DataFrame, emotion_col: str = "emotion", id_col: str = "ym_track_id", rules=POPULAR_EMOTION_KEEP) -> DataFrame:
    """P-8."""
    return df.where(keep_rate_expr(emotion_col, id_col, rules))


# ------------------------------------------------------------------ P-9 .. P-11 (playlist ingest)
MP3_CODEC, MP3_BITRATE = "mp3", 320


def track_reject_reason(track: Column) -> Column:
    """P-9: why a playlist track is not ingested (null = valid)."""
    albums, artists = track["albums"], track["artists"]
    has_mp3 = F.exists(F.coalesce(track["download_info"], F.array()), lambda d: (d["codec"] == MP3_CODEC) & (d["bitrate"] == MP3_BITRATE))
    return (
        F.when(track.isNull() | track["id"].isNull(), F.lit("no track"))
        .when(F.coalesce(F.size(albums), F.lit(-1)) < 1, F.lit("no album"))
        .when(F.coalesce(F.size(artists), F.lit(-1)) < 1, F.lit("no artist"))
        .when(F.try_element_at(albums, F.lit(1)).isNull() | F.try_element_at(artists, F.lit(1)).isNull(), F.lit("null album or artist"))
        .when(F.try_element_at(albums, F.lit(1))["cover_uri"].isNull(), F.lit("no cover"))
        .when(~F.coalesce(has_mp3, F.lit(False)), F.lit("no mp3 320"))
    )


def playlist_emotion(title: Column, prefix: str = "emotion-") -> Column:
    """P-11: class from a playlist title ``emotion-<name>``; genre/national playlists give null."""
    return F.when(title.startswith(prefix), F.substring(title, len(prefix) + 1, 1 << 20))


# Where downloaded files of a track lie.
AUDIO_DIR, LYRICS_DIR, COVER_DIR, COVER_SIZE = "data/audios/", "data/lyrics/", "data/covers/", "1000x1000"


def flatten_playlist_tracks(entries: DataFrame, track_col: str = "track", title_col: str = "title", pos_col: str = "pos", keep: Sequence[str] = ()) -> DataFrame:
    """S-13 / P-9 / P-10 / P-11: playlist entries ``(title, pos, track struct)`` -> flat track rows.

    Invalid tracks are kept with a ``reject_reason`` so the caller can report
    them.  ``keep`` names further columns of ``entries`` to pass through.
    """
    t = F.col(track_col)
    album = F.try_element_at(t["albums"], F.lit(1))
    year = album["year"].cast("string").try_cast("int")
    tid = t["id"].cast("string")
    return entries.select(
        F.col(title_col).alias("playlist"),
        F.col(pos_col).alias("pos"),
        track_reject_reason(t).alias("reject_reason"),
        t["id"].alias("ym_track_id"),
        album["id"].alias("ym_album_id"),
        t["title"].alias("track_title"),
        F.try_element_at(t["artists"], F.lit(1))["name"].alias("artist_name"),
        cover_template(album["cover_uri"], COVER_SIZE).alias("cover_url"),
        album["genre"].alias("ym_genre"),
        year.alias("year"),
        playlist_emotion(F.col(title_col)).alias("emotion"),
        F.concat(F.lit(AUDIO_DIR), tid, F.lit(".mp3")).alias("audio_path"),
        F.when(F.length(t["lyrics"]) > 0, F.concat(F.lit(LYRICS_DIR), tid, F.lit(".txt"))).alias("lyrics_path"),
        F.concat(F.lit(COVER_DIR), tid, F.lit(f":{COVER_SIZE}.jpg")).alias("cover_path"),
        *keep,
    )


def emotions_in_order(rows: DataFrame, key_col: str, label_col: str, order_cols: Sequence[str], out_col: str = "emotions") -> DataFrame:
    """A-8 across rows: per key, the distinct labels in order of first appearance.

    Pre-aggregates to one row per (key, label) before collecting, so a key's
    list is bounded by the vocabulary, not by how often it appears.
    """
    first = rows.where(F.col(label_col).isNotNull()).groupBy(key_col, label_col).agg(
        F.min(F.struct(*[F.col(c) for c in order_cols])).alias("_first")
    )
    grouped = first.groupBy(key_col).agg(F.array_sort(F.collect_list(F.struct("_first", label_col))).alias("_s"))
    return grouped.select(key_col, F.transform("_s", lambda s: s[label_col]).alias(out_col))


def tracks_from_entries(entries: DataFrame, key: str = "ym_track_id", label_col: str = "emotion", pos_col: str = "pos", list_col: str = "emotions_maybe") -> DataFrame:
    """One row per track of valid playlist entries: the fields of its first entry, and its distinct labels in order
    of first appearance (null when it is on no labelled playlist).

    Two aggregates: by (track, label), which collapses a hot track before the
    shuffle, then by track over at most one row per label.
    """
    fields = [c for c in entries.columns if c not in (key, label_col, pos_col)]
    by_label = entries.groupBy(key, label_col).agg(F.min(pos_col).alias("_p"), F.min_by(F.struct(*fields), pos_col).alias("_row"))
    labelled = F.when(F.col(label_col).isNotNull(), F.struct("_p", label_col))
    by_track = by_label.groupBy(key).agg(F.min("_p").alias(pos_col), F.min_by("_row", "_p").alias("_row"), F.array_sort(F.collect_list(labelled)).alias("_s"))
    labels = F.when(F.size("_s") > 0, F.transform("_s", lambda x: x[label_col]))
    return by_track.select(key, pos_col, *[F.col("_row")[c].alias(c) for c in fields], labels.alias(list_col))


def cut_position(entries: DataFrame, current: DataFrame, limit: int | Column, key: str = "ym_track_id", pos_col: str = "pos") -> DataFrame:
    """L-3: the entries that are read before the table holds ``limit`` tracks.

    Reading goes on until the track that fills the table has been inserted;
    later entries are not read at all, so they add no label to known tracks
    either.  The cut is the first position of the k-th new track, k = limit -
    tracks in ``current``; it is found with a dense index over stretches of
    near-equal numbers of tracks, in the query itself.
    """
    fresh = entries.groupBy(key).agg(F.min(pos_col).alias("_p")).join(current.select(key), key, "left_anti")
    k = (limit if isinstance(limit, Column) else F.lit(int(limit))) - current.select(F.count(F.lit(1))).scalar()
    indexed = dense_index(fresh, ["_p", key], quantile_block(fresh, "_p"), idx_col="_i")
    cut = indexed.where(F.col("_i") == k - 1).select(F.max("_p")).scalar()
    return entries.where((k > 0) & (cut.isNull() | (F.col(pos_col) <= cut)))


def merge_playlist(current: DataFrame, entries: DataFrame, key: str = "ym_track_id", label_col: str = "emotion", pos_col: str = "pos", list_col: str = "emotions_maybe", limit: int | Column | None = None) -> DataFrame:
    """U-3: merge valid playlist entries (one row per entry, in ``pos_col`` order) into the tracks table.

    Known tracks keep their fields and get the new labels appended (A-8); new
    tracks are inserted with the fields of their first entry, also from
    playlists without a label (null list).  With ``limit`` reading stops as in
    :func:`cut_position`.  Columns of ``current`` that entries lack are null in
    inserted rows.
    """
    read = entries if limit is None else cut_position(entries, current, limit, key, pos_col)
    new = tracks_from_entries(read, key, label_col, pos_col, list_col)
    n = new.select(*[F.col(c).alias("_n_" + c) for c in new.columns])
    both = current.join(n, F.col(key) == F.col("_n_" + key), "full_outer")
    known = F.col(key).isNotNull()
    appended = F.when(F.col("_n_" + list_col).isNull(), F.col(list_col)).otherwise(append_distinct(F.col(list_col), F.col("_n_" + list_col)))
    out = []
    for c, kind in current.dtypes:
        inserted = F.col("_n_" + c) if c in new.columns else F.lit(None).cast(kind)
        out.append(F.when(known, appended if c == list_col else F.col(c)).otherwise(inserted).alias(c))
    return both.select(*out)


# ------------------------------------------------------------------ U-1 / U-5 / U-4 / U-7
def drop_duplicates_first(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """U-1: one row per key, the first in ``order_cols`` order.

    ``min_by`` over a struct, with partial aggregation: a hot key collapses
    before the shuffle.
    """
    payload = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in order_cols])
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*payload), order).alias("_row"))
    return agg.select(*keys, *[F.col("_row")[c].alias(c) for c in payload]).select(*df.columns)


def set_difference(requested: DataFrame, received: DataFrame, key: str) -> DataFrame:
    """U-4: requested ids not received."""
    return requested.select(key).distinct().join(received.select(key), key, "left_anti")


def distinct_labels(df: DataFrame, list_col: str, out_col: str = "label") -> DataFrame:
    """U-7: distinct label names (sorted by the caller if needed)."""
    return df.select(F.explode(list_col).alias(out_col)).where(F.col(out_col).isNotNull()).distinct()


# ------------------------------------------------------------------ J-3 .. J-6, J-10
def with_features(tracks: DataFrame, features: DataFrame, key: str = "ym_track_id", feature_key: str = "track_id") -> DataFrame:
    """J-3: tracks that have features (semi join)."""
    return tracks.join(features.select(F.col(feature_key).alias("_fk")), F.col(key) == F.col("_fk"), "left_semi")


ARTIST_FIELDS = ("artist_country", "artist_sex", "artist_year")


def dedupe_cache(cache: DataFrame, name_col: str = "artist_name") -> DataFrame:
    """One cache row per lower-cased name: the one with the most requests (then the max name)."""
    keyed = cache.withColumn("_key", lower_key(name_col))
    payload = [c for c in cache.columns]
    agg = keyed.groupBy("_key").agg(F.max_by(F.struct(*payload), F.struct("requests_cnt", name_col)).alias("_row"))
    return agg.select("_key", *[F.col("_row")[c].alias(c) for c in payload])


def enrich_artists(tracks: DataFrame, cache: DataFrame, fallbacks: Sequence[DataFrame] = (), name_col: str = "artist_name") -> DataFrame:
    """J-4 + P-14: fill missing artist fields by lower-cased name, track value first, then cache,
    then each fallback source in order (each source: ``artist_name`` + some of the fields).

    Every source is first reduced to one row per name, then all of them to one
    row per name that holds each field's first known value in source order, so
    the tracks are shuffled once.  An artist who owns a large share of the
    tracks is left to AQE's skew join.
    """
    sources = [dedupe_cache(cache, name_col)] + [dedupe_source(s, name_col) for s in fallbacks]
    ranked = None
    for i, src in enumerate(sources):
        fields = [F.col(f).cast("string").alias(f) if f in src.columns else F.lit(None).cast("string").alias(f) for f in ARTIST_FIELDS]
        one = src.select("_key", F.lit(i).alias("_rank"), *fields)
        ranked = one if ranked is None else ranked.unionByName(one)
    first = ranked.groupBy("_key").agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("_rank"))).alias("_s_" + f) for f in ARTIST_FIELDS])
    out = tracks.withColumn("_key", lower_key(name_col)).join(first, "_key", "left")
    for f in ARTIST_FIELDS:
        out = out.withColumn(f, F.coalesce(F.col(f), F.col("_s_" + f)))
    return out.drop("_key", *["_s_" + f for f in ARTIST_FIELDS])


def dedupe_source(src: DataFrame, name_col: str = "artist_name") -> DataFrame:
    """One row per lower-cased name: the smallest by (name, then the fields as they stand); facts of different rows do not mix."""
    fields = [f for f in ARTIST_FIELDS if f in src.columns]
    keyed = src.withColumn("_key", lower_key(name_col))
    agg = keyed.groupBy("_key").agg(F.min_by(F.struct(*fields), F.struct(name_col, *fields)).alias("_row"))
    return agg.select("_key", *[F.col("_row")[f].alias(f) for f in fields])


def artist_work_list(cache: DataFrame, max_requests: int = 1) -> DataFrame:
    """P-13: artists still missing a field with ``requests_cnt <= max_requests``; their count goes up by one."""
    missing = F.lit(False)
    for f in ARTIST_FIELDS:
        missing = missing | F.col(f).isNull()
    return cache.where(missing & (F.coalesce(F.col("requests_cnt"), F.lit(0)) <= max_requests)).withColumn(
        "requests_cnt", F.coalesce(F.col("requests_cnt"), F.lit(0)) + 1
    )


def enrich_genres(tracks: DataFrame, lookup: DataFrame, on_miss: str = "drop", list_col: str = "deezer_genres") -> DataFrame:
    """J-5: tracks without genres get them from ``lookup`` by (title, artist).

    Tracks with genres are kept unchanged; a hit with no genres keeps the row;
    a miss is dropped (``on_miss='drop'``) or kept (``'keep'``).  The lookup is
    reduced to one row per key, the smallest genre list it has; a title/artist
    pair that repeats across very many tracks is left to AQE's skew join.
    """
    lk = lookup.groupBy("track_title", "artist_name").agg(F.min("genres").alias("_g"), F.lit(True).alias("_hit"))
    j = tracks.join(lk, ["track_title", "artist_name"], "left")
    has = non_empty(list_col)
    if on_miss == "drop":
        j = j.where(has | F.col("_hit").isNotNull())
    return j.withColumn(list_col, F.when(has, F.col(list_col)).otherwise(F.coalesce(F.col("_g"), F.col(list_col)))).drop("_g", "_hit")


def join_manifest(manifest: DataFrame, tracks: DataFrame, key: str = "track_id", track_key: str = "ym_track_id") -> tuple[DataFrame, DataFrame]:
    """J-6 / J-10: manifest rows with a track (inner) and the misses (anti)."""
    t = tracks.withColumnRenamed(track_key, key)
    return manifest.join(t, key, "inner"), manifest.join(t.select(key), key, "left_anti")


def tracks_without_file(tracks: DataFrame, manifest: DataFrame, key: str = "track_id", track_key: str = "ym_track_id") -> DataFrame:
    """J-10: tracks whose file is not in the manifest (anti join)."""
    have = manifest.select(F.col(key).alias("_have"))
    return tracks.join(have, F.col(track_key) == F.col("_have"), "left_anti")


# ------------------------------------------------------------------ L-4 / L-5 / W-1
def page(df: DataFrame, order_cols: Sequence[str], page_no: int = 0, per_page: int = 20) -> DataFrame:
    """L-5 (and L-4 with page 0): one page in a total order; top-k + offset, no full sort."""
    return df.orderBy(*order_cols).offset(page_no * per_page).limit(per_page)


def page_after(df: DataFrame, key: str, last_key=None, per_page: int = 20) -> DataFrame:
    """L-5 at depth: keyset paging, the rows after ``last_key`` in ``key`` order.

    A filter (pushed to the scan) plus a top-k, so page 10,000 costs the same
    as page 1, unlike an offset.
    """
    src = df if last_key is None else df.where(F.col(key) > F.lit(last_key))
    return src.orderBy(key).limit(per_page)


def first_n_per_class(df: DataFrame, class_col: str, order_cols: Sequence[str], n: int = 200, fanout: int = 64) -> DataFrame:
    """W-1: the first ``n`` rows of every class in ``order_cols`` order.

    Two-level top-n: first per (class, map-side group) where the group is
    ``spark_partition_id() % fanout``, then per class over at most
    ``n * fanout`` survivors.  Each level gets a partial limit before its
    shuffle (window group limit), so a class with a third of all rows never
    lands in one task.  Exact: the global first ``n`` are among every
    group's first ``n``.
    """
    orders = [F.col(c) for c in order_cols]
    salted = df.withColumn("_grp", F.pmod(F.spark_partition_id(), F.lit(fanout)))
    w1 = Window.partitionBy(class_col, "_grp").orderBy(*orders)
    lvl1 = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= n).drop("_r1", "_grp")
    w2 = Window.partitionBy(class_col).orderBy(*orders)
    return lvl1.withColumn("_rank", F.row_number().over(w2)).where(F.col("_rank") <= n).drop("_rank")


# The columns of the catalogue page, in its order.
CATALOGUE_COLUMNS = (
    "ym_track_id", "ym_album_id", "track_title", "artist_name", "audio_path", "lyrics_path", "cover_path", "cover_url", "emotion", "genre",
    "artist_country", "artist_year", "artist_age",
)


def catalogue_view(df: DataFrame) -> DataFrame:
    """P-21: the catalogue page's 13 columns; the cover URL gets ``https://``.  Columns the table lacks
    (``artist_age`` is in no table) come out null."""
    out = {c: F.col(c) if c in df.columns else F.lit(None).cast("string") for c in CATALOGUE_COLUMNS}
    if "cover_url" in df.columns:
        out["cover_url"] = F.concat(F.lit("https://"), F.col("cover_url"))
    return df.select(*[e.alias(c) for c, e in out.items()])
