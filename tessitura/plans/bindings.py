"""Bind the driver's tables to the catalogue's roles.

The driver ships TPC-H-like tables, not track catalogues.  Each role below is
a projection of a driver table (plus fixed vocabularies) with the column names
the operators expect.  Every binding exists twice: as a DataFrame here and as
DuckDB SQL (``*_SQL``) for the oracle, and the two must stay equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EMOTIONS, GENRE_MAP, NARROW_GENRES
from ..session import spread
from ..sources.tables import read_table

BASE_URL = "https://static.tracks.example/"

# Full lineitem row: a total order for answers (no shorter key is unique).
ANSWER_ORDER = [
    "submitted_at", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]
ANSWER_ORDER_SQL = ", ".join(c + " NULLS FIRST" for c in ANSWER_ORDER)


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# ----------------------------------------------------------------- answers (lineitem)
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crowd answers: task = order (track), worker = supplier, answer NO when returned.

    Pool class by line parity (odd -> happy, even -> sadness); skipped when the
    line is open; reward = quantity; the audio URL has an album prefix except for
    every 7th track and every 4th line, so both URL forms of F-5 occur, also of
    one track.  By rules on the key some answers have no worker, no time, or a
    URL that names no track.
    """
    li = spread(read_table(spark, sf_dir, "lineitem"))
    tid = F.col("l_orderkey").cast("string")
    of = lambda n: F.pmod("l_orderkey", F.lit(n)) == 0
    plain = of(7) | (F.pmod("l_linenumber", F.lit(4)) == 3)
    path = F.when(of(97), F.concat(F.lit("audio/"), tid, F.lit(".ogg"))).when(plain, F.concat(F.lit("audio/"), tid, F.lit(".mp3"))).otherwise(F.concat(F.lit("audio/"), F.expr("l_orderkey div 7").cast("string"), F.lit(":"), tid, F.lit(".mp3")))
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        F.when(~of(101), F.col("l_suppkey").cast("string")).alias("worker_id"),
        F.when(~of(103), F.col("l_shipdate")).alias("submitted_at"),
        F.when(F.col("l_linestatus") == "O", F.lit("SKIPPED")).otherwise(F.lit("SUBMITTED")).alias("status"),
        F.col("l_quantity").alias("reward"),
        F.concat(F.lit(BASE_URL), path).alias("audio_path"),
        F.when(F.col("l_returnflag") == "R", F.lit("NO")).otherwise(F.lit("YES")).alias("result"),
        F.when(F.pmod("l_linenumber", F.lit(2)) == 1, F.lit("happy")).otherwise(F.lit("sadness")).alias("emotion"),
    )


ANSWERS_SQL = f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
       l_discount, l_tax, l_returnflag, l_linestatus,
       CASE WHEN l_orderkey % 101 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS worker_id,
       CASE WHEN l_orderkey % 103 <> 0 THEN l_shipdate END AS submitted_at,
       CASE WHEN l_linestatus = 'O' THEN 'SKIPPED' ELSE 'SUBMITTED' END AS status,
       l_quantity AS reward,
       '{BASE_URL}' || CASE WHEN l_orderkey % 97 = 0 THEN 'audio/' || CAST(l_orderkey AS VARCHAR) || '.ogg'
                          WHEN l_orderkey % 7 = 0 OR l_linenumber % 4 = 3 THEN 'audio/' || CAST(l_orderkey AS VARCHAR) || '.mp3'
                          ELSE 'audio/' || CAST(l_orderkey // 7 AS VARCHAR) || ':' || CAST(l_orderkey AS VARCHAR) || '.mp3' END AS audio_path,
       CASE WHEN l_returnflag = 'R' THEN 'NO' ELSE 'YES' END AS result,
       CASE WHEN l_linenumber % 2 = 1 THEN 'happy' ELSE 'sadness' END AS emotion
FROM lineitem
"""


# ----------------------------------------------------------------- voted tracks (orders)
def order_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("ym_track_id"),
        F.col("o_custkey").alias("ym_album_id"),
        F.col("o_orderpriority").alias("priority"),
        F.concat(F.lit("audio/"), F.col("o_orderkey").cast("string"), F.lit(".mp3")).alias("audio_path"),
        F.element_at(F.array(*[F.lit(e) for e in EMOTIONS]), (F.pmod("o_orderkey", F.lit(len(EMOTIONS))) + 1).cast("int")).alias("emotion"),
    )


ORDER_TRACKS_SQL = f"""
SELECT o_orderkey AS ym_track_id, o_custkey AS ym_album_id, o_orderpriority AS priority,
       'audio/' || CAST(o_orderkey AS VARCHAR) || '.mp3' AS audio_path,
       {sql_list(EMOTIONS)}[CAST(o_orderkey % {len(EMOTIONS)} AS INTEGER) + 1] AS emotion
FROM orders
"""

# Raw genre labels seen on parts: the mapping's keys, the narrow genres and a null.
RAW_GENRES = list(GENRE_MAP.keys()) + NARROW_GENRES + [None]


# ----------------------------------------------------------------- finalised tracks (part)
def final_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finalised tracks from ``part``: raw genre and nation picked by id, emotion by id and size."""
    p = read_table(spark, sf_dir, "part")
    raw = F.array(*[F.lit(g) if g is not None else F.lit(None).cast("string") for g in RAW_GENRES])
    n_raw = len(RAW_GENRES)
    return p.select(
        F.col("p_partkey").alias("ym_track_id"),
        F.col("p_size").cast("long").alias("ym_album_id"),
        F.col("p_name").alias("track_title"),
        F.col("p_type").alias("ptype"),
        F.element_at(raw, (F.pmod(F.col("p_partkey") * 7 + F.col("p_size"), F.lit(n_raw)) + 1).cast("int")).alias("genre"),
        F.element_at(raw, (F.pmod(F.col("p_partkey"), F.lit(n_raw)) + 1).cast("int")).alias("nation"),
        F.element_at(F.array(*[F.lit(e) for e in EMOTIONS]), (F.pmod(F.col("p_partkey") + F.col("p_size"), F.lit(len(EMOTIONS))) + 1).cast("int")).alias("emotion"),
    )


def _raw_genres_sql() -> str:
    return "[" + ", ".join("NULL" if g is None else "'" + g + "'" for g in RAW_GENRES) + "]"


FINAL_TRACKS_SQL = f"""
SELECT p_partkey AS ym_track_id, CAST(p_size AS BIGINT) AS ym_album_id, p_name AS track_title, p_type AS ptype,
       {_raw_genres_sql()}[CAST((p_partkey * 7 + p_size) % {len(RAW_GENRES)} AS INTEGER) + 1] AS genre,
       {_raw_genres_sql()}[CAST(p_partkey % {len(RAW_GENRES)} AS INTEGER) + 1] AS nation,
       {sql_list(EMOTIONS)}[CAST((p_partkey + p_size) % {len(EMOTIONS)} AS INTEGER) + 1] AS emotion
FROM part
"""


# ----------------------------------------------------------------- playlists (events)
GENRE_KEYS = list(GENRE_MAP.keys())


def _pick(values, idx):
    """``values[idx]`` for a 0-based index column over a literal list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def playlist_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playlist dump entries ``(title, pos, ts, track struct)`` from ``events``.

    Title by event type (purchase -> genre-, signup -> national-, else emotion-)
    with the class picked by ``props.k``; the track is the user; albums,
    artists, cover and download info are missing/wrong on fixed id residues so
    that every reject reason occurs.
    """
    from ..schemas import GENRES, GENRES_NATIONAL

    e = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    eid, uid = F.col("event_id"), F.col("user_id")
    title = (
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("genre-"), _pick(GENRES, F.pmod(k, F.lit(len(GENRES))))))
        .when(F.col("event_type") == "signup", F.concat(F.lit("national-"), _pick(GENRES_NATIONAL, F.pmod(k, F.lit(len(GENRES_NATIONAL))))))
        .otherwise(F.concat(F.lit("emotion-"), _pick(EMOTIONS, F.pmod(k, F.lit(len(EMOTIONS))))))
    )
    album = F.struct(
        F.expr("user_id div 3").alias("id"),
        _pick(GENRE_KEYS, F.pmod(uid, F.lit(len(GENRE_KEYS)))).alias("genre"),
        (F.lit(1990) + F.pmod(uid, F.lit(30))).cast("int").alias("year"),
        F.when(F.pmod(eid, F.lit(17)) == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("avatars.example/"), uid.cast("string"), F.lit("/%%"))).alias("cover_uri"),
    )
    albums = F.when(F.pmod(eid, F.lit(11)) == 0, F.array().cast("array<struct<id:bigint,genre:string,year:int,cover_uri:string>>")).otherwise(F.array(album))
    artists = F.when(F.pmod(eid, F.lit(13)) == 0, F.array().cast("array<struct<name:string>>")).otherwise(
        F.array(F.struct(F.concat(F.lit("Artist "), F.pmod(uid, F.lit(40)).cast("string")).alias("name")))
    )
    download = F.array(F.struct(
        F.when(F.pmod(eid, F.lit(7)) == 0, F.lit("aac")).otherwise(F.lit("mp3")).alias("codec"),
        F.when(F.pmod(eid, F.lit(5)) == 0, F.lit(192)).otherwise(F.lit(320)).alias("bitrate"),
    ))
    track = F.struct(
        uid.alias("id"),
        F.concat(F.lit("track "), uid.cast("string")).alias("title"),
        albums.alias("albums"),
        artists.alias("artists"),
        download.alias("download_info"),
        F.when(F.pmod(uid, F.lit(3)) == 0, F.lit("la la")).when(F.pmod(uid, F.lit(3)) == 1, F.lit("")).alias("lyrics"),
    )
    return e.select(title.alias("title"), eid.alias("pos"), F.col("ts"), track.alias("track"))


def _playlist_sql() -> str:
    from ..schemas import GENRES, GENRES_NATIONAL

    return f"""
SELECT CASE WHEN event_type = 'purchase' THEN 'genre-' || {sql_list(GENRES)}[k % {len(GENRES)} + 1]
            WHEN event_type = 'signup' THEN 'national-' || {sql_list(GENRES_NATIONAL)}[k % {len(GENRES_NATIONAL)} + 1]
            ELSE 'emotion-' || {sql_list(EMOTIONS)}[k % {len(EMOTIONS)} + 1] END AS title,
       event_id AS pos, ts, user_id AS tid, user_id // 3 AS album_id,
       'track ' || CAST(user_id AS VARCHAR) AS track_title,
       {sql_list(GENRE_KEYS)}[user_id % {len(GENRE_KEYS)} + 1] AS album_genre,
       CAST(1990 + user_id % 30 AS INTEGER) AS album_year,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'avatars.example/' || CAST(user_id AS VARCHAR) || '/%%' END AS cover_uri,
       event_id % 11 = 0 AS no_album, event_id % 13 = 0 AS no_artist,
       'Artist ' || CAST(user_id % 40 AS VARCHAR) AS artist,
       event_id % 7 <> 0 AND event_id % 5 <> 0 AS has_mp3_320
FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
"""


PLAYLIST_SQL = _playlist_sql()

FLAT_PLAYLIST_SQL = f"""
SELECT title AS playlist, pos, ts,
       CASE WHEN no_album THEN 'no album' WHEN no_artist THEN 'no artist'
            WHEN cover_uri IS NULL THEN 'no cover' WHEN NOT has_mp3_320 THEN 'no mp3 320' END AS reject_reason,
       tid AS ym_track_id,
       CASE WHEN no_album THEN NULL ELSE album_id END AS ym_album_id,
       track_title,
       CASE WHEN no_artist THEN NULL ELSE artist END AS artist_name,
       CASE WHEN no_album THEN NULL ELSE replace(cover_uri, '%%', '1000x1000') END AS cover_url,
       CASE WHEN no_album THEN NULL ELSE album_genre END AS ym_genre,
       CASE WHEN no_album THEN NULL ELSE album_year END AS year,
       CASE WHEN starts_with(title, 'emotion-') THEN substr(title, 9) END AS emotion,
       'data/audios/' || CAST(tid AS VARCHAR) || '.mp3' AS audio_path,
       CASE WHEN tid % 3 = 0 THEN 'data/lyrics/' || CAST(tid AS VARCHAR) || '.txt' END AS lyrics_path,
       'data/covers/' || CAST(tid AS VARCHAR) || ':1000x1000.jpg' AS cover_path
FROM ({PLAYLIST_SQL})
"""
