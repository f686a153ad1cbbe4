"""Catalogue queries: playlists from ``events``, finalised tracks from ``part``,
artists from ``customer``/``nation``, crowd labels from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lists import join_list
from ..operators import aggregates, catalog
from ..schemas import GENRE_MAP, GENRE_MAP_DEFAULT, NARROW_GENRES, POPULAR_EMOTION_KEEP, POPULAR_GENRE_KEEP, UNPOPULAR_GENRES
from ..sources.tables import manifest_ids, read_table
from .bindings import (
    ANSWER_ORDER_SQL,
    ANSWERS_SQL,
    FINAL_TRACKS_SQL,
    FLAT_PLAYLIST_SQL,
    final_tracks,
    playlist_entries,
)
from .q_crowd import CONFIRMED_SQL, confirmed_emotions
from .registry import register

SPLIT_TS = "2024-01-15"


def valid_playlist_rows(spark, sf_dir):
    flat = catalog.flatten_playlist_tracks(playlist_entries(spark, sf_dir), keep=["ts"])
    return flat.where(F.col("reject_reason").isNull())


FLAT_COLS = ["playlist", "pos", "reject_reason", "ym_track_id", "ym_album_id", "track_title", "artist_name",
             "cover_url", "ym_genre", "year", "emotion", "audio_path", "lyrics_path", "cover_path"]


@register(
    "catalog_playlist_ingest",
    ("S-13", "P-9", "P-10", "P-11", "F-7", "F-9"),
    f"SELECT {', '.join(FLAT_COLS)} FROM ({FLAT_PLAYLIST_SQL})",
)
def q_ingest(spark, sf_dir):
    return catalog.flatten_playlist_tracks(playlist_entries(spark, sf_dir)).select(*FLAT_COLS)


@register(
    "catalog_playlist_json",
    ("S-13", "P-9", "P-10", "P-11"),
    f"SELECT * REPLACE (row_number() OVER (PARTITION BY playlist ORDER BY pos) - 1 AS pos) FROM (SELECT {', '.join(FLAT_COLS)} FROM ({FLAT_PLAYLIST_SQL}))",
)
def q_playlist_json(spark, sf_dir):
    """Playlists written as JSON, one per line, read back with the declared schema and flattened."""
    from ..session import scratch_path
    from ..sources.tables import read_playlists, write_json

    e = playlist_entries(spark, sf_dir)
    tracks = F.transform(F.array_sort(F.collect_list(F.struct("pos", "track"))), lambda x: x["track"])
    path = scratch_path(spark, "playlists")
    write_json(e.groupBy("title").agg(tracks.alias("tracks")), path)
    return catalog.flatten_playlist_tracks(read_playlists(spark, path)).select(*FLAT_COLS)


def _emotions_by_track(rows):
    return catalog.emotions_in_order(rows, "ym_track_id", "emotion", ["pos"], "emotions_maybe")


TRACK_FIELDS = ["ym_album_id", "track_title", "artist_name", "cover_url", "ym_genre", "year", "audio_path", "lyrics_path", "cover_path"]
MERGE_SQL = f"""
WITH flat AS ({FLAT_PLAYLIST_SQL}),
     ok AS (SELECT * FROM flat WHERE reject_reason IS NULL),
     o AS (SELECT * FROM ok WHERE ts < TIMESTAMP '{SPLIT_TS}'),
     cur AS (SELECT ym_track_id, {', '.join(f'arg_min({c}, pos) AS {c}' if c != 'lyrics_path' else f"{c}" for c in TRACK_FIELDS if c != 'lyrics_path')},
                    (arg_min({{{{'x': lyrics_path}}}}, pos)).x AS lyrics_path FROM o GROUP BY ym_track_id),
     n0 AS (SELECT * FROM ok WHERE ts >= TIMESTAMP '{SPLIT_TS}'),
     fresh AS (SELECT ym_track_id, min(pos) AS p FROM n0 ANTI JOIN cur USING (ym_track_id) GROUP BY ym_track_id),
     lim AS (SELECT {{limit}} - (SELECT count(*) FROM cur) AS k),
     cut AS (SELECT max(p) AS p FROM (SELECT p, row_number() OVER (ORDER BY p, ym_track_id) AS i FROM fresh), lim WHERE i = k),
     n AS (SELECT n0.* FROM n0, lim, cut WHERE k > 0 AND (cut.p IS NULL OR n0.pos <= cut.p)),
     ins AS (SELECT ym_track_id, {', '.join(f'arg_min({c}, pos) AS {c}' for c in TRACK_FIELDS if c != 'lyrics_path')},
                    (arg_min({{{{'x': lyrics_path}}}}, pos)).x AS lyrics_path FROM n ANTI JOIN cur USING (ym_track_id) GROUP BY ym_track_id),
     keep AS (SELECT * FROM cur UNION ALL BY NAME SELECT * FROM ins),
     l0 AS (SELECT ym_track_id, emotion, 0 AS src, min(pos) AS p FROM o WHERE emotion IS NOT NULL GROUP BY ALL
            UNION ALL SELECT ym_track_id, emotion, 1, min(pos) FROM n WHERE emotion IS NOT NULL GROUP BY ALL),
     labels AS (SELECT ym_track_id, string_agg(emotion, '|' ORDER BY src, p) AS emotions_maybe
                FROM (SELECT * FROM l0 QUALIFY row_number() OVER (PARTITION BY ym_track_id, emotion ORDER BY src, p) = 1) GROUP BY ym_track_id)
SELECT k.ym_track_id, {', '.join('k.' + c for c in TRACK_FIELDS)}, l.emotions_maybe, CAST(NULL AS VARCHAR) AS deezer_genres,
       CAST(NULL AS VARCHAR) AS artist_country, CAST(NULL AS VARCHAR) AS artist_sex, CAST(NULL AS VARCHAR) AS artist_year, CAST(NULL AS VARCHAR) AS emotions
FROM keep k LEFT JOIN labels l USING (ym_track_id)
""".replace("{{", "{").replace("}}", "}")


def merged_playlists(spark, sf_dir, new_tracks=None):
    """The events before SPLIT_TS are the table's ingest from nothing, those after it the new playlists (16 columns)."""
    from ..schemas import TRACKS
    from ..sources.tables import empty_frame, tracks_to_csv_frame

    from ..session import materialize

    ok = materialize(valid_playlist_rows(spark, sf_dir).drop("playlist", "reject_reason"), "playlist-entries")  # read by the cut and the merge
    ts = F.lit(SPLIT_TS).cast("timestamp_ntz")
    old, new = ok.where(F.col("ts") < ts).drop("ts"), ok.where(F.col("ts") >= ts).drop("ts")
    current = catalog.merge_playlist(empty_frame(spark, TRACKS), old)
    limit = None if new_tracks is None else old.select(F.countDistinct("ym_track_id")).scalar() + F.lit(new_tracks)
    return tracks_to_csv_frame(catalog.merge_playlist(current, new, limit=limit))


@register("catalog_playlist_merge", ("U-3", "A-8", "F-2", "P-10", "S-3"), MERGE_SQL.replace("{limit}", "1000000000000"))
def q_merge(spark, sf_dir):
    return merged_playlists(spark, sf_dir)


@register("catalog_ingest_limit", ("L-3", "U-3"), MERGE_SQL.replace("{limit}", "(SELECT count(*) FROM cur) + 5"))
def q_ingest_limit(spark, sf_dir):
    # room for 5 more tracks than the table holds
    return merged_playlists(spark, sf_dir, new_tracks=5)


@register(
    "catalog_filter_member",
    ("P-2", "A-8"),
    f"""
WITH flat AS ({FLAT_PLAYLIST_SQL})
SELECT DISTINCT ym_track_id FROM flat WHERE reject_reason IS NULL AND emotion = 'happy'
""",
)
def q_member(spark, sf_dir):
    lists = _emotions_by_track(valid_playlist_rows(spark, sf_dir))
    return catalog.filter_member(lists, "emotions_maybe", "happy").select("ym_track_id")


CONF_CTE = CONFIRMED_SQL.strip()


@register(
    "catalog_label_count",
    ("P-3", "P-4"),
    f"""
WITH conf AS ({CONF_CTE})
SELECT ym_track_id, n_emotions, CASE WHEN n_emotions = 1 THEN 'one' ELSE 'many' END AS kind FROM conf WHERE n_emotions >= 1
UNION ALL SELECT ym_track_id, n_emotions, 'all' FROM conf WHERE n_emotions >= 1
""",
)
def q_label_count(spark, sf_dir):
    conf = confirmed_emotions(spark, sf_dir).withColumn("emotions_arr", F.split("emotions", r"\|"))
    conf = conf.withColumn("emotions_arr", F.filter("emotions_arr", lambda x: x != ""))
    kinds = (("one", catalog.ONE_LABEL), ("many", catalog.MANY_LABELS), ("all", catalog.ALL_TRACKS))
    out = None
    for name, kind in kinds:
        part = catalog.select_by_label_count(conf, kind, "emotions_arr").select("ym_track_id", "n_emotions", F.lit(name).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "catalog_label_frequencies",
    ("A-3", "L-2"),
    f"""
WITH conf AS ({CONF_CTE}),
     e AS (SELECT unnest(string_split(emotions, '|')) AS label FROM conf WHERE emotions <> ''),
     c AS (SELECT label, count(*) AS count FROM e GROUP BY label)
SELECT label, count, CAST(sum(count) OVER () AS BIGINT) AS total FROM c
""",
)
def q_freq(spark, sf_dir):
    conf = confirmed_emotions(spark, sf_dir).withColumn("labels", F.filter(F.split("emotions", r"\|"), lambda x: x != ""))
    return aggregates.sort_frequencies(aggregates.label_frequencies(conf, "labels"))


def _genre_case_sql(col: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in GENRE_MAP.items())
    return f"coalesce(CASE {col} {whens} END, '{GENRE_MAP_DEFAULT}')"


def _keep_sql(col: str, rules: dict, id_col: str = "ym_track_id") -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.items())
    return f"(CASE {col} {whens} END IS NULL OR {id_col} % 10 <= CASE {col} {whens} END)"


@register(
    "catalog_map_genre",
    ("J-7",),
    f"SELECT ym_track_id, genre AS genre_raw, {_genre_case_sql('genre')} AS genre FROM ({FINAL_TRACKS_SQL})",
)
def q_map_genre(spark, sf_dir):
    t = final_tracks(spark, sf_dir).withColumnRenamed("genre", "genre_raw")
    return catalog.map_genre(t, "genre_raw", "genre").select("ym_track_id", "genre_raw", "genre")


@register(
    "catalog_unknown_genres",
    ("J-7",),
    f"""
SELECT DISTINCT genre AS raw FROM ({FINAL_TRACKS_SQL})
WHERE genre IS NOT NULL AND genre NOT IN ({", ".join("'" + k + "'" for k in list(GENRE_MAP) + ["relax"])})
""",
)
def q_unknown_genres(spark, sf_dir):
    return catalog.unknown_genres(final_tracks(spark, sf_dir), "genre", strict=True)


NARROW_SQL = f"""
SELECT ym_track_id, ym_album_id, {_genre_case_sql('genre')} AS genre, nation, emotion
FROM ({FINAL_TRACKS_SQL}) WHERE genre IS NOT NULL AND genre NOT IN ({", ".join("'" + g + "'" for g in NARROW_GENRES)})
"""


@register("catalog_drop_narrow_genres", ("P-6", "J-7", "P-3"), NARROW_SQL)
def q_narrow(spark, sf_dir):
    return catalog.drop_narrow_genres(final_tracks(spark, sf_dir)).select("ym_track_id", "ym_album_id", "genre", "nation", "emotion")


@register(
    "catalog_unpopular_genres",
    ("P-5",),
    f"SELECT * FROM ({NARROW_SQL}) WHERE genre IN ({', '.join(chr(39) + g + chr(39) for g in UNPOPULAR_GENRES)})",
)
def q_unpopular(spark, sf_dir):
    return catalog.filter_genres(q_narrow(spark, sf_dir), UNPOPULAR_GENRES, keep=True)


@register("catalog_reduce_popular_genres", ("P-7", "R-5"), f"SELECT * FROM ({NARROW_SQL}) WHERE {_keep_sql('genre', POPULAR_GENRE_KEEP)}")
def q_reduce_genres(spark, sf_dir):
    return catalog.reduce_popular_genres(q_narrow(spark, sf_dir))


@register(
    "catalog_reduce_popular_emotions",
    ("P-8", "R-5"),
    f"SELECT * FROM ({FINAL_TRACKS_SQL}) WHERE {_keep_sql('emotion', POPULAR_EMOTION_KEEP)}",
)
def q_reduce_emotions(spark, sf_dir):
    return catalog.reduce_popular_emotions(final_tracks(spark, sf_dir))


@register(
    "catalog_filter_has_emotion",
    ("P-1",),
    f"SELECT ym_track_id, emotion FROM ({FINAL_TRACKS_SQL}) WHERE emotion = 'sadness'",
)
def q_has_emotion(spark, sf_dir):
    return catalog.filter_equals(final_tracks(spark, sf_dir), "emotion", "sadness").select("ym_track_id", "emotion")


@register(
    "catalog_counts_by_class",
    ("A-4", "A-5"),
    f"""
WITH t AS ({NARROW_SQL})
SELECT CASE WHEN grouping(emotion) = 0 THEN 'emotion' WHEN grouping(genre) = 0 THEN 'genre' ELSE '*' END AS dimension,
       CASE WHEN grouping(emotion) = 0 THEN emotion WHEN grouping(genre) = 0 THEN genre END AS value,
       count(*) AS count
FROM t GROUP BY GROUPING SETS ((emotion), (genre), ())
""",
)
def q_counts(spark, sf_dir):
    return aggregates.counts_by(q_narrow(spark, sf_dir), ["emotion", "genre"])


@register(
    "catalog_row_counts",
    ("A-5",),
    f"""
WITH t AS ({FINAL_TRACKS_SQL})
SELECT count(*) AS rows, count(*) FILTER (WHERE genre IS NULL) AS no_genre,
       count(*) FILTER (WHERE emotion IN ('happy', 'joy')) AS happy_or_joy FROM t
""",
)
def q_row_counts(spark, sf_dir):
    t = final_tracks(spark, sf_dir)
    return aggregates.row_counts(t, no_genre=F.col("genre").isNull(), happy_or_joy=F.col("emotion").isin("happy", "joy"))


@register(
    "catalog_balance",
    ("P-6", "P-7", "P-8", "U-1"),
    f"""
WITH t AS (SELECT * FROM ({NARROW_SQL}) WHERE {_keep_sql('genre', POPULAR_GENRE_KEEP)} AND {_keep_sql('emotion', POPULAR_EMOTION_KEEP)})
SELECT ym_album_id, genre, min(ym_track_id) AS ym_track_id, arg_min(emotion, ym_track_id) AS emotion
FROM t GROUP BY ym_album_id, genre
""",
)
def q_balance(spark, sf_dir):
    t = catalog.reduce_popular_emotions(catalog.reduce_popular_genres(q_narrow(spark, sf_dir)))
    d = catalog.drop_duplicates_first(t.select("ym_album_id", "genre", "ym_track_id", "emotion"), ["ym_album_id", "genre"], ["ym_track_id"])
    return d


@register(
    "catalog_first_n_per_class",
    ("W-1",),
    f"""
SELECT ym_track_id, emotion FROM ({FINAL_TRACKS_SQL})
QUALIFY row_number() OVER (PARTITION BY emotion ORDER BY ym_track_id) <= 100
""",
)
def q_first_n(spark, sf_dir):
    return catalog.first_n_per_class(final_tracks(spark, sf_dir).select("ym_track_id", "emotion"), "emotion", ["ym_track_id"], n=100)


@register(
    "catalog_page",
    ("L-4", "L-5", "P-21"),
    f"""
SELECT ym_track_id, ym_album_id, track_title, artist_name, audio_path, lyrics_path, cover_path, 'https://' || cover_url AS cover_url,
       emotion, ym_genre AS genre, NULL::VARCHAR AS artist_country, NULL::VARCHAR AS artist_year, NULL::VARCHAR AS artist_age
FROM (SELECT * FROM ({FLAT_PLAYLIST_SQL}) WHERE reject_reason IS NULL QUALIFY row_number() OVER (PARTITION BY ym_track_id ORDER BY pos) = 1)
ORDER BY ym_track_id LIMIT 20 OFFSET 20
""",
)
def q_page(spark, sf_dir):
    first = catalog.drop_duplicates_first(valid_playlist_rows(spark, sf_dir), ["ym_track_id"], ["pos"])
    view = catalog.catalogue_view(first.withColumnRenamed("ym_genre", "genre"))
    return catalog.page(view, ["ym_track_id"], page_no=1)


@register(
    "catalog_page_after",
    ("L-5",),
    f"SELECT ym_track_id, genre, emotion FROM ({FINAL_TRACKS_SQL}) WHERE ym_track_id > 77 ORDER BY ym_track_id LIMIT 20",
)
def q_page_after(spark, sf_dir):
    return catalog.page_after(final_tracks(spark, sf_dir).select("ym_track_id", "genre", "emotion"), "ym_track_id", 77)


# ------------------------------------------------------------------ artists (customer / nation)
def artist_tracks(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    name = F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    return o.select(
        F.col("o_orderkey").alias("ym_track_id"),
        name.alias("artist_name"),
        F.when(F.pmod("o_orderkey", F.lit(5)) == 0, F.lit("KNOWN")).alias("artist_country"),
        F.lit(None).cast("string").alias("artist_sex"),
        F.lit(None).cast("string").alias("artist_year"),
    )


def artist_cache(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left")
    return j.select(
        F.col("c_name").alias("artist_name"),
        F.when(F.pmod("c_custkey", F.lit(4)) == 0, F.lit(None).cast("string")).otherwise(F.col("n_name")).alias("artist_country"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("male")).when(F.col("c_mktsegment") == "MACHINERY", F.lit("female")).alias("artist_sex"),
        F.when(F.pmod("c_custkey", F.lit(3)) == 0, F.lit(None).cast("string")).otherwise((F.lit(1950) + F.pmod("c_custkey", F.lit(60))).cast("string")).alias("artist_year"),
        F.pmod("c_custkey", F.lit(4)).cast("int").alias("requests_cnt"),
    )


def region_source(spark, sf_dir):
    """Fallback country source: region name of the customer's nation."""
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("c_name").alias("artist_name"), F.col("r_name").alias("artist_country"))


ARTIST_CACHE_SQL = """
SELECT c_name AS artist_name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE n_name END AS artist_country,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'male' WHEN c_mktsegment = 'MACHINERY' THEN 'female' END AS artist_sex,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(1950 + c_custkey % 60 AS VARCHAR) END AS artist_year,
       CAST(c_custkey % 4 AS INTEGER) AS requests_cnt
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
"""


@register(
    "catalog_artist_enrich",
    ("J-4", "F-4", "P-14"),
    f"""
WITH cache AS ({ARTIST_CACHE_SQL}),
     reg AS (SELECT lower(c_name) AS k, max(r_name) AS country FROM customer JOIN nation ON c_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
     cache1 AS (SELECT lower(artist_name) AS k, arg_max(artist_country, (requests_cnt, artist_name)) AS c,
                       arg_max(artist_sex, (requests_cnt, artist_name)) AS s, arg_max(artist_year, (requests_cnt, artist_name)) AS y
                FROM cache GROUP BY 1),
     t AS (SELECT o_orderkey AS ym_track_id, 'CUSTOMER#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS artist_name,
                  CASE WHEN o_orderkey % 5 = 0 THEN 'KNOWN' END AS artist_country FROM orders)
SELECT t.ym_track_id, t.artist_name, coalesce(t.artist_country, cache1.c, reg.country) AS artist_country,
       cache1.s AS artist_sex, cache1.y AS artist_year
FROM t LEFT JOIN cache1 ON lower(t.artist_name) = cache1.k LEFT JOIN reg ON lower(t.artist_name) = reg.k
""",
)
def q_artists(spark, sf_dir):
    out = catalog.enrich_artists(artist_tracks(spark, sf_dir), artist_cache(spark, sf_dir), [region_source(spark, sf_dir)])
    return out.select("ym_track_id", "artist_name", "artist_country", "artist_sex", "artist_year")


@register(
    "catalog_artist_work_list",
    ("P-13",),
    f"""
SELECT artist_name, artist_country, artist_sex, artist_year, requests_cnt + 1 AS requests_cnt FROM ({ARTIST_CACHE_SQL})
WHERE (artist_country IS NULL OR artist_sex IS NULL OR artist_year IS NULL) AND requests_cnt <= 1
""",
)
def q_work_list(spark, sf_dir):
    return catalog.artist_work_list(artist_cache(spark, sf_dir))


@register(
    "catalog_genre_enrich",
    ("J-5",),
    f"""
WITH t AS (SELECT p_partkey AS ym_track_id, p_name AS track_title, p_brand AS artist_name,
                  CASE WHEN p_type = 'PROMO' THEN p_type END AS g FROM part),
     lk AS (SELECT DISTINCT p_name AS track_title, p_brand || CASE WHEN p_size > 10 THEN '' ELSE ' (live)' END AS artist_name FROM part),
     lkg AS (SELECT track_title, artist_name, lower(track_title) AS genres FROM lk WHERE length(track_title) % 2 = 0
             UNION ALL SELECT track_title, artist_name, NULL FROM lk WHERE length(track_title) % 2 = 1)
SELECT t.ym_track_id, coalesce(CASE WHEN t.g IS NOT NULL THEN t.g ELSE lkg.genres END, '') AS deezer_genres
FROM t LEFT JOIN lkg USING (track_title, artist_name)
WHERE t.g IS NOT NULL OR lkg.track_title IS NOT NULL
""",
)
def q_genres(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    tracks = p.select(
        F.col("p_partkey").alias("ym_track_id"), F.col("p_name").alias("track_title"), F.col("p_brand").alias("artist_name"),
        F.when(F.col("p_type") == "PROMO", F.array(F.col("p_type"))).otherwise(F.array().cast("array<string>")).alias("deezer_genres"),
    )
    # the lookup knows small parts under another artist name, so their tracks are misses
    known_as = F.concat("p_brand", F.when(F.col("p_size") > 10, F.lit("")).otherwise(F.lit(" (live)")))
    lk = p.select(F.col("p_name").alias("track_title"), known_as.alias("artist_name")).distinct()
    lk = lk.withColumn("genres", F.when(F.length("track_title") % 2 == 0, F.split(F.lower("track_title"), "\\|")))
    out = catalog.enrich_genres(tracks, lk, on_miss="drop")
    return out.select("ym_track_id", join_list("deezer_genres").alias("deezer_genres"))


@register(
    "catalog_dedup_answers",
    ("U-1",),
    f"""
WITH a AS ({ANSWERS_SQL})
SELECT l_orderkey, l_suppkey, l_linenumber FROM a
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY {ANSWER_ORDER_SQL}) = 1
""",
)
def q_dedup(spark, sf_dir):
    from .bindings import ANSWER_ORDER, answers

    a = answers(spark, sf_dir).select("l_orderkey", "l_suppkey", "l_linenumber", *[c for c in ANSWER_ORDER if c not in ("l_orderkey", "l_linenumber")])
    d = catalog.drop_duplicates_first(a, ["l_orderkey", "l_suppkey"], ANSWER_ORDER)
    return d.select("l_orderkey", "l_suppkey", "l_linenumber")


@register(
    "catalog_distinct_labels",
    ("U-7", "U-5"),
    f"""
WITH flat AS ({FLAT_PLAYLIST_SQL})
SELECT DISTINCT emotion AS label FROM flat WHERE reject_reason IS NULL AND emotion IS NOT NULL
""",
)
def q_distinct_labels(spark, sf_dir):
    lists = _emotions_by_track(valid_playlist_rows(spark, sf_dir))
    return catalog.distinct_labels(lists, "emotions_maybe")


@register(
    "catalog_missing_ids",
    ("U-4",),
    """
SELECT DISTINCT o_orderkey AS ym_track_id FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)
""",
)
def q_missing(spark, sf_dir):
    req = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ym_track_id"))
    got = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ym_track_id"))
    return catalog.set_difference(req, got, "ym_track_id")


PAGE_ID_RE = r"/(\d+)(?:\.html)?/?(?:[?#].*)?$"


@register(
    "catalog_image_manifest",
    ("S-5", "J-6", "J-10", "F-10"),
    f"""
WITH m AS (SELECT url AS path, TRY_CAST(NULLIF(regexp_extract(url, '{PAGE_ID_RE}', 1), '') AS BIGINT) AS track_id FROM pages)
SELECT m.path, m.track_id, p.p_name AS track_title, 'hit' AS status FROM m JOIN part p ON m.track_id = p.p_partkey
UNION ALL
SELECT m.path, m.track_id, NULL, 'miss' FROM m WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = m.track_id)
UNION ALL
SELECT NULL, p.p_partkey, p.p_name, 'no file' FROM part p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.track_id = p.p_partkey)
""",
)
def q_manifest(spark, sf_dir):
    m = manifest_ids(read_table(spark, sf_dir, "pages").select(F.col("url").alias("path")), "path", PAGE_ID_RE)
    tracks = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ym_track_id"), F.col("p_name").alias("track_title"))
    hits, misses = catalog.join_manifest(m, tracks)
    lost = catalog.tracks_without_file(tracks, m)
    nothing = F.lit(None).cast("string")
    return (
        hits.select("path", "track_id", "track_title", F.lit("hit").alias("status"))
        .unionByName(misses.select("path", "track_id", nothing.alias("track_title"), F.lit("miss").alias("status")))
        .unionByName(lost.select(nothing.alias("path"), F.col("ym_track_id").alias("track_id"), "track_title", F.lit("no file").alias("status")))
    )



# ------------------------------------------------------------------ artist responses (S-14, P-12)
def artist_responses(spark, sf_dir):
    """Saved response bodies derived from ``customer``/``nation``/``region``: XML search + getinfo, JSON locations."""
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    key = F.col("c_custkey")
    code = F.when(F.pmod(key, F.lit(10)) == 0, F.lit("103")).when(F.pmod(key, F.lit(10)) == 1, F.lit("101")).otherwise(F.lit("100"))
    answer = F.when(F.pmod(key, F.lit(7)) == 0, F.lit("invalid")).otherwise(F.lit("valid"))
    search = F.format_string("<row><code>%s</code><answer>%s</answer><country>%s</country><mbid>mb%d</mbid></row>", code, answer, F.col("n_name"), key)
    info_country = F.when(F.pmod(key, F.lit(3)) == 0, F.concat(F.col("n_name"), F.lit("-info"))).otherwise(F.col("n_name"))
    info = F.format_string("<row><country>%s</country><mbid>mb%d</mbid><sexe>%s</sexe><year_debut>%d</year_debut></row>",
                           info_country, key, F.col("c_mktsegment"), (F.lit(1950) + F.pmod(key, F.lit(60))).cast("int"))
    status = F.when(F.pmod(key, F.lit(5)) == 0, F.lit("error")).otherwise(F.lit("success"))
    locs = F.when(F.pmod(key, F.lit(4)) == 0, F.lit("[]")).otherwise(F.format_string('[{"country":"%s"}]', F.col("r_name")))
    js = F.format_string('{"headers":{"status":"%s"},"results":[{"locations":%s}]}', status, locs)
    name = F.col("c_name").alias("artist_name")
    # every third artist was asked before; the old answers, though greater as text, no longer count
    stale = F.format_string("<row><code>999</code><answer>old</answer><country>old %d</country></row>", key)
    asked_before = j.where(F.pmod(key, F.lit(3)) == 1)
    parts = [
        asked_before.select(name, F.lit("musicovery").alias("source"), F.explode(F.array(F.lit("search"), F.lit("getinfo"))).alias("kind"), stale.alias("body")).withColumn("received", F.lit(1).cast("long")),
        asked_before.select(name, F.lit("jamendo").alias("source"), F.lit("locations").alias("kind"), F.lit('{"old":1}').alias("body"), F.lit(1).cast("long").alias("received")),
        j.select(name, F.lit("musicovery").alias("source"), F.lit("search").alias("kind"), search.alias("body")),
        j.select(name, F.lit("musicovery").alias("source"), F.lit("getinfo").alias("kind"), F.when(F.col("c_acctbal") >= 0, info).otherwise(F.lit("<row></row>")).alias("body")),
        j.select(name, F.lit("jamendo").alias("source"), F.lit("locations").alias("kind"), js.alias("body")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p if "received" in p.columns else p.withColumn("received", F.lit(2).cast("long")))
    return out


@register(
    "catalog_artist_as_of",
    ("S-14", "P-12"),
    """
WITH r AS (SELECT c_custkey AS k, v, CAST(DATE '1992-03-01' + CAST(c_custkey % 300 + v * 500 AS INTEGER) AS TIMESTAMP) AS received,
                  CASE WHEN (c_custkey + v) % 10 = 0 THEN 'limit' WHEN (c_custkey + v) % 10 = 1 OR (c_custkey + v) % 7 = 0 THEN 'error' ELSE 'ok' END AS status,
                  n_name || ' ' || CAST(v AS VARCHAR) AS country
           FROM customer JOIN nation ON c_nationkey = n_nationkey, range(4) t(v))
SELECT o_orderkey, r.status, CASE WHEN r.status = 'ok' THEN r.country END AS artist_country
FROM orders ASOF LEFT JOIN r ON o_custkey = r.k AND CAST(o_orderdate AS TIMESTAMP) >= r.received
""",
)
def q_artist_as_of(spark, sf_dir):
    """Orders as requests for an artist at a time; every artist was answered four times over the years."""
    from ..operators import artists

    c, n = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "nation")
    kind = F.col("c_custkey") + F.col("v")
    code = F.when(F.pmod(kind, F.lit(10)) == 0, F.lit("103")).when(F.pmod(kind, F.lit(10)) == 1, F.lit("101")).otherwise(F.lit("100"))
    answer = F.when(F.pmod(kind, F.lit(7)) == 0, F.lit("invalid")).otherwise(F.lit("valid"))
    body = F.format_string("<row><code>%s</code><answer>%s</answer><country>%s %d</country></row>", code, answer, F.col("n_name"), F.col("v"))
    received = F.date_add(F.lit("1992-03-01").cast("date"), (F.pmod("c_custkey", F.lit(300)) + F.col("v") * 500).cast("int")).cast("timestamp_ntz")
    versions = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("v"))
    responses = versions.select(F.col("c_custkey").cast("string").alias("artist_name"), F.lit("musicovery").alias("source"), F.lit("search").alias("kind"), body.alias("body"), received.alias("received"))
    requests = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("artist_name"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    return artists.answers_as_of(requests, responses, "at").select("o_orderkey", "status", "artist_country")


@register(
    "catalog_artist_responses",
    ("S-14", "P-12"),
    """
WITH b AS (SELECT c_name AS artist_name, c_custkey AS k, c_acctbal, n_name, r_name, c_mktsegment FROM customer
           LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
     s AS (SELECT *, CASE WHEN k % 10 = 0 THEN '103' WHEN k % 10 = 1 THEN '101' ELSE '100' END AS code,
                  CASE WHEN k % 7 = 0 THEN 'invalid' ELSE 'valid' END AS answer, c_acctbal >= 0 AS has_info FROM b)
SELECT artist_name,
       CASE WHEN code = '103' THEN 'limit' WHEN code <> '100' OR answer <> 'valid' THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN code = '100' AND answer = 'valid' THEN
            CASE WHEN has_info THEN (CASE WHEN k % 3 = 0 THEN n_name || '-info' ELSE n_name END) ELSE n_name END END AS artist_country,
       CASE WHEN code = '100' AND answer = 'valid' AND has_info THEN c_mktsegment END AS artist_sex,
       CASE WHEN code = '100' AND answer = 'valid' AND has_info THEN CAST(1950 + k % 60 AS VARCHAR) END AS artist_year,
       CASE WHEN k % 5 <> 0 AND k % 4 <> 0 THEN r_name END AS fallback_country
FROM s
""",
)
def q_artist_responses(spark, sf_dir):
    from ..operators import artists

    resp = artist_responses(spark, sf_dir)
    info = artists.parse_search_info(resp)
    loc = artists.parse_locations(resp).withColumnRenamed("artist_country", "fallback_country")
    return info.join(loc, "artist_name", "left").select(
        "artist_name", "status", "artist_country", "artist_sex", "artist_year", "fallback_country"
    )


# ------------------------------------------------------------------ CSV edge (S-1, S-2, S-3, F-1), JSON sink (S-9)
@register(
    "catalog_tracks_csv_roundtrip",
    ("S-1", "S-2", "S-3", "F-1", "F-2"),
    f"""
WITH flat AS ({FLAT_PLAYLIST_SQL}),
     ok AS (SELECT * FROM flat WHERE reject_reason IS NULL),
     t AS (SELECT DISTINCT ym_track_id FROM ok),
     f AS (SELECT ym_track_id, emotion, min(pos) AS p FROM ok WHERE emotion IS NOT NULL GROUP BY ALL),
     g AS (SELECT ym_track_id, string_agg(emotion, '|' ORDER BY p) AS e, count(*) AS n FROM f GROUP BY ym_track_id)
SELECT ym_track_id,
       CASE WHEN ym_track_id % 5 = 0 THEN NULL WHEN ym_track_id % 5 = 1 THEN '' ELSE 'say "' || CAST(ym_track_id AS VARCHAR) || '", ' || chr(10) || '|x' END AS track_title,
       CASE WHEN ym_track_id % 4 = 0 THEN '' ELSE e END AS emotions_maybe, CASE WHEN ym_track_id % 4 = 0 THEN 0 ELSE n END AS n_emotions
FROM t LEFT JOIN g USING (ym_track_id)
""",
)
def q_csv_roundtrip(spark, sf_dir):
    """Tracks written as CSV and read back: lists, empty lists and nulls, and titles with quotes, newlines and nothing."""
    from ..schemas import TRACKS
    from ..session import scratch_path
    from ..sources.tables import empty_frame, read_tracks_csv, write_csv

    ok = valid_playlist_rows(spark, sf_dir).drop("playlist", "reject_reason", "ts")
    lists = catalog.merge_playlist(empty_frame(spark, TRACKS), ok)
    tid = F.col("ym_track_id")
    title = F.when(tid % 5 == 0, F.lit(None)).when(tid % 5 == 1, F.lit("")).otherwise(F.format_string('say "%d", \n|x', tid))
    lists = lists.withColumn("track_title", title).withColumn("emotions_maybe", F.when(tid % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("emotions_maybe")))
    path = scratch_path(spark, "tracks-csv")
    write_csv(lists, path)
    back = read_tracks_csv(spark, path)
    n = F.when(F.col("emotions_maybe").isNotNull(), F.size("emotions_maybe")).cast("long")
    return back.select("ym_track_id", "track_title", join_list("emotions_maybe").alias("emotions_maybe"), n.alias("n_emotions"))


@register(
    "catalog_json_records",
    ("S-9",),
    f"""
SELECT CAST(to_json({{'ym_track_id': ym_track_id, 'track_title': track_title, 'genre': genre, 'emotion': emotion}}) AS VARCHAR) AS json
FROM ({FINAL_TRACKS_SQL})
UNION ALL SELECT CAST(to_json({{'id': ym_track_id}}) AS VARCHAR) FROM ({FINAL_TRACKS_SQL})
""",
)
def q_json(spark, sf_dir):
    """The records and, as rows of their own, the ids."""
    from ..sources.tables import ids_as_json, to_json_records

    t = final_tracks(spark, sf_dir).select("ym_track_id", "track_title", "genre", "emotion")
    return to_json_records(t).unionByName(ids_as_json(t))


# ------------------------------------------------------------------ path helpers (F-6, F-10), weights (F-3)
@register(
    "catalog_audio_renames",
    ("F-6", "F-10", "F-7"),
    f"""
WITH a AS (SELECT DISTINCT audio_path FROM ({ANSWERS_SQL})),
     r AS (SELECT audio_path, regexp_replace(audio_path, '/\\d+:(\\d+\\.mp3)$', '/\\1') AS new_path FROM a)
SELECT audio_path, new_path,
       regexp_replace(regexp_extract(new_path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem,
       NULLIF(regexp_extract(regexp_extract(new_path, '([^/]*)$', 1), '\\.([^.]*)$', 1), '') AS ext,
       'audio_short/' || regexp_extract(new_path, '([^/]*)$', 1) AS short_path
FROM r
""",
)
def q_renames(spark, sf_dir):
    from ..functions.paths import file_ext, file_stem, remove_album_from_name, short_audio_path
    from .bindings import answers

    a = answers(spark, sf_dir).select("audio_path").distinct()
    r = a.withColumn("new_path", remove_album_from_name("audio_path"))
    return r.select("audio_path", "new_path", file_stem("new_path").alias("stem"), file_ext("new_path").alias("ext"),
                    short_audio_path("new_path").alias("short_path"))


# ------------------------------------------------------------------ image-pair study (J-6, P-16, P-17)
PAIR_BASE = "https://static.tracks.example/data/"


@register(
    "catalog_pair_tasks",
    ("P-16", "P-17", "J-6", "R-3"),
    f"""
WITH m AS (SELECT DISTINCT TRY_CAST(NULLIF(regexp_extract(url, '{PAGE_ID_RE}', 1), '') AS BIGINT) AS track_id FROM pages),
     items AS (SELECT m.track_id,
                      '{PAIR_BASE}audios/' || CAST(m.track_id AS VARCHAR) || '.mp3' AS url_audio,
                      'https://covers.example/' || CAST(p.p_partkey AS VARCHAR) || '.jpg' AS url_cover,
                      '{PAIR_BASE}images/' || CAST(m.track_id AS VARCHAR) || '_gen.jpg' AS url_cover_generated
               FROM m JOIN part p ON m.track_id = p.p_partkey),
     idx AS (SELECT *, row_number() OVER (ORDER BY md5('3:' || CAST(track_id AS VARCHAR)), track_id) - 1 AS i,
                    count(*) OVER () AS n FROM items),
     r AS (SELECT a.url_cover_generated AS image_first, b.url_cover_generated AS image_second, a.url_audio AS audio_path
           FROM idx a JOIN idx b
             ON b.i = CAST(('0x' || substr(md5('partner:3:' || CAST(a.track_id AS VARCHAR)), 1, 15))::UBIGINT % a.n AS BIGINT))
SELECT 'original' AS kind, url_cover AS image_first, url_cover_generated AS image_second, url_audio AS audio_path FROM items
UNION ALL
SELECT 'analog', url_cover_generated,
       '{PAIR_BASE}images-other/image-' || CAST(CAST(('0x' || substr(md5('analog:3:' || CAST(track_id AS VARCHAR)), 1, 8))::UBIGINT % 1000 AS BIGINT) + 1 AS VARCHAR) || '.jpg',
       url_audio FROM items
UNION ALL
SELECT 'random', image_first, image_second, audio_path FROM r
""",
)
def q_pairs(spark, sf_dir):
    from ..operators import pairs
    from ..session import materialize

    images = manifest_ids(read_table(spark, sf_dir, "pages").select(F.col("url").alias("path")), "path", PAGE_ID_RE).select("track_id").distinct()
    p = read_table(spark, sf_dir, "part")
    tracks = p.select(
        F.col("p_partkey").alias("ym_track_id"), F.col("p_type").alias("genre"),
        F.concat(F.lit("covers.example/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("cover_url"),
    )
    items, _missing = pairs.pair_items(images, tracks, base=PAIR_BASE)
    items = materialize(items, "pair-items")  # read by the three pair kinds (random twice)
    out = pairs.pairs_original(items).withColumn("kind", F.lit("original"))
    out = out.unionByName(pairs.pairs_analog(items, seed=3, base=PAIR_BASE).withColumn("kind", F.lit("analog")))
    out = out.unionByName(pairs.pairs_random(items, seed=3).withColumn("kind", F.lit("random")))
    return out.select("kind", "image_first", "image_second", "audio_path")
