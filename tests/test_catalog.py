"""Catalogue operators: null semantics, genre maps, keep rules, dedup, merge, limit, top-n, enrichment."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tessitura.functions.lists import join_list, split_list
from tessitura.operators import aggregates, catalog
from tessitura.schemas import GENRE_MAP

from .conftest import rows

FINAL = "ym_track_id long, ym_album_id long, genre string, nation string, emotion string"


def test_split_and_join_lists(spark):
    df = spark.createDataFrame([("a|b",), ("",), (None,), ("a.b|c",)], "s string")
    got = [r.l for r in df.select(split_list("s").alias("l")).collect()]
    assert got == [["a", "b"], [], None, ["a.b", "c"]]
    back = df.select(join_list(split_list("s")).alias("j")).collect()
    assert [r.j for r in back] == ["a|b", "", None, "a.b|c"]


def test_genre_filters_and_keep_rules(spark):
    df = spark.createDataFrame(
        [(10, 1, "pop", None, "quiet"), (11, 1, "pop", None, "quiet"), (12, 1, "pop", None, None), (20, 2, None, None, "happy"),
         (23, 2, "blues", None, "happy"), (35, 3, "rock", None, "sadness")],
        FINAL,
    )
    # P-7: pop keeps id % 10 <= 1, rock <= 2; null genre kept
    assert rows(catalog.reduce_popular_genres(df), "ym_track_id") == [(10,), (11,), (20,), (23,)]
    # P-8: quiet keeps <= 1; null emotion kept; sadness <= 2
    assert rows(catalog.reduce_popular_emotions(df), "ym_track_id") == [(10,), (11,), (12,), (20,), (23,)]
    # P-5 keeps the unpopular genres; the drop form keeps nulls
    assert rows(catalog.filter_genres(df, keep=True), "ym_track_id") == [(23,)]
    assert (20,) in rows(catalog.filter_genres(df, keep=False), "ym_track_id")


def test_genre_map_default_and_strict(spark):
    df = spark.createDataFrame([("allrock",), ("house",), ("unknown",), (None,), ("relax",)], "g string")
    got = [r.m for r in df.select(catalog.genre_map_expr("g").alias("m")).collect()]
    assert got == ["rock", "electronic", "other", "other", "other"]
    strict_ok = spark.createDataFrame([("house",), ("relax",)], "g string").select(catalog.genre_map_expr("g", strict=True).alias("m"))
    assert [r.m for r in strict_ok.collect()] == ["house", "relax"]
    with pytest.raises(Exception):
        df.select(catalog.genre_map_expr("g", strict=True)).collect()
    unknown = catalog.unknown_genres(df, "g")
    assert rows(unknown) == [("unknown",)]
    assert len(GENRE_MAP) == 65


def test_drop_narrow_genres_source_column(spark):
    df = spark.createDataFrame([(1, 1, "african", "rusrock", "x"), (2, 1, "hardrock", "jazz", "x"), (3, 1, None, "pop", "x")], FINAL)
    assert rows(catalog.drop_narrow_genres(df), "ym_track_id", "genre") == [(2, "rock")]
    assert rows(catalog.drop_narrow_genres(df, source_col="nation"), "ym_track_id", "genre") == [(2, "jazz")]


def test_drop_duplicates_first(spark):
    df = spark.createDataFrame([(1, 7, "b", 2), (1, 7, "a", 1), (2, 7, "c", 5)], "t long, a long, v string, o int")
    assert rows(catalog.drop_duplicates_first(df, ["t", "a"], ["o"])) == [(1, 7, "a", 1), (2, 7, "c", 5)]


def test_emotions_in_order_and_merge_with_limit(spark):
    rows_in = spark.createDataFrame(
        [(1, "sad", 5), (1, "happy", 3), (1, "sad", 1), (2, "fear", 2), (3, "joy", 9), (4, "joy", 7)],
        "ym_track_id long, emotion string, pos long",
    )
    lists = catalog.emotions_in_order(rows_in, "ym_track_id", "emotion", ["pos"], "emotions_maybe")
    got = dict((r.ym_track_id, r.emotions_maybe) for r in lists.collect())
    assert got[1] == ["sad", "happy"]


ENTRY = "ym_track_id long, emotion string, pos long, track_title string"


def _merge_case(spark):
    current = spark.createDataFrame([(1, "one", ["happy"], None), (2, "two", ["fear"], "x"), (5, "five", None, None)], "ym_track_id long, track_title string, emotions_maybe array<string>, emotions string")
    entries = spark.createDataFrame(
        [(1, "sad", 1, "other"), (4, "joy", 2, "four"), (3, None, 3, "three"), (3, "joy", 4, "later"), (5, "joy", 5, "x"), (1, "happy", 6, "x"), (2, "joy", 7, "x"), (6, "sad", 8, "six"), (4, "sad", 9, "x"), (4, "joy", 10, "x")],
        ENTRY,
    )
    return current, entries


def test_merge_playlist(spark):
    current, entries = _merge_case(spark)
    out = {r.ym_track_id: r for r in catalog.merge_playlist(current, entries).collect()}
    assert {k: r.emotions_maybe for k, r in out.items()} == {1: ["happy", "sad"], 2: ["fear", "joy"], 3: ["joy"], 4: ["joy", "sad"], 5: ["joy"], 6: ["sad"]}
    assert [out[k].track_title for k in (1, 3, 4)] == ["one", "three", "four"] and out[2].emotions == "x"
    unlabelled = catalog.merge_playlist(current.where("false"), entries.where("emotion is null")).collect()
    assert [(r.ym_track_id, r.emotions_maybe) for r in unlabelled] == [(3, None)]


def test_reading_stops_at_the_limit(spark):
    """Entries after the track that fills the table are not read: their labels are not applied either."""
    current, entries = _merge_case(spark)
    for limit, new, two in ((3, set(), ["fear"]), (4, {4}, ["fear"]), (5, {3, 4}, ["fear"]), (6, {3, 4, 6}, ["fear", "joy"]), (50, {3, 4, 6}, ["fear", "joy"])):
        out = {r.ym_track_id: r.emotions_maybe for r in catalog.merge_playlist(current, entries, limit=limit).collect()}
        assert set(out) - {1, 2, 5} == new and out[2] == two
    plan = catalog.merge_playlist(current, entries, limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_cut_position_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    rows_in = [(int(t), None, int(p), "t") for p, t in zip(rng.permutation(2000) * 10**12, rng.integers(0, 300, 2000))]
    entries = spark.createDataFrame(rows_in, ENTRY)
    current = spark.createDataFrame([(i,) for i in range(20)], "ym_track_id long")
    for limit in (20, 21, 60, 299, 1000):
        seen, exp = set(range(20)), []
        for t, _, p, _ in sorted(rows_in, key=lambda r: r[2]):
            if len(seen) >= limit:
                break
            seen.add(t)
            exp.append(p)
        got = sorted(r.pos for r in catalog.cut_position(entries, current, limit).collect())
        assert got == exp


def test_first_n_per_class_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": rng.permutation(3000), "c": rng.choice(["a", "b", "c"], 3000, p=[0.7, 0.2, 0.1])})
    df = spark.createDataFrame(pdf).repartition(12)
    got = rows(catalog.first_n_per_class(df, "c", ["id"], n=50, fanout=4), "c", "id")
    exp = sorted(tuple(x) for x in pdf.sort_values("id").groupby("c").head(50)[["c", "id"]].itertuples(index=False))
    assert got == exp


def test_counts_by_grouping_sets(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "emotion string, genre string")
    got = rows(aggregates.counts_by(df, ["emotion", "genre"]))
    assert got == sorted([("emotion", "a", 2), ("emotion", "b", 1), ("genre", "x", 2), ("genre", "y", 1), ("*", None, 3)], key=lambda t: (t[0], t[1] or "", t[2]))


def test_enrich_artists_fill_only_missing(spark):
    tracks = spark.createDataFrame([(1, "ABBA", "SE", None, None), (2, "Queen", None, None, None), (3, "Nobody", None, None, None)],
                                   "ym_track_id long, artist_name string, artist_country string, artist_sex string, artist_year string")
    cache = spark.createDataFrame([("abba", "XX", "group", "1972", 1), ("queen", None, "group", "1970", 0)],
                                  "artist_name string, artist_country string, artist_sex string, artist_year string, requests_cnt int")
    fb = spark.createDataFrame([("QUEEN", "GB")], "artist_name string, artist_country string")
    out = dict((r.ym_track_id, (r.artist_country, r.artist_sex, r.artist_year)) for r in catalog.enrich_artists(tracks, cache, [fb]).collect())
    assert out[1] == ("SE", "group", "1972") and out[2] == ("GB", "group", "1970") and out[3] == (None, None, None)


def test_enrich_genres_drop_or_keep(spark):
    tracks = spark.createDataFrame([(1, "t1", "a", ["pop"]), (2, "t2", "a", []), (3, "t3", "a", []), (4, "t4", "a", [])],
                                   "ym_track_id long, track_title string, artist_name string, deezer_genres array<string>")
    lk = spark.createDataFrame([("t2", "a", ["rock"]), ("t3", "a", None)], "track_title string, artist_name string, genres array<string>")
    drop = dict((r.ym_track_id, r.deezer_genres) for r in catalog.enrich_genres(tracks, lk, "drop").collect())
    assert drop == {1: ["pop"], 2: ["rock"], 3: []}
    keep = dict((r.ym_track_id, r.deezer_genres) for r in catalog.enrich_genres(tracks, lk, "keep").collect())
    assert keep[4] == []


def test_playlist_reject_reasons(spark):
    schema = "title string, pos long, track struct<id:bigint,title:string,albums:array<struct<id:bigint,genre:string,year:int,cover_uri:string>>,artists:array<struct<name:string>>,download_info:array<struct<codec:string,bitrate:int>>,lyrics:string>"
    alb = [(5, "rock", 2001, "c/%%")]
    data = [
        ("emotion-happy", 1, (1, "t", alb, [("A",)], [("mp3", 320)], None)),
        ("emotion-happy", 2, (2, "t", [], [("A",)], [("mp3", 320)], None)),
        ("genre-rock", 3, (3, "t", alb, [], [("mp3", 320)], None)),
        ("emotion-sad", 4, (4, "t", [(5, "rock", 2001, None)], [("A",)], [("mp3", 320)], None)),
        ("emotion-sad", 5, (5, "t", alb, [("A",)], [("mp3", 192), ("aac", 320)], None)),
        ("emotion-sad", 6, None),
    ]
    df = spark.createDataFrame(data, schema)
    out = {r.pos: r for r in catalog.flatten_playlist_tracks(df).collect()}
    assert out[1].reject_reason is None and out[1].cover_url == "c/1000x1000" and out[1].emotion == "happy"
    assert [out[i].reject_reason for i in (2, 3, 4, 5, 6)] == ["no album", "no artist", "no cover", "no mp3 320", "no track"]
    assert out[3].emotion is None


def test_page_offset(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert [r.k for r in catalog.page(df, ["k"], page_no=2, per_page=20).collect()] == list(range(40, 60))


def test_page_after_keyset(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert [r.k for r in catalog.page_after(df, "k", 39, 20).collect()] == list(range(40, 60))
    assert [r.k for r in catalog.page_after(df, "k", None, 3).collect()] == [0, 1, 2]


def test_tracks_without_file_and_view(spark):
    tracks = spark.createDataFrame([(1, "c/1"), (2, "c/2")], "ym_track_id long, cover_url string")
    files = spark.createDataFrame([("a/1.jpg", 1), ("a/x.jpg", None)], "path string, track_id long")
    assert rows(catalog.tracks_without_file(tracks, files), "ym_track_id") == [(2,)]
    view = catalog.catalogue_view(tracks)
    assert len(view.columns) == 13 and view.first().cover_url == "https://c/1"
