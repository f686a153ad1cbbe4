"""Source readers and writers: CSV edge, answers export, fonts JSON, keyword list, text folder, file manifest."""

from __future__ import annotations

import os


from tessitura.schemas import TRACKS
from tessitura.session import scratch_path
from tessitura.sources import tables


def _local(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def test_tracks_csv_round_trip(spark):
    row = {f.name: None for f in TRACKS.fields}
    row.update(ym_track_id=1, track_title='Say "hi", now', emotions_maybe=["happy", "sad"], deezer_genres=[], year=1999)
    row2 = {f.name: None for f in TRACKS.fields}
    row2.update(ym_track_id=2, track_title="multi\nline", emotions_maybe=None)
    df = spark.createDataFrame([tuple(r[f.name] for f in TRACKS.fields) for r in (row, row2)], TRACKS)
    path = scratch_path(spark, "t-csv")
    tables.write_csv(df, path)
    back = {r.ym_track_id: r for r in tables.read_tracks_csv(spark, path).collect()}
    assert back[1].track_title == 'Say "hi", now' and back[1].emotions_maybe == ["happy", "sad"] and back[1].year == 1999
    assert back[1].deezer_genres == [] and back[2].deezer_genres is None
    assert back[2].track_title == "multi\nline" and back[2].emotions_maybe is None


def test_empty_frame_and_read_or_empty(spark):
    assert tables.empty_frame(spark).count() == 0
    missing = tables.read_or_empty(spark, scratch_path(spark, "t-none"), TRACKS)
    assert missing.count() == 0 and missing.schema == TRACKS


def test_read_answers_export(spark):
    folder = _local(scratch_path(spark, "t-ans"))
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "a.tsv"), "w") as fh:
        fh.write("INPUT:audio_path\tOUTPUT:result\tASSIGNMENT:worker_id\n")
        fh.write("https://x/a/1.mp3\tYES\tw1\nhttps://x/a/1.mp3\tNO\tw2\n")
    df = tables.read_answers(spark, folder)
    assert df.columns == ["answer_id", "worker_id", "submitted_at", "status", "reward", "audio_path", "result"]
    assert sorted((r.worker_id, r.result) for r in df.collect()) == [("w1", "YES"), ("w2", "NO")]


def test_fonts_and_keyword_list(spark):
    folder = _local(scratch_path(spark, "t-res"))
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "fonts.json"), "w") as fh:
        fh.write('{"happy": ["Arial", "Comic"], "sad": []}')
    with open(os.path.join(folder, "keywords.txt"), "w") as fh:
        fh.write("love; night ;rain\n")
    fonts = {r.emotion: r.fonts for r in tables.read_emotion_fonts(spark, os.path.join(folder, "fonts.json")).collect()}
    assert fonts == {"happy": ["Arial", "Comic"], "sad": []}
    kw = [(r.idx, r.keyword) for r in tables.read_keyword_list(spark, os.path.join(folder, "keywords.txt")).orderBy("idx").collect()]
    assert kw == [(0, "love"), (1, "night"), (2, "rain")]


def test_text_folder_and_manifest(spark):
    folder = _local(scratch_path(spark, "t-lyrics"))
    os.makedirs(folder, exist_ok=True)
    for name, text in (("56547.txt", "la la\nla"), ("12.txt", "\n"), ("notes.md", "x")):
        with open(os.path.join(folder, name), "w") as fh:
            fh.write(text)
    lyr = {r.track_id: r.text for r in tables.read_text_dir(spark, os.path.join(folder, "*.txt")).collect()}
    assert lyr == {56547: "la la\nla", 12: "\n"}
    man = tables.file_manifest(spark, folder, r"(\d+)\.txt$")
    got = sorted((os.path.basename(r.path), r.track_id) for r in man.collect())
    assert got == [("12.txt", 12), ("56547.txt", 56547), ("notes.md", None)]


def test_json_records(spark):
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    assert tables.to_json_records(df).first().json == '{"id":1,"name":"a"}'



def test_csv_tells_empty_lists_from_missing_ones(spark):
    values = [(1, "a\n\"b\", c", ["x", "y"]), (2, "", []), (3, None, None)]
    df = tables.empty_frame(spark)
    from pyspark.sql import functions as F

    rows_in = spark.createDataFrame(values, "ym_track_id long, track_title string, emotions_maybe array<string>")
    full = rows_in.select(*[F.col(f.name) if f.name in rows_in.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    path = scratch_path(spark, "t-empty-csv")
    tables.write_csv(full, path)
    back = sorted((r.ym_track_id, r.track_title, r.emotions_maybe) for r in tables.read_tracks_csv(spark, path).collect())
    assert back == values
