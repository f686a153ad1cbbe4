"""Small helpers: label maps, keys, vocabularies, sinks, paths, time blocks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tessitura.functions import paths
from tessitura.functions.scores import multi_hot, multi_hot_inverse
from tessitura.operators import metrics
from tessitura.operators.ordering import epoch_micros
from tessitura.schemas import EMOTIONS, mapping_table, vocabulary
from tessitura.session import scratch_path
from tessitura.sources import tables


def test_multi_hot_round_trip(spark):
    df = spark.createDataFrame([(["sad", "happy"],), ([],), (None,)], "l array<string>")
    vocab = ["happy", "joy", "sad"]
    got = df.select(multi_hot("l", vocab).alias("m")).select("m", multi_hot_inverse("m", vocab).alias("back")).collect()
    assert [r.m for r in got] == [[1, 0, 1], [0, 0, 0], [0, 0, 0]]
    assert [r.back for r in got] == [["happy", "sad"], [], []]


def test_emotion_index_words_emoji(spark):
    df = spark.createDataFrame([("happy",), ("bored",)], "emotion string")
    out = df.select(
        metrics.emoji_of("emotion").alias("e"), metrics.emotion_words_of("emotion").alias("w")
    ).collect()

    assert out[1].e == "" and out[1].w == "bored" and out[0].w != "happy"


def test_top1_and_encode(spark):
    df = spark.createDataFrame([([0.1, 0.9],)], "s array<double>")
    assert metrics.top1(df, "s").first().pred == 1
    enc = metrics.encode_labels(spark.createDataFrame([("sadness",), ("x",)], "n string"), "n", EMOTIONS)
    assert [r.label_idx for r in enc.collect()] == [sorted(EMOTIONS).index("sadness"), None]


def test_vocabulary_and_mapping_tables(spark):
    v = vocabulary(spark, ["a", "b"])
    assert [(r.idx, r.name) for r in v.orderBy("idx").collect()] == [(0, "a"), (1, "b")]
    m = mapping_table(spark, {"k": "v"}, "key", "value")
    assert m.first().asDict() == {"key": "k", "value": "v"}


def test_paths(spark):
    df = spark.createDataFrame([("https://s/x/12:345.mp3?x=1",), ("Queen",)], "p string")
    out = df.select(
        paths.lower_key("p").alias("k"), paths.file_stem("p").alias("stem"), paths.file_ext("p").alias("ext"),
        paths.remove_album_from_name(F.regexp_replace("p", r"\?.*$", "")).alias("r"), paths.shard_of(F.lit(45)).alias("b"),
        paths.track_key(F.lit(1), F.lit(2), F.lit("happy")).alias("key"),
    ).collect()
    assert out[0].stem == "12:345" and out[0].ext == "mp3" and out[0].r == "https://s/x/345.mp3"
    assert out[1].k == "queen" and out[1].ext is None and out[0].b == 5 and out[0].key == "1:2:happy"


def test_register_tables_and_json_sink(spark):
    tables.register_tables(spark, "/root/testdata/sf0.001", ["region"])
    assert spark.sql("SELECT count(*) FROM region").first()[0] == 5
    path = scratch_path(spark, "t-json")
    tables.write_json(spark.createDataFrame([(1, "a"), (2, None)], "id long, name string"), path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ['{"id":1,"name":"a"}', '{"id":2,"name":null}']
    df = spark.createDataFrame([(1, None)], "ym_track_id long, g string")
    assert tables.to_json_records(df).first().json == '{"ym_track_id":1,"g":null}' and tables.ids_as_json(df).first().json == '{"id":1}'


def test_epoch_micros_ntz_and_ltz(spark):
    ntz = spark.createDataFrame([(dt.datetime(1970, 1, 2),)], "t timestamp_ntz")
    ltz = spark.createDataFrame([(dt.datetime(1970, 1, 2),)], "t timestamp")
    assert ntz.select(epoch_micros(ntz, "t").alias("u")).first().u == 86_400_000_000
    assert ltz.select(epoch_micros(ltz, "t").alias("u")).first().u == 86_400_000_000  # session zone is UTC


def test_result_json_forms_and_ranked_fields(spark):
    df = spark.createDataFrame([(["happy", "joy"],)], "e array<string>")
    out = df.select(
        metrics.result_json("emotions", F.col("e")).alias("ok"),
        metrics.result_json("error", F.lit("Unknown emotion")).alias("err"),
        metrics.result_json("keywords", F.array(F.lit("love"))).alias("kw"),
        metrics.result_json("fonts", F.transform("e", lambda e: F.struct(e.alias("emotion"), F.array(F.lit("Acme")).alias("fonts")))).alias("fonts"),
        *metrics.ranked_fields("e", 3, "emotion"),
    ).first()
    assert out.ok == '{"result":{"emotions":["happy","joy"]}}'
    assert out.fonts == '{"result":[{"emotion":"happy","fonts":["Acme"]},{"emotion":"joy","fonts":["Acme"]}]}'
    assert out.err == '{"result":{"error":"Unknown emotion"}}' and out.kw == '{"result":{"keywords":["love"]}}'
    assert (out.emotion_1, out.emotion_2, out.emotion_3) == ("happy", "joy", None)


def test_request_errors_and_picks(spark):
    df = spark.createDataFrame([(1, [], "happy"), (2, [[1.0]], "bored"), (3, [[1.0]], "happy")], "id long, c array<array<double>>, emotion string")
    errs = {r.id: r.error for r in metrics.request_errors(df, chunks_col="c", emotion_col="emotion").collect()}
    assert errs == {1: "Audio features are empty", 2: "Unknown emotion", 3: None}
    fonts = spark.createDataFrame([(1, ["A", "B", "C"]), (2, [])], "id long, fonts array<string>")
    picks = {r.id: r.p for r in fonts.select("id", metrics.seeded_picks("fonts", "id", 5, seed=1).alias("p")).collect()}
    assert len(picks[1]) == 5 and set(picks[1]) <= {"A", "B", "C"} and picks[2] == []
