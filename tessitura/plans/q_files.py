"""File sources: rows of a given table are written to files and read back by the reader in question."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text
from ..session import scratch_path
from ..sources import shards
from ..sources.tables import file_manifest, read_answers, read_emotion_fonts, read_keyword_list, read_or_empty, read_table, read_text_dir, vocabulary_line
from .bindings import ANSWERS_SQL, answers
from .q_features import EMB_SQL
from .q_scores import FONTS_SQL, fonts_table
from .q_store import build_store
from .q_text import VOCAB_SQL, docs
from .registry import register

FOLDER_ID = r"item_id=(\d+)/"


@register(
    "files_text_dir",
    ("S-4", "S-5", "F-8"),
    """
SELECT item_id AS track_id, text || chr(10) AS text, CAST(length(text) + 1 AS INTEGER) AS n_chars, CAST(1 AS BIGINT) AS n_files FROM benchmark
""",
)
def q_text_dir(spark, sf_dir):
    """One text file per benchmark item; the listing and the texts, by the id in the path."""
    path = scratch_path(spark, "texts")
    b = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    b.repartition("item_id").write.partitionBy("item_id").text(path)
    whole = read_text_dir(spark, path, FOLDER_ID)
    listed = file_manifest(spark, path, FOLDER_ID, glob="*.txt").groupBy("track_id").agg(F.count(F.lit(1)).alias("n_files"))
    return whole.join(listed, "track_id").select("track_id", "text", F.length("text").alias("n_chars"), "n_files")


@register(
    "files_answers",
    ("S-12",),
    f"""
SELECT l_orderkey * 10 + l_linenumber AS answer_id, worker_id, strftime(submitted_at, '%Y-%m-%d %H:%M:%S') AS submitted_at, status, CAST(reward AS DOUBLE) AS reward, audio_path, result
FROM ({ANSWERS_SQL})
""",
)
def q_answers_file(spark, sf_dir):
    """The answers exported as a tab-separated file with the crowd platform's column names, and read back typed."""
    a = answers(spark, sf_dir)
    out = a.select(
        F.col("audio_path").alias("INPUT:audio_path"), F.col("result").alias("OUTPUT:result"), F.col("worker_id").alias("ASSIGNMENT:worker_id"),
        F.date_format("submitted_at", "yyyy-MM-dd HH:mm:ss").alias("ASSIGNMENT:submitted"), F.col("status").alias("ASSIGNMENT:status"), F.col("reward").alias("ASSIGNMENT:reward"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ASSIGNMENT:assignment_id"),
    )
    path = scratch_path(spark, "answers-tsv")
    out.write.option("header", True).option("delimiter", "\t").csv(path)
    back = read_answers(spark, path)
    return back.withColumn("submitted_at", F.date_format("submitted_at", "yyyy-MM-dd HH:mm:ss"))


@register("files_emotion_fonts", ("S-10", "J-11"), f"SELECT emotion, array_to_string(fonts, '|') AS fonts FROM ({FONTS_SQL})")
def q_fonts_file(spark, sf_dir):
    """The fonts of each emotion as one JSON object in a file."""
    path = scratch_path(spark, "fonts-json")
    # one row per emotion class: the file is small by nature
    table = fonts_table(spark, sf_dir).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("emotion", "fonts")))).alias("value"))
    table.coalesce(1).write.text(path)
    return read_emotion_fonts(spark, path).select("emotion", F.array_join("fonts", "|").alias("fonts"))


@register(
    "files_keyword_list",
    ("S-10", "S-11", "S-3"),
    f"SELECT CAST(row_number() OVER (ORDER BY count DESC, keyword) - 1 AS INTEGER) AS idx, keyword FROM ({VOCAB_SQL})",
)
def q_keyword_file(spark, sf_dir):
    """The vocabulary as one delimited line in a file; a second file that is not there adds nothing."""
    path = scratch_path(spark, "keywords")
    vocabulary_line(text.keyword_vocabulary(text.tfidf_keywords(docs(spark, sf_dir)))).write.text(path)
    back = read_keyword_list(spark, path)
    return back.unionByName(read_or_empty(spark, path + "-none", back.schema))


@register(
    "store_lookup_ids",
    ("S-7", "S-6"),
    f"""
WITH e AS ({EMB_SQL}), r AS (SELECT DISTINCT doc_id AS track_id FROM labels)
SELECT r.track_id, e.track_id IS NOT NULL AS exists, CASE WHEN r.track_id IN (3, 8, 23, 44, 101) AND e.track_id IS NOT NULL THEN 8 ELSE 0 END::BIGINT AS n_rows
FROM r LEFT JOIN e USING (track_id)
""",
)
def q_lookup_ids(spark, sf_dir):
    """Which requested ids the store has, and the rows of a few ids given as a list."""
    store = shards.read_store(spark, build_store(spark, sf_dir))
    requested = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("track_id")).distinct()
    some = shards.lookup_ids(store, [3, 8, 23, 44, 101]).groupBy("track_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return shards.exists(store, requested).join(some, "track_id", "left").select("track_id", "exists", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
