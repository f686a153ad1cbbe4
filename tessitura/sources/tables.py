"""Table sources and sinks (S-1..S-5, S-9..S-12).

Every reader declares its schema; nothing is inferred.  Writers always go
to a new path (never the one being read).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lists import join_list, split_list
from ..schemas import ANSWERS_RAW, LIST_COLUMNS, PLAYLISTS, TRACKS, TRACKS_CSV
from .csv_splits import read_quoted_csv

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (Parquet: schema comes from the file footer)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> None:
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


# ------------------------------------------------------------------ S-1 / S-2
EMPTY = "\u0001"  # what the reader puts for a quoted empty field, to tell it from a missing one


def read_tracks_csv(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """S-1: tracks CSV with header; ``|`` lists become arrays (F-1).

    A field with nothing between the separators is null, a quoted empty field is
    the empty string (an empty list); pandas' ``NA``/``null``/``nan`` are text
    here.  Fields may hold quotes and line breaks; large files are still read by
    many tasks (:mod:`.csv_splits`).  ``whole_files`` reads one file per task
    with Spark's own reader, for files with stray quotes in unquoted fields.
    """
    empties = {"nullValue": "", "emptyValue": EMPTY}
    if whole_files:
        raw = spark.read.schema(TRACKS_CSV).options(header=True, multiLine=True, escape='"', **empties).csv(path)
    else:
        raw = read_quoted_csv(spark, path, TRACKS_CSV, **empties)
    text = {f.name: F.when(F.col(f.name) == EMPTY, F.lit("")).otherwise(F.col(f.name)) for f in raw.schema.fields if isinstance(f.dataType, T.StringType)}
    return raw.select(*[(split_list(text[c]) if c in LIST_COLUMNS else text.get(c, F.col(c))).alias(c) for c in raw.columns])


def tracks_to_csv_frame(df: DataFrame) -> DataFrame:
    """F-2 before S-2: arrays become ``|``-joined strings."""
    out = []
    for f in df.schema.fields:
        out.append(join_list(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S-2: header CSV, no index column; null is written as nothing, the empty string (an empty list) as ``""``."""
    out = tracks_to_csv_frame(df)
    out.write.mode(mode).option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", '""').csv(path)


# ------------------------------------------------------------------ S-3
def empty_frame(spark: SparkSession, schema: T.StructType = TRACKS) -> DataFrame:
    """S-3: empty typed table."""
    return spark.createDataFrame([], schema)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """S-3 helper: the table at ``path``, or an empty one of ``schema`` when absent."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except Exception as exc:  # missing path -> AnalysisException
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            return empty_frame(spark, schema)
        raise


# ------------------------------------------------------------------ S-4 / S-5
def read_text_dir(spark: SparkSession, path: str, id_pattern: str = r"(\d+)\.txt$") -> DataFrame:
    """S-4: one row per file below ``path``, whole text; the id is what ``id_pattern`` finds in the file's path."""
    df = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    tid = F.nullif(F.regexp_extract(name, id_pattern, 1), F.lit("")).try_cast("bigint")
    return df.select(tid.alias("track_id"), F.col("value").alias("text"))


def file_manifest(spark: SparkSession, path: str, id_pattern: str = r"(\d+)\.[^./]+$", glob: str | None = None) -> DataFrame:
    """S-5: ``(path, track_id)`` of every file below ``path``; file contents are never read."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.option("recursiveFileLookup", True).load(path).select("path")
    return manifest_ids(df, "path", id_pattern)


def manifest_ids(df: DataFrame, path_col: str = "path", id_pattern: str = r"(\d+)\.[^./]+$") -> DataFrame:
    """S-5 on an existing path column: the numeric id captured by ``id_pattern``."""
    tid = F.nullif(F.regexp_extract(F.col(path_col), id_pattern, 1), F.lit("")).try_cast("bigint")
    return df.withColumn("track_id", tid)


# ------------------------------------------------------------------ S-9
def to_json_records(df: DataFrame, col_name: str = "json") -> DataFrame:
    """S-9: one JSON record per row; null fields are written as null."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(col_name))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def ids_as_json(df: DataFrame, id_col: str = "ym_track_id", col_name: str = "json") -> DataFrame:
    """S-9: the ids alone, one JSON row ``{"id": ..}`` each."""
    return to_json_records(df.select(F.col(id_col).alias("id")), col_name)


# ------------------------------------------------------------------ S-13
def read_playlists(spark: SparkSession, path: str) -> DataFrame:
    """S-13: playlist dumps (JSON, one playlist per line) as entries ``(title, pos, track struct)``; ``pos`` is 0-based in the list."""
    raw = spark.read.schema(PLAYLISTS).json(path)
    return raw.select("title", F.posexplode("tracks").alias("pos", "track")).select("title", F.col("pos").cast("long").alias("pos"), "track")


# ------------------------------------------------------------------ S-10 / S-11
def parse_emotion_fonts(text: Column) -> Column:
    """S-10: JSON object ``{emotion: [font, ...]}`` -> map column."""
    return F.from_json(text, "map<string,array<string>>")


def read_emotion_fonts(spark: SparkSession, path: str) -> DataFrame:
    """S-10: the fonts JSON file as ``(emotion, fonts)`` rows."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(parse_emotion_fonts(F.col("value"))).alias("emotion", "fonts"))


def read_keyword_list(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """S-10: ``;``-separated keyword list as ``(idx, keyword)``."""
    raw = spark.read.text(path, wholetext=True)
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")  # noqa: E731  (spaces, tabs and newlines)
    exploded = raw.select(F.posexplode(split_list(strip(F.col("value")), sep)).alias("idx", "keyword"))
    return exploded.select(F.col("idx").cast("int"), strip(F.col("keyword")).alias("keyword"))


def vocabulary_line(vocab: DataFrame, sep: str = ";", idx_col: str = "idx", name_col: str = "keyword") -> DataFrame:
    """S-11: vocabulary table -> one delimited line (the reader splits on ``;``, so we write ``;``).

    The vocabulary is bounded (top-k) so one row is fine.
    """
    return vocab.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(idx_col, name_col))), lambda s: s[name_col]), sep).alias("line")
    )


# ------------------------------------------------------------------ S-12
def read_answers(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """S-12: exported crowd answers; ``INPUT:audio_path``/``OUTPUT:result`` are renamed."""
    if fmt == "csv":
        raw = spark.read.option("header", True).option("delimiter", "\t").option("inferSchema", False).csv(path)  # all columns are text
    else:
        raw = spark.read.format(fmt).load(path)
    renames = {"INPUT:audio_path": "audio_path", "OUTPUT:result": "result", "ASSIGNMENT:worker_id": "worker_id",
               "ASSIGNMENT:submitted": "submitted_at", "ASSIGNMENT:status": "status", "ASSIGNMENT:reward": "reward",
               "ASSIGNMENT:assignment_id": "answer_id"}
    cols = []
    for f in ANSWERS_RAW.fields:
        src = next((k for k, v in renames.items() if v == f.name and k in raw.columns), f.name if f.name in raw.columns else None)
        cols.append((F.col(f"`{src}`").try_cast(f.dataType) if src else F.lit(None).cast(f.dataType)).alias(f.name))
    return raw.select(*cols)

