"""Declared schemas and fixed vocabularies.

Schemas are always declared; nothing is inferred.  Vocabularies are small
fixed lists, turned into ``(idx, name)`` DataFrames and broadcast (their size
is bounded by the literal lists below).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES -- these must equal the catalogue's own vocabularies and rules
# for results to match.  Listed in their natural (declaration) order.
# ---------------------------------------------------------------------------

# Emotion classes, in declaration order (index = position).
EMOTIONS = [
    "comfortable", "happy", "inspirational", "joy", "lonely", "funny", "nostalgic",
    "passionate", "quiet", "relaxed", "romantic", "sadness", "soulful", "sweet",
    "serious", "anger", "wary", "surprise", "fear",
]

# Genre classes of the dataset pipeline (20).
GENRES = [
    "rock", "alternative", "blues", "classical", "metal", "jazz", "country", "dance",
    "electronic", "pop", "folk", "soundtrack", "bard", "rap", "indie", "lounge",
    "modern", "punk", "rnb", "other",
]

# Genre classes of the model pipeline (21): adds house and relax, no other.
GENRES_MODELS = [
    "rock", "alternative", "blues", "classical", "metal", "jazz", "country", "dance",
    "electronic", "pop", "folk", "soundtrack", "bard", "rap", "house", "indie",
    "lounge", "modern", "punk", "relax", "rnb",
]

# National genre playlists (14).
GENRES_NATIONAL = [
    "azerbaijani", "amerfolk", "argentinetango", "armenian", "african", "balkan",
    "eastern", "georgian", "jewish", "eurofolk", "caucasian", "celtic", "latinfolk",
    "rusfolk",
]

# GTZAN genre classes (10).
GENRES_GTZAN = ["blues", "classical", "country", "disco", "hiphop", "jazz", "metal", "pop", "reggae", "rock"]

# Raw music-service genre -> genre class (dataset pipeline, 65 keys, default "other").
GENRE_MAP = {
    "allrock": "rock", "alternative": "alternative", "blues": "blues", "classical": "classical",
    "classicalmasterpieces": "classical", "classicmetal": "metal", "conjazz": "jazz",
    "country": "country", "dance": "dance", "disco": "dance", "dub": "electronic",
    "dubstep": "electronic", "electronics": "electronic", "epicmetal": "metal", "estrada": "pop",
    "eurofolk": "folk", "extrememetal": "metal", "films": "soundtrack", "folk": "folk",
    "folkmetal": "folk", "folkrock": "folk", "foreignbard": "bard", "foreignrap": "rap",
    "hardcore": "rock", "hardrock": "rock", "house": "electronic", "indie": "indie",
    "japanesepop": "pop", "jazz": "jazz", "kpop": "pop", "latinfolk": "folk",
    "local-indie": "indie", "lounge": "lounge", "meditation": "lounge", "metal": "metal",
    "modern": "modern", "newage": "electronic", "newwave": "rock", "numetal": "rock",
    "pop": "pop", "posthardcore": "rock", "postrock": "rock", "prog": "metal",
    "progmetal": "metal", "punk": "punk", "rap": "rap", "rnb": "rnb", "rnr": "rock",
    "rock": "rock", "rusbards": "bard", "rusestrada": "pop", "rusfolk": "folk",
    "ruspop": "pop", "rusrap": "rap", "rusrock": "rock", "ska": "punk", "soul": "rnb",
    "soundtrack": "soundtrack", "stonerrock": "rock", "techno": "electronic",
    "tradjazz": "jazz", "turkishpop": "pop", "tvseries": "soundtrack", "ukrrock": "rock",
    "videogame": "soundtrack",
}
GENRE_MAP_DEFAULT = "other"

# Strict model-pipeline variant: same keys but house -> house, plus relax -> relax;
# unknown keys are an error.
GENRE_MAP_STRICT = {**GENRE_MAP, "house": "house", "relax": "relax"}

# Genres that balancing keeps as "unpopular" and the narrow genres it drops.
UNPOPULAR_GENRES = ["blues", "country", "lounge", "punk"]
NARROW_GENRES = [
    "african", "bollywood", "caucasian", "forchildren", "eastern", "trance", "sport",
    "shanson", "naturesounds", "jewish", "balkan", "children", "georgian", "celtic",
    "musical", "funk", "vocal", "dnb", "experimental", "animated", "reggae", "industrial",
    "relax",
]

# Deterministic keep rules: a row of class c is kept when id % 10 <= t.
POPULAR_GENRE_KEEP = {
    "pop": 1, "rock": 2, "electronic": 4, "alternative": 5, "indie": 5, "rap": 6,
    "soundtrack": 7, "dance": 8,
}
POPULAR_EMOTION_KEEP = {
    "quiet": 1, "nostalgic": 2, "sadness": 2, "sweet": 4, "surprise": 4, "soulful": 5,
    "romantic": 5, "lonely": 6, "comfortable": 6,
}

# Emoji per emotion (display text; unknown -> '').
EMOJI = {
    "comfortable": "😊", "happy": "😁", "inspirational": "🤩", "joy": "😂", "lonely": "😟",
    "funny": "😆", "nostalgic": "🙄", "passionate": "😍", "quiet": "🤐", "relaxed": "😌",
    "romantic": "😘", "sadness": "🙁", "soulful": "🙃", "sweet": "🤗", "serious": "🤨",
    "anger": "😡", "wary": "😑", "surprise": "😲", "fear": "😱",
}

# Task-page words per emotion (unknown -> the emotion name itself).
EMOTION_WORDS = {
    "comfortable": "Комфортная, уютная, домашняя", "happy": "Счастливая", "inspirational": "Вдохновляющая",
    "joy": "Радостная, позитивная, бодрая", "lonely": "Одинокая", "funny": "Забавная, смешная",
    "nostalgic": "Ностальгическая", "passionate": "Страстная, сексуальная", "quiet": "Спокойная, тихая",
    "relaxed": "Расслабленная, релакс", "romantic": "Романтическая", "sadness": "Печальная, грустная",
    "soulful": "Душевная", "sweet": "Сладкая, милая", "serious": "Серьёзная", "anger": "Ярость, гнев",
    "wary": "Острожная, напряжённая", "surprise": "Удивительная, сюрприз", "fear": "Страх",
}

# Crowd rules.
REWARD_PER_ASSIGNMENT = 0.01
TASKS_PER_SUITE = 20
OVERLAP = 3
TRAINING_PASSING_SKILL = 90
WORKER_REGIONS = [225, 187, 159, 149]
WORKER_LANGUAGES = ["RU"]
WORKER_CLIENTS = ["TOLOKA_APP", "BROWSER"]
INCOME_LIMIT_24H = 20.0
SKIPPED_IN_ROW_LIMIT = 10
MAJORITY_ANSWER_THRESHOLD = 3
MAJORITY_HISTORY_SIZE = 10
MAJORITY_MIN_ANSWERS = 4
MAJORITY_MIN_CORRECT_PCT = 75

# Feature extraction constants.
SAMPLE_RATE = 22050
N_FFT = 2048
HOP_LENGTH = 1024
N_MELS = 128
MINUTE_FRAMES = 1292
LOG_FLOOR = 1e-6
N_SHARDS = 20

# Split / batch defaults.
TEST_SPLIT = 0.1
SPLIT_SEED = 2021
BATCH_SIZE = 9
KEYWORDS_TOP = 10
KEYWORD_VOCAB_SIZE = 50
TOP_K_EMOTIONS = 3
# ---------------------------------------------------------------------------

TRACKS = T.StructType([
    T.StructField("ym_track_id", T.LongType()),
    T.StructField("ym_album_id", T.LongType()),
    T.StructField("track_title", T.StringType()),
    T.StructField("artist_name", T.StringType()),
    T.StructField("cover_url", T.StringType()),
    T.StructField("ym_genre", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("emotions_maybe", T.ArrayType(T.StringType())),
    T.StructField("audio_path", T.StringType()),
    T.StructField("lyrics_path", T.StringType()),
    T.StructField("cover_path", T.StringType()),
    T.StructField("deezer_genres", T.ArrayType(T.StringType())),
    T.StructField("artist_country", T.StringType()),
    T.StructField("artist_sex", T.StringType()),
    T.StructField("artist_year", T.StringType()),
    T.StructField("emotions", T.ArrayType(T.StringType())),
])

# CSV edge of the tracks table: lists are '|'-joined strings.
TRACKS_CSV = T.StructType([
    T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType)
    for f in TRACKS.fields
])
LIST_COLUMNS = [f.name for f in TRACKS.fields if isinstance(f.dataType, T.ArrayType)]

TRACKS_FINAL = T.StructType([
    T.StructField("ym_track_id", T.LongType()),
    T.StructField("ym_album_id", T.LongType()),
    T.StructField("genre", T.StringType()),
    T.StructField("nation", T.StringType()),
    T.StructField("emotion", T.StringType()),
])

ANSWERS_RAW = T.StructType([
    T.StructField("answer_id", T.LongType()),
    T.StructField("worker_id", T.StringType()),
    T.StructField("submitted_at", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("reward", T.DoubleType()),
    T.StructField("audio_path", T.StringType()),
    T.StructField("result", T.StringType()),
])

ASSIGNMENTS = T.StructType([
    T.StructField("ym_track_id", T.LongType()),
    T.StructField("emotion", T.StringType()),
    T.StructField("NO", T.LongType()),
    T.StructField("YES", T.LongType()),
    T.StructField("rate", T.DoubleType()),
])

WORKERS = T.StructType([
    T.StructField("worker_id", T.StringType()),
    T.StructField("region", T.IntegerType()),
    T.StructField("language", T.StringType()),
    T.StructField("client", T.StringType()),
    T.StructField("skill", T.DoubleType()),
])

PLAYLISTS = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("tracks", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("albums", T.ArrayType(T.StructType([
            T.StructField("id", T.LongType()),
            T.StructField("genre", T.StringType()),
            T.StructField("year", T.IntegerType()),
            T.StructField("cover_uri", T.StringType()),
        ]))),
        T.StructField("artists", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
        T.StructField("download_info", T.ArrayType(T.StructType([
            T.StructField("codec", T.StringType()),
            T.StructField("bitrate", T.IntegerType()),
        ]))),
        T.StructField("lyrics", T.StringType()),
    ]))),
])

ARTIST_CACHE = T.StructType([
    T.StructField("artist_name", T.StringType()),
    T.StructField("artist_country", T.StringType()),
    T.StructField("artist_sex", T.StringType()),
    T.StructField("artist_year", T.StringType()),
    T.StructField("requests_cnt", T.IntegerType()),
])

ARTIST_RESPONSES = T.StructType([
    T.StructField("artist_name", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("body", T.StringType()),
])

GENRE_LOOKUP = T.StructType([
    T.StructField("track_title", T.StringType()),
    T.StructField("artist_name", T.StringType()),
    T.StructField("genres", T.ArrayType(T.StringType())),
])

KEYWORDS = T.StructType([
    T.StructField("track_id", T.LongType()),
    T.StructField("keywords", T.ArrayType(T.StructType([
        T.StructField("keyword", T.StringType()),
        T.StructField("weight", T.DoubleType()),
    ]))),
])

LYRICS = T.StructType([
    T.StructField("track_id", T.LongType()),
    T.StructField("text", T.StringType()),
])

FEATURE_FRAMES = T.StructType([
    T.StructField("track_id", T.LongType()),
    T.StructField("bucket", T.IntegerType()),
    T.StructField("chunk", T.IntegerType()),
    T.StructField("frame", T.IntegerType()),
    T.StructField("mel", T.ArrayType(T.FloatType())),
])

PCM = T.StructType([
    T.StructField("track_id", T.LongType()),
    T.StructField("block", T.IntegerType()),
    T.StructField("samples", T.ArrayType(T.FloatType())),
])

LABELS = T.StructType([
    T.StructField("track_id", T.LongType()),
    T.StructField("labels", T.ArrayType(T.StringType())),
])

SCORES = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("scores", T.ArrayType(T.DoubleType())),
    T.StructField("label", T.IntegerType()),
])

EMOTION_FONTS = T.StructType([
    T.StructField("emotion", T.StringType()),
    T.StructField("fonts", T.ArrayType(T.StringType())),
])

IMAGES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("track_id", T.LongType()),
])

PAIR_TASKS = T.StructType([
    T.StructField("image_first", T.StringType()),
    T.StructField("image_second", T.StringType()),
    T.StructField("audio_path", T.StringType()),
])

HISTORY = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
])


def vocabulary(spark: SparkSession, names: list[str], name_col: str = "name", idx_col: str = "idx") -> DataFrame:
    """``(idx int, name string)`` table of a fixed vocabulary, index = position."""
    schema = T.StructType([T.StructField(idx_col, T.IntegerType(), False), T.StructField(name_col, T.StringType(), False)])
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], schema)


def mapping_table(spark: SparkSession, mapping: dict, key_col: str, value_col: str, value_type=None) -> DataFrame:
    value_type = value_type or T.StringType()
    schema = T.StructType([T.StructField(key_col, T.StringType(), False), T.StructField(value_col, value_type, True)])
    return spark.createDataFrame(list(mapping.items()), schema)
