"""Image-pair study tables (J-6, P-16, P-17, R-3): generated covers compared with the
original cover, with another generator's image, or with a random generated cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .split import random_partner

BASE = "https://static.tracks.example/data/"
AUDIO = "audios/%d.mp3"
GENERATED = "images/%d_gen.jpg"
OTHER_GENERATED = "images-other/image-%d.jpg"


def pair_items(images: DataFrame, tracks: DataFrame, base: str = BASE, key: str = "track_id") -> tuple[DataFrame, DataFrame]:
    """J-6 + P-17 ``load``: generated-image manifest rows joined to their tracks (inner), with the
    audio, original-cover and generated-cover URLs; second result: manifest rows with no track."""
    t = tracks.select(F.col("ym_track_id").alias(key), "genre", "cover_url")
    items = images.join(t, key, "inner").select(
        key, "genre",
        F.format_string(base + AUDIO, F.col(key)).alias("url_audio"),
        F.concat(F.lit("https://"), F.col("cover_url")).alias("url_cover"),
        F.format_string(base + GENERATED, F.col(key)).alias("url_cover_generated"),
    )
    missing = images.join(t.select(key), key, "left_anti")
    return items, missing


def pairs_original(items: DataFrame) -> DataFrame:
    """P-16 ``original`` / P-17 ``my_vs_original``: original cover first, generated second."""
    return items.select(F.col("url_cover").alias("image_first"), F.col("url_cover_generated").alias("image_second"),
                        F.col("url_audio").alias("audio_path"))


def pairs_analog(items: DataFrame, key: str = "track_id", n_other: int = 1000, seed: int = 0, base: str = BASE) -> DataFrame:
    """P-16 ``analog`` / P-17 ``my_vs_album_cover_generation``: generated cover vs image ``1..n_other``
    of another generator, the index a reproducible hash of (seed, track)."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("analog"), F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    other = F.format_string(base + OTHER_GENERATED, (F.pmod(h, F.lit(n_other)) + 1).cast("int"))
    return items.select(F.col("url_cover_generated").alias("image_first"), other.alias("image_second"), F.col("url_audio").alias("audio_path"))


def pairs_random(items: DataFrame, key: str = "track_id", seed: int = 0) -> DataFrame:
    """P-16 ``random``: generated cover vs the generated cover of a random row (may be itself), R-3."""
    partner = random_partner(items.select(key, "url_cover_generated", "url_audio"), key, seed=seed, exclude_self=False)
    covers = items.select(F.col(key).alias("partner_" + key), F.col("url_cover_generated").alias("_other"))
    j = partner.join(covers, "partner_" + key, "left")
    return j.select(F.col("url_cover_generated").alias("image_first"), F.col("_other").alias("image_second"), F.col("url_audio").alias("audio_path"))
