"""Path, URL and key expressions (F-4..F-7, F-9..F-11)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .._compat import col_of
from ..schemas import N_SHARDS


def lower_key(c) -> Column:
    """F-4: lower-cased join key."""
    return F.lower(col_of(c))


def track_id_from_url(c, base_url: str | None = None) -> Column:
    """F-5: ``<base>…/album:track.mp3`` -> track, else ``<base>…/track.mp3`` -> track, else null.

    The base URL and the dots are escaped (they were plain regex text in the
    reference, a quirk we do not keep).
    """
    return F.nullif(F.regexp_extract(col_of(c), track_url_pattern(base_url), 1), F.lit("")).try_cast("bigint")


def track_url_pattern(base_url: str | None = None) -> str:
    """Regex of F-5; group 1 is the track id."""
    if base_url:
        return "^" + re.escape(base_url) + r".+/(?:\d+:)?(\d+)\.mp3"
    return r"/(?:\d+:)?(\d+)\.mp3"


def remove_album_from_name(c) -> Column:
    """F-6: ``…/album:track.mp3`` -> ``…/track.mp3`` (new name only, no file moves)."""
    return F.regexp_replace(col_of(c), r"/\d+:(\d+\.mp3)$", "/$1")


def audio_path_default(track_id, album_id=None, audio_dir: str = "audio") -> Column:
    """F-7: relative path of a track's audio, with the album prefix when given."""
    tid = col_of(track_id).cast("string")
    if album_id is None:
        return F.concat(F.lit(audio_dir + "/"), tid, F.lit(".mp3"))
    return F.concat(F.lit(audio_dir + "/"), col_of(album_id).cast("string"), F.lit(":"), tid, F.lit(".mp3"))


def audio_url(track_id, base_url: str) -> Column:
    """F-7: public URL of a track's audio."""
    return F.concat(F.lit(base_url.rstrip("/") + "/"), col_of(track_id).cast("string"), F.lit(".mp3"))


def short_audio_path(c, short_dir: str = "audio_short") -> Column:
    """F-7: same file name in the short-audio folder."""
    return F.regexp_replace(col_of(c), r"^(.*/)?([^/]+)$", short_dir + "/$2")


def cover_template(c, size: str = "1000x1000") -> Column:
    """F-9: cover URI template ``%%`` -> size."""
    return F.replace(col_of(c), F.lit("%%"), F.lit(size))


def https(c) -> Column:
    return F.concat(F.lit("https://"), col_of(c))


def file_name(c) -> Column:
    """Last path segment, query and fragment removed."""
    path = F.regexp_replace(col_of(c), r"[?#].*$", "")
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(c) -> Column:
    """F-10: file name without its extension."""
    return F.regexp_replace(file_name(c), r"\.[^.]*$", "")


def file_ext(c) -> Column:
    """F-10: extension without the dot, null when none."""
    return F.nullif(F.regexp_extract(file_name(c), r"\.([^.]*)$", 1), F.lit(""))


def shard_of(track_id, n: int = N_SHARDS) -> Column:
    """F-11: shard number ``pmod(id, n)`` (the reference always used 20)."""
    return F.pmod(col_of(track_id), F.lit(n)).cast("int")


def track_key(album_id, track_id, suffix) -> Column:
    """U-2 key builder ``album:track:suffix`` (kept as columns elsewhere)."""
    return F.concat_ws(":", col_of(album_id).cast("string"), col_of(track_id).cast("string"), col_of(suffix).cast("string"))
