"""Delimited-list codec at CSV edges (F-1, F-2, F-3) and small list helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .._compat import col_of


def split_list(c, sep: str = "|") -> Column:
    """F-1: ``'a|b'`` -> ``['a','b']``; null -> null; ``''`` -> ``[]``.

    ``split`` takes a regex, so the separator is escaped, and the empty
    tokens that ``split('')`` yields are filtered out.
    """
    c = col_of(c)
    parts = F.split(c, re.escape(sep))
    return F.when(c.isNull(), F.lit(None)).otherwise(F.filter(parts, lambda x: x != F.lit("")))


def join_list(c, sep: str = "|") -> Column:
    """F-2: array -> delimited string (nulls are skipped by ``array_join``)."""
    return F.array_join(col_of(c), sep)


def split_weights(c, sep: str = ";") -> Column:
    """F-3: ``'0.5;0.2'`` -> ``[0.5, 0.2]``; bad numbers become null."""
    return F.transform(split_list(c, sep), lambda x: x.try_cast("double"))


def keyword_structs(keywords, weights, sep: str = ";") -> Column:
    """Zip a keyword list and a weight list into ``array<struct<keyword, weight>>``."""
    zipped = F.arrays_zip(split_list(keywords, sep).alias("keyword"), split_weights(weights, sep).alias("weight"))
    return F.transform(zipped, lambda s: F.struct(s["keyword"].alias("keyword"), s["weight"].alias("weight")))


def append_distinct(old, new) -> Column:
    """A-8 for two lists: append the new values that are absent, keep order."""
    old = F.coalesce(col_of(old), F.array().cast("array<string>"))
    new = F.coalesce(col_of(new), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(old, new))


def non_empty(c) -> Column:
    c = col_of(c)
    return c.isNotNull() & (F.size(c) > 0)
