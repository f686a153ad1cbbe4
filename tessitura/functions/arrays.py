"""Feature-array expressions (X-2, X-3, X-4, X-7, A-10): native higher-order functions,
so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .._compat import col_of
from ..schemas import LOG_FLOOR


def equal_chunks(arr, n: int) -> Column:
    """X-2: full chunks of ``n`` elements, the tail dropped; ``[]`` when shorter than ``n``.

    ``sequence(1, 0)`` runs backwards, so k = 0 is guarded explicitly.
    """
    arr = col_of(arr)
    k = F.floor(F.size(arr) / F.lit(n)).cast("int")
    chunks = F.transform(F.sequence(F.lit(1), k), lambda i: F.slice(arr, (i - 1) * n + 1, n))
    return F.when(arr.isNull(), F.lit(None)).when(k > 0, chunks).otherwise(F.array_repeat(F.slice(arr, 1, 0), 0))


def log_floor(arr, floor: float = LOG_FLOOR) -> Column:
    """X-3: zeros become ``floor``, then natural log."""
    return F.transform(col_of(arr), lambda x: F.log(F.when(x == 0, F.lit(floor)).otherwise(x.cast("double"))))


def pad_truncate(arr, n: int, fill: float = 0.0) -> Column:
    """X-4: pad with ``fill`` or cut to exactly ``n`` elements."""
    arr = col_of(arr)
    elem = F.lit(fill).cast("double")
    return F.slice(F.concat(arr.cast("array<double>"), F.array_repeat(elem, n)), 1, n)


def first_or_zeros(chunks, shape_len: int) -> Column:
    """X-7: the first chunk, or a zero chunk when there is none."""
    chunks = col_of(chunks)
    return F.coalesce(F.try_element_at(chunks, F.lit(1)), F.array_repeat(F.lit(0.0).cast("double"), shape_len))


def reshape(arr, width: int) -> Column:
    """Flat array -> rows of ``width`` (time-major frames)."""
    return equal_chunks(arr, width)


def mean_over_time(frames) -> Column:
    """A-10: element-wise mean of a list of equal-length frames (average pooling over time)."""
    frames = col_of(frames)
    first = F.try_element_at(frames, F.lit(1))
    zeros = F.transform(first, lambda _: F.lit(0.0).cast("double"))
    total = F.aggregate(frames, zeros, lambda acc, f: F.zip_with(acc, f, lambda a, b: a + b.cast("double")))
    n = F.size(frames)
    return F.when(n > 0, F.transform(total, lambda s: s / n))


def array_sum(arr) -> Column:
    return F.aggregate(col_of(arr), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double"))
