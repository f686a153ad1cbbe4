"""Labels, top-k and metrics over score tables (M-4, M-6..M-10, A-9, W-3, J-11, J-12, R-4, F-12, F-14, F-16)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._compat import col_of
from ..functions.scores import argmax, topk_indices
from ..schemas import EMOJI, EMOTION_WORDS, EMOTIONS
from ..session import bounded_broadcast


def encode_labels(df: DataFrame, label_col: str, vocab: Sequence[str], out_col: str = "label_idx", sort_vocab: bool = True) -> DataFrame:
    """M-4: name -> index through a vocabulary (sorted A-Z by default, like a fitted encoder).

    One vocabulary table with explicit indexes serves both directions (Q-2).
    """
    names = sorted(vocab) if sort_vocab else list(vocab)
    lit_map = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    return df.withColumn(out_col, F.try_element_at(lit_map, F.col(label_col)).cast("int"))


def topk_accuracy_expr(scores_col, label_col, k: int) -> Column:
    """M-6 as an aggregate expression."""
    return F.avg(F.array_contains(topk_indices(scores_col, k), col_of(label_col)).cast("double"))


def cover_accuracy_expr(true_col, pred_col) -> Column:
    """M-7 as an aggregate expression: share of rows where the two label sets meet."""
    return F.avg(F.coalesce(F.arrays_overlap(col_of(true_col), col_of(pred_col)), F.lit(False)).cast("double"))


def topk_accuracy(df: DataFrame, scores_col: str, label_col: str, ks: Sequence[int] = (1, 3)) -> DataFrame:
    """M-6: share of rows whose label is among the top-k scores, for each k."""
    return df.agg(*[topk_accuracy_expr(scores_col, label_col, k).alias(f"top{k}_accuracy") for k in ks])


def cover_accuracy(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """M-7: share of rows where the true and predicted label sets meet."""
    return df.agg(cover_accuracy_expr(true_col, pred_col).alias("cover_accuracy"))


def confusion_matrix(df: DataFrame, true_col: str, pred_col: str, labels: Sequence) -> DataFrame:
    """M-8: counts per (true, predicted) over a fixed label list; every true label gets a row.

    Pivot values are given, so no extra job discovers them.
    """
    spark = df.sparkSession
    piv = df.groupBy(true_col).pivot(pred_col, list(labels)).agg(F.count(F.lit(1))).na.fill(0)
    labels_df = spark.createDataFrame([(v,) for v in labels], [true_col]).select(F.col(true_col).cast(df.schema[true_col].dataType))
    vocab = bounded_broadcast(labels_df, len(labels))
    out = vocab.join(piv, true_col, "left").na.fill(0)
    return out.select(true_col, *[F.col(f"`{v}`").cast("long").alias(f"pred_{v}") for v in labels])


def accuracy(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    return df.agg(F.avg((F.col(true_col) == F.col(pred_col)).cast("double")).alias("accuracy"))


def chunk_vote(chunks: DataFrame, key_col: str, chunk_col: str, scores_col: str, k_chunk: int = 3, k_out: int = 3) -> DataFrame:
    """A-9 + W-3: each chunk's top-``k_chunk`` labels, counted over all chunks of a key; the
    ``k_out`` most frequent, ties by first appearance (chunk, rank), then label.

    The reference counted tensors by identity, so it returned the first chunk's
    top-k (Q-1); this is the real vote.  Pre-aggregated per (key, label) before
    the window, which then sees at most one row per label.
    """
    top = chunks.select(key_col, chunk_col, F.posexplode(topk_indices(scores_col, k_chunk)).alias("rank", "label"))
    counts = top.groupBy(key_col, "label").agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct(chunk_col, "rank")).alias("_first"))
    w = Window.partitionBy(key_col).orderBy(F.desc("votes"), F.asc("_first"), F.asc("label"))
    ranked = counts.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k_out)
    return ranked.select(key_col, "label", "votes", (F.col("pos") - 1).alias("pos"))


def collect_ranked(df: DataFrame, key_col: str, value_col: str, pos_col: str = "pos", out_col: str = "labels") -> DataFrame:
    """Re-assemble a small ranked list (at most k rows per key) into an array."""
    g = df.groupBy(key_col).agg(F.array_sort(F.collect_list(F.struct(pos_col, value_col))).alias("_s"))
    return g.select(key_col, F.transform("_s", lambda s: s[value_col]).alias(out_col))


def emoji_of(c) -> Column:
    """F-12: display emoji of an emotion, ``''`` when unknown."""
    lit_map = F.create_map(*[F.lit(x) for kv in EMOJI.items() for x in kv])
    return F.coalesce(F.try_element_at(lit_map, col_of(c)), F.lit(""))


def emotion_words_of(c) -> Column:
    """F-12: task-page words of an emotion, the emotion name itself when unknown."""
    lit_map = F.create_map(*[F.lit(x) for kv in EMOTION_WORDS.items() for x in kv])
    return F.coalesce(F.try_element_at(lit_map, col_of(c)), col_of(c))


def fonts_lookup(df: DataFrame, fonts: DataFrame, emotion_col: str = "emotion") -> DataFrame:
    """J-11: emotion -> fonts, ``[]`` when unknown.  The font lists grow with the data, so the join is not hinted."""
    f = fonts.select(F.col("emotion").alias("_fe"), F.col("fonts").alias("_fonts"))
    j = df.join(f, F.col(emotion_col) == F.col("_fe"), "left")
    return j.withColumn("fonts", F.coalesce("_fonts", F.array().cast("array<string>"))).drop("_fe", "_fonts")


def seeded_picks(items, key, n: int = 5, seed: int = 0) -> Column:
    """R-4: ``n`` picks with replacement from ``items``, reproducible from (key, i, seed).

    The pick index is the first 8 hex digits of ``md5(key:i:seed)`` modulo the
    list size (so SQL engines with md5 can reproduce it).
    """
    items, key = col_of(items), col_of(key)

    def pick(i):
        h = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), i.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
        return F.element_at(items, (F.pmod(h, F.size(items)) + 1).cast("int"))

    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), pick)).otherwise(F.array().cast("array<string>"))


def result_json(kind: str, payload: Column) -> Column:
    """F-14: ``{"result": {kind: payload}}`` for emotions, keywords and error messages; ``kind='fonts'`` takes an
    array of ``struct<emotion, fonts>`` and gives ``{"result": [{"emotion": .., "fonts": [..]}, ..]}``."""
    body = payload if kind == "fonts" else F.struct(payload.alias(kind))
    return F.to_json(F.struct(body.alias("result")), {"ignoreNullFields": "false"})


def ranked_fields(labels, k: int, prefix: str) -> list[Column]:
    """F-16: ``prefix_1..prefix_k`` from a ranked list (null past its end)."""
    lab = col_of(labels)
    return [F.try_element_at(lab, F.lit(i + 1)).alias(f"{prefix}_{i + 1}") for i in range(k)]


def mislabels(predictions: DataFrame, labels: DataFrame, tracks: DataFrame, key: str = "track_id") -> DataFrame:
    """J-12 / U-5: tracks whose predicted label is not among their true labels, as distinct (pred, audio_path)."""
    j = predictions.join(labels, key).join(tracks.select(key, "audio_path"), key)
    return j.where(~F.coalesce(F.array_contains("labels", F.col("pred")), F.lit(False))).select("pred", "audio_path").distinct()


def request_errors(df: DataFrame, chunks_col: str | None = None, emotion_col: str | None = None, pred_col: str | None = None) -> DataFrame:
    """P-20: request validation: empty features, unknown emotion, empty prediction -> error text (null = ok)."""
    err = F.lit(None).cast("string")
    conds = []
    if chunks_col:
        conds.append((F.coalesce(F.size(chunks_col), F.lit(0)) <= 0, "Audio features are empty"))
    if emotion_col:
        conds.append((~F.coalesce(F.col(emotion_col).isin(EMOTIONS), F.lit(False)), "Unknown emotion"))
    if pred_col:
        conds.append((F.coalesce(F.size(pred_col), F.lit(0)) <= 0, "Prediction is empty"))
    for cond, msg in reversed(conds):
        err = F.when(cond, F.lit(msg)).otherwise(err)
    return df.withColumn("error", err)


def top1(df: DataFrame, scores_col: str, out_col: str = "pred") -> DataFrame:
    return df.withColumn(out_col, argmax(scores_col))
