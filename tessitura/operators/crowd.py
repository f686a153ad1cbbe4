"""Crowd labelling: vote, confirm, upsert, task suites and worker-quality windows.

Input is a raw answers table, one row per worker answer
(``answer_id, worker_id, submitted_at, status, reward, audio_path, result``)
plus the pool's class in ``emotion``.  All windows are bounded by a block
(a day, a span of days, a position chunk) so a very active worker never lands
in one task; skewed joins on a task key are split by AQE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._compat import col_of
from ..functions.paths import track_id_from_url
from ..schemas import (
    EMOTIONS,
    INCOME_LIMIT_24H,
    MAJORITY_ANSWER_THRESHOLD,
    MAJORITY_HISTORY_SIZE,
    MAJORITY_MIN_ANSWERS,
    MAJORITY_MIN_CORRECT_PCT,
    SKIPPED_IN_ROW_LIMIT,
    TASKS_PER_SUITE,
    TRAINING_PASSING_SKILL,
    WORKER_CLIENTS,
    WORKER_LANGUAGES,
    WORKER_REGIONS,
    vocabulary,
)
from ..session import bounded_broadcast, materialize
from .ordering import day_block, dense_index, epoch_micros, near_equal_parts, quantile_block

DAY_MICROS = 86_400_000_000
MONEY = "decimal(20,4)"
BUSY_TIMES = 1 << 20  # times of one worker that one window may hold


# --------------------------------------------------------------------- A-1 / L-1
def majority_vote(
    answers: DataFrame,
    emotion=None,
    input_col: str = "audio_path",
    result_col: str = "result",
    emotion_col: str = "emotion",
    base_url: str | None = None,
    keep_input: bool = False,
) -> DataFrame:
    """A-1: per (pool class, task input) count YES and NO, track id from the URL, ``rate = YES/(YES+NO)``.

    ``emotion`` is a literal pool class, or None to take it from ``emotion_col``.
    One hash aggregate with map-side partial counts; a hot task collapses to
    one row per map task before the shuffle.  Missing answers count 0; a task
    with no YES/NO answer gets a null rate (Q-6).  ``keep_input`` keeps the task
    input, which with the class is the row's key.
    """
    src = answers if emotion is None else answers.withColumn(emotion_col, F.lit(emotion))
    res = col_of(result_col)
    counts = src.groupBy(emotion_col, input_col).agg(
        F.count_if(res == "NO").alias("NO"),
        F.count_if(res == "YES").alias("YES"),
    )
    return counts.select(
        *([input_col] if keep_input else []),
        track_id_from_url(F.col(input_col), base_url).alias("ym_track_id"),
        F.col(emotion_col).alias("emotion"),
        F.col("NO").cast("long").alias("NO"),
        F.col("YES").cast("long").alias("YES"),
        F.try_divide(F.col("YES").cast("double"), (F.col("YES") + F.col("NO")).cast("double")).alias("rate"),
    )


def sort_by_rate(assignments: DataFrame) -> DataFrame:
    """L-1: rate descending (nulls last), then track id and class for a total order."""
    return assignments.orderBy(F.desc_nulls_last("rate"), F.asc_nulls_last("ym_track_id"), F.asc("emotion"))


# --------------------------------------------------------------------- A-2 / J-13
def confirmed_labels(assignments: DataFrame, threshold: float = 1.0, vocab: Sequence[str] = EMOTIONS) -> DataFrame:
    """A-2: ``(ym_track_id, emotions)`` for assignments with ``rate >= threshold``.

    Labels come out in vocabulary order (unknown names last, then A-Z).  The
    collect runs per track over at most one row per class.
    """
    spark = assignments.sparkSession
    voc = bounded_broadcast(vocabulary(spark, list(vocab), "emotion", "_vidx"), len(vocab))
    ok = assignments.where(F.col("rate") >= F.lit(threshold)).where(F.col("ym_track_id").isNotNull())
    ranked = ok.select("ym_track_id", "emotion").join(voc, "emotion", "left")
    # collect_set dedups (track, class) inside the one aggregation: a single shuffle by track
    grouped = ranked.groupBy("ym_track_id").agg(
        F.array_sort(F.collect_set(F.struct(F.coalesce("_vidx", F.lit(len(vocab))).alias("i"), F.col("emotion").alias("e")))).alias("_s")
    )
    return grouped.select("ym_track_id", F.transform("_s", lambda s: s["e"]).alias("emotions"))


def apply_confirmed(tracks: DataFrame, confirmed: DataFrame, track_col: str = "ym_track_id", out_col: str = "emotions") -> DataFrame:
    """J-13: every track gets its confirmed labels, ``[]`` when none."""
    conf = confirmed.withColumnRenamed("ym_track_id", "_tid").withColumnRenamed("emotions", "_emos")
    base = tracks.drop(out_col) if out_col in tracks.columns else tracks
    joined = base.join(conf, F.col(track_col) == F.col("_tid"), "left")
    return joined.withColumn(out_col, F.coalesce("_emos", F.array().cast("array<string>"))).drop("_tid", "_emos")


# --------------------------------------------------------------------- U-2 / W-2
def upsert_assignments(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("ym_track_id", "emotion")) -> DataFrame:
    """U-2 / W-2: union old and new assignments; one row per key stays.

    The kept row is the last one in the order (old before new, rate from high
    to low, no rate last): new beats old, and of several rows of one version
    (two URLs of a track) the lowest rate wins, then the fewest YES, then the
    fewest NO.  Rows without a track id are one key per class, like any id.
    One aggregate by key with partial aggregation.
    """
    cols = list(old.columns)
    tagged = old.select(*cols, F.lit(0).alias("_ver")).unionByName(new.select(*cols, F.lit(1).alias("_ver")))
    payload = [c for c in cols if c not in keys]
    last = F.struct("_ver", F.col("rate").isNull(), -F.col("rate"), -F.col("YES"), -F.col("NO"))
    agg = tagged.groupBy(*keys).agg(F.max_by(F.struct(*payload), last).alias("_row"))
    return agg.select(*keys, *[F.col("_row")[c].alias(c) for c in payload]).select(*cols)


# --------------------------------------------------------------------- J-1 / J-2
def unassigned(tracks: DataFrame, assignments: DataFrame, track_col: str = "ym_track_id") -> DataFrame:
    """J-1: tracks with no assignment (anti join)."""
    ids = assignments.select(F.col("ym_track_id").alias("_tid")).where(F.col("_tid").isNotNull())
    return tracks.join(ids, F.col(track_col) == F.col("_tid"), "left_anti")


def assigned(tracks: DataFrame, assignments: DataFrame, track_col: str = "ym_track_id") -> DataFrame:
    """J-2: tracks that have an assignment (semi join; the reference names it "filter_assigned")."""
    ids = assignments.select(F.col("ym_track_id").alias("_tid"))
    return tracks.join(ids, F.col(track_col) == F.col("_tid"), "left_semi")


# --------------------------------------------------------------------- P-15 / W-7
def task_projection(tracks: DataFrame, base_url: str, emotion=None, path_col: str = "audio_path", emotion_col: str = "emotion",
                    keep: Sequence[str] = ()) -> DataFrame:
    """P-15: tasks ``(emotion, audio_url)`` from tracks; the URL is ``base + audio_path`` (``keep``: extra columns)."""
    emo = F.lit(emotion) if emotion is not None else F.col(emotion_col)
    return tracks.select(emo.alias("emotion"), *keep, F.concat(F.lit(base_url), F.col(path_col)).alias("audio_path"))


def task_suites(
    tasks: DataFrame,
    order_cols: Sequence = ("audio_path",),
    group_cols: Sequence[str] = ("emotion",),
    per_suite: int = TASKS_PER_SUITE,
    block: Column | None = None,
) -> DataFrame:
    """W-7: per pool, cut the ordered tasks into ``ceil(n/per_suite)`` near-equal suites.

    Positions come from :func:`dense_index` (blocked, no whole-pool sort);
    sizes equal ``numpy.array_split``.  Adds ``task_idx`` and ``suite``.
    """
    # ``block`` must be monotone in ``order_cols``; without one, the first order column is cut at its quantiles
    blk = block if block is not None else quantile_block(tasks, order_cols[0])
    indexed = dense_index(tasks, order_cols, blk, partition_cols=group_cols, idx_col="task_idx", total_col="_n")
    k = F.ceil(F.col("_n") / F.lit(per_suite))
    return indexed.withColumn("suite", near_equal_parts("task_idx", "_n", k)).drop("_n")


# --------------------------------------------------------------------- P-18 / P-19
def eligible_workers(
    workers: DataFrame,
    regions: Sequence[int] = WORKER_REGIONS,
    languages: Sequence[str] = WORKER_LANGUAGES,
    clients: Sequence[str] = WORKER_CLIENTS,
    min_skill: float | None = TRAINING_PASSING_SKILL,
) -> DataFrame:
    """P-18 and P-19: region AND language AND client filter, then the training gate."""
    cond = F.col("region").isin(list(regions)) & F.col("language").isin(list(languages)) & F.col("client").isin(list(clients))
    if min_skill is not None:
        cond = cond & (F.col("skill") >= F.lit(min_skill))
    return workers.where(cond)


# --------------------------------------------------------------------- W-4
def income_last_24h(
    answers: DataFrame,
    worker_col: str = "worker_id",
    time_col: str = "submitted_at",
    reward_col: str = "reward",
    limit: float = INCOME_LIMIT_24H,
    busy_times: int = BUSY_TIMES,
) -> DataFrame:
    """W-4: per answer, the worker's income over the last 24 h (inclusive); restricted when >= limit.

    An answer adds its reward when it is given and takes it back when its 24
    hours are over, so the income is a running sum over these events.  Events of
    one worker at one time are added up first; the sums run over a worker's times.
    Workers of more than ``busy_times`` times have them cut into stretches with near-equal
    numbers of events, and the sums run in two levels, over stretches and over their
    totals, so no task holds more, however many answers a worker has.  The
    answers then look their time up (a hot worker and time is an equi-join that
    AQE splits).  Rewards are summed as decimals.  Answers without a time see
    each other only; answers without a worker are one worker.
    """
    base = answers.withColumn("_key", F.struct(F.col(worker_col).alias("w"), epoch_micros(answers, time_col).alias("at")))
    pay = F.coalesce(F.col(reward_col).cast(MONEY), F.lit(0).cast(MONEY))
    given = F.struct("_key.at", pay.alias("pay"), F.lit(1).alias("given"))
    over = F.struct((F.col("_key.at") + DAY_MICROS + 1).alias("at"), (-pay).cast(MONEY).alias("pay"), F.lit(0).alias("given"))
    events = base.select(F.col("_key.w").alias("w"), F.inline(F.when(F.col("_key.at").isNull(), F.array(given)).otherwise(F.array(given, over))))
    times = materialize(events.groupBy("w", "at").agg(F.sum("pay").alias("pay"), F.max("given").alias("given")), "income-times")
    busy = materialize(times.groupBy("w").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > busy_times).select(F.col("w").alias("_w")), "income-busy")
    # a worker is one stretch of time, a busy one is cut into many
    stretch = F.lit(0).cast("long")
    if not busy.isEmpty():
        flagged = times.join(busy.withColumn("_busy", F.lit(True)), F.col("w").eqNullSafe(F.col("_w")), "left")
        times, stretch = flagged.drop("_w"), F.when(F.col("_busy"), quantile_block(times, "at")).otherwise(stretch)
    placed = times.withColumn("_blk", F.struct("w", F.when(F.col("at").isNotNull(), stretch).alias("b"))).repartition("_blk")
    inside = Window.partitionBy("_blk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_run", F.sum("pay").over(inside))
    # answers without a time are a stretch of their own that no other sees
    totals = placed.groupBy("_blk").agg(F.sum(F.when(F.col("at").isNotNull(), F.col("pay")).otherwise(F.lit(0).cast(MONEY))).alias("_sum"))
    earlier = Window.partitionBy("_blk.w").orderBy("_blk.b").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_blk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    incomes = placed.where("given = 1").join(before, "_blk").select(F.struct("w", "at").alias("_key"), (F.col("_before") + F.col("_run")).alias("income_24h"))
    out = base.join(incomes, "_key").drop("_key")
    out = out.withColumn("restricted", F.col("income_24h") >= F.lit(limit).cast(MONEY))
    return out.withColumn("income_24h", F.col("income_24h").cast("double"))


# --------------------------------------------------------------------- W-5
def skipped_in_row(
    answers: DataFrame,
    skipped: Column,
    order_cols: Sequence,
    worker_col: str = "worker_id",
    time_col: str = "submitted_at",
    limit: int = SKIPPED_IN_ROW_LIMIT,
    block_days: int = 30,
) -> DataFrame:
    """W-5: length of the run of skipped answers ending at each answer; restricted when >= limit.

    The run length is the distance to the last non-skipped answer.  Rows are
    shuffled once, by (worker, ``block_days``-day block); positions inside the
    block come from a window, and a small table with one row per block carries
    the rows and the last non-skipped position of all earlier blocks.  Answers
    without a time are the first block, those without a worker one worker.
    """
    block = F.struct(F.col(worker_col).alias("w"), day_block(epoch_micros(answers, time_col), block_days).alias("d"))
    base = answers.withColumn("_skip", F.coalesce(skipped, F.lit(False))).withColumn("_blk", block).repartition("_blk")
    w_in = Window.partitionBy("_blk").orderBy(*[col_of(c) for c in order_cols])
    placed = base.withColumn("_i", F.row_number().over(w_in))
    answered = F.when(~F.col("_skip"), F.col("_i"))
    placed = placed.withColumn("_last", F.max(answered).over(w_in.rowsBetween(Window.unboundedPreceding, 0)))
    per_block = placed.groupBy("_blk").agg(F.max("_i").alias("_n"), F.max("_last").alias("_end"))
    w_prev = Window.partitionBy("_blk.w").orderBy("_blk.d").rowsBetween(Window.unboundedPreceding, -1)
    before = per_block.withColumn("_before", F.coalesce(F.sum("_n").over(w_prev), F.lit(0)))
    carry = before.withColumn("_carry", F.max(F.col("_before") + F.col("_end")).over(w_prev)).select("_blk", "_before", "_carry")
    last = F.coalesce(F.col("_before") + F.col("_last"), F.col("_carry"), F.lit(0))
    streak = F.when(F.col("_skip"), F.col("_before") + F.col("_i") - last).otherwise(F.lit(0)).cast("long")
    out = placed.join(carry, "_blk").withColumn("skipped_in_row", streak)
    return out.withColumn("restricted", F.col("skipped_in_row") >= F.lit(limit)).drop("_skip", "_blk", "_i", "_last", "_before", "_carry")


# --------------------------------------------------------------------- W-6
def majority_answers(
    answers: DataFrame,
    task_cols: Sequence[str] = ("emotion", "audio_path"),
    result_col: str = "result",
    threshold: int = MAJORITY_ANSWER_THRESHOLD,
    values: Sequence[str] = ("YES", "NO"),
) -> DataFrame:
    """Majority answer per task: the one value given by at least ``threshold`` workers (none when two are).

    One aggregate with a ``count_if`` per known answer value (like a pivot with
    given values), so a single shuffle by task.
    """
    counts = answers.groupBy(*task_cols).agg(*[F.count_if(F.col(result_col) == F.lit(v)).alias(f"_c{i}") for i, v in enumerate(values)])
    reached = [F.col(f"_c{i}") >= F.lit(threshold) for i in range(len(values))]
    n_reached = sum((r.cast("int") for r in reached), F.lit(0))
    pick = F.lit(None).cast("string")
    for i in reversed(range(len(values))):
        pick = F.when(reached[i], F.lit(values[i])).otherwise(pick)
    return counts.where(n_reached == 1).select(*task_cols, pick.alias("majority"))


def majority_agreement(
    answers: DataFrame,
    order_cols: Sequence,
    task_cols: Sequence[str] = ("emotion", "audio_path"),
    worker_col: str = "worker_id",
    time_col: str = "submitted_at",
    result_col: str = "result",
    threshold: int = MAJORITY_ANSWER_THRESHOLD,
    history: int = MAJORITY_HISTORY_SIZE,
    min_answers: int = MAJORITY_MIN_ANSWERS,
    min_correct_pct: float = MAJORITY_MIN_CORRECT_PCT,
    chunk: int = 4096,
    block_days: int = 30,
) -> DataFrame:
    """W-6: over each worker's last ``history`` answers to tasks that reached a majority,
    the share that agreed with it; restricted when ``>= min_answers`` answers and ``< min_correct_pct`` %.

    Exact per-worker positions (:func:`dense_index`, ``block_days`` blocks), then fixed
    position chunks; in the same pass the last ``history-1`` rows of a chunk are also
    dealt to the next chunk as context, so each window task holds ``chunk + history``
    rows.  The scored answers are written once, as positions read them twice (a job
    runs when this is called); a task with a large share of the answers is left to
    AQE's skew join.  Null workers are one worker, null times come first.
    """
    key = F.struct(*task_cols)  # null-safe
    major = majority_answers(answers, task_cols, result_col, threshold).select(key.alias("_task"), "majority")
    scored = answers.withColumn("_task", key).join(major, "_task").drop("_task")
    scored = materialize(scored.withColumn("correct", (F.col(result_col) == F.col("majority")).cast("int")), "scored-answers")
    indexed = dense_index(scored, order_cols, day_block(epoch_micros(scored, time_col), block_days), partition_cols=[worker_col], idx_col="_pos")
    own = F.floor(F.col("_pos") / F.lit(chunk)).cast("long")
    context = F.pmod(F.col("_pos"), F.lit(chunk)) >= F.lit(chunk - (history - 1))
    dealt = indexed.withColumn("_own", own).withColumn("_chunk", F.explode(F.when(context, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    w = Window.partitionBy(worker_col, "_chunk").orderBy("_pos").rowsBetween(-(history - 1), 0)
    out = (
        dealt.withColumn("n_recent", F.count(F.lit(1)).over(w))
        .withColumn("correct_pct", F.avg("correct").over(w) * 100.0)
        .where(F.col("_chunk") == F.col("_own"))
        .withColumn("n_total", F.col("_pos") + 1)
    )
    restricted = (F.col("n_total") >= F.lit(min_answers)) & (F.col("correct_pct") < F.lit(min_correct_pct))
    return out.withColumn("restricted", restricted).drop("_pos", "_chunk", "_own")
