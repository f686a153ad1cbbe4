"""Log-mel features from a PCM table (X-1, X-5, X-6) and long-form chunking (X-2).

Input is ``(track_id, block, samples array<float>)`` with every block but the
last exactly ``block_size`` samples.  Each block is joined with the last
``n_fft/2`` samples of the block before and the first ``n_fft/2`` of the
block after (two equi-joins on ``(track_id, block)``), so every frame is
computed from one row: no task ever holds a whole track.  Where the blocks of
a track are known to stand in order in one partition (``placed``), the neighbours
are read in passing instead.  The STFT and mel projection run in NumPy, block by
block, and results leave in record batches of bounded size.

Mel filters follow the published Slaney-style definition used by common
audio libraries by default: ``fmin=0``, ``fmax=sr/2``, area-normalised
triangles; STFT with a periodic Hann window, ``center=True`` and zero
padding at the track ends; power 2.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread
from ..schemas import HOP_LENGTH, LOG_FLOOR, MINUTE_FRAMES, N_FFT, N_MELS, SAMPLE_RATE

BLOCK_SIZE = 1 << 16


def hz_to_mel(f):
    f = np.asarray(f, dtype=np.float64)
    f_sp = 200.0 / 3
    min_log_hz = 1000.0
    min_log_mel = min_log_hz / f_sp
    logstep = np.log(6.4) / 27.0
    return np.where(f >= min_log_hz, min_log_mel + np.log(np.maximum(f, 1e-12) / min_log_hz) / logstep, f / f_sp)


def mel_to_hz(m):
    m = np.asarray(m, dtype=np.float64)
    f_sp = 200.0 / 3
    min_log_hz = 1000.0
    min_log_mel = min_log_hz / f_sp
    logstep = np.log(6.4) / 27.0
    return np.where(m >= min_log_mel, min_log_hz * np.exp(logstep * (m - min_log_mel)), f_sp * m)


def hz_to_mel_htk(f):
    return 2595.0 * np.log10(1.0 + np.asarray(f, dtype=np.float64) / 700.0)


def mel_to_hz_htk(m):
    return 700.0 * (10.0 ** (np.asarray(m, dtype=np.float64) / 2595.0) - 1.0)


def mel_filterbank(sr: int = SAMPLE_RATE, n_fft: int = N_FFT, n_mels: int = N_MELS, scale: str = "slaney") -> np.ndarray:
    """``(n_mels, 1 + n_fft/2)`` triangular mel filters.

    ``scale='slaney'``: Slaney mel scale, area-normalised (first extractor);
    ``scale='htk'``: HTK mel scale, no normalisation (second extractor's defaults).
    """
    to_mel, to_hz = (hz_to_mel, mel_to_hz) if scale == "slaney" else (hz_to_mel_htk, mel_to_hz_htk)
    fft_freqs = np.linspace(0, sr / 2.0, 1 + n_fft // 2)
    mel_pts = to_hz(np.linspace(to_mel(0.0), to_mel(sr / 2.0), n_mels + 2))
    fdiff = np.diff(mel_pts)
    ramps = mel_pts[:, None] - fft_freqs[None, :]
    lower = -ramps[:-2] / fdiff[:-1, None]
    upper = ramps[2:] / fdiff[1:, None]
    weights = np.maximum(0.0, np.minimum(lower, upper))
    if scale != "slaney":
        return weights
    enorm = 2.0 / (mel_pts[2 : n_mels + 2] - mel_pts[:n_mels])
    return weights * enorm[:, None]


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(n) / n)


def log_mel_frames(signal: np.ndarray, first_frame_start: int, n_frames: int, n_fft: int = N_FFT, hop: int = HOP_LENGTH, mel: np.ndarray | None = None, floor: float = LOG_FLOOR) -> np.ndarray:
    """Log-mel of ``n_frames`` frames of ``signal`` starting at sample ``first_frame_start``; ``(n_frames, n_mels)``."""
    mel = mel_filterbank(n_fft=n_fft) if mel is None else mel
    if n_frames <= 0:
        return np.zeros((0, mel.shape[0]), dtype=np.float32)
    idx = first_frame_start + np.arange(n_frames)[:, None] * hop + np.arange(n_fft)[None, :]
    frames = signal[idx] * hann(n_fft)[None, :]
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    m = power @ mel.T
    m = np.where(m == 0, floor, m)
    return np.log(m).astype(np.float32)


def whole_signal_log_mel(y: np.ndarray, n_fft: int = N_FFT, hop: int = HOP_LENGTH) -> np.ndarray:
    """Reference path for tests: the same features over a whole signal in memory."""
    pad = n_fft // 2
    yp = np.concatenate([np.zeros(pad), np.asarray(y, dtype=np.float64), np.zeros(pad)])
    n = 1 + len(y) // hop
    return log_mel_frames(yp, 0, n, n_fft, hop)


FRAME_SCHEMA = T.StructType([
    T.StructField("track_id", T.LongType()),
    T.StructField("frame", T.IntegerType()),
    T.StructField("mel", T.ArrayType(T.FloatType())),
])


PACKED = 1 << 20  # numbers in one record batch made here


def _packed(rows, names: list[str], number: pa.DataType = pa.int32()):
    """Record batches of bounded size from ``(track, number, float32 array)`` rows."""
    ids, numbers, arrays, n = [], [], [], 0

    def batch():
        ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
        values = np.concatenate(arrays).astype(np.float32, copy=False)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, number), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=names)

    for tid, at, array in rows:
        ids.append(tid)
        numbers.append(at)
        arrays.append(array)
        n += len(array) + 1
        if n >= PACKED:
            yield batch()
            ids, numbers, arrays, n = [], [], [], 0
    if ids:
        yield batch()


def _lists(column: pa.Array):
    """Every list of a column as an array (a view), None for null."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    size = pc.list_value_length(column)
    ends = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False))
    for null, lo, hi in zip(column.is_null().to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
        yield None if null else values[lo:hi]


def _halos(batches, placed: bool):
    """``(track, block, samples, samples before, samples after)`` of every block; None where the track has no such block.

    The neighbours are columns of their own or, with ``placed``, the rows next to it.
    """
    rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), *(_lists(c) for c in b.columns[2:])))
    if not placed:
        yield from rows
        return
    follows = lambda x, y: x is not None and y is not None and x[0] == y[0] and x[1] + 1 == y[1]
    before = now = None
    for after in itertools.chain(rows, [None]):
        if now is not None:
            yield (*now, before[2] if follows(before, now) else None, after[2] if follows(now, after) else None)
        before, now = now, after


def _blocks_to_frames(block_size: int, n_fft: int, hop: int, n_mels: int, sr: int, scale: str = "slaney", placed: bool = False):
    half = n_fft // 2

    def frames(batches):
        mel = mel_filterbank(sr, n_fft, n_mels, scale)
        for tid, b, samples, prev, nxt in _halos(batches, placed):
            cur = samples.astype(np.float64)
            is_last = nxt is None
            p = np.zeros(half) if prev is None else prev[len(prev) - half :].astype(np.float64)
            nx = np.zeros(0) if nxt is None else nxt[:half].astype(np.float64)
            nx = np.concatenate([nx, np.zeros(half - len(nx))])
            local = np.concatenate([p, cur, nx])
            start_global = b * block_size
            t0 = start_global // hop
            if is_last:
                t1 = (start_global + len(cur)) // hop
            else:
                t1 = (start_global + block_size) // hop - 1
            n = t1 - t0 + 1
            for k, frame in enumerate(log_mel_frames(local, t0 * hop - start_global, n, n_fft, hop, mel)):
                yield tid, t0 + k, frame

    def run(batches):
        yield from _packed(frames(batches), ["track_id", "frame", "mel"])

    return run


def log_mel(pcm: DataFrame, block_size: int = BLOCK_SIZE, n_fft: int = N_FFT, hop: int = HOP_LENGTH, n_mels: int = N_MELS, sr: int = SAMPLE_RATE, channel: int | None = None, scale: str = "slaney", placed: bool = False) -> DataFrame:
    """X-1 / X-5: ``(track_id, frame, mel array<float>)`` time-major log-mel rows.

    X-5 is the same operator with ``channel`` (one channel of a multi-channel
    PCM table, ``channel`` column) and ``scale='htk'``, after :func:`resample_bandlimited`.

    ``placed`` says that the blocks of every track stand in order, one after the other, in one
    partition, as :func:`pcm_from_text` makes them for texts with ids of their own; their neighbours are
    then the rows next to them and no samples are shuffled.
    """
    if block_size % hop:
        raise ValueError("block_size must be a multiple of hop")
    src = pcm if channel is None else pcm.where(F.col("channel") == channel)
    src = src.select("track_id", "block", "samples")
    half = n_fft // 2
    if not placed:
        prev = src.select("track_id", (F.col("block") + 1).alias("block"), F.slice("samples", -half, half).alias("prev_tail"))
        nxt = src.select("track_id", (F.col("block") - 1).alias("block"), F.slice("samples", 1, half).alias("next_head"))
        src = src.join(prev, ["track_id", "block"], "left").join(nxt, ["track_id", "block"], "left")
    return src.mapInArrow(_blocks_to_frames(block_size, n_fft, hop, n_mels, sr, scale, placed), FRAME_SCHEMA)


def _cut_at_blocks(made: DataFrame, block_size: int) -> DataFrame:
    """``(track_id, j0, out)``: stretches of new samples from number ``j0`` on, cut at the new blocks' borders and put together there."""
    to = F.explode(F.sequence(F.floor(F.col("j0") / block_size), F.floor((F.col("j0") + F.size("out") - 1) / block_size)))
    cut = made.withColumn("block", to)
    lo = F.greatest(F.col("block") * block_size, F.col("j0"))
    n = F.least((F.col("block") + 1) * block_size, F.col("j0") + F.size("out")) - lo
    pieces = cut.select("track_id", F.col("block").cast("int").alias("block"), lo.alias("at"), F.slice("out", (lo - F.col("j0") + 1).cast("int"), n.cast("int")).alias("piece"))
    blocks = pieces.groupBy("track_id", "block").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("_p"))
    return blocks.select("track_id", "block", F.flatten(F.transform("_p", lambda x: x["piece"])).alias("samples"))


def _in_blocks(made, block_size: int):
    """The same for pieces ``(track, j0, out)`` that come in order: ``(track, block, samples)``."""
    now, parts = None, []
    for tid, j0, out in made:
        while len(out):
            block = j0 // block_size
            if now != (tid, block):
                if parts:
                    yield (*now, np.concatenate(parts))
                now, parts = (tid, block), []
            n = min(len(out), (block + 1) * block_size - j0)
            parts.append(out[:n])
            j0, out = j0 + n, out[n:]
    if parts:
        yield (*now, np.concatenate(parts))


def resample(pcm: DataFrame, sr_in: int, sr_out: int = SAMPLE_RATE, block_size: int = BLOCK_SIZE) -> DataFrame:
    """The PCM table at another sample rate, by linear interpolation (no band limit); a track keeps its duration.

    A block makes the output samples that fall into it and needs only the first
    sample of the next block; its output is cut at the borders of the new blocks
    and put together there, so no task holds more than a few blocks.
    """
    step = lambda j: F.floor(j * sr_in / F.lit(sr_out))
    w = Window.partitionBy("track_id").orderBy("block")
    src = pcm.select("track_id", "block", "samples", F.lead(F.col("samples")[0]).over(w).alias("next"))
    begin = F.col("block").cast("long") * block_size
    end = begin + F.size("samples")
    up = lambda n: F.floor((n * sr_out + (sr_in - 1)) / F.lit(sr_in)).cast("long")
    src = src.withColumn("begin", begin).withColumn("j0", up(begin)).withColumn("j1", up(end) - 1).where(F.col("j1") >= F.col("j0"))
    wide = F.concat("samples", F.array(F.coalesce("next", F.element_at("samples", -1))))

    def value(j):
        i = (step(j) - F.col("begin")).cast("int")
        part = F.pmod(j * sr_in, F.lit(sr_out)) / F.lit(sr_out)
        return (F.get("wide", i) * (1 - part) + F.get("wide", i + 1) * part).cast("float")

    made = src.withColumn("wide", wide).select("track_id", "j0", F.transform(F.sequence("j0", "j1"), value).alias("out"))
    return _cut_at_blocks(made, block_size)


ZERO_CROSSINGS = 64  # of the sinc, to either side
ROLLOFF = 0.94  # share of the lower rate's band that passes
KAISER_BETA = 9.0  # side lobes some 90 dB down


def polyphase_bank(sr_in: int, sr_out: int, zeros: int = ZERO_CROSSINGS, rolloff: float = ROLLOFF, beta: float = KAISER_BETA) -> np.ndarray:
    """``(phases, 2 * half)`` filters of a Kaiser-windowed sinc, one per position of an output sample between two
    input samples: phase ``p`` of ``phases`` weighs the inputs ``half - 1`` before to ``half`` after."""
    phases = sr_out // math.gcd(sr_in, sr_out)
    cutoff = min(1.0, sr_out / sr_in) * rolloff
    half = math.ceil(zeros / cutoff)
    t = np.arange(phases)[:, None] / phases - np.arange(-(half - 1), half + 1)[None, :]
    window = np.i0(beta * np.sqrt(np.maximum(0.0, 1.0 - (t / half) ** 2))) / np.i0(beta)
    bank = cutoff * np.sinc(cutoff * t) * window
    return bank / bank.sum(axis=1, keepdims=True)  # a constant stays what it is


def resample_frames(signal: np.ndarray, start: int, j0: int, j1: int, sr_in: int, sr_out: int, bank: np.ndarray) -> np.ndarray:
    """Output samples ``j0 .. j1 - 1``; ``signal[0]`` is input sample ``start`` and reaches half a filter beyond both ends."""
    up, down, half = sr_out // math.gcd(sr_in, sr_out), sr_in // math.gcd(sr_in, sr_out), bank.shape[1] // 2
    at = np.arange(j0, j1, dtype=np.int64) * down
    windows = np.lib.stride_tricks.sliding_window_view(signal, 2 * half)
    return np.einsum("ij,ij->i", windows[at // up - start - (half - 1)], bank[at % up])


def resample_bandlimited(pcm: DataFrame, sr_in: int, sr_out: int = SAMPLE_RATE, block_size: int = BLOCK_SIZE, placed: bool = False) -> DataFrame:
    """X-5: the PCM table at another sample rate through a polyphase windowed-sinc filter; a track keeps its duration.

    What lies above the new rate's band is damped by more than 60 dB.  Every
    block gets the last samples of the block before and the first of the block
    after as halo (two equi-joins), silence beyond the track's ends, and makes
    the output samples that fall into it.  With ``placed`` (see :func:`log_mel`) the halo
    comes from the rows next to it, and the new table is placed as well.
    """
    bank = polyphase_bank(sr_in, sr_out)
    half = bank.shape[1] // 2
    if block_size < half:
        raise ValueError(f"blocks of {half} samples or more are needed")
    src = pcm.select("track_id", "block", "samples")
    if not placed:
        before = src.select("track_id", (F.col("block") + 1).alias("block"), F.slice("samples", -F.least(F.lit(half), F.size("samples")), half).alias("before"))
        after = src.select("track_id", (F.col("block") - 1).alias("block"), F.slice("samples", 1, half).alias("after"))
        src = src.join(before, ["track_id", "block"], "left").join(after, ["track_id", "block"], "left").select("track_id", "block", "samples", "before", "after")
    first = lambda n: -(-n * sr_out // sr_in)  # noqa: E731  (the first output sample at or after input sample n)

    def pieces(batches):
        for tid, block, mid, left, right in _halos(batches, placed):
            begin = block * block_size
            j0, j1 = first(begin), first(begin + len(mid))
            if j1 > j0:
                left = np.zeros(0) if left is None else left[max(0, len(left) - half) :].astype(np.float64)
                right = np.zeros(0) if right is None else right[:half].astype(np.float64)
                signal = np.concatenate([np.zeros(half - len(left)), left, mid.astype(np.float64), right, np.zeros(half - len(right))])
                yield tid, j0, resample_frames(signal, begin - half, j0, j1, sr_in, sr_out, bank).astype(np.float32)

    def run(batches):
        yield from _packed(pieces(batches), ["track_id", "j0", "out"], pa.int64())

    def run_placed(batches):
        yield from _packed(_in_blocks(pieces(batches), block_size), ["track_id", "block", "samples"])

    if placed:
        return src.mapInArrow(run_placed, PCM_SCHEMA)
    return _cut_at_blocks(src.mapInArrow(run, "track_id long, j0 long, out array<float>"), block_size)


def first_seconds(pcm: DataFrame, seconds: float, sr: int = SAMPLE_RATE, block_size: int = BLOCK_SIZE) -> DataFrame:
    """X-6: only the first ``seconds`` of every track (blocks past it dropped, the boundary block cut)."""
    limit = int(seconds * sr)
    keep = pcm.where(F.col("block") * block_size < limit)
    n_keep = F.least(F.size("samples"), F.lit(limit) - F.col("block") * block_size)
    return keep.withColumn("samples", F.slice("samples", 1, n_keep.cast("int")))


def explode_chunks(df: DataFrame, chunks_col: str = "chunks", key: str = "track_id") -> DataFrame:
    """X-8: one item per (track, minute chunk): ``(key, chunk, values)``."""
    return df.select(key, F.posexplode(chunks_col).alias("chunk", "values"))


def training_matrix(features: DataFrame, labels: DataFrame, vocab: list[str], length: int, key: str = "track_id",
                    values_col: str = "values", labels_col: str = "labels") -> DataFrame:
    """X-10: every feature row padded/cut to ``length`` values (zeros before any log) with its
    multi-hot label vector in vocabulary order; rows are joined by key, never by position (Q-4, Q-15)."""
    from ..functions.arrays import pad_truncate
    from ..functions.scores import multi_hot

    j = features.join(labels.select(key, labels_col), key, "inner")
    return j.select(key, pad_truncate(values_col, length).alias("x"), multi_hot(labels_col, vocab).alias("y"))


def frame_counts(pcm: DataFrame, hop: int = HOP_LENGTH) -> DataFrame:
    """Frames per track with centred framing: ``1 + len // hop`` (from block sizes, no FFT needed)."""
    n = pcm.groupBy("track_id").agg(F.sum(F.size("samples")).alias("n_samples"))
    return n.select("track_id", "n_samples", (F.floor(F.col("n_samples") / F.lit(hop)) + 1).cast("long").alias("n_frames"))


def chunk_frames(frames: DataFrame, chunk_len: int = MINUTE_FRAMES, counts: DataFrame | None = None) -> DataFrame:
    """X-2 long form: ``chunk = frame div chunk_len``; the incomplete tail chunk of each track is dropped.

    The frame count per track comes from ``counts`` (see :func:`frame_counts`)
    or, when not given, from a grouped aggregate over the frames.
    """
    if counts is None:
        n = frames.groupBy("track_id").agg((F.max("frame") + 1).alias("_nf"))
    else:
        n = counts.select("track_id", F.col("n_frames").alias("_nf"))
    j = frames.join(n, "track_id")
    full = F.floor(F.col("_nf") / F.lit(chunk_len))
    return (
        j.withColumn("chunk", F.floor(F.col("frame") / F.lit(chunk_len)).cast("int"))
        .where(F.col("chunk") < full)
        .withColumn("frame", (F.col("frame") - F.col("chunk") * chunk_len).cast("int"))
        .drop("_nf")
    )


PCM_SCHEMA = T.StructType([
    T.StructField("track_id", T.LongType()),
    T.StructField("block", T.IntegerType()),
    T.StructField("samples", T.ArrayType(T.FloatType())),
])


def _text_to_blocks(block_size: int):
    def blocks(batches):
        for batch in batches:
            for tid, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if text is None or len(text) == 0:
                    continue
                codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
                y = ((codes % 64).astype(np.float32) - 32.0) / 32.0
                for b in range(0, (len(y) + block_size - 1) // block_size):
                    yield int(tid.as_py()), b, y[b * block_size : (b + 1) * block_size]

    def run(batches):
        yield from _packed(blocks(batches), ["track_id", "block", "samples"])

    return run


def pcm_from_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_size: int = BLOCK_SIZE) -> DataFrame:
    """A PCM table derived from text (one sample per character, in [-1, 1)), cut into blocks.

    Used to drive X-1 at the scale of the text corpus; real deployments read
    decoded audio into the same ``(track_id, block, samples)`` shape.  Blocks of one text
    stand in order, one after the other; a task holds one batch of texts and a bounded number of samples.
    """
    docs = spread(docs.select(id_col, text_col))
    return docs.mapInArrow(_text_to_blocks(block_size), PCM_SCHEMA)


def frame_stats(frames: DataFrame) -> DataFrame:
    """Per track: frame count and mean/max log-mel (a compact check of X-1 output)."""
    per = frames.select("track_id", F.aggregate("mel", F.lit(0.0).cast("double"), lambda a, x: a + x).alias("_s"), F.array_max("mel").alias("_m"), F.size("mel").alias("_n"))
    return per.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n_frames"),
        (F.sum("_s") / F.sum("_n")).alias("mean_log_mel"),
        F.max("_m").alias("max_log_mel"),
    )

