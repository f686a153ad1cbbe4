"""Approximate nearest neighbours by inner product over shifted space-filling curves.

Vectors are projected to a few dimensions by a random rotation per curve, shifted,
put on a grid and ordered along a Hilbert curve.  Spark range-partitions every
curve's keys; a row's rank along the curve gives its block.  A query is compared
with all rows of the blocks within ``reach`` of its own on every curve, the blocks'
best are merged, and the scores are exact inner products of the original vectors
in double precision.

Larger norms win inner products, so vectors are first given one more coordinate
that makes all norms equal (the query's is zero): then the largest inner product
is the smallest angle.

The window is calibrated: for a bounded sample of queries the true neighbours are
found by a full scan, and the reach is the one that would have found the share
``recall`` of them on some curve.  Every row is indexed.

Skew: equal vectors are one entry with their 21 smallest ids (more can never be
among the 20 nearest of any query), and blocks are cut by rank, so none is larger
than another.

Defined results: vectors that are null, all zero, hold null or non-finite values,
or have another length than most, take no part, and neither do null ids; of
repeated (vec_id, vector) rows one stays; ties go to the smaller vec_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize, read, register, shuffle_width

DIMS, BITS, CURVES = 8, 7, 8
BLOCK_ROWS = 8192
SAMPLE = 64
RECALL = 0.97
LEAST_WINDOW = 1024
SEED = 7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer points (n, dims) with ``bits`` bits per axis; dims * bits <= 63."""
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q, below = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(flip, below, swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[dims - 1] >> np.uint64(level)) & np.uint64(1) != 0, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << np.uint64(1) | (x[i] >> np.uint64(level)) & np.uint64(1)
    return key


def curve_basis(curve: int, length: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Random orthonormal directions and a shift in [0, 1) per direction."""
    rng = np.random.default_rng([SEED, curve])
    basis = np.linalg.qr(rng.standard_normal((length, max(dims, 1))))[0][:, :dims]
    return basis, rng.random(basis.shape[1])


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(-1, length)


def distinct_vectors(vectors: DataFrame, keep: int, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame, int]:
    """(gid, v, ids) of every distinct valid vector, (vec_id, gid) of all rows, and the vectors' length."""
    v = F.col(vector_col)
    sane = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & sane).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    length = lengths[0]["n"] if lengths else 1
    rows = rows.where(F.size("v") == length)
    gids = rows.groupBy("v").agg(F.min("vec_id").alias("gid"))
    by_id = Window.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= keep)
    entries = few.groupBy("v").agg(F.min("vec_id").alias("gid"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return entries.select("gid", "v", "ids"), rows.join(gids, "v").select("vec_id", "gid").distinct(), length


def build_index(entries: DataFrame, length: int, curves: int = CURVES, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """curve, rank, gid: the order of all distinct vectors along every curve (written to the shared folder)."""
    spark = entries.sparkSession
    width = shuffle_width(spark)
    dims = min(dims, length + 1)
    bases = [curve_basis(c, length + 1, dims) for c in range(curves)]
    norms = entries.select(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()["m"] or 1.0

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), length)
            extra = np.sqrt(np.maximum(norms - (x * x).sum(1), 0.0))
            x = np.concatenate([x, extra[:, None]], 1) / np.sqrt(norms)
            for c, (basis, shift) in enumerate(bases):
                # coordinates lie in [-1, 1]; most of them within a few standard deviations, 1 / sqrt(length)
                spread = np.clip((x @ basis) * np.sqrt(length + 1) / 6.0 + 0.5, 0.0, 1.0)
                cells = np.minimum((spread * 0.5 + shift * 0.5) * (1 << bits), (1 << bits) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, dtype=np.int32)), pa.array(hilbert_keys(cells, bits).astype(np.int64)), b.column(0)], names=["curve", "key", "gid"])

    keys = entries.select("gid", "v").mapInArrow(run, "curve int, key long, gid long")

    def number(batches):
        n = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(n, n + b.num_rows))], names=["curve", "gid", "part", "seq"])
            n += b.num_rows

    ordered = keys.repartitionByRange(width, "curve", "key", "gid").sortWithinPartitions("curve", "key", "gid").select("curve", "gid", F.spark_partition_id().alias("part"))
    ordered = materialize(ordered.mapInArrow(number, "curve int, gid long, part int, seq long"), "ann-order")
    # one row per partition and curve
    firsts = ordered.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("least"))
    w = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = firsts.select("curve", "part", (F.coalesce(F.sum("n").over(w), F.lit(0)) - F.col("least")).alias("off"))
    ranked = ordered.join(checked_broadcast(offsets, curves * width), ["curve", "part"]).select("curve", (F.col("seq") + F.col("off")).alias("rank"), "gid")
    return materialize(ranked, "ann-rank")


def exact_neighbours(entries: DataFrame, queries: list[tuple[int, list[float]]], length: int, k: int) -> DataFrame:
    """qid, gid, score: the k best of all entries for a bounded list of queries, by full scan (a query's own entry left out)."""
    qid = np.array([q for q, _ in queries], dtype=np.int64)
    qv = np.array([v for _, v in queries], dtype=np.float64).reshape(len(queries), length)

    def run(batches):
        for b in batches:
            gids, scores = b.column(0).to_numpy(), qv @ _matrix(b.column(1), length).T
            scores[qid[:, None] == gids[None, :]] = -np.inf
            top = np.argpartition(-scores, min(k, scores.shape[1] - 1), axis=1)[:, :k]
            pick = np.take_along_axis(scores, top, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, top.shape[1])), pa.array(gids[top].ravel()), pa.array(pick.ravel())], names=["qid", "gid", "score"])

    found = entries.select("gid", "v").mapInArrow(run, "qid long, gid long, score double").where(F.col("score") > float("-inf"))
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "gid"))).where(F.col("_n") <= k).drop("_n")


def calibrate(entries: DataFrame, index: DataFrame, queries: DataFrame, length: int, k: int, recall: float = RECALL, sample: int = SAMPLE) -> int:
    """Ranks to look at on either side so that the share ``recall`` of the sample's true neighbours lies inside on some curve."""
    picked = queries.select("gid").distinct().orderBy(F.xxhash64("gid"), "gid").limit(sample)
    rows = sorted((r["gid"], r["v"]) for r in entries.select("gid", "v").join(F.broadcast(picked), "gid").collect())
    if not rows:
        return LEAST_WINDOW
    truth = materialize(exact_neighbours(entries, rows, length, k), "ann-truth")
    here = index.join(F.broadcast(picked), "gid").select("curve", F.col("gid").alias("qid"), F.col("rank").alias("at"))
    far = index.join(F.broadcast(truth.select("qid", "gid")), "gid").join(here, ["curve", "qid"]).groupBy("qid", "gid").agg(F.min(F.abs(F.col("rank") - F.col("at"))).alias("far"))
    distances = np.sort([r["far"] for r in far.select("far").collect()])  # at most sample * k
    return max(LEAST_WINDOW, int(distances[int(np.ceil(recall * len(distances))) - 1]) + 1) if len(distances) else LEAST_WINDOW


_FOUND = "qid long, gid long, score double"


def _search_blocks(length: int, k: int):
    """Partition function over rows sorted by (curve, block, is_query): the best k entries of each block for each of its queries."""

    def best(gids, vecs, qids, qvecs):
        out = []
        c = np.concatenate(vecs)
        g = np.concatenate(gids)
        for i in range(0, len(qids), 512):
            s = qvecs[i : i + 512] @ c.T
            top = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k] if s.shape[1] > k else np.tile(np.arange(s.shape[1]), (len(s), 1))
            out.append(pa.RecordBatch.from_arrays([pa.array(np.repeat(qids[i : i + 512], top.shape[1])), pa.array(g[top].ravel()), pa.array(np.take_along_axis(s, top, 1).ravel())], names=["qid", "gid", "score"]))
        return out

    def run(batches):
        block, gids, vecs = None, [], []
        for b in batches:
            curve, at, is_query, gid = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            x = _matrix(b.column(4), length)
            cut = np.flatnonzero(np.append(True, (curve[1:] != curve[:-1]) | (at[1:] != at[:-1]) | (is_query[1:] != is_query[:-1])))
            for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(at)]):
                here = (curve[a], at[a])
                if here != block:
                    block, gids, vecs = here, [], []
                if not is_query[a]:
                    gids.append(gid[a:z])
                    vecs.append(x[a:z])
                elif gids:
                    yield from best(gids, vecs, gid[a:z], x[a:z])

    return run


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row for which ``is_query`` (a condition on vec_id) holds."""
    spark = vectors.sparkSession
    width = shuffle_width(spark)
    entries, members, length = distinct_vectors(vectors, k + 1, id_col, vector_col)
    entries = materialize(entries, "ann-entries")
    asked = materialize(members.where(is_query), "ann-queries")
    index = build_index(entries, length)
    window = calibrate(entries, index, asked, length, k, recall)
    reach = -(-window // BLOCK_ROWS)
    placed = index.join(entries.select("gid", "v"), "gid").withColumn("block", F.floor(F.col("rank") / BLOCK_ROWS))
    last = index.agg(F.max("rank").alias("m")).first()["m"]
    n_blocks = (last // BLOCK_ROWS + 1) if last is not None else 0
    query_gids = asked.select("gid").distinct()
    hosts = F.sequence(F.greatest(F.col("block") - reach, F.lit(0)), F.least(F.col("block") + reach, F.lit(max(n_blocks - 1, 0))))
    rows = placed.select("curve", "block", F.lit(False).alias("is_query"), "gid", "v").unionByName(
        placed.join(query_gids, "gid").select("curve", F.explode(hosts).alias("block"), F.lit(True).alias("is_query"), "gid", "v")
    )
    found = rows.repartition(width, "curve", "block").sortWithinPartitions("curve", "block", "is_query").mapInArrow(_search_blocks(length, k + 1), _FOUND)
    found = found.groupBy("qid", "gid").agg(F.max("score").alias("score"))
    near = found.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "gid"))).where(F.col("_n") <= k + 1)
    # entries back to ids: the k + 1 best ids of each distinct query vector, then without the query itself
    ids = near.join(entries.select("gid", "ids"), "gid").select("qid", "score", F.explode("ids").alias("vec_id"))
    lists = ids.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("_n") <= k + 1)
    lists = lists.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("best"))
    answers = asked.join(lists, asked["gid"] == lists["qid"]).select(F.col("vec_id").alias("query_id"), "best")
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = answers.select("query_id", F.posexplode(others).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


@register("op8_ann")
def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest of every vector whose id is divisible by 20."""
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
