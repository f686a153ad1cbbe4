"""Session helpers: configuration, shared scratch folders, bounded broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults every job in this package relies on.  AQE re-plans joins at run
# time (sort-merge -> broadcast when a side turns out small), coalesces tiny
# shuffle partitions and splits skewed ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # top-n per group with n <= this value gets a partial limit before the shuffle
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
    # Arrow batches to Python workers are cut by bytes too: PCM blocks and
    # per-document candidate lists are wide rows
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    # checkpoint files of DataFrames that are no longer referenced get deleted
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

SPREAD_CONF = "spark.tessitura.spread"

# Largest table we ever hint as broadcast.  Only tables whose row count is
# bounded by construction (vocabularies, block-offset tables, top-k lists)
# may be passed to :func:`bounded_broadcast`.
MAX_BROADCAST_ROWS = 1 << 20


def get_session(
    app: str = "tessitura",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in conf.items():
        if not k.startswith(("spark.sql.", SPREAD_CONF)) or k == "spark.sql.shuffle.partitions" and shuffle_partitions is None:
            continue
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by whoever runs the job and is read from
    the session.  Only when nothing is set and the master is local (one
    machine, as in tests) a folder of our own is made, and removed at exit;
    any other master without the setting is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a session without a local SparkContext (Spark Connect): use the setting as is
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("spark.checkpoint.dir is not set")
        return configured
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tessitura-ckpt-")
        atexit.register(shutil.rmtree, configured, True)
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tessitura/{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession, path: str | None = None) -> None:
    """Delete one written table, or all that this application wrote; call it when their readers are done."""
    target = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessitura"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def bounded_broadcast(df: DataFrame, bound_rows: int) -> DataFrame:
    """Hint a broadcast for a table whose row count is bounded by construction.

    ``bound_rows`` is the proven upper bound (size of a fixed vocabulary, of a
    ``limit``, or of a block table).  Anything unbounded must not come here;
    leave it to AQE, which only broadcasts after measuring the real size.
    """
    if bound_rows > MAX_BROADCAST_ROWS:
        return df
    return F.broadcast(df)


def local_test_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    os.environ.setdefault("PYSPARK_PYTHON", "python")
    return get_session(
        "tessitura-test",
        master=f"local[{cores}]",
        shuffle_partitions=shuffle_partitions,
        extra={
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
            SPREAD_CONF: str(cores),
        },
    )


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out evenly over as many partitions as the setting ``spark.tessitura.spread`` names; unset: unchanged.

    For CPU-heavy per-row work right after a scan of a few files that cannot be
    split.  At scale the scan itself has enough splits, so it is left unset.
    """
    n = df.sparkSession.conf.get(SPREAD_CONF, None)
    return df.repartition(int(n)) if n else df


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (resolved first; never ``localCheckpoint``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table below the shared checkpoint folder and read it back.

    Cuts the lineage like a checkpoint, but the copy is columnar: later reads
    prune columns and skip row groups, and it survives lost executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def split_repeats(df: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose key no other row has, the rest or None); null keys belong to the rest.

    What holds for a key that comes once (its whole group is one row) needs no
    shuffle; the rest takes the general way.  Only the keys are shuffled here (a
    job runs when this is called).
    """
    again = materialize(df.groupBy(F.col(key).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 OR _again IS NULL").select("_again"), name)
    if again.isEmpty():
        return df, None
    same = F.col(key).eqNullSafe(F.col("_again"))
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")


HOT_KEYS = 1 << 18


def join_hot_keys(rows: DataFrame, table: DataFrame, key: str, heat: str, bound: int = HOT_KEYS) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row per key, a written table): an inner join that shuffles the rows of rare keys only.

    The ``bound`` keys with the largest ``heat`` are broadcast, which keeps the rows of a
    skewed table where they are; the others meet by a shuffle.
    """
    hot = bounded_broadcast(materialize(table.orderBy(F.desc(heat), F.asc(key)).limit(bound), "hot-keys"), bound)
    far = rows.join(hot.select(key), key, "left_anti").join(table, key)
    return rows.join(hot, key).unionByName(far)
