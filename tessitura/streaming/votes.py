"""Incremental crowd vote with Structured Streaming.

Answer files arrive in a folder; a stateful streaming aggregation keeps the YES
and NO counts per task (one state row per task, in the state store; use the
RocksDB provider for large state).  Each micro-batch hands over the counts that
changed, and Spark's own update mode and checkpoint decide what that is.  A
query started again with the same checkpoint goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.crowd import majority_vote
from ..session import scratch_path
from ..sources.keyed import read_keyed, replace_rows, upsert_keyed


def vote_stream(spark: SparkSession, answers_dir: str, schema: T.StructType, base_url: str | None = None, max_files: int | None = None, keep_input: bool = False) -> DataFrame:
    """Streaming A-1 over the answer files of a folder (``max_files`` per micro-batch; None: all there are)."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return majority_vote(reader.parquet(answers_dir), base_url=base_url, keep_input=keep_input)


def run_votes(votes: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Process everything that has arrived (``availableNow``), then stop."""
    q = votes.writeStream.outputMode(mode).foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


KEYS = ["emotion", "audio_path"]


def final_votes(spark: SparkSession, answers_dir: str, schema: T.StructType, base_url: str | None = None, max_files: int | None = None, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """The vote after all files: every micro-batch hands over the tasks whose counts changed, which are upserted in place.

    A batch that is run again writes the same rows.  With ``path`` and
    ``checkpoint`` of an earlier call only files that have come since are read.
    """
    out = path or scratch_path(spark, "votes")
    votes = vote_stream(spark, answers_dir, schema, base_url, max_files, keep_input=True)

    def upsert(batch: DataFrame, _: int) -> None:
        upsert_keyed(batch.sparkSession, out, batch, KEYS, replace_rows(KEYS), votes.schema)

    run_votes(votes, upsert, checkpoint or scratch_path(spark, "votes-checkpoint"))
    return read_keyed(spark, out, votes.schema).drop("audio_path")
