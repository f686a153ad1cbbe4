"""Streaming query: the crowd vote computed incrementally over answer files must equal the batch vote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming.votes import final_votes
from .bindings import ANSWERS_SQL, BASE_URL, answers
from .q_crowd import _vote_sql
from .registry import register


@register("stream_vote_upsert", ("A-1", "U-2", "S-12"), f"WITH answers AS ({ANSWERS_SQL}) {_vote_sql()}")
def q_stream_vote(spark, sf_dir):
    src = answers(spark, sf_dir).select("emotion", "audio_path", "result", "submitted_at")
    folder = scratch_path(spark, "answers")
    # two deliveries of answers, so the state is used across micro-batches
    late = F.pmod(F.hash("audio_path", "submitted_at"), F.lit(2)) == 0
    src.where(~late).write.parquet(folder)
    src.where(late).write.mode("append").parquet(folder)
    n_files = len(spark.read.schema(src.schema).parquet(folder).inputFiles())
    return final_votes(spark, folder, src.schema, base_url=BASE_URL, max_files=max(1, n_files // 2))
