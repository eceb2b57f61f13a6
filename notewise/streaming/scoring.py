"""Incremental scoring of answers as they arrive (Structured Streaming).

Generation jobs drop answer files (method, step, record_id, candidate) into
a folder. ``start_stream_scoring`` scores each new file once: a stream-static
join with the gold records, then the same stateless ROUGE job as the batch
path (tokens and LCS kernels are per row, so they run unchanged on a
micro-batch). The sink is parquet with its checkpoint in the shared folder,
so a restarted query resumes where it stopped and never scores a file twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from notewise.operators.rouge import ALL_METRICS, score_pairs

RESPONSE_SCHEMA = T.StructType([
    T.StructField("method", T.StringType()),
    T.StructField("step", T.IntegerType()),
    T.StructField("record_id", T.LongType()),
    T.StructField("candidate", T.StringType()),
])


def scored_stream(spark: SparkSession, responses_dir: str, gold: DataFrame,
                  metrics=ALL_METRICS, max_files_per_trigger: int = 64) -> DataFrame:
    """The streaming DataFrame of per-answer scores."""
    answers = (spark.readStream.schema(RESPONSE_SCHEMA)
               .option("maxFilesPerTrigger", max_files_per_trigger)
               .parquet(responses_dir))
    ref = gold.select("record_id", gold["output"].alias("reference"))
    pairs = answers.join(ref, "record_id")
    return score_pairs(pairs, metrics=metrics, keep=["method", "step", "record_id"])


def start_stream_scoring(spark: SparkSession, responses_dir: str, gold: DataFrame,
                         sink_dir: str, checkpoint_dir: str, metrics=ALL_METRICS,
                         available_now: bool = False) -> StreamingQuery:
    """Start the query; ``available_now`` processes what is there and stops."""
    scores = scored_stream(spark, responses_dir, gold, metrics)
    writer = (scores.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint_dir)
              .option("path", sink_dir))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="30 seconds")
    return writer.start()
