"""Post features on a stream of posts.

``readStream`` of new post files -> the same row expressions as the batch
job -> any sink.  No state is kept: each micro-batch is transformed on its
own, so the query recovers from its checkpoint after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.text import word_features

POST_SCHEMA = "doc_id long, Tweet string, `Stock Name` string, `Company Name` string"


def post_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Posts arriving as parquet files under ``path``; ``max_files`` bounds a
    micro-batch and is unset by default."""
    reader = spark.readStream.schema(POST_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def post_features(stream: DataFrame) -> DataFrame:
    """T1-T3 per post; same expressions as the batch operator."""
    return word_features(stream).select("doc_id", "Stock Name", "clean", "fear_score",
                                        "finance_keyword_score")


def start_feature_sink(features: DataFrame, out_path: str, checkpoint: str,
                       trigger_seconds: int | None = None) -> StreamingQuery:
    """Append features as parquet; ``checkpoint`` must be on shared storage."""
    w = (features.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    else:
        w = w.trigger(availableNow=True)
    return w.start()
