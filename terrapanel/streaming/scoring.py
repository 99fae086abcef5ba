"""Scoring of files as they arrive."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from terrapanel.operators.scoring import Scorer, score_batches


def score_stream(spark: SparkSession, source: str, schema: str, features: str, meta: list[str], f: Scorer, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Parquet files of a folder, scored batch by batch and appended to another one, each row exactly once.

    With ``available_now`` the query ends when what is there has been scored.
    """
    scored = score_batches(spark.readStream.schema(schema).parquet(source), features, meta, f)
    writer = scored.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
