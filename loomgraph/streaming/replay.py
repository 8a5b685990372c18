"""Replay of call logs as a stream: the fold of loomgraph.operators.logs.final_state over unbounded input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.logs import final_state


def stream_final_state(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """(episode, n_calls, n_committed, state) after all files under ``path`` have gone by."""
    schema = spark.read.parquet(path).schema
    e = spark.readStream.schema(schema).parquet(path)
    calls = e.select(F.col("user_id").alias("episode"), F.col("value").alias("amount"), (F.col("event_type") != "error").alias("ok"))
    run = f"{folder}/replay-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        # states that a batch changed; a batch that is tried again replaces its own folder
        batch.write.mode("overwrite").parquet(f"{run}/out/batch={n}")

    q = final_state(calls).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    last = F.max_by(F.struct("n_calls", "n_committed", "state"), "batch").alias("s")
    return spark.read.parquet(f"{run}/out").groupBy("episode").agg(last).select("episode", "s.*")
