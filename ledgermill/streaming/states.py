"""Folding event streams into the latest state of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.sources.tables import scratch


def state_fold(events: DataFrame) -> DataFrame:
    """user_id, state (the type of the latest event), last_event_id, n_events; for a table or a stream."""
    at = F.struct("ts", "event_id")
    return events.groupBy("user_id").agg(F.max_by("event_type", at).alias("state"), F.max_by("event_id", at).alias("last_event_id"), F.count("*").alias("n_events"))


def folded_stream(spark: SparkSession, folder: str, names: str = "*.parquet", files_per_trigger: int = 16) -> DataFrame:
    """Runs the fold over all files of these names in the folder and returns the states. Each batch writes the keys that it changed to the shared folder,
    under its number, so that a batch that is run again replaces itself."""
    at, schema = scratch(spark, "states"), spark.read.option("pathGlobFilter", names).parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", names).parquet(folder)

    def write(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{at}/out/step={batch}")

    query = state_fold(stream).writeStream.outputMode("update").option("checkpointLocation", f"{at}/progress").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    states = spark.read.parquet(f"{at}/out")
    return states.groupBy("user_id").agg(*[F.max_by(c, "batch").alias(c) for c in ("state", "last_event_id", "n_events")])


def broadcast_stream(spark: SparkSession, folder: str, names: str) -> DataFrame:
    """topic and n of the messages that a stream of events sends out: each batch writes its messages (topic, payload) under its number, so that a
    batch that is run again replaces its own."""
    at, schema = scratch(spark, "topics"), spark.read.option("pathGlobFilter", names).parquet(folder).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", names).parquet(folder)

    def send(events: DataFrame, batch: int) -> None:
        events.select(F.col("event_type").alias("topic"), F.to_json(F.struct(*events.columns)).alias("payload")).write.mode("overwrite").parquet(f"{at}/out/step={batch}")

    stream.writeStream.option("checkpointLocation", f"{at}/progress").foreachBatch(send).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("topic").agg(F.count("*").alias("n"))
