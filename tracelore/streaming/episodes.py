"""Streaming forms: traces parsed as files arrive, and running statistics of event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelore.functions.segmenting import sentences
from tracelore.operators import parsing


def parse_stream(traces: DataFrame, text: str, keys: list[str], *, time: str | None = None, late: str = "1 day") -> DataFrame:
    """Episodes of a stream of traces before context rules, each trace once: a second copy within ``late`` is dropped."""
    if time is not None:
        traces = traces.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    rows = traces.select(*keys, F.posexplode(sentences()(F.col(text))).alias("position", "text"))
    return rows.select("*", parsing.classify(F.col("text")).alias("c")).select(*keys, "position", "text", "c.behavior", "c.confidence")


def parse_folder(spark: SparkSession, schema, source: str, target: str, checkpoint: str, keys: list[str], text: str = "text") -> StreamingQuery:
    """Parse the Parquet files of a folder as they come, whole traces at a time, and append; the checkpoint resumes a stopped run."""

    def write(batch: DataFrame, _: int) -> None:
        parsing.parse(batch.dropDuplicates(keys), text, keys).write.mode("append").parquet(target)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, size: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Events, summed value and users by window and type, late rows up to ``late`` included."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"), F.approx_count_distinct("user_id").alias("users"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "value", "users")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user: events no further apart than ``gap``."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what there is and wait for it."""
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
