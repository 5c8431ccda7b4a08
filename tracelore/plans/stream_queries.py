"""Queries that run a stream over a table's files and give what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelore.plans.evaluation_queries import rounded
from tracelore.plans.registry import query
from tracelore.streaming import episodes as T


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files: a folder of them, or the one file of that name."""
    name = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(name).schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    stream = spark.readStream.schema(schema)
    return stream.parquet(name) if folder else stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _written(spark: SparkSession, stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Drain a stream into a Parquet folder beside the warehouse's tables and read it."""
    import uuid

    base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_streams/{name}-{uuid.uuid4().hex}"
    T.drain(stream, lambda d, _: d.write.mode("append").parquet(f"{base}/out"), f"{base}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2""")
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of the event stream; update mode over one batch writes each window once."""
    out = _written(spark, T.windowed_counts(_events(spark, sf_dir)), "windows", "update")
    return rounded(out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value"))


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 6) AS value FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a gap of twelve hours, from the same plan as the stream's."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rounded(T.sessions(e, "12 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "value"))
