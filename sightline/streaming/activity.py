"""Request analytics as streams: daily windows and sessions with watermarks, and an upsert of log entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.logs import status_class
from sightline.session import shared_dir, work_path


def daily_windows(requests: DataFrame, time: str = "received_at", lateness: str = "2 hours") -> DataFrame:
    """Requests by day and status class; rows later than `lateness` behind the newest are dropped once their day is closed."""
    marked = requests.withWatermark(time, lateness) if requests.isStreaming else requests
    return marked.groupBy(F.window(time, "1 day").alias("w"), status_class(F.col("status")).alias("status_class")).agg(F.count("*").alias("requests"))


def sessions(requests: DataFrame, key: str, time: str = "received_at", gap: str = "30 minutes", lateness: str = "2 hours") -> DataFrame:
    """Runs of requests of a key with no pause of `gap` or more: key, start, end (last request plus gap), requests."""
    marked = requests.withWatermark(time, lateness) if requests.isStreaming else requests
    grouped = marked.where(F.col(key).isNotNull()).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("requests"))
    return grouped.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "requests")


def read_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's Parquet files as a stream; the table may be one file or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(f"{sf_dir}/{table}.parquet") if folder else reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def run_complete(stream: DataFrame, label: str) -> DataFrame:
    """Runs an aggregating stream over all data that is there, and returns its last complete result from the shared folder."""
    spark, out = stream.sparkSession, work_path(stream.sparkSession, label)
    schema = stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{shared_dir(spark)}/sightline/{out.rpartition('/')[2]}-log").trigger(availableNow=True).start()
    query.awaitTermination()
    target = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out)


def run_appending(stream: DataFrame, label: str) -> DataFrame:
    """Runs an aggregating stream in append mode over all data that is there, and returns the rows that its watermark closed.

    State of closed windows is dropped as the stream goes on; windows that the watermark has not passed at the end are not in the result,
    as they may still change.
    """
    spark, out = stream.sparkSession, work_path(stream.sparkSession, label)
    query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{shared_dir(spark)}/sightline/{out.rpartition('/')[2]}-log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
