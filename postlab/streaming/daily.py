"""AGG-07 (real-date daily metrics) over a stream of silver post files.

Event-time tumbling windows of one day with a watermark: a day's row is emitted once the watermark
passes the end of the day (append mode), late posts inside the watermark still count, and the
state store only keeps the open days. The result has the batch columns of
``postlab.operators.calendar.real_daily_metrics``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def daily_metrics_stream(stream: DataFrame, ts_col: str = "event_ts", watermark: str = "2 days") -> DataFrame:
    """Streaming aggregate: one row per closed day (analysis_date, three means, post_volume)."""
    ts = F.col(ts_col).cast("timestamp")
    agg = (stream.withColumn("__ts", ts).withWatermark("__ts", watermark)
           .groupBy(F.window("__ts", "1 day").alias("w"))
           .agg(F.avg("engagement_velocity").alias("engagement_velocity"),
                F.avg("misinformation_probability").alias("misinformation_probability"),
                F.avg("credibility_score").alias("credibility_score"),
                F.count("post_id").alias("post_volume")))
    return agg.select(F.to_date(F.col("w.start")).alias("analysis_date"), "engagement_velocity",
                      "misinformation_probability", "credibility_score", "post_volume")


def start_daily_metrics(spark: SparkSession, source_dir: str, schema: StructType, sink_dir: str,
                        checkpoint_dir: str, watermark: str = "2 days", available_now: bool = False,
                        max_files_per_trigger: int | None = None):
    """Start the query: parquet files in ``source_dir`` -> parquet rows in ``sink_dir`` (exactly once
    through the checkpoint, which must be on shared storage)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    out = daily_metrics_stream(reader.parquet(source_dir), watermark=watermark)
    writer = (out.writeStream.outputMode("append").format("parquet")
              .option("checkpointLocation", checkpoint_dir).option("path", sink_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
