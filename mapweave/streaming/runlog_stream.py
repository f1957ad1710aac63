"""The append-only run log as a stream: tumbling event counts with a watermark, and their batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

WATERMARK, WINDOW = "10 minutes", "1 hour"


def windowed_counts(log: DataFrame, window: str = WINDOW) -> DataFrame:
    """Counts per window and step, with low-score and reuse counts. Works on streams and on tables."""
    return log.groupBy(F.window("timestamp", window).alias("w"), "step").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("best_combined_score") < 0.4).alias("low_scores"),
        F.count_if(F.col("cache_status") == "hit").alias("hits")).select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "step", "n", "low_scores", "hits")


def stream_counts(log: DataFrame, path: str, checkpoint: str, watermark: str = WATERMARK, window: str = WINDOW) -> StreamingQuery:
    """Append closed windows to a Parquet folder; rows later than the watermark are dropped."""
    out = windowed_counts(log.withWatermark("timestamp", watermark), window)
    return (out.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def closed_windows(log: DataFrame, watermark: str = WATERMARK, window: str = WINDOW) -> DataFrame:
    """Batch twin: the windows a finished stream has closed."""
    end = log.agg((F.max("timestamp") - F.expr(f"INTERVAL {watermark}")).alias("_end"))
    return windowed_counts(log, window).join(F.broadcast(end)).filter(F.col("window_end") <= F.col("_end")).drop("_end")  # end: one row
