"""Reply counts by ordered pair of persons over a stream of replies.

Replies carry both persons (the producer knows whom it answers), so a micro-batch needs no join with history. Batches
are summed before they are merged; the state is one row a pair. Late replies only add to a pair, so no watermark is
needed for the totals; ``windowed`` has one for counts by time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def totals(replies: DataFrame) -> DataFrame:
    """(p1, p2, n) of a stream (p1, p2, ...), replies to oneself left out; for output mode update or complete."""
    return replies.filter("p1 <> p2").groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n"))


def windowed(replies: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(start, p1, p2, n): counts by ``width`` of event time; a window is final once the stream is ``late`` past its end."""
    rows = replies.filter("p1 <> p2").withWatermark(time, late)
    counted = rows.groupBy(F.window(time, width).alias("span"), "p1", "p2").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("span.start").alias("start"), "p1", "p2", "n")


def keep_totals(replies: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's pair counts as Parquet under ``path``/batch=N; a repeated batch replaces its own folder.

    ``current`` sums the folders, so exactly one count of every batch is read whatever was run again.
    """

    def write(batch: DataFrame, number: int) -> None:
        totals(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return replies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, path: str) -> DataFrame:
    """(p1, p2, n) over all batches written so far."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").groupBy("p1", "p2").agg(F.sum("n").alias("n"))
