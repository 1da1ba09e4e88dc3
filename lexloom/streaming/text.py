"""Analysis of texts that arrive as a stream: an extension, the engine itself works on tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize


def word_counts(texts: DataFrame, time: str, text: str = "text", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """window, token, n of a stream of texts with event times; rows later than the watermark are dropped by it."""
    words = texts.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).select(time, F.explode(tokenize(text)).alias("token")).where(F.col("token").rlike(r"^\p{L}"))
    return words.groupBy(F.window(time, window).alias("window"), "token").agg(F.count(F.lit(1)).alias("n"))


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window, event_type, n, total of a stream of events with the time ``ts``."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("window"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
