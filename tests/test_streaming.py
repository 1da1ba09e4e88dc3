from pyspark.sql import functions as F

from lexloom.streaming import text


def test_streams_equal_batches(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source)
    (tmp_path / "in").mkdir()
    batch.select("ts", F.col("event_type").alias("text"), "event_type", "value").repartition(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    for name, counted in (("words", text.word_counts(stream, "ts")), ("kinds", text.event_counts(stream))):
        q = counted.writeStream.outputMode("complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("kinds").agg(F.sum("n")).first()[0] == batch.count()
    words = batch.select(F.explode(text.tokenize("event_type"))).count()
    assert spark.table("words").agg(F.sum("n")).first()[0] == words
