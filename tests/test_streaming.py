"""Streams give what the batch operators give on the same log."""
from pyspark.sql import functions as F

from convograph.operators import log, triggers
from convograph.streaming import intake


def run(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def parts(spark, small, tmp_path):
    """The log in two files that arrive one after the other, the second with redelivered rows."""
    m = spark.read.parquet(f"{small}/messages.parquet")
    half = m.agg(F.percentile_approx("id", 0.5)).first()[0]
    path = str(tmp_path / "log")
    m.where(F.col("id") <= half).coalesce(1).write.parquet(path)
    m.where((F.col("id") > half) | (F.col("id") % 7 == 0)).coalesce(1).write.mode("append").parquet(path)
    return m, lambda: spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_redelivery_counts_once(spark, small, tmp_path):
    m, stream = parts(spark, small, tmp_path)
    assert run(spark, intake.first_writes(stream()), "firsts").count() == log.first_writes(m).count()


def test_wake_equals_batch(spark, small, tmp_path):
    m = spark.read.parquet(f"{small}/messages.parquet")
    path = str(tmp_path / "log")
    m.coalesce(1).write.parquet(path)
    got = {tuple(r) for r in run(spark, intake.wake_fires(spark.readStream.schema(m.schema).parquet(path)), "wakes").collect()}
    assert got == {tuple(r) for r in triggers.wake_fires(m).collect()}


def test_windows_add_up(spark, small, tmp_path):
    m = spark.read.parquet(f"{small}/messages.parquet")
    path = str(tmp_path / "log")
    m.coalesce(1).write.parquet(path)
    w = run(spark, intake.tail_windows(spark.readStream.schema(m.schema).parquet(path)), "tails", "complete")
    got = {tuple(r) for r in w.groupBy("chat_id").agg(F.sum("messages"), F.sum("bytes"), F.sum("chars_cjk"), F.sum("words")).collect()}
    assert got == {tuple(r) for r in log.tail_stats(m).select("chat_id", "messages", "bytes", "chars_cjk", "words").collect()}
