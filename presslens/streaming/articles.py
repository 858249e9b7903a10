"""Articles as a stream: cleaned, first of each url, and counts kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.functions import text as X
from presslens.operators.matrix import phrase_matrix


def read_articles(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def clean_stream(articles: DataFrame, time: str = "scraped_at", delay: str = "7 days", patterns=()) -> DataFrame:
    """Cleaned articles, each url once within the watermark; rows without url, text or time are left out."""
    a = articles.where(F.col("url").isNotNull() & F.col("maintext").isNotNull() & F.col(time).isNotNull())
    a = a.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url"])
    return a.withColumn("cleantext", X.clean_nlp(F.col("maintext"), patterns, entities=False))


def merge_counts(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Sum of two long matrices: counts of documents add up, so maintenance is exact."""
    both = new if old is None else old.unionByName(new)
    keys = [c for c in new.columns if c != "n"]
    return both.groupBy(*keys).agg(F.sum("n").alias("n"))


def matrix_sink(path: str, text: str = "cleantext", domain: str = "source_domain", **options):
    """``foreachBatch`` function that appends each batch's matrix under its number; a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        phrase_matrix(batch, text, domain, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The matrix over all batches so far."""
    return merge_counts(None, spark.read.parquet(path).drop("batch"))


def windowed_events(events: DataFrame, time: str = "ts", delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type, for batch and stream alike; late rows beyond the watermark are left out of a stream."""
    e = events.withWatermark(time, delay) if events.isStreaming else events
    return e.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
