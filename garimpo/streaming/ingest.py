"""Streaming of listing files: the same expressions, with late repetitions dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from garimpo.functions import prices, titles


def listing_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(stream: DataFrame, ts: str = "createdat", keys: tuple[str, ...] = ("provider", "url"), late: str = "3 days") -> DataFrame:
    """The first sight of each key, for as long as repetitions may arrive; state older than `late` is dropped."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def with_attributes(stream: DataFrame) -> DataFrame:
    t = F.col("title")
    return stream.withColumns({"normalizedtitle": titles.clean_title(t), "brand": titles.brand(t), "currentprice": prices.current_price(F.col("price"), F.col("pricetext"))})


def hourly_counts(stream: DataFrame, ts: str = "createdat", late: str = "3 days") -> DataFrame:
    """Listings and mean price per provider and hour; hours are final once the watermark has passed them."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), "provider").agg(F.count("*").alias("listings"), F.avg("price").alias("avg_price"))


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that has arrived, then stop; a later call goes on from there."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
