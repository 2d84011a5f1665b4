"""Aggregates over runs, listings and judged pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_statistics(runs: DataFrame, keys: list[str], ms: str, rows: str, ok: Column) -> DataFrame:
    """Per key: runs, successes, success rate, mean time over all runs, mean rows over successful ones, total rows, longest run."""
    good = F.when(ok, F.col(rows))
    return runs.groupBy(*keys).agg(
        F.count("*").alias("runs"), F.count_if(ok).alias("successes"), F.avg(ok.cast("double")).alias("success_rate"), F.avg(ms).alias("avg_ms"),
        F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.avg(good).alias("avg_rows"), F.sum(rows).alias("total_rows"),
    )


def pivot_counts(df: DataFrame, key: str, by: Column, values: list[str]) -> DataFrame:
    """Per key the number of rows of each value; one aggregation of conditional counts, no second pass to find the values."""
    df = df.withColumn("__by", by)
    return df.groupBy(key).agg(*[F.count_if(F.col("__by") == v).alias(v) for v in values])


def confusion(judged: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1 of one boolean against another."""
    one = judged.agg(
        F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"),
    )
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return one.withColumns({"precision": p, "recall": r}).withColumn("f1", F.try_divide(F.col("precision") * F.col("recall") * 2.0, F.col("precision") + F.col("recall")))


def validity(df: DataFrame, key: str, price: str, title: str, url: str) -> DataFrame:
    """Per key whether all rows have a positive finite price, a title and an http address; how many, and how many different titles."""
    p = F.col(price)
    return df.groupBy(key).agg(
        F.bool_and(F.coalesce(p > 0, F.lit(False)) & ~F.coalesce(F.isnan(p), F.lit(False))).alias("valid_price"),
        F.bool_and(F.trim(F.coalesce(F.col(title), F.lit(""))) != "").alias("valid_title"),
        F.bool_and(F.coalesce(F.col(url).startswith("http"), F.lit(False))).alias("valid_url"),
        F.count("*").alias("listings"), F.countDistinct(title).alias("titles"),
    )
