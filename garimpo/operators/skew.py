"""Lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: A key is hot if it holds at least 1/HOT_SHARE of the rows (and HOT_ROWS of them); so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
HOT_ROWS = 100_000


def hot_keys(df: DataFrame, key: str, total: int | None = None) -> list[Row]:
    """(key, n) of the keys that hold at least total / HOT_SHARE rows of df: never more than HOT_SHARE rows, if `total` counts df (by default it is counted)."""
    total = df.count() if total is None else total
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.filter((F.col("n") >= max(HOT_ROWS, total // HOT_SHARE)) & F.col(key).isNotNull()).collect()


def lookup(df: DataFrame, key: str, table: DataFrame, value: str, hot: list[Row]) -> DataFrame:
    """df left-joined to `table` (unique in `key`) for its column `value`. Rows of `hot` keys meet a broadcast of just those keys.

    The broadcast has at most len(hot) rows, which the caller bounds (see `hot_keys`). Without hot keys it is a plain join.
    A null key finds nothing.
    """
    table = table.select(F.col(key).alias("__key"), F.col(value).alias("__value"))
    join = lambda x, t: x.join(t, F.col(key) == F.col("__key"), "left").withColumn(value, F.col("__value")).drop("__key", "__value")
    if not hot:
        return join(df, table)
    few = df.sparkSession.createDataFrame([(r[key],) for r in hot], df.select(F.col(key).alias("__hot")).schema)
    is_hot = df.join(F.broadcast(few), F.col(key) == F.col("__hot"), "left")
    small = F.broadcast(table.join(F.broadcast(few.withColumnRenamed("__hot", "__key")), "__key", "left_semi"))
    return join(is_hot.filter(F.col("__hot").isNotNull()).drop("__hot"), small).unionByName(join(is_hot.filter(F.col("__hot").isNull()).drop("__hot"), table))
