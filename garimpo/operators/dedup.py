"""First-wins deduplication in order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions.edges import filled


def first_wins(df: DataFrame, key: Column, *order: str | Column) -> DataFrame:
    """The first row of each key by `order`; rows with a null key are all kept apart as one key (SQL grouping of nulls).

    A partial minimum before the exchange instead of a window: a key with most of the rows sends one row per task.
    """
    place = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    return df.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*df.columns), place).alias("__row")).select("__row.*")


def first_by_title(df: DataFrame, order: str, title: str = "title", url: str = "url") -> DataFrame:
    """Rows with a title and a URL, the first of each exact title."""
    usable = df.filter(filled(F.col(title)).isNotNull() & filled(F.col(url)).isNotNull())
    return first_wins(usable, F.col(title), order)


def dedup_listings(df: DataFrame, order: str, *, title: str = "title", url: str = "url", provider: str = "provider", source: str = "source", keep_without_url: bool = False) -> DataFrame:
    """One row per URL, then one per (title, provider) in lower case; blank titles are never merged.

    Per URL the first row wins, unless it has no source and a later one has: then the first with a source takes its place.
    The place decides which of two rows with the same title comes first. Rows without a URL are dropped unless
    `keep_without_url`. Both steps are partial minima, so a URL or title with most of the rows doesn't gather in a task.
    """
    columns = df.columns
    has_url = filled(F.col(url)).isNotNull()
    no_source = filled(F.col(source)).isNull().cast("int")
    best = F.min_by(F.struct(*columns), F.struct(no_source, F.col(order))).alias("__row")
    one = df.filter(has_url).groupBy(F.col(url).alias("__url")).agg(best, F.min(order).alias("__place")).select("__row.*", "__place")
    if keep_without_url:
        one = one.unionByName(df.filter(~has_url).withColumn("__place", F.col(order)))
    name = F.trim(F.lower(F.coalesce(F.col(title), F.lit(""))))
    label = F.coalesce(filled(F.trim(F.lower(F.col(provider)))), F.trim(F.lower(F.col(source))), F.lit(""))
    key = F.struct(name.alias("t"), F.when(name == "", F.col(order).cast("string")).otherwise(label).alias("p"))
    kept = one.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*columns), F.col("__place")).alias("__row"))
    return kept.select("__row.*")


def missing_between(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that are in one of two results but not in the other, with `side` (left or right); duplicates count."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
