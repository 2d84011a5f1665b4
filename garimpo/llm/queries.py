"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions.text import is_blank
from garimpo.llm import canonical_values, components, hash_forest, leakage, listings, mixing, product_numbers, reading, residue
from garimpo.llm.sql import SQL as SQL_TEXTS
from garimpo.session import cut
from garimpo.sources.tables import table


def brand_reference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "brand_reference").select(F.col("brandid").alias("id"), F.col("brandname").alias("name"), F.col("shortname").alias("short"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "normalized_products", "id", "originaltitle", "brand", "model").withColumnRenamed("originaltitle", "title")
    return listings.groups(df, brand_reference(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return listings.pairs(_items(spark, d))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Membership: the smallest id of its item's listings for every listing with an item."""
    members = _items(spark, d)
    least = members.groupBy("item").agg(F.min("id").alias("groupid"), F.count("*").alias("members"))
    return members.join(least, "item").select("id", "groupid", "members")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical_values.map_rows(table(spark, d, "normalized_products", "id", "brand"), "id", "brand", brand_reference(spark, d), "brandid")


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that mean no listed brand, with their number of rows."""
    rows = table(spark, d, "normalized_products", "id", "brand")
    named = canonical_values.map_values(rows.select(F.col("brand").alias("value")), brand_reference(spark, d)).filter(F.col("id") == -1)
    counts = rows.groupBy(F.col("brand").alias("value")).agg(F.count("*").alias("n"))
    return counts.join(named, "value").select("value", "n").filter(~is_blank(F.col("value")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "raw_products", "id", "provider", "providerproductid", "url")
    same = product_numbers.identities(F.col("provider"), F.col("providerproductid"), F.col("url"))
    return hash_forest.repeated_rows(df.select("id", same.alias("identities")))


def p5_near(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate titles (five-word shingles, 0.8) of every row whose number is divisible by 100, against all rows."""
    df = table(spark, d, "raw_products", "id", "title").withColumnRenamed("title", "text")
    return hash_forest.similar_texts(df, F.coalesce(F.regexp_extract("id", r"(\d+)$", 1).try_cast("long") % 100 == 0, F.lit(False)))


def _residue(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "raw_products", "id", "provider", "title"), "provider", "title")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _residue(spark, d).select("id")


def p6_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Records with residue, by kind."""
    return _residue(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "comparisons", "leftid", "rightid", "verdict")
    return components.connected_groups(df.filter(components.positive(F.col("verdict"))), "leftid", "rightid")


def p8_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every leak with the field it is from and the words of the longest common run."""
    return leakage.leaked(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "prompt", "answer"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_runs(spark, d).select("doc_id", "item_id").distinct()


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = cut(mixing.token_counts(table(spark, d, "documents", "doc_id", "source", "text")))
    budget = cut(mixing.budgets(sized, table(spark, d, "mix_targets")))
    return mixing.draw(sized, budget), budget


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The drawn documents and how often each is used."""
    return _mixture(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.shares(*_mixture(spark, d))


def _measured(spark: SparkSession, d: str) -> DataFrame:
    return cut(reading.measures(table(spark, d, "documents", "doc_id", "text")))


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """Reading level of every document."""
    measured = _measured(spark, d)
    return reading.levels(measured, reading.fit(measured, table(spark, d, "reading_labels")))


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source and reading level."""
    source = table(spark, d, "documents", "doc_id", "source")
    return p10_levels(spark, d).join(source, "doc_id").groupBy("source", "readinglevel").agg(F.count("*").alias("documents"), F.avg("wordspersentence").alias("wordspersentence"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_unmatched": p3_unmatched,
    "p5_found": p5_found,
    "p5_near": p5_near,
    "p6_found": p6_found,
    "p6_kinds": p6_kinds,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_runs": p8_runs,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_levels": p10_levels,
    "p10_profile": p10_profile,
}

SQL = SQL_TEXTS
