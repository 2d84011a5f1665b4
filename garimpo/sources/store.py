"""The three tables of searches and their rows on Parquet: append, read back, counts, schema changes.

A store is a folder with `searches`, `raw_products` and `normalized_products`. Rows of products are partitioned by
provider, so a read of one shop lists only its files; other lookups are pruned by Parquet statistics.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions.prices import stored_price

# Columns of the tables.
SCHEMAS = {
    "searches": "id string, query string, provider string, url string, status string, productCount int, executionTime bigint, rawJSON string, pagination string, schemaVersion int, createdAt timestamp",
    "raw_products": "id string, searchId string, provider string, providerProductId string, title string, priceText string, price double, url string, source string, rawJSON string, createdAt timestamp",
    "normalized_products": "id string, searchId string, provider string, originalTitle string, normalizedTitle string, brand string, model string, storageCapacity string, memoryCapacity string, currency string, currentPrice double, originalPrice double, originalPriceText string, availability string, priceText string, price double, url string, source string, confidence double, createdAt timestamp",
}
SCHEMA_VERSION = 2


def conform(df: DataFrame, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """df with exactly the columns of `schema`: missing ones are null or their default, obsolete ones are dropped, types are cast."""
    wanted = df.sparkSession.createDataFrame([], schema).dtypes
    defaults = defaults or {}
    have = set(df.columns)
    return df.select(*[(F.col(f"`{n}`") if n in have else F.lit(defaults.get(n))).cast(t).alias(n) for n, t in wanted])


@dataclass
class Store:
    spark: SparkSession
    path: str

    def _write(self, df: DataFrame, name: str) -> None:
        w = df.write.mode("append")
        (w.partitionBy("provider") if name != "searches" else w).parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        """The table, in today's schema whatever the files were written with; an empty one if nothing is stored."""
        schema = SCHEMAS[name]
        try:
            df = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)
        return conform(df, schema)

    def add_searches(self, df: DataFrame) -> None:
        """Append searches; each needs an id. An execution time of 0 is stored as null, an absent status as success."""
        df = conform(df, SCHEMAS["searches"], {"status": "success", "schemaVersion": SCHEMA_VERSION})
        df = df.withColumn("id", F.coalesce("id", F.raise_error(F.lit("a search needs an id")).cast("string")))
        self._write(df.withColumn("executionTime", F.nullif("executionTime", F.lit(0))).withColumn("createdAt", F.coalesce("createdAt", F.current_timestamp())), "searches")

    def add_raw(self, df: DataFrame) -> None:
        """Append raw rows: new ids, the price read from its text where the column is null."""
        df = conform(df, SCHEMAS["raw_products"], {"source": "raw"})
        df = df.withColumns({"id": F.expr("uuid()"), "price": F.coalesce("price", stored_price(F.col("priceText"))), "createdAt": F.coalesce("createdAt", F.current_timestamp())})
        self._write(df, "raw_products")

    def add_normalized(self, df: DataFrame, *, null_price_as_zero: bool = False) -> None:
        """Append normalized rows with new ids. `null_price_as_zero`: absent prices are stored as 0, and `price` always is."""
        df = conform(df, SCHEMAS["normalized_products"], {"source": "normalized"})
        if null_price_as_zero:
            df = df.withColumns({"currentPrice": F.coalesce("currentPrice", F.lit(0.0)), "originalPrice": F.coalesce("originalPrice", F.lit(0.0)), "price": F.lit(0.0)})
        self._write(df.withColumns({"id": F.expr("uuid()"), "createdAt": F.coalesce("createdAt", F.current_timestamp())}), "normalized_products")

    def search(self, search_id: str) -> DataFrame:
        """One row with the search and its raw and normalized rows as arrays, empty if it has none; no row if it isn't stored."""
        one = self.read("searches").filter(F.col("id") == search_id)
        return with_products(one, self.read("raw_products").filter(F.col("searchId") == search_id), self.read("normalized_products").filter(F.col("searchId") == search_id))

    def counts(self) -> DataFrame:
        return table_counts({name: self.read(name) for name in SCHEMAS})


def with_products(searches: DataFrame, raw: DataFrame, normalized: DataFrame, key: str = "id", foreign: str = "searchId") -> DataFrame:
    """searches with `raw` and `normalized`: arrays of the rows of each search in the order of their ids."""
    def grouped(df: DataFrame, name: str) -> DataFrame:
        rest = ["id", *[c for c in df.columns if c not in (foreign, "id")]]
        return df.groupBy(F.col(foreign).alias(key)).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))

    df = searches.join(grouped(raw, "raw"), key, "left").join(grouped(normalized, "normalized"), key, "left")
    return df.withColumns({n: F.coalesce(n, F.array().cast(dict(df.dtypes)[n])) for n in ("raw", "normalized")})


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(searches, raw, normalized, products): numbers of rows; products is raw and normalized together."""
    names = {"searches": "searches", "raw_products": "raw", "normalized_products": "normalized"}
    rows = reduce(DataFrame.unionAll, [tables[name].select(F.lit(out).alias("t")) for name, out in names.items()])
    df = rows.agg(*[F.count_if(F.col("t") == out).alias(out) for out in names.values()])
    return df.withColumn("products", F.col("raw") + F.col("normalized"))
