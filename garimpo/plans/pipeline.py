"""Search pipelines from captured listings to judged offers."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions import prices, relevance, storage, titles
from garimpo.functions.edges import filled
from garimpo.functions.urls import absolute_url
from garimpo.operators.dedup import dedup_listings, first_by_title
from garimpo.operators.pairs import against
from garimpo.session import cut
from garimpo.sources.store import Store


class Page(NamedTuple):
    """What a source gives for a query: rows with title, price_text, url and `ord`, the order of arrival (price and source may be added)."""

    rows: DataFrame
    url: str = ""
    pagination: dict | None = None
    ms: int = 0


#: A source may return bare rows as well.
Source = Callable[[str], Page | DataFrame]


def _page(source: Source, query: str) -> Page:
    if not isinstance(query, str) or not query:
        raise ValueError("query must be a non-empty string")
    got = source(query)
    return got if isinstance(got, Page) else Page(got)


def shop_listings(cards: DataFrame, home: str, source: str, order: str = "pos") -> DataFrame:
    """Cards of one shop as listings: complete ones only, addresses absolute, prices read, the first of each title."""
    df = cards.withColumns({"url": absolute_url(F.col("url"), home), "price": prices.parse_price(F.col("price_text")), "source": F.lit(source)})
    return first_by_title(df, order)


def with_provider(df: DataFrame, name: str) -> DataFrame:
    """Provider where it is filled, else the source, else `name`."""
    have = [filled(F.col(c)) for c in ("provider", "source") if c in df.columns]
    return df.withColumn("provider", F.coalesce(*have, F.lit(name)))


def normalized(df: DataFrame) -> DataFrame:
    """Listings (provider, title, price, price_text, url, ord) with the attributes read from their titles."""
    t, text = F.col("title"), F.col("price_text")
    return df.select(
        "provider", F.coalesce(t, F.lit("")).alias("original_title"), titles.clean_title(t).alias("normalized_title"), titles.brand(t).alias("brand"),
        titles.model(t).alias("model"), titles.storage_capacity(t).alias("storage_capacity"), titles.memory_capacity(t).alias("memory_capacity"), F.lit("BRL").alias("currency"),
        prices.current_price(F.col("price"), text).alias("current_price"), prices.original_price(F.col("price"), text).alias("original_price"), text.alias("price_text"),
        titles.availability(t, text, F.col("provider")).alias("availability"), "url", F.lit(1.0).alias("confidence"), "ord",
    )


def canonical(df: DataFrame, *, from_original: bool = False) -> DataFrame:
    """Normalized rows with the facts of `storage.canonical`; rows without a title have none (they don't fail the search).

    Rows that have all facts already are passed through.
    """
    if set(storage.FACTS) <= set(df.columns):
        return df
    first, second = ("original_title", "normalized_title") if from_original else ("normalized_title", "original_title")
    df = df.withColumn("__title", F.coalesce(filled(F.col(first)), filled(F.col(second))))
    return storage.canonical(df.drop("model", "confidence"), "__title").drop("__title")


@dataclass
class Result:
    """Outcome of a search: DataFrames, what each source gave, and the sources that failed with their messages.

    providers: per source that succeeded its provider, success, productCount, url and pagination.
    """

    products: DataFrame | None = None
    normalized: DataFrame | None = None
    canonical: DataFrame | None = None
    comparisons: DataFrame | None = None
    errors: dict[str, str] = field(default_factory=dict)
    providers: list[dict] = field(default_factory=list)
    search_id: str | None = None
    unfiltered: int | None = None
    filtered: int | None = None

    @property
    def all_failed(self) -> bool:
        return self.products is None

    def counts(self) -> dict[str, int]:
        """Sources asked, succeeded and failed, products left, and how many the relevance filter took out."""
        kept = 0 if self.products is None else self.products.count()
        out = 0 if self.unfiltered is None or self.filtered is None else self.unfiltered - self.filtered
        return {"providerCount": len(self.providers) + len(self.errors), "successfulCount": len(self.providers), "failedCount": len(self.errors), "productCount": kept, "filteredCount": out}

    def view(self, mode: str = "both") -> dict[str, DataFrame | None]:
        """What a view shows: raw rows only, normalized rows in both places, or (both) raw with normalized rows."""
        if mode not in ("raw", "normalized", "both"):
            raise ValueError(f"unknown view {mode}")
        return {"products": self.normalized if mode == "normalized" else self.products, "normalized": None if mode == "raw" else self.normalized}


def _store(store: Store, search_id: str, query: str, name: str, page: Page, rows: DataFrame, norm: DataFrame, n: int) -> None:
    spark = rows.sparkSession
    head = (search_id, query, name, page.url, "success" if n else "partial", n, page.ms, json.dumps(page.pagination) if page.pagination else None)
    store.add_searches(spark.createDataFrame([head], "id string, query string, provider string, url string, status string, productCount int, executionTime bigint, pagination string"))
    named = {"price_text": "priceText", "original_title": "originalTitle", "normalized_title": "normalizedTitle", "storage_capacity": "storageCapacity", "memory_capacity": "memoryCapacity", "current_price": "currentPrice", "original_price": "originalPrice"}
    store.add_raw(rows.drop("source").withColumnsRenamed(named).withColumn("searchId", F.lit(search_id)))
    store.add_normalized(norm.withColumnsRenamed(named).withColumn("searchId", F.lit(search_id)))


def search(
    query: str, name: str, source: Source, *, compare_with: DataFrame | None = None, query_filter: bool = True, threshold: float = relevance.DEFAULT_THRESHOLD, store: Store | None = None
) -> Result:
    """One shop: listings, normalized and canonical rows, compared with `compare_with` (canonical rows with ord) if given.

    With a `store` the source is read once, into a table of the shared folder, and the search is stored with its raw and normalized
    rows: status success if it has rows, else partial. If anything fails, one failed search is stored instead and the
    error is returned by name. Without a store nothing runs before its result is asked for, and errors are raised.
    """
    if store is None:
        return _search(query, name, _page(source, query), None, compare_with, query_filter, threshold)
    search_id, began, stored = str(uuid.uuid4()), time.time(), False
    try:
        page = _page(source, query)
        rows = cut(with_provider(page.rows, name))
        n = rows.count()
        _store(store, search_id, query, name, page, rows, normalized(rows), n)
        stored = True
        out = _search(query, name, page, rows, compare_with, query_filter, threshold)
        out.search_id = search_id
        out.providers = [{"provider": name, "success": True, "productCount": n, "url": page.url, "pagination": page.pagination}]
        return out
    except Exception as e:  # noqa: BLE001
        if not stored:
            ms = int((time.time() - began) * 1000)
            store.add_searches(store.spark.createDataFrame([(search_id, str(query), name, "", "failed", 0, ms)], "id string, query string, provider string, url string, status string, productCount int, executionTime bigint"))
        return Result(errors={name: str(e)}, search_id=search_id)


def _search(query: str, name: str, page: Page, rows: DataFrame | None, compare_with: DataFrame | None, query_filter: bool, threshold: float) -> Result:
    found = with_provider(page.rows, name) if rows is None else rows
    norm = normalized(found)
    devices = canonical(norm)
    products = relevance.relevant(norm.withColumn("title", F.col("normalized_title")), query, threshold) if query_filter else norm
    judged = None if compare_with is None else against(devices, compare_with, ["ord"])
    return Result(products, norm, devices, judged)


def search_many(query: str, sources: dict[str, Source], *, query_filter: bool = False, threshold: float = relevance.DEFAULT_THRESHOLD, providers: list[str] | None = None) -> Result:
    """Several shops: what succeeds is united, filtered (on request) and deduplicated; what fails is reported by name.

    Each source is read into a table of the shared folder, so one that breaks while it is read fails by itself.
    `providers` restricts the sources; an unknown name is an error. Arrival is by the order of `sources`, then by `ord`.
    """
    unknown = set(providers or ()) - set(sources)
    if unknown:
        raise ValueError(f"unknown providers: {sorted(unknown)}")
    parts, errors, results = [], {}, []
    for k, (name, source) in enumerate(sources.items()):
        if providers is not None and name not in providers:
            continue
        try:
            page = _page(source, query)
            df = with_provider(page.rows, name)
            df = cut(df.withColumn("ord", F.struct(F.lit(k).alias("source"), F.col("ord").cast("long").alias("n"))))
            results.append({"provider": name, "success": True, "productCount": df.count(), "url": page.url, "pagination": page.pagination})
            parts.append(df)
        except Exception as e:  # noqa: BLE001
            errors[name] = str(e)
    if not parts:
        return Result(errors=errors)
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = normalized(found)
    products = rows.withColumns({"title": F.col("original_title"), "source": F.col("provider")})
    out = Result(normalized=rows, canonical=canonical(rows, from_original=True), errors=errors, providers=results, unfiltered=sum(r["productCount"] for r in results))
    out.filtered = out.unfiltered
    if query_filter:
        products = relevance.relevant(products, query, threshold)
        out.filtered = products.count()
    out.products = dedup_listings(products, "ord")
    return out


def provider_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("provider").agg(F.count("*").alias("listings"), F.count("price").alias("priced"), F.min("price").alias("least"), F.max("price").alias("most"))
