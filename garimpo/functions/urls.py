"""Search addresses and pagination read from links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def search_slug(query: Column) -> Column:
    """A query as part of an address: percent-encoded, spaces as hyphens, ! ' ( ) * ~ left as they are."""
    x = F.replace(F.url_encode(F.trim(query)), F.lit("+"), F.lit("-"))
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        x = F.replace(x, F.lit(code), F.lit(sign))
    return x


def search_page_url(base: str, query: Column, page: Column, per_page: int = 48) -> Column:
    """Address of a result page; pages after the first name the offset of their first row."""
    first = F.concat(F.lit(base), search_slug(query))
    offset = ((page - 1) * per_page + 1).cast("string")
    return F.when(F.coalesce(page, F.lit(1)) <= 1, first).otherwise(F.concat(first, F.lit("_Desde_"), offset, F.lit("_NoIndex_True")))


def absolute_url(url: Column, home: str) -> Column:
    """A link made absolute against the home address: http links stay, //host and /path are completed, other paths appended."""
    root = home.rstrip("/")
    return (
        F.when(url.startswith("http"), url).when(url.startswith("//"), F.concat(F.lit(root.split("//")[0]), url))
        .when(url.startswith("/"), F.concat(F.lit(root), url)).otherwise(F.concat(F.lit(root + "/"), url))
    )


def page_number(url: Column, parameter: str) -> Column:
    """The number in a query parameter; without the parameter, or where it is empty, 0; null where it is no number."""
    value = F.regexp_extract(url, rf"[?&]{parameter}=([^&#]*)", 1)
    return F.when(value == "", F.lit(0)).otherwise(F.when(F.regexp_like(value, F.lit(r"^\d{1,9}$")), value.try_cast("int")))


def pagination(links: Column, current_url: Column, parameter: str) -> Column:
    """struct<currentPage, pages (sorted), nextPageUrl, hasNextPage> from the links of a page (array<string>, absolute).

    The first link of each page counts; the next page is the smallest above the current one, which defaults to 1.
    """
    numbered = F.filter(F.transform(links, lambda u, i: F.struct(page_number(u, parameter).alias("page"), i.alias("i"), u.alias("url"))), lambda x: x["page"].isNotNull())
    here = page_number(current_url, parameter)
    current = F.when(F.regexp_like(current_url, F.lit(rf"[?&]{parameter}=[^&#]")), here).otherwise(F.lit(1))
    after = F.array_min(F.filter(numbered, lambda x: x["page"] > current))
    pages = F.array_sort(F.array_distinct(F.transform(numbered, lambda x: x["page"])))
    return F.struct(current.alias("currentPage"), pages.alias("pages"), after["url"].alias("nextPageUrl"), after.isNotNull().alias("hasNextPage"))
