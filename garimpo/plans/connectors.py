"""Connectors: shops whose result pages were captured, asked by query and page number.

Captured pages are a DataFrame (query, page, url, html). A connector picks the page, reads its cards with the reader of
the shop's layout and its pagination from the links (or buttons) in it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions import urls
from garimpo.functions.edges import let
from garimpo.plans.pipeline import Page, shop_listings
from garimpo.sources import pages as readers


def links_of(html: Column) -> Column:
    """array<string> of the targets of all links of a page."""
    return F.regexp_extract_all(html, F.lit(r"<a\b[^>]*href=\"([^\"]*)\""), F.lit(1))


def link_pagination(html: Column, url: Column, home: str, parameter: str) -> Column:
    """Pagination read from a page's links that name a page in `parameter`."""
    absolute = F.transform(F.filter(links_of(html), lambda u: u.contains(f"{parameter}=")), lambda u: urls.absolute_url(u, home))
    return urls.pagination(absolute, url, parameter)


def button_pagination(html: Column, next_url: Callable[[Column], Column]) -> Column:
    """Pagination read from numbered buttons: which one is current, and whether the button for the next page is there and enabled.

    `next_url` gives the address of a page number. Without buttons the only page is the current one, 1.
    """
    # Classes of the buttons.
    button = r"(?s)<(?:li|a|button|span)\b[^>]*class=\"[^\"]*andes-pagination__button\b[^>]*>.*?</(?:li|a|button|span)>"

    def read(buttons: Column) -> Column:
        number = lambda b: F.regexp_extract(readers.inner_text(b), r"^(\d{1,9})$", 1).try_cast("int")
        pages = F.array_sort(F.array_distinct(F.array_compact(F.transform(buttons, number))))
        current = F.coalesce(number(F.get(F.filter(buttons, lambda b: b.contains("andes-pagination__button--current")), F.lit(0))), F.lit(1))
        after = F.filter(buttons, lambda b: b.contains("andes-pagination__button--next"))
        more = (F.size(after) > 0) & ~F.exists(after, lambda b: b.contains("andes-pagination__button--disabled") | b.contains('data-andes-state="disabled"'))
        all_ = F.when(F.size(buttons) == 0, F.array(F.lit(1))).otherwise(pages)
        return F.struct(current.alias("currentPage"), all_.alias("pages"), F.when(more, next_url(current + 1)).alias("nextPageUrl"), more.alias("hasNextPage"))

    return let(F.regexp_extract_all(html, F.lit(button), F.lit(0)), read)


@dataclass
class Connector:
    """A source over captured pages.

    name, home: the shop. reader: cards (pos, title, price_text, url) of pages (page, html). pagination: struct of a page
    (html, url, query). parameter: where the shop names the page in its addresses.
    """

    name: str
    home: str
    captured: DataFrame
    reader: Callable[[DataFrame], DataFrame]
    pagination: Callable[[Column, Column, Column], Column]

    def page(self, query: str, number: int = 1) -> DataFrame:
        """The captured page of a query, at most one row; of several captures the one with the least address and text."""
        rows = self.captured.filter((F.col("query") == query) & (F.col("page") == number))
        return rows.groupBy("query", "page").agg(F.min(F.struct("url", "html")).alias("p")).select("query", "page", "p.*")

    def search(self, query: str, number: int = 1) -> Page:
        """Listings of one result page; a page that wasn't captured has none. The query must be a non-empty string."""
        if not isinstance(query, str) or not query.strip():
            raise ValueError("query must be a non-empty string")
        one = self.page(query, number)
        head = one.select("url", self.pagination(F.col("html"), F.col("url"), F.col("query")).alias("p")).first()
        rows = shop_listings(self.reader(one.select("page", "html")), self.home, self.name, "pos").withColumnRenamed("pos", "ord")
        return Page(rows, head.url if head else "", head.p.asDict() if head and head.p else None)

    def __call__(self, query: str) -> Page:
        return self.search(query)


def marked_shop(name: str, home: str, captured: DataFrame) -> Connector:
    return Connector(name, home, captured, readers.marked_cards, lambda html, url, _: link_pagination(html, url, home, "page"))


def plain_shop(name: str, home: str, captured: DataFrame) -> Connector:
    return Connector(name, home, captured, lambda df: readers.plain_cards(df, "page"), lambda html, url, _: link_pagination(html, url, home, "page_number"))


def listed_shop(name: str, home: str, captured: DataFrame, host: str, base: str) -> Connector:
    """`base`: the address before the query; `host`: what addresses of the shop itself hold."""
    following = lambda query: lambda number: urls.search_page_url(base, query, number)
    return Connector(name, home, captured, lambda df: readers.listed_cards(df, host), lambda html, _, query: button_pagination(html, following(query)))


def valid_pagination(p: Column, expected: Column | None = None) -> Column:
    """Whether a pagination struct has a current page (the expected one, if given), at least one page and says whether more follow."""
    ok = p["currentPage"].isNotNull() & (F.size(p["pages"]) > 0) & p["hasNextPage"].isNotNull()
    ok = ok if expected is None else ok & (expected.isNull() | (p["currentPage"] == expected))
    return F.coalesce(ok, F.lit(False))

