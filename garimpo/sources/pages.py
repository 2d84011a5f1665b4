"""Product cards of captured result pages: (html) to rows of title, price_text and url, one reader per shop layout.

Cards are cut out with regular expressions, so pages are read inside the plan; tags inside a card's texts are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions.edges import filled, let, plain_spaces

#: Most rows that are read of one page of the layout `plain_cards`.
CARD_LIMIT = 80


def inner_text(html: Column) -> Column:
    """Text of a piece of HTML: tags dropped, common entities resolved, ends trimmed."""
    x = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(sign))
    return F.trim(plain_spaces(x))


def _cards(pages: DataFrame, pattern: str, html: str, keep: list[str]) -> DataFrame:
    cards = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(0))
    return pages.select(*keep, F.posexplode(cards).alias("pos", "card"))


def marked_cards(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Cards that are links marked as products, with the title in a heading and the price in an element of a price class."""
    keep = keep or []
    df = _cards(pages, r"(?s)<a\b[^>]*data-cy=\"list-product\"[^>]*>.*?</a>", html, keep)
    title = filled(inner_text(F.regexp_extract("card", r"(?s)<h2\b[^>]*>(.*?)</h2>", 1)))
    price = filled(inner_text(F.regexp_extract("card", r"(?s)<(\w+)\b[^>]*class=\"[^\"]*price[^\"]*\"[^>]*>(.*?)</\1>", 2)))
    return df.select(*keep, "pos", title.alias("title"), price.alias("price_text"), filled(F.regexp_extract("card", r"<a\b[^>]*href=\"([^\"]*)\"", 1)).alias("url"))


def card_title(text: Column) -> Column:
    """What stands before the first price of a card's text, without seals, sponsor marks, ratings and shipping notes."""
    x = F.substring_index(text, "R$", 1)
    for pattern in (r"(?is)selo:\s*.*?produto\s+patrocinado", r"(?i)selo:\s*\S+(?:\s+\S+)?", r"(?i)produto\s+patrocinado", r"(?iu)avaliação\s*[\d.,]+\s*de\s*[\d.,]+", r"(?i)frete\s+gr[aá]tis\*?"):
        x = F.regexp_replace(x, pattern, "")
    return F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), r"^[^A-Za-zÀ-ÿ0-9]+", "")


def card_price(text: Column) -> Column:
    """The last price of a card's text that is no instalment ("10x de R$ 99")."""
    def last(parts: Column) -> Column:
        prices = F.transform(F.slice(parts, 2, 1 << 20), lambda p, i: F.struct(F.regexp_extract(p, r"^(\s*[\d.]+,?\d*)", 1).alias("p"), F.contains(F.lower(F.right(F.get(parts, i), F.lit(10))), F.lit("x de")).alias("parts")))
        kept = F.filter(prices, lambda x: (x["p"] != "") & ~x["parts"])
        return let(kept, lambda k: F.when(F.size(k) > 0, F.concat(F.lit("R$"), F.element_at(k, -1)["p"])))

    return let(F.split(text, r"R\$"), last)


def plain_cards(pages: DataFrame, page_id: str, html: str = "html") -> DataFrame:
    """Cards that are links to a product and hold everything in one text; the first of each link, at most CARD_LIMIT of a page."""
    df = _cards(pages, r"(?s)<a\b[^>]*href=\"[^\"]*/produto/[^\"]*\"[^>]*>.*?</a>", html, [page_id])
    lines = F.filter(F.transform(F.split(inner_text(F.regexp_replace("card", r"(?i)<br */?>|</(?:div|p|span|h\d)>", "\n")), "\n"), F.trim), lambda x: x != "")
    df = df.select(page_id, "pos", F.regexp_extract("card", r"<a\b[^>]*href=\"([^\"]*)\"", 1).alias("url"), lines.alias("lines")).withColumn("text", F.array_join("lines", " "))
    df = df.filter(F.contains("text", F.lit("R$")))
    first = df.groupBy(page_id, "url").agg(F.min_by(F.struct("pos", "lines", "text"), "pos").alias("c")).select(page_id, "url", "c.*")
    clean = card_title(F.col("text"))
    spare = F.filter("lines", lambda x: ~x.contains("R$") & ~x.contains("desconto") & ~x.contains("pix") & ~x.contains("frete") & (F.length(x) > 10))
    title = F.when(F.length(clean) > 10, clean).otherwise(F.coalesce(F.get(spare, F.lit(0)), F.get("lines", F.lit(0))))
    # Cards of a page are few; the limit is part of the layout and holds for each page.
    of_page = F.slice(F.array_sort(F.collect_list(F.struct("pos", title.alias("title"), card_price(F.col("text")).alias("price_text"), "url"))), 1, CARD_LIMIT)
    return first.groupBy(page_id).agg(of_page.alias("rows")).select(page_id, F.explode("rows").alias("r")).select(page_id, "r.*")


def good_link(href: Column, host: str) -> Column:
    """A link of the shop itself; advertising and click counters give null (so does a product whose address has "click" in it)."""
    return F.when(href.contains(host) & ~href.contains("publicidade.") & ~href.contains("click"), href)


def listed_cards(pages: DataFrame, host: str, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Cards that are items of a result list: advertisements are dropped, and so is what has no title or good link."""
    keep = keep or []
    df = _cards(pages, r"(?s)<li\b[^>]*ui-search-layout__item[^>]*>.*?</li>", html, keep)
    df = df.filter(~F.regexp_like("card", F.lit(r"class=\"[^\"]*(?:poly-component__ads-promotions|ui-search-item__ad)\b")))
    title = filled(inner_text(F.regexp_extract("card", r"(?s)<h2\b[^>]*>(.*?)</h2>", 1)))
    price = filled(F.regexp_replace(inner_text(F.regexp_extract("card", r"(?s)<(\w+)\b[^>]*class=\"[^\"]*price[^\"]*\"[^>]*>(.*?)</\1>", 2)), r"\s+", " "))
    links = F.transform(F.regexp_extract_all("card", F.lit(r"<a\b[^>]*href=\"([^\"]*)\""), F.lit(1)), lambda h: good_link(h, host))
    url = F.get(F.array_compact(links), F.lit(0))
    return df.select(*keep, "pos", title.alias("title"), price.alias("price_text"), url.alias("url")).filter(F.col("title").isNotNull() & F.col("url").isNotNull())


#: Readers by layout.
READERS: dict[str, Callable[..., DataFrame]] = {"marked": marked_cards, "plain": plain_cards, "listed": listed_cards}
