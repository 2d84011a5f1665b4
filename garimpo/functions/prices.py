"""Prices of listings as numbers. (Amounts in common units, with ambiguous marks resolved, are in operators.units.)"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from garimpo.functions.edges import filled, let, plain_spaces


def number(text: Column) -> Column:
    """With a comma: dots are thousands marks and the first comma is the decimal mark. Without: d.ddd groups, else digits and dots."""
    x = F.regexp_replace(text, r"\s+", "")
    comma = F.regexp_replace(F.regexp_replace(x, r"\.", ""), r"^([^,]*),", "$1.")
    grouped = F.regexp_like(x, F.lit(r"^\d{1,3}(?:\.\d{3})+$"))
    plain = F.when(grouped, F.regexp_replace(x, r"\.", "")).otherwise(F.regexp_replace(x, r"[^\d.]", ""))
    y = F.when(x.contains(","), comma).otherwise(plain)
    return F.when(F.regexp_like(y, F.lit(r"^(\d+\.?\d*|\.\d+)$")), y.try_cast("double"))


def parse_price(text: Column, prefix: str = "R$") -> Column:
    """The least amount after `prefix` that is no instalment ("10x de R$ 99"); without one the greatest other number; else null."""
    t = plain_spaces(text)
    value = lambda p: F.regexp_extract(p, r"^\s*([\d\s.,]+)", 1)

    def after_prefix(parts: Column) -> Column:
        left = lambda i: F.right(F.get(parts, i), F.lit(12))
        after = F.transform(F.slice(parts, 2, 1 << 20), lambda p, i: F.struct(value(p).alias("v"), F.regexp_like(left(i), F.lit(r"(?i)\d\s*[x×]\s*(?:de\s*)?$")).alias("parts"), F.regexp_like(p, F.lit(r"(?i)^\s*[\d\s.,]+[x×]")).alias("times")))
        priced = F.transform(F.filter(after, lambda a: ~a["parts"] & ~a["times"] & (a["v"] != "")), lambda a: number(a["v"]))
        return F.array_min(F.filter(priced, lambda x: x > 0))

    prefixed = let(F.split(t, "(?i)" + re.escape(prefix)), after_prefix)
    after_times = F.regexp_replace(t, r"(?i)(\d\s*[x×]\s*(?:de\s*)?)\d[\d.,\s]*", "$1")
    loose = F.regexp_replace(after_times, r"(?i)\d[\d.,\s]*([x×])", "$1")
    other = F.array_max(F.filter(F.transform(F.regexp_extract_all(loose, F.lit(r"(\d[\d.,\s]*)"), F.lit(1)), number), lambda x: x > 0))
    return F.when(filled(text).isNotNull(), F.coalesce(prefixed, other))


def stored_price(text: Column) -> Column:
    """Digits with the first comma as decimal mark, dots dropped; 0 where nothing can be read."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[^\d.,]", ""), r"\.", ""), r"^([^,]*),", "$1.")
    return F.coalesce(filled(F.regexp_extract(x, r"^(\d+\.?\d*|\.\d+)", 1)).try_cast("double"), F.lit(0.0))


def price_in(text: Column, currency: Column | None) -> Column:
    """The price a text states; amounts are marked with R$ in reais (BRL, or no `currency` given) and with $ otherwise."""
    brl = parse_price(text)
    return brl if currency is None else F.when(currency == "BRL", brl).otherwise(parse_price(text, "$"))


def current_price(price: Column, text: Column, currency: Column | None = None) -> Column:
    """The price column where it is a finite number, else what the text says."""
    finite = price.isNotNull() & ~F.isnan(price) & (F.abs(price) != F.lit(float("inf")))
    return F.when(finite, price).otherwise(F.coalesce(price_in(text, currency), F.when(price.isNotNull(), F.lit(0.0))))


def original_price(price: Column, text: Column, currency: Column | None = None) -> Column:
    """The greatest of several "R$" amounts of the text and the current price; the current price if there are no several."""
    amounts = F.regexp_extract_all(plain_spaces(text), F.lit(r"(?i)r\$\s*([\d.]+,\d{2}|\d+(?:\.\d+)?)"), F.lit(1))
    values = F.filter(F.transform(amounts, lambda a: F.replace(F.replace(a, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")), lambda v: v > 0)
    now = current_price(price, text, currency)
    return F.when(now.isNotNull() & (F.coalesce(F.size(values), F.lit(0)) > 1), F.greatest(F.array_max(values), now)).otherwise(now)


def format_brl(price: Column) -> Column:
    """R$ 1.234,56; N/A for null."""
    cents = F.floor(F.abs(price) * 100 + 0.5).cast("long")
    whole = F.translate(F.format_number(F.floor(cents / 100), 0), ",", ".")
    return F.coalesce(F.concat(F.when(price < 0, "-").otherwise(""), F.lit("R$ "), whole, F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0")), F.lit("N/A"))


def format_ms(ms: Column) -> Column:
    """999ms, 1.0s; null stays null."""
    tenths = F.floor(ms / 100.0 + 0.5).cast("long")
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms.isNotNull(), F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s")))
