"""Product numbers of listings, however their ids and addresses are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from garimpo.functions.edges import let

#: Fewest digits of a number in an address that can be a product number; shorter ones belong to the title in it.
LEAST_DIGITS = 7
# Query parameters that hold a product number or a further address.
NUMBER_PARAMETERS = "id|pid|sku|produto|product|item|codigo"
ADDRESS_PARAMETERS = "to|url|u|target|dest"


def from_id(text: Column) -> Column:
    """An id without shop prefix, separators and leading zeros if that leaves digits, else its letters and digits; blank is null."""
    bare = F.regexp_replace(F.lower(text), r"[^a-z0-9]", "")
    number = F.regexp_extract(bare, r"^[a-z]*?0*(\d+)$", 1)
    return F.when(number != "", number).when(bare != "", bare)


def from_url(url: Column) -> Column:
    """The product number in an address: redirects are followed, tracking parameters and fragments ignored; else null."""
    def number(address: Column) -> Column:
        parameter = F.regexp_extract(address, rf"[?&](?:{NUMBER_PARAMETERS})=(\d{{{LEAST_DIGITS},}})(?!\d)", 1)
        path = F.regexp_extract(F.substring_index(address, "?", 1), rf"(?<![a-z0-9])p?(\d{{{LEAST_DIGITS},}})(?![a-z0-9])", 1)
        found = let(F.when(address.contains("?"), parameter), lambda p: F.when(p != "", p).otherwise(path))
        return let(found, lambda n: F.when(n != "", F.regexp_replace(n, r"^0+(?=\d)", "")))

    redirected = F.regexp_extract(url, rf"(?i)[?&](?:{ADDRESS_PARAMETERS})=([^&#\s]+)", 1)
    inner = F.when(url.contains("%"), let(redirected, lambda x: F.when(x != "", F.try_url_decode(x))))
    return let(F.substring_index(F.lower(F.trim(F.coalesce(inner, url))), "#", 1), number)


def identities(provider: Column, product_id: Column, url: Column) -> Column:
    """array<string> of a listing's identities within its provider: the numbers of its id and its address, or the bare address."""
    shop = F.coalesce(F.lower(F.trim(provider)), F.lit(""))
    bare = F.lower(F.trim(F.regexp_replace(url, r"[?#].*$", "")))
    by_url = lambda number: F.coalesce(number, F.when(F.trim(url) != "", bare))
    both = let(from_url(url), lambda number: F.array_distinct(F.array_compact(F.array(from_id(product_id), by_url(number)))))
    return F.transform(both, lambda n: F.concat(shop, F.lit("#"), n))
