"""Attributes read from listing titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from garimpo.functions.edges import filled, found, has, let, plain_spaces

# Brand names to look for, in this order.
BRANDS = (
    "Intel", "AMD", "Nvidia", "NVIDIA", "ASUS", "ASRock", "Gigabyte", "MSI", "Corsair", "Kingston", "Samsung", "Western Digital", "WD",
    "Seagate", "Crucial", "ADATA", "Kingmax", "HyperX", "Logitech", "Razer", "Cooler Master", "EVGA", "Thermaltake", "Be Quiet", "Seasonic",
    "FSP", "Super Flower", "NZXT", "Lian Li", "Montech", "SilverStone", "Transcend", "Lexar", "SanDisk", "KingSpec", "G-Skill", "Pichau",
    "Kabum", "GeForce",
)
# Phrases that mean a listing can't be bought.
OUT_OF_STOCK = ("fora de estoque", "sem estoque", "indisponível", "esgotado", "sem disponibilidade", "out of stock")

#: Noise to remove, in this order: stars, ratings, a leading seal or sponsor mark, instalments (to a space).
NOISE = (
    ("[*\u2605\u2b50]+\u200b?", ""),
    (r"(?iu)avaliação\s*[\d.,]+\s*de\s*[\d.,]*", ""),
    (r"(?i)^selo:\s*\S+(?:\s+\S+)?\s*", ""),
    (r"(?i)^produto\s+patrocinado\s*", ""),
    (r"(?i)\s*\d+\s*[x×]\s*de\s*r\$\s*[\d.,]+\s*", " "),
)


def clean_title(title: Column) -> Column:
    """Title without noise and with single spaces; null gives an empty text. The first "(n... Geração)" goes as well."""
    x = plain_spaces(F.coalesce(title, F.lit("")))
    for pattern, to in NOISE:
        x = F.regexp_replace(x, pattern, to)
    x = F.regexp_replace(x, r"(?s)^(.*?)\s*\(\d+[^)]*\s*[Gg]eração\)", "$1")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def brand(title: Column) -> Column:
    """The leftmost listed brand as typed, or NVIDIA wherever that stands; else null."""
    return F.when(has(title, r"(?i)\bnvidia\b"), F.lit("NVIDIA")).otherwise(found(title, rf"(?i)\b({'|'.join(BRANDS)})\b"))


def model(title: Column) -> Column:
    """A known product line with its number, else a code; else what follows the brand, the first token with a digit, or the title."""
    lines = (
        r"(?i)\b(geforce\s+(?:rtx|gtx)\s*\d+(?:\s*ti)?(?:\s+\w+)?)",
        r"(?i)\b(ryzen\s+(?:\d+\s*\S+|9\s+\d+\S*))",
        r"(?i)\b(core\s+(?:i\d|3|5|7|9)[\s.\d\-ix]+)",
        r"\b([A-Z]\d{2,4}[A-Z]?)",
    )

    def read(x: Column) -> Column:
        clean, own = x["clean"], x["own"]
        first_word = F.lower(F.split(own, " ")[0])
        named = [let(F.trim(found(clean, p)), lambda h: F.when(own.isNull() | (F.lower(h) != first_word), h)) for p in lines]
        at = F.instr(clean, own)
        after = F.when(at > 0, F.trim(F.substring(clean, at + F.length(own), F.length(clean))))
        rest = F.when((F.length(after) > 0) & (F.length(after) < 60), after)
        token = F.filter(F.split(clean, r"\s+"), lambda t: (F.length(t) >= 2) & F.regexp_like(t, F.lit(r"\d")))
        return F.when(clean != "", F.coalesce(*named, rest, F.get(token, F.lit(0)), clean))

    return let(F.struct(clean_title(title).alias("clean"), brand(title).alias("own")), read)


def storage_capacity(title: Column) -> Column:
    """The first terabyte amount, else the first gigabyte amount, as written."""
    return F.trim(F.coalesce(found(title, r"(?i)\b(\d+\.\d+\s*tb)\b"), found(title, r"(?i)\b(\d+(?:\.\d+)?\s*tb)\b"), found(title, r"(?i)\b(\d+(?:\.\d+)?\s*gb)\b")))


def memory_capacity(title: Column) -> Column:
    """The first giga- or megabyte amount of a title that names memory or shows a gigabyte amount."""
    t = F.lower(title)
    named = t.contains("ram") | t.contains("dimm") | t.contains("ddr") | t.contains("memória")
    return F.when(named | has(title, r"(?i)\b\d+(?:\.\d+)?\s*gb"), F.trim(found(title, r"(?i)\b(\d+(?:\.\d+)?\s*(?:gb|mb))\b")))


def availability(title: Column, price_text: Column, provider: Column) -> Column:
    """out_of_stock by phrase, in_stock by a price; without one it is unknown in the shop kabum and in_stock elsewhere; no title: unknown."""
    text = F.lower(F.concat_ws(" ", title, F.coalesce(price_text, F.lit(""))))
    gone = F.lit(False)
    for phrase in OUT_OF_STOCK:
        gone = gone | text.contains(phrase)
    priced = F.coalesce(has(price_text, r"\d"), F.lit(False))
    kabum = F.when(filled(price_text).isNotNull(), "in_stock").otherwise("unknown")
    return F.when(filled(title).isNull(), "unknown").when(gone, "out_of_stock").when(priced, "in_stock").when(provider == "kabum", kabum).otherwise("in_stock")


def is_listing(title: Column) -> Column:
    """Whether a title names a product: it is neither blank nor one of a page's own links to more."""
    return F.coalesce(~F.trim(title).isin("", "Ver todas", "Ver todos"), F.lit(False))
