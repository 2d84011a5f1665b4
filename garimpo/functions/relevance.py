"""Relevance of listings to a search query by weighted tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions.edges import filled, let
from garimpo.functions.titles import BRANDS, clean_title

# Words for units and what they stand for; weights of token types.
UNITS = {"pol": "in", "polgadas": "in", "pulg": "in", "pulgadas": "in", "inch": "in", "in": "in", "gb": "gb", "tb": "tb"}
WEIGHTS = {"brand": 0.30, "model": 0.25, "unit": 0.15, "numeric": 0.10, "generic": 0.08}
UNIT_WORDS = r"(?i)^(in|inch|inches|pol|pulgadas|gb|tb|m\.2|nvme|ssd|hdd|ddr|sata|pci)$"
_BRANDS = tuple(sorted({b.lower() for b in BRANDS}))
DEFAULT_THRESHOLD = 0.3


def query_tokens(query: str | None) -> list[tuple[str, str]]:
    """(text, type) of a query's tokens. A token that contains any unit word is a unit ("kingston" has "in" in it)."""
    out = []
    for token in (query or "").lower().split():
        if re.fullmatch(r"\d+\.?\d*", token):
            kind = "numeric"
        elif any(u in token for u in (*UNITS.values(), *UNITS)):
            kind = "unit"
        elif token in _BRANDS:
            kind = "brand"
        else:
            kind = "model" if re.search(r"\d", token) else "generic"
        out.append((token, kind))
    return out


def title_tokens(title: Column, brand: Column, model: Column) -> Column:
    """array<struct<text, type>> of a title's tokens in lower case, with brand and model appended where they aren't among them."""
    def kind(t: Column) -> Column:
        return F.when(F.lower(t).isin(*_BRANDS), "brand").when(F.regexp_like(t, F.lit(r"\d")) & (F.length(t) <= 8), "model").when(F.regexp_like(t, F.lit(UNIT_WORDS)), "unit").otherwise("generic")

    own = F.transform(F.split(clean_title(title), r"\s+"), lambda t: F.struct(F.lower(t).alias("text"), kind(t).alias("type")))

    def with_columns(tokens: Column) -> Column:
        def added(value: Column, name: str) -> Column:
            token = F.struct(F.lower(value).alias("text"), F.lit(name).alias("type"))
            return F.when(filled(value).isNotNull() & ~F.exists(tokens, lambda t: (t["type"] == name) & (t["text"] == F.lower(value))), F.array(token)).otherwise(F.array())

        return F.concat(tokens, let(brand, lambda v: added(v, "brand")), let(model, lambda v: added(v, "model")))

    return let(own, with_columns)


def _matched(token: tuple[str, str], tokens: Column) -> Column:
    text, kind = token
    if kind == "unit":
        return F.exists(tokens, lambda t: t["text"].contains("in") | t["text"].contains("gb") | t["text"].contains("tb") | t["text"].contains(text))
    if kind in ("model", "brand"):
        return F.exists(tokens, lambda t: (t["text"] == text) | (t["type"] == kind))
    return F.exists(tokens, lambda t: t["text"] == text)


def scored(df: DataFrame, query: str | None, title: str = "title", brand: str = "brand", model: str = "model") -> DataFrame:
    """df with `score` (0 to 1), `matched` and `unmatched` query tokens; a query without tokens scores 1."""
    asked = query_tokens(query)
    if not asked:
        none = F.array().cast("array<string>")
        return df.withColumns({"score": F.lit(1.0), "matched": none, "unmatched": none})
    total = sum(WEIGHTS[k] for _, k in asked)
    texts = F.array(*[F.lit(q) for q, _ in asked])

    def judge(hit: Column) -> Column:
        got = F.lit(0.0)
        for i, (_, k) in enumerate(asked):
            got = got + F.when(hit[i], F.lit(WEIGHTS[k])).otherwise(F.lit(0.0))
        pick = lambda want: F.filter(texts, lambda _, i: F.get(hit, i) == want)
        return F.struct(F.least(got / F.lit(total), F.lit(1.0)).alias("score"), pick(True).alias("matched"), pick(False).alias("unmatched"))

    tokens = title_tokens(F.col(title), F.col(brand), F.col(model))
    hits = let(tokens, lambda t: F.array(*[_matched(q, t) for q in asked]))
    df = df.withColumn("__judged", let(hits, judge))
    return df.withColumns({c: F.col(f"__judged.{c}") for c in ("score", "matched", "unmatched")}).drop("__judged")


def relevant(df: DataFrame, query: str | None, threshold: float = DEFAULT_THRESHOLD, *, zero_is_default: bool = True, **columns: str) -> DataFrame:
    """The rows of `scored` from `threshold` on. Without a query everything passes. `zero_is_default`: 0 means the default."""
    if not query:
        return df
    least = DEFAULT_THRESHOLD if zero_is_default and not threshold else threshold
    return scored(df, query, **columns).filter(F.col("score") >= least)
