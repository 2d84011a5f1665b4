"""Classes of failure messages and retry delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of each class, in the order in which the classes are tried; then error names.
TRANSIENT = r"(?i:busy|try again|temporary|unavailable|refused)|ECONNREFUSED"
RETRIABLE = r"(?i:timeout|timed out|network|cloudflare|rate limit|session|page)|net::|403|429"
PERMANENT = r"(?i:not found|404|invalid|bad argument|cannot read|undefined|does not exist)"
NAMES = (("Timeout", "retriable"), ("ConnectionError", "transient"), ("ConnectionRefused", "transient"), ("ParseError", "permanent"), ("TypeError", "permanent"))


def failure_class(message: Column, name: Column) -> Column:
    """transient, retriable, permanent or unknown, by message and then by error name; a null message is the text "null"."""
    text = F.coalesce(message, F.lit("null"))
    out = F.lit("unknown")
    for part, kind in reversed(NAMES):
        out = F.when(F.contains(F.coalesce(name, F.lit("")), F.lit(part)), kind).otherwise(out)
    for pattern, kind in ((PERMANENT, "permanent"), (RETRIABLE, "retriable"), (TRANSIENT, "transient")):
        out = F.when(F.regexp_like(text, F.lit(pattern)), kind).otherwise(out)
    return out


#: What a failure is called: its class.
label = failure_class


def should_retry(kind: Column, attempt: Column, most: int = 3) -> Column:
    return (attempt < most) & kind.isin("retriable", "transient")


def retry_delay(attempt: Column, base_ms: int = 500, most_ms: int = 5000) -> Column:
    """Exponential delay without jitter, in ms."""
    return F.least(F.lit(float(base_ms)) * F.pow(F.lit(2.0), F.least(attempt, F.lit(10))), F.lit(float(most_ms)))


def failure_category(message: Column, name: Column) -> Column:
    """Where a run failed, by words of its message (case counts); any message with "Error" counts as network_dns at last."""
    text, n = F.coalesce(message, F.lit("null")), F.coalesce(name, F.lit(""))
    any_of = lambda *words: F.regexp_like(text, F.lit("|".join(words)))
    return (
        F.when(any_of("Cloudflare", "Pru Pru", "Manutenção", "403", "429"), "cloudflare")
        .when(any_of("timeout", "timed out") | n.contains("Timeout"), "timeout")
        .when(any_of("navigation", "navigate", "Navigation"), "navigation")
        .when(any_of("selector", "Selector", "not found"), "selector")
        .when(any_of("network", "DNS", "net::", "ECONNREFUSED", "Error"), "network_dns")
        .otherwise("other")
    )


# Codes of failed result pages by category.
PAGE_CODES = {"cloudflare": "CLOUDFLARE", "timeout": "TIMEOUT", "navigation": "NAVIGATION", "selector": "INPUT_NOT_FOUND", "network_dns": "NAVIGATION", "other": "DOM_CHANGED"}


def is_blocked(page_title: Column) -> Column:
    """Whether a page is a shop's maintenance or access-check page, by its title."""
    return F.coalesce(page_title.contains("Manutenção") | page_title.contains("Pru Pru"), F.lit(False))


def page_code(message: Column, name: Column, cards: Column) -> Column:
    """Code of a failed page; NO_PRODUCTS for a page that loaded without any card; null for one with cards and no message."""
    category = failure_category(message, name)
    code = F.lit(None).cast("string")
    for key, value in PAGE_CODES.items():
        code = F.when(category == key, value).otherwise(code)
    return F.when(message.isNotNull(), code).when(F.coalesce(cards, F.lit(0)) == 0, "NO_PRODUCTS")
