"""What a promotion text says: type flags, discount, keyword categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlens.functions import sql_text as sql

# Patterns of each promotion type (case-insensitive, any may match).
PROMO_TYPE_PATTERNS = {
    "free_shipping_promo": [
        r"darmowa dostawa",
        r"bezpłatna wysyłka",
        r"free shipping",
        r"za darmo\s+wysy",
    ],
    "discount_percent_promo": [r"rabat", r"-\d+%", r"discount", r"taniej", r"tańsza"],
    "free_item_promo": [r"gratis", r"bezpłatnie", r"free item", r"za darmo\s+produkt"],
    "bundle_multibuy_promo": [
        r"druga sztuka",
        r"kupujesz.*drugi",
        r"2[+\w]*\s+za",
        r"bundle",
        r"komplet",
    ],
    "min_purchase_promo": [
        r"zamówień powyżej",
        r"minimum",
        r"od\s+\d+",
        r"powyżej\s+\d+",
        r"za\s+\d+\s+zł",
    ],
}

# Keyword categories of the promotion report.
KEYWORD_CATEGORIES = {
    "Free Shipping": ["darmowa dostawa", "bezpłatna wysyłka", "free shipping"],
    "Discount %": ["rabat", "discount", "%", "taniej"],
    "Free Item": ["gratis", "bezpłatnie", "free"],
    "Bundle/Multi-buy": ["druga sztuka", "kupujesz", "przy zakupie"],
    "Min Purchase": ["zamówień powyżej", "minimum", "od"],
    "Time Limited": ["ograniczona", "limited", "koniec"],
}

# Fixed value: a discount as written in a text.
DISCOUNT_PATTERN = r"-(\d+)%"


def matches_any(text: str, patterns: list[str]) -> str:
    """SQL text: whether a pattern occurs in the lower-cased text; null gives null.

    ``(?U)`` makes \\w, \\d and \\s cover Polish letters and the like.
    """
    return f"(lower({text}) RLIKE {sql.literal('(?U)(?iu)' + '|'.join(patterns))})"


def promo_flags(
    text: str = "promo_description", patterns: dict[str, list[str]] | None = None
) -> dict[str, Column]:
    """A 0/1 column per promotion type; null text gives 0."""
    return {
        name: F.expr(flag)
        for name, flag in promo_flags_sql(text, patterns or PROMO_TYPE_PATTERNS).items()
    }


def promo_flags_sql(text: str, patterns: dict[str, list[str]]) -> dict[str, str]:
    filled = f"coalesce({sql.name(text)}, '')"
    return {
        name: f"CAST({matches_any(filled, alternatives)} AS BIGINT)"
        for name, alternatives in patterns.items()
    }


def discount_percent(text: str = "promo_description") -> Column:
    """The first ``-N%`` of the text as a number, else 0."""
    digits = F.regexp_extract(F.col(text), "(?U)" + DISCOUNT_PATTERN, 1)
    return F.coalesce(digits.try_cast("long"), F.lit(0).cast("long"))
