"""Cards to product rows: rich, basic and id-carrying layouts, and the output form.

Extraction yields real nulls and numbers; :func:`normalise_products` turns them into
the 14 output columns with text sentinels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    MISSING,
    brl_cents,
    discount_pct,
    offscreen_price,
    rating_value,
    review_count,
    split_price,
    to_cents,
)
from ..plans import rules as R
from .fields import (
    card_images,
    first_image,
    first_link,
    first_text,
    has_badge,
    product_link,
    seller_name,
    shipping_label,
)
from .pages import CARD_COLUMNS
from .selectors import CARD_IN_PAGE, first, first_match_text, first_nonempty_text

# Output columns in order.
TEXT_COLUMNS = [
    "title", "price", "original_price", "discount_percentage", "seller", "rating",
    "reviews_count", "shipping", "product_url", "image_url", "installments", "location",
]
NUMBER_COLUMNS = ["page_number", "position_on_page"]
PRODUCT_COLUMNS = TEXT_COLUMNS + NUMBER_COLUMNS

_CARD_COLUMNS = (*CARD_COLUMNS, "parse_error")


_PRICES = ("price", "original_price")


def _listing_fields(rules: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Raw field texts of a listing card; fields without a rule are null."""
    readers = {"product_url": first_link, "image_url": first_image}
    return {name: readers.get(name, first_text)(rules.get(name, [])) for name in TEXT_COLUMNS}


def _with_cents(raw: DataFrame, legacy: bool) -> DataFrame:
    # a step of its own: parsing mentions the text several times, finding it is expensive
    return raw.withColumns(
        {c: brl_cents(F.col(c), legacy).cast("string") for c in _PRICES if c in raw.columns}
    )


def _keys(cards: DataFrame) -> list[str]:
    return [c for c in cards.columns if c not in _CARD_COLUMNS]


def rich_products(
    cards: DataFrame, rules: Mapping[str, Sequence[str]] = R.RICH_RULES, legacy: bool = False
) -> DataFrame:
    """Twelve fields of a rich card; a card with nothing found still gives a row."""
    fields = _listing_fields(rules)
    raw = cards.withColumn("card_images", card_images()).select(
        *_keys(cards), *[c.alias(n) for n, c in fields.items()]
    )
    return _with_cents(raw, legacy)


def basic_products(
    cards: DataFrame, rules: Mapping[str, Sequence[str]] = R.BASIC_RULES, legacy: bool = False
) -> DataFrame:
    """Title, price, link and image of a basic card."""
    return rich_products(cards, rules, legacy)


def listing_products(
    cards: DataFrame,
    rich: Mapping[str, Sequence[str]] = R.RICH_RULES,
    basic: Mapping[str, Sequence[str]] = R.BASIC_RULES,
    legacy: bool = False,
) -> DataFrame:
    """Rich and basic cards together, each by the rules of its layout, in one pass."""
    one, other = _listing_fields(rich), _listing_fields(basic)
    raw = cards.withColumn("card_images", card_images()).select(
        *_keys(cards),
        *[
            F.when(F.col("layout") == R.RICH, one[n]).otherwise(other[n]).alias(n)
            for n in TEXT_COLUMNS
        ],
    )
    return _with_cents(raw, legacy)


def title_and_prices(cards: DataFrame, legacy: bool = False) -> DataFrame:
    """Title, current price, original price and raw discount text by layout."""
    rich, basic = _listing_fields(R.RICH_RULES), _listing_fields(R.BASIC_RULES)
    wanted = ("title", "price", "original_price", "discount_percentage")
    raw = cards.select(
        *_keys(cards),
        *[F.when(F.col("layout") == R.RICH, rich[n]).otherwise(basic[n]).alias(n) for n in wanted],
    )
    return _with_cents(raw, legacy)


def card_identity() -> tuple[Column, Column]:
    """Item id and title of an id-carrying card, null when empty."""
    item = F.nullif(F.col("card_attrs")[R.ID_ATTRIBUTE], F.lit(""))
    title = F.expr(first_nonempty_text(R.ID_RULES["title"], CARD_IN_PAGE))
    return item, title


def id_products(cards: DataFrame, legacy: bool = False, outer: bool = False) -> DataFrame:
    """Products of id-carrying cards; cards without id or title are dropped.

    Adds ``item_id`` and ``has_badge`` beside the output fields. ``outer`` keeps the others too,
    with a null ``item_id``.
    """

    def text(rule: str) -> Column:
        return F.expr(first_match_text(R.ID_RULES[rule], CARD_IN_PAGE))

    item, title = card_identity()
    whole = item.isNotNull() & title.isNotNull()
    identified = cards.withColumns({"item_id": F.when(whole, item), "title": title})
    if not outer:
        identified = identified.filter(F.col("item_id").isNotNull())
    # texts first, numbers from them next: each text is looked up once
    raw = identified.select(
        *_keys(cards),
        "item_id",
        "title",
        text("price_whole").alias("_whole"),
        text("price_fraction").alias("_fraction"),
        text("price_full").alias("_full"),
        text("original_price").alias("_before"),
        text("rating").alias("_rating"),
        text("reviews").alias("_reviews"),
        seller_name().alias("seller"),
        shipping_label().alias("shipping"),
        product_link(F.col("item_id")).alias("product_url"),
        F.expr(first(R.ID_RULES["image"], "m.attrs['src']", CARD_IN_PAGE)).alias("_image"),
        has_badge().alias("has_badge"),
    )
    price = F.when(
        F.col("_whole").isNotNull() & F.col("_fraction").isNotNull(),
        split_price(F.col("_whole"), F.col("_fraction")),
    ).otherwise(offscreen_price(F.col("_full")))
    priced = raw.withColumns(
        {
            "_price": to_cents(price, legacy),
            "_original": to_cents(offscreen_price(F.col("_before")), legacy),
            "_stars": rating_value(F.col("_rating")),
        }
    ).withColumn("_discount", discount_pct(F.col("_price"), F.col("_original")))
    nothing = F.lit(None).cast("string")
    return priced.select(
        *_keys(cards),
        "item_id",
        "title",
        F.col("_price").cast("string").alias("price"),
        F.col("_original").cast("string").alias("original_price"),
        F.when(F.col("_discount") != 0, F.concat(F.col("_discount").cast("string"), F.lit("%")))
        .alias("discount_percentage"),
        "seller",
        F.when(F.col("_stars") != 0, F.col("_stars").cast("string")).alias("rating"),
        F.coalesce(review_count(F.col("_reviews"), legacy), F.lit(0)).cast("string").alias("reviews_count"),
        "shipping",
        "product_url",
        F.nullif(F.col("_image"), F.lit("")).alias("image_url"),
        nothing.alias("installments"),
        nothing.alias("location"),
        "has_badge",
    )


def normalise_products(products: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The 14 output columns in order: ``N/A`` for missing texts, 1 for missing numbers."""

    def column(name: str, default: Column, kind: str) -> Column:
        given = F.col(name).cast(kind) if name in products.columns else F.lit(None).cast(kind)
        return F.coalesce(given, default).alias(name)

    return products.select(
        *keys,
        *[column(c, F.lit(MISSING), "string") for c in TEXT_COLUMNS],
        *[column(c, F.lit(1), "int") for c in NUMBER_COLUMNS],
    )
