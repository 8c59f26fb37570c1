"""Extraction rules as data: layout, field, priority, selector.

Fixed values: the selectors, attribute names, phrases and words below must be
exactly these for the extraction to give the expected rows. Lists are in order of
priority. Replace any list to read other page layouts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

RICH = "poly-card"
BASIC = "classic"
ID = "id-card"

OFFSET_PLATFORM = "mercadolivre"
QUERY_PLATFORM = "amazon"
PLATFORMS = [OFFSET_PLATFORM, QUERY_PLATFORM]

RICH_CARD = "li.ui-search-layout__item"
BASIC_CARD = "div.ui-search-result__wrapper"

RICH_RULES = {
    "title": [
        ".poly-component__title a",
        ".poly-component__title",
        "h2.poly-box",
        ".poly-component__title-wrapper a",
        "h2",
        "a[title]",
    ],
    "price": [
        ".poly-price__current .andes-money-amount__fraction",
        ".andes-money-amount__fraction",
        ".poly-component__price .andes-money-amount__fraction",
        "span.andes-money-amount__fraction",
    ],
    "original_price": [
        ".andes-money-amount--previous .andes-money-amount__fraction",
        "s.andes-money-amount .andes-money-amount__fraction",
        ".andes-money-amount--previous",
        "s.andes-money-amount",
    ],
    "discount_percentage": [
        ".andes-money-amount__discount",
        'span[class*="discount"]',
        ".poly-price__discount",
    ],
    "seller": [
        ".poly-component__seller",
        ".ui-search-official-store-label",
        'span[class*="seller"]',
        'span[class*="store"]',
    ],
    "rating": [
        ".poly-reviews__rating",
        ".ui-search-reviews__rating-number",
        'span[class*="rating"]',
    ],
    "reviews_count": [
        ".poly-reviews__total",
        ".ui-search-reviews__amount",
        'span[class*="reviews"]',
    ],
    "shipping": [
        ".poly-component__shipping",
        ".ui-search-item__shipping",
        'p[class*="shipping"]',
        'span[class*="shipping"]',
    ],
    "installments": [
        ".poly-price__installments",
        ".ui-search-item__group__element--installments",
        'span[class*="installments"]',
    ],
    "location": [
        ".poly-component__location",
        ".ui-search-item__location",
        'span[class*="location"]',
    ],
    "product_url": [
        ".poly-component__title a",
        '.poly-card a[href*="mercadolivre"]',
        'a[href*="mercadolibre"]',
        "a[href]",
    ],
    "image_url": [
        ".poly-card__portada img",
        ".poly-component__picture img",
        ".ui-search-result-image img",
        ".ui-search-result__image img",
        ".ui-search-result-image__element img",
        ".ui-search-result__image-wrapper img",
        ".poly-card img",
        ".poly-component img",
        ".poly-box img",
        'img[class*="ui-search"]',
        'img[class*="poly"]',
        'img[class*="result"]',
        'img[class*="product"]',
        'img[class*="item"]',
        'img[class*="card"]',
        "figure img",
        "picture img",
        'div[class*="image"] img',
        'div[class*="picture"] img',
        'div[class*="photo"] img',
        'span[class*="image"] img',
        "li img",
        "article img",
        "section img",
        "a img",
        'img[src*="mlstatic"]',
        'img[data-src*="mlstatic"]',
        'img[data-lazy*="mlstatic"]',
        'img[srcset*="mlstatic"]',
        'img[src*="http"]',
        'img[data-src*="http"]',
        "img",
    ],
}

BASIC_RULES = {
    "title": [
        "h2.ui-search-item__title",
        ".ui-search-item__title",
        "a.ui-search-item__group__element",
    ],
    "price": ["span.andes-money-amount__fraction", "span.price-tag-fraction"],
    "product_url": ['a[href*="mercadolivre"]', "a[href]"],
    "image_url": [
        ".ui-search-result-image img",
        ".ui-search-result__image img",
        'img[class*="ui-search"]',
        "figure img",
        "a img",
        'img[src*="mlstatic"]',
        "img",
    ],
}

ID_CONTAINER = "div.s-main-slot"
ID_CARD = 'div[data-component-type="s-search-result"]'
ID_ATTRIBUTE = "data-asin"
ID_RULES = {
    "title": "h2.a-size-base-plus",
    "link": "h2 a",
    "link_alternatives": ['a[href*="/dp/"]', "h2 > a", "a.a-link-normal"],
    "image": "img.s-image",
    "price_whole": "span.a-price-whole",
    "price_fraction": "span.a-price-fraction",
    "price_full": "span.a-price > span.a-offscreen",
    "original_price": 'span.a-price.a-text-price[data-a-strike="true"] span.a-offscreen',
    "rating": "span.a-icon-alt",
    "reviews": "span.a-size-base.s-underline-text",
    "badge": "i.a-icon-prime",
    "seller": "span.a-size-small.a-color-secondary",
    "seller_candidates": ["span.a-size-base", "div.a-row span"],
    "shipping_candidates": ["span.a-size-base", "span.a-color-base", "div.a-row"],
    "page_item": "span.s-pagination-item:not(.s-pagination-disabled)",
}
SPONSORED_PATH = "/sspa/click"

IMAGE_ATTRIBUTES = ["src", "data-src", "data-lazy", "data-original", "data-srcset", "srcset"]

SELLER_STOP_WORDS = [
    "compras", "mil", "passado", "vendidos", "pix", "vista", "até", "parcela", "x de",
]
SELLER_CANDIDATE_STOP_WORDS = [
    "compras", "mil", "passado", "vendidos", "estrela", "avaliação", "entrega", "frete", "pix",
    "vista", "até", "parcela", "x de", "r$",
]
SELLER_MARKS = ["vendido por", "de:", "por:"]
SELLER_REMOVED = ["Vendido por", "vendido por", "de:", "De:", "por:", "Por:"]
SELLER_FINAL_STOP_WORDS = ["vista", "pix", "parcela", "compras", "vendidos"]

BADGE_LABEL = "Prime"
FREE_SHIPPING_LABEL = "Frete Grátis"
FREE_SHIPPING_WORDS = ["frete grátis", "frete gratis", "entrega grátis", "entrega gratis"]
FAST_SHIPPING_WORDS = ["receba amanhã", "receba hoje", "entrega hoje"]
SHIPPING_WORD = "frete"
SHIPPING_STOP_WORDS = ["compras", "vendidos", "r$", "reais"]

BLOCK_PHRASES = {
    QUERY_PLATFORM: [
        "api-services-support@amazon.com",
        "Sorry, we just need to make sure you",
        "Enter the characters you see below",
    ],
}
BOT_HINTS = ["captcha", "robot", "automated", "unusual traffic"]

# name, selector
INSPECTION_RULES = [
    ("Main container", "div.s-main-slot"),
    ("Product card (v1)", 'div[data-component-type="s-search-result"]'),
    ("Product card (v2)", "div.s-result-item"),
    ("Product link", "h2.s-line-clamp-2 a"),
    ("Product title", "h2.s-line-clamp-2"),
    ("Product price", "span.a-price-whole"),
    ("Product image", "img.s-image"),
    ("Rating", "span.a-icon-alt"),
    ("Reviews count", "span.a-size-base.s-underline-text"),
    ("Prime badge", "i.a-icon-prime"),
    ("Seller info", "span.a-size-base-plus"),
    ("Alternative container", "div.sg-col-inner"),
    ("Any product link", 'a[href*="/dp/"]'),
]
SAMPLE_CARDS = ['div[data-component-type="s-search-result"]', "div.s-result-item[data-asin]"]
SAMPLE_TITLE = "h2.s-line-clamp-2"
SAMPLE_LINK = "h2.s-line-clamp-2 a"

MAX_RULES = 10_000


def rules_from(table: DataFrame, layout: str) -> dict[str, list[str]]:
    """Rules of a layout from a (layout, field, priority, selector) table.

    Rules become part of the query text, so their number is checked first.
    """
    rows = table.filter(table.layout == layout).limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules for layout {layout}")
    rules: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r.field, r.priority)):
        rules.setdefault(row.field, []).append(row.selector)
    return rules
