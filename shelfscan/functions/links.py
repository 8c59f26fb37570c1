"""Search-page addresses and image links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, once, strip

# Address prefixes, page size, accepted image hosts.
OFFSET_BASE = "https://lista.mercadolivre.com.br"
QUERY_BASE = "https://www.amazon.com.br"
OFFSET_STEP = 50
IMAGE_DOMAINS = [
    "mlstatic.com",
    "mercadolibre.com",
    "mercadolivre.com.br",
    "mla-s1-p.mlstatic.com",
    "mla-s2-p.mlstatic.com",
    "http2.mlstatic.com",
]


def percent_encoded(c: Column) -> Column:
    """Percent-encoding that leaves letters, digits, ``_ . - ~ /`` as they are."""
    encoded = F.url_encode(c)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        encoded = F.replace(encoded, F.lit(old), F.lit(new))
    return encoded


def listing_url_offset(term: Column, page: Column) -> Column:
    """Address with an item offset from the second page on."""
    url = F.concat(F.lit(OFFSET_BASE + "/"), percent_encoded(term))
    offset = ((page - 1) * OFFSET_STEP + 1).cast("string")
    return F.when(page == 1, url).otherwise(
        F.concat(url, F.lit("_Desde_"), offset, F.lit("_NoIndex_True"))
    )


def listing_url_query(term: Column, page: Column) -> Column:
    """Address with a page parameter from the second page on."""
    url = F.concat(F.lit(QUERY_BASE + "/s?k="), percent_encoded(term))
    return F.when(page > 1, F.concat(url, F.lit("&page="), page.cast("string"))).otherwise(url)


def valid_image_url(c: Column) -> Column:
    """At least 10 characters, http or protocol-relative, on an accepted host."""
    def valid(url: Column) -> Column:
        begins = F.startswith(url, F.lit("//")) | F.startswith(url, F.lit("http"))
        return (F.length(url) >= 10) & begins & contains_any(url, IMAGE_DOMAINS)

    return F.coalesce(once(strip(c), valid), F.lit(False))


def srcset_head(c: Column) -> Column:
    """First address of a ``srcset`` text."""
    return F.split_part(F.split_part(c, F.lit(","), F.lit(1)), F.lit(" "), F.lit(1))


def image_variant(c: Column) -> Column:
    """Switch an image address of the CDN to its double-size variant."""
    upgrade = (
        F.contains(c, F.lit("mlstatic.com"))
        & F.contains(c, F.lit("_V_"))
        & ~F.contains(c, F.lit("_2X_"))
    )
    return F.when(upgrade, F.replace(c, F.lit("_V_"), F.lit("_2X_"))).otherwise(c)
