"""Field extraction over a card's elements, as column expressions.

A rule list is tried in order and the first usable value wins. Later rules are not
evaluated once a value is found (``coalesce`` stops at the first non-null).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.links import QUERY_BASE, image_variant, srcset_head, valid_image_url
from ..functions.text import contains_any, once, strip
from ..plans import rules as R
from .marks import bit
from .selectors import (
    CARD,
    CARD_IN_PAGE,
    Scope,
    all_texts,
    first,
    first_nonempty_text,
    found,
    guarded,
    matches,
)


def _first_of(values: Sequence[str]) -> Column:
    return F.expr(f"coalesce({', '.join(values)})") if values else F.lit(None).cast("string")


def first_text(rules: Sequence[str], scope: Scope = CARD) -> Column:
    """Text of the first match of the first rule where that text is not empty."""
    return _first_of([first_nonempty_text(r, scope) for r in rules])


def first_link(rules: Sequence[str], scope: Scope = CARD) -> Column:
    """Absolute ``href`` of the first match; other links move on to the next rule."""
    link = "if(startswith(m.attrs['href'], 'http'), m.attrs['href'], null)"
    return _first_of([first(r, link, scope) for r in rules])


def card_images(
    attributes: Sequence[str] = tuple(R.IMAGE_ATTRIBUTES), elems: str = CARD.elems
) -> Column:
    """``(id, url)`` of the elements that have a valid image address, in document order.

    An element's address is its first valid attribute, whichever rule finds it.
    """

    def address(e: Column) -> Column:
        tried = F.array(
            *[srcset_head(e["attrs"][a]) if "srcset" in a else e["attrs"][a] for a in attributes]
        )
        valid = F.filter(tried, lambda u: u.isNotNull() & valid_image_url(u))
        return F.struct(e["id"].alias("id"), once(F.get(valid, 0), image_variant).alias("url"))

    def has_any(e: Column) -> Column:
        present = F.lit(False)
        noted: dict[str, int] = {}
        for a in attributes:
            if known := bit(f"[{a}]"):
                noted[known[0]] = noted.get(known[0], 0) | known[1]
            else:
                present = present | e["attrs"][a].isNotNull()
        for name, own in noted.items():
            present = present | (e[name].bitwiseAND(F.lit(own)) != 0)
        return present

    return F.filter(
        F.transform(F.filter(elems, has_any), address), lambda i: i["url"].isNotNull()
    )


def first_image(
    rules: Sequence[str], scope: Scope = CARD, images: str = "card_images", tried: int = 3
) -> Column:
    """First valid image address: by rule, then element (``tried`` per rule), then attribute.

    ``images`` is a column made by :func:`card_images`; cards without any valid
    address are decided by it alone.
    """
    if not rules:
        return F.lit(None).cast("string")
    found_by = ", ".join(
        guarded(
            r,
            f"get(filter({images}, i -> exists(slice({matches(r, scope)}, 1, {tried}), "
            "m -> m.id = i.id)), 0).url",
            scope,
        )
        for r in rules
    )
    return F.expr(f"if(size({images}) = 0, null, coalesce({found_by}))")


def _absolute(href: Column) -> Column:
    full = F.when(F.startswith(href, F.lit("/")), F.concat(F.lit(QUERY_BASE), href)).otherwise(href)
    return once(F.split_part(full, F.lit("?"), F.lit(1)), lambda u: F.nullif(u, F.lit("")))


def product_link(item_id: Column, scope: Scope = CARD_IN_PAGE) -> Column:
    """Product address without query part; sponsored or missing links use the item id."""

    def href(rule: str) -> Column:
        return once(F.expr(first(rule, "m.attrs['href']", scope)), _absolute)

    *others, last = R.ID_RULES["link_alternatives"]
    # the first alternative that matches decides, with or without an address
    alternative = href(last)
    for rule in reversed(others):
        alternative = F.when(F.expr(found(rule, scope)), href(rule)).otherwise(alternative)
    canonical = F.concat(F.lit(QUERY_BASE + "/dp/"), item_id)
    return once(
        F.coalesce(href(R.ID_RULES["link"]), alternative),
        lambda link: F.when(
            link.isNull() | F.contains(link, F.lit(R.SPONSORED_PATH)), canonical
        ).otherwise(link),
    )


def _texts(selectors: Sequence[str], scope: Scope) -> Column:
    return F.expr("concat(" + ", ".join(all_texts(s, scope) for s in selectors) + ")")


def seller_name(scope: Scope = CARD_IN_PAGE) -> Column:
    """Seller from its own element, else from the first marked text of a usable length."""
    own = once(
        F.expr(first_nonempty_text(R.ID_RULES["seller"], scope)),
        lambda t: F.when(~contains_any(F.lower(t), R.SELLER_STOP_WORDS), t),
    )

    def marked(text: Column) -> Column:
        return once(
            F.lower(text),
            lambda lower: contains_any(lower, R.SELLER_MARKS)
            & ~contains_any(lower, R.SELLER_CANDIDATE_STOP_WORDS),
        )

    def name(text: Column) -> Column:
        for mark in R.SELLER_REMOVED:
            text = F.replace(text, F.lit(mark), F.lit(""))
        return strip(text)

    names = F.transform(
        F.filter(_texts(R.ID_RULES["seller_candidates"], scope), marked), name
    )
    # without a name longer than two characters the last one stays
    chosen = once(
        names,
        lambda n: F.coalesce(
            F.get(F.filter(n, lambda x: F.length(x) > 2), 0),
            F.nullif(F.try_element_at(n, F.lit(-1)), F.lit("")),
        ),
    )
    return once(
        F.coalesce(own, chosen),
        lambda s: F.when(~contains_any(F.lower(s), R.SELLER_FINAL_STOP_WORDS), s),
    )


def shipping_label(scope: Scope = CARD_IN_PAGE) -> Column:
    """Badge label, else the first candidate text that speaks about shipping."""

    def label(text: Column) -> Column:
        return once(
            F.lower(text),
            lambda lower: F.when(contains_any(lower, R.FREE_SHIPPING_WORDS), F.lit(R.FREE_SHIPPING_LABEL))
            .when(contains_any(lower, R.FAST_SHIPPING_WORDS), text)
            .when(
                F.contains(lower, F.lit(R.SHIPPING_WORD))
                & (F.length(text) < 100)
                & ~contains_any(lower, R.SHIPPING_STOP_WORDS),
                text,
            ),
        )

    # rules in order: later ones are not looked at once a label is found
    labels = [
        F.get(F.array_compact(F.transform(F.expr(all_texts(s, scope)), label)), 0)
        for s in R.ID_RULES["shipping_candidates"]
    ]
    return F.when(has_badge(scope), F.lit(R.BADGE_LABEL)).otherwise(F.coalesce(*labels))


def has_badge(scope: Scope = CARD_IN_PAGE) -> Column:
    return F.coalesce(F.expr(found(R.ID_RULES["badge"], scope)), F.lit(False))
