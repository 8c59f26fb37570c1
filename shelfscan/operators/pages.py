"""Page-level operators: layout, cards, block and bot checks, counts, sizes.

``html`` operators work on captured pages; the others on the output of
:func:`~shelfscan.operators.elements.page_elements`. None of them shuffles unless it
aggregates over pages.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent_2dp
from ..functions.text import contains_any
from ..plans import rules as R
from .marks import NAMES
from .selectors import CARD_IN_PAGE, PAGE, first, first_match_text, found, matches, text_of


def blocked(
    pages: DataFrame, phrases: Mapping[str, Sequence[str]] = R.BLOCK_PHRASES, html: str = "html"
) -> DataFrame:
    """Flag pages that contain a block phrase of their platform (case-sensitive)."""
    flag = F.lit(False)
    for platform, words in phrases.items():
        flag = F.when(F.col("platform") == platform, contains_any(F.col(html), list(words))).otherwise(flag)
    return pages.withColumn("blocked", F.coalesce(flag, F.lit(False)))


def is_blank(html: str = "html") -> Column:
    """No character but white space; the page is read up to the first other one."""
    return F.col(html).isNull() | ~F.col(html).rlike(r"(?U)\S")


def blank_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages without any content, with the error they raise."""
    return pages.filter(is_blank(html)).select(
        *[c for c in pages.columns if c != html],
        F.coalesce(F.length(html), F.lit(0)).alias("html_length"),
        F.lit("ValidationException").alias("error_type"),
    )


def fetch_outcome(df: DataFrame, ok: str = "success", error: str = "error_message", legacy: bool = False) -> DataFrame:
    """Error type of each failed fetch from its message, null when it succeeded.

    ``legacy`` finds "rate" inside any word ("operated"), not only as a word.
    """
    text = F.coalesce(F.nullif(F.col(error), F.lit("")), F.lit("Unknown crawling error"))
    lower = F.lower(text)
    limited = F.contains(lower, F.lit("rate")) if legacy else lower.rlike(r"\brate\b")
    kind = (
        F.when(F.contains(text, F.lit("403")) | F.contains(lower, F.lit("blocked")), "BlockedException")
        .when(F.contains(text, F.lit("429")) | limited, "RateLimitException")
        .otherwise("NetworkException")
    )
    failed = ~F.coalesce(F.col(ok), F.lit(False))
    return df.withColumn("outcome", F.when(failed, kind)).withColumn(
        "outcome_message", F.when(failed, text)
    )


def bot_hints(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = (), hints: Sequence[str] = tuple(R.BOT_HINTS)
) -> DataFrame:
    """Hint words in the page text, ignoring case, for pages on which no rule matches.

    Needs ``page_elements(..., raw_text=True)``.
    """
    lower = F.lower("raw_text")
    words = F.filter(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(lower, h))
    for _, selector in rules:
        words = F.when(F.expr(found(selector, PAGE)), F.expr("array()").cast("array<string>")).otherwise(words)
    return pages.withColumn("hints", words)


def page_sizes(pages: DataFrame, by: Sequence[str] = (), html: str = "html") -> DataFrame:
    """Pages and characters per key; a missing page counts as 0 characters."""
    size = F.coalesce(F.length(html), F.lit(0))
    return pages.groupBy(*by).agg(
        F.count("*").alias("pages"),
        F.sum(size).alias("total_chars"),
        F.min(size).alias("min_chars"),
        F.max(size).alias("max_chars"),
    )


def detect_layout(pages: DataFrame) -> DataFrame:
    """Rich layout when the page has a rich card, else basic (also without any card)."""
    return pages.withColumn(
        "layout",
        F.when(F.expr(found(R.RICH_CARD, PAGE)), F.lit(R.RICH)).otherwise(F.lit(R.BASIC)),
    )


# What cards carry for the field rules alone.
CARD_COLUMNS = (
    "card_id", "card_attrs", "text_base", "card_text", "card_classes", "elems", *[f"card_{n}" for n in NAMES],
)


def _explode_cards(pages: DataFrame, found_cards: str, elems: str, outer: bool) -> DataFrame:
    """One row per card with its own slice of the page's elements and text.

    Cards are made before they become rows: a filter on their fields is then not carried below
    the making of their elements, which it would repeat for every mention.
    """
    parts = f"struct(c, substring(text, c.text_at + 1, c.text_len) as own_text, {elems} as own)"
    marked = ", ".join(
        f"aggregate(d.own, 0L, (m, e) -> m | e.{n}) as card_{n}" for n in NAMES
    )
    cards = f"transform(transform({found_cards}, c -> {parts}), d -> struct(d.c, d.own_text, d.own, {marked}))"
    rest = [c for c in pages.columns if c not in ("elements", "text", "_cards", "_shallow")]
    exploded = pages.select(*rest, F.expr(f"posexplode{'_outer' if outer else ''}({cards}) as (_at, _card)"))
    return exploded.selectExpr(
        *rest,
        "cast(_at + 1 as int) as position_on_page",
        "_card.c.id as card_id",
        "_card.c.attrs as card_attrs",
        "_card.c.text_at as text_base",
        "_card.own_text as card_text",
        "_card.own as elems",
        "array_join(flatten(transform(_card.own, e -> e.classes)), ' ') as card_classes",
        *[f"_card.card_{n} as card_{n}" for n in NAMES],
    )


def _with_outer(pages: DataFrame, cards: str) -> tuple[DataFrame, str, str]:
    """``pages`` with their cards, and what names the cards and the elements of each.

    The ancestors of a card come before its own elements. They are looked for among the elements
    that are less deep than some card, once picked for the page, not among all that a page has.
    """
    found = pages.withColumn("_cards", F.expr(cards))
    shallow = "filter(elements, a -> a.depth < array_max(_cards.depth))"
    elems = (
        "concat(filter(_shallow, a -> a.id < c.id AND a.end >= c.id), "
        "slice(elements, c.id + 1, c.end - c.id + 1))"
    )
    return found.withColumn("_shallow", F.expr(f"if(size(_cards) > 0, {shallow}, array())")), "_cards", elems


def product_cards(pages: DataFrame, outer: bool = False) -> DataFrame:
    """Listing cards with layout and rank; each sees only its own elements.

    ``outer`` keeps pages without a card as one row without position.
    """
    laid_out = pages if "layout" in pages.columns else detect_layout(pages)
    cards = (
        f"if(layout = '{R.RICH}', {matches(R.RICH_CARD, PAGE)}, {matches(R.BASIC_CARD, PAGE)})"
    )
    return _explode_cards(laid_out, cards, "slice(elements, c.id + 1, c.end - c.id + 1)", outer)


def id_cards(pages: DataFrame, outer: bool = False) -> DataFrame:
    """Id-carrying cards inside the first result container, with rank.

    The ancestors of a card stay visible to its rules, in front of its own elements.
    """
    container = f"get({matches(R.ID_CONTAINER, PAGE)}, 0)"
    boxed = pages.withColumn("_box", F.expr(container)).withColumn("layout", F.lit(R.ID))
    inside = f"filter({matches(R.ID_CARD, PAGE)}, c -> c.id > _box.id AND c.id <= _box.end)"
    return _explode_cards(*_with_outer(boxed, inside), outer).drop("_box")


def extraction_stats(cards: DataFrame, by: Sequence[str], ok: Column | None = None) -> DataFrame:
    """Containers, extracted and failed cards per page, and whether the layout may have changed.

    ``cards`` come from an ``outer`` card operator, so pages without cards are kept.
    All cards of a page are still together, so the shuffle carries one row per page.
    """
    real = F.col("position_on_page").isNotNull()
    good = real if ok is None else real & F.coalesce(ok, F.lit(False))
    return (
        cards.groupBy(*by, "layout")
        .agg(
            F.count_if(real).alias("containers_found"),
            F.count_if(good).alias("successful_extractions"),
        )
        .withColumn(
            "failed_extractions", F.col("containers_found") - F.col("successful_extractions")
        )
        .withColumn(
            "success_rate",
            F.coalesce(
                percent_2dp(F.col("successful_extractions"), F.col("containers_found")), F.lit(0.0)
            ),
        )
        .withColumn(
            "layout_change",
            (F.col("containers_found") > 0) & (F.col("successful_extractions") == 0),
        )
    )


def selector_counts(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = tuple(R.INSPECTION_RULES),
    by: Sequence[str] = (),
) -> DataFrame:
    """Hits per selector over all pages, zero counts included.

    ``products_found`` is the largest count among the product and container rules.
    All rules are counted in one pass, then turned into rows.
    """
    names = [f"_c{i}" for i in range(len(rules))]
    counted = pages.select(
        *by, *[F.expr(f"size({matches(s, PAGE)})").alias(n) for n, (_, s) in zip(names, rules)]
    )
    totals = counted.groupBy(*by).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    relevant = [
        F.col(n) for n, (label, _) in zip(names, rules)
        if "product" in label.lower() or "container" in label.lower()
    ]
    most = F.array_max(F.array(*relevant)) if relevant else F.lit(0)
    rows = F.array(
        *[
            F.struct(F.lit(label).alias("rule"), F.lit(s).alias("selector"), F.col(n).alias("found"))
            for n, (label, s) in zip(names, rules)
        ]
    )
    return totals.select(*by, most.alias("products_found"), F.inline(rows))


def page_total(pages: DataFrame) -> DataFrame:
    """Highest page number in the pagination, 1 when there is none."""
    numbers = (
        f"transform(filter(transform({matches(R.ID_RULES['page_item'], PAGE)}, "
        f"m -> {text_of('m', PAGE)}), t -> t rlike '^[0-9]+$'), t -> try_cast(t as int))"
    )
    return pages.withColumn("total_pages", F.coalesce(F.expr(f"array_max({numbers})"), F.lit(1)))


def sample_cards(pages: DataFrame, k: int = 3, rules: Sequence[str] = tuple(R.SAMPLE_CARDS)) -> DataFrame:
    """First ``k`` identified cards per page by the first rule that finds one, with raw texts."""

    def identified(rule: str) -> str:
        return f"filter({matches(rule, PAGE)}, c -> c.attrs['{R.ID_ATTRIBUTE}'] <> '')"

    chosen = identified(rules[-1])
    for rule in reversed(rules[:-1]):
        mine = identified(rule)
        chosen = f"if(size({mine}) > 0, {mine}, {chosen})"
    cards = _explode_cards(*_with_outer(pages, f"slice({chosen}, 1, {k})"), False)
    scope = CARD_IN_PAGE

    def text(rule: str) -> Column:
        return F.expr(first_match_text(rule, scope))

    def shown(c: Column) -> Column:
        return F.coalesce(c, F.lit("N/A"))

    whole, fraction = text(R.ID_RULES["price_whole"]), text(R.ID_RULES["price_fraction"])
    link = F.expr(first(R.SAMPLE_LINK, "m.attrs['href']", scope))
    keep = [c for c in cards.columns if c not in (*CARD_COLUMNS, "position_on_page")]
    return cards.select(
        *keep,
        F.col("position_on_page").alias("sample"),
        F.col("card_attrs")[R.ID_ATTRIBUTE].alias("item_id"),
        shown(text(R.SAMPLE_TITLE)).alias("title"),
        shown(F.concat(whole, F.coalesce(fraction, F.lit("")))).alias("price"),
        shown(text(R.ID_RULES["rating"])).alias("rating"),
        shown(text(R.ID_RULES["reviews"])).alias("reviews"),
        shown(link).alias("link"),
        F.expr(found(R.ID_RULES["badge"], scope)).alias("has_badge"),
    )
