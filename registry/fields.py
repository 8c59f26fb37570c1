"""Column logic of the extraction (F) and text repair (R5, R6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscan.functions import links, text
from shelfscan.operators import fields as fl
from shelfscan.operators import products as pr
from shelfscan.operators.elements import page_elements
from shelfscan.operators.pages import id_cards, product_cards
from shelfscan.operators.selectors import PAGE
from shelfscan.plans import rules as R

from . import query
from .pages import given_elements
from .rendered import id_pages, listing_pages
from .tables import table
from .views import with_views

_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents"]
_LINE_SQL = ", ".join(_LINE)
_CENTS = "cast(round(l_extendedprice * 100) as bigint)"
_KEYS = ["platform", "search_term", "page_number", "position_on_page"]
_KEYS_SQL = ", ".join(_KEYS)


def lines(spark, sf):
    return table(spark, sf, "lineitem").withColumn("cents", F.expr(_CENTS)).withColumn(
        "brl", F.expr("translate(format_number(cast(cents as decimal(18,0)) / 100, 2), ',.', '.,')")
    )


def line_sql(columns: str) -> str:
    return f"select {_LINE_SQL}, {columns} from (select *, {_CENTS} as cents from lineitem)"


def rich_cards(spark, sf):
    return product_cards(page_elements(listing_pages(spark, sf)))


def cards_by_id(spark, sf):
    return id_cards(page_elements(id_pages(spark, sf)))


@query("f1_first_text", """
select page_id, trim(replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&'), '&nbsp;', ' ')) as heading,
  null::varchar as missing,
  nullif(trim(replace(regexp_extract(html, '<li><a[^>]*>([^<]*)</a>', 1), '&amp;', '&')), '') as first_entry
from pages""")
def _(spark, sf):
    return given_elements(spark, sf).select(
        "page_id",
        fl.first_text(["h6.none", "h1", "title"], PAGE).alias("heading"),
        fl.first_text(["section > nav", "td"], PAGE).alias("missing"),
        fl.first_text(["nav li a", "a"], PAGE).alias("first_entry"),
    )


@query("f2_first_link", with_views(f"""
select {_KEYS_SQL}, case when layout = 'poly-card' then case when position('/p/' in product_url) > 0 then null else product_url end end as plain,
  product_url as with_fallback from listing_products""", "listing_products"))
def _(spark, sf):
    return rich_cards(spark, sf).select(
        *_KEYS,
        fl.first_link(["a[href]"]).alias("plain"),
        fl.first_link(["a[href]", "a[title]", 'a[href*="mercadolivre"]']).alias("with_fallback"),
    )


@query("f3_first_image", with_views(f"select {_KEYS_SQL}, image_url from listing_products", "listing_products"))
def _(spark, sf):
    return rich_cards(spark, sf).withColumn("card_images", fl.card_images()).select(
        *_KEYS, fl.first_image(R.RICH_RULES["image_url"]).alias("image_url")
    )


_URLS = """case l_orderkey % 8 when 0 then concat('https://http2.mlstatic.com/D_', l_partkey, '_V_.webp')
  when 1 then concat('//mlstatic.com/', l_partkey, '.gif') when 2 then concat('http://example.com/', l_partkey, '.jpg')
  when 3 then concat('  https://mercadolivre.com.br/assets/', l_partkey, '_V_.png ') when 4 then concat('ftp://mlstatic.com/', l_partkey)
  when 5 then 'http://ml' when 6 then null else concat('https://mlstatic.com/_2X_/', l_partkey, '_V_.png 2x,https://x.y/z 1x') end"""


@query("f4_valid_image_url", line_sql("coalesce(l_orderkey % 8 in (0, 1, 3, 7), false) as valid"))
def _(spark, sf):
    return lines(spark, sf).withColumn("u", F.expr(_URLS)).select(
        *_LINE, links.valid_image_url(F.col("u")).alias("valid")
    )


@query("f5_image_variant", line_sql("""
  case l_orderkey % 8 when 0 then concat('https://http2.mlstatic.com/D_', l_partkey, '_2X_.webp')
  when 1 then concat('//mlstatic.com/', l_partkey, '.gif') when 2 then concat('http://example.com/', l_partkey, '.jpg')
  when 3 then '' when 4 then concat('ftp://mlstatic.com/', l_partkey) when 5 then 'http://ml'
  when 7 then concat('https://mlstatic.com/_2X_/', l_partkey, '_V_.png') end as variant"""))
def _(spark, sf):
    return lines(spark, sf).withColumn("u", F.expr(_URLS)).select(
        *_LINE, links.image_variant(links.srcset_head(F.col("u"))).alias("variant")
    )


_PRICE_TEXT = """case l_orderkey % 7 when 0 then concat('R$ ', brl) when 1 then brl
  when 2 then replace(brl, '.', '') when 3 then concat(brl, '9 à vista') when 4 then split_part(brl, ',', 1)
  when 5 then 'sob consulta' else '1,2,3' end"""


@query("f6_brl_cents", line_sql("""
  case when l_orderkey % 7 <= 3 then cents when l_orderkey % 7 = 4 then cents // 100 * 100 end as value,
  case when l_orderkey % 7 in (0, 1, 2) then cast(trunc(cents / 100 * 100.0::double) as bigint)
    when l_orderkey % 7 = 3 then cast(trunc(cast(concat(cents // 100, '.', lpad(cast(cents % 100 as varchar), 2, '0'), '9') as double) * 100) as bigint)
    when l_orderkey % 7 = 4 then cents // 100 * 100 end as legacy"""))
def _(spark, sf):
    rows = lines(spark, sf).withColumn("t", F.expr(_PRICE_TEXT))
    return rows.select(
        *_LINE, text.brl_cents(F.col("t")).alias("value"),
        text.brl_cents(F.col("t"), legacy=True).alias("legacy"),
    )


@query("f7_brl_decimal", line_sql("""
  case when l_orderkey % 7 in (0, 1, 2) then cents / 100
    when l_orderkey % 7 = 3 then (cents * 10 + 9) / 1000
    when l_orderkey % 7 = 4 then cents // 100 end::double as value"""))
def _(spark, sf):
    rows = lines(spark, sf).withColumn("t", F.expr(_PRICE_TEXT))
    return rows.select(*_LINE, text.brl_decimal(F.col("t")).cast("double").alias("value"))


@query("f8_split_price", line_sql("""
  case when l_orderkey % 5 < 2 then cents / 100 when l_orderkey % 5 = 2 then cents // 100 end::double as value"""))
def _(spark, sf):
    rows = lines(spark, sf).withColumns(
        {
            "w": F.expr("""case l_orderkey % 5 when 1 then concat(split_part(brl, ',', 1), ',')
                when 3 then 'a partir' when 4 then null else split_part(brl, ',', 1) end"""),
            "f": F.expr("if(l_orderkey % 5 = 2, '', split_part(brl, ',', 2))"),
        }
    )
    return rows.select(
        *_LINE, text.split_price(F.col("w"), F.col("f")).cast("double").alias("value")
    )


@query("f9_offscreen_price", line_sql("case when l_orderkey % 4 < 2 then cents / 100 end::double as value"))
def _(spark, sf):
    rows = lines(spark, sf).withColumn(
        "t",
        F.expr("""case l_orderkey % 4 when 0 then concat('R$ ', brl) when 1 then concat('R$\\u00a0', brl, ' ')
            when 2 then concat('por R$ ', brl) else '' end"""),
    )
    return rows.select(*_LINE, text.offscreen_price(F.col("t")).cast("double").alias("value"))


@query("f10_to_cents", line_sql("""cast(cents * (100 - cast(round(l_discount * 100) as bigint)) // 100 as varchar) as value"""))
def _(spark, sf):
    price = F.expr(
        "cast(cents * (100 - cast(round(l_discount * 100) as bigint)) as decimal(24,0)) * 0.0001"
    )
    return lines(spark, sf).select(*_LINE, text.to_cents(price).cast("string").alias("value"))


@query("f11_product_link", with_views(f"select {_KEYS_SQL}, product_url from id_products", "id_products"))
def _(spark, sf):
    return pr.id_products(cards_by_id(spark, sf)).select(*_KEYS, "product_url")


@query("f12_rating_value", line_sql("""
  case l_orderkey % 4 when 0 then l_linenumber + l_suppkey % 10 / 10 when 1 then l_linenumber
    when 2 then l_linenumber + l_partkey % 10 / 10 end::double as value"""))
def _(spark, sf):
    rows = lines(spark, sf).withColumn(
        "t",
        F.expr("""case l_orderkey % 4 when 0 then concat(l_linenumber, ',', l_suppkey % 10, ' de 5 estrelas')
            when 1 then concat('nota ', l_linenumber, ' de 5') when 2 then concat(l_linenumber, '.', l_partkey % 10, '.1')
            else 'sem nota' end"""),
    )
    return rows.select(*_LINE, text.rating_value(F.col("t")).alias("value"))


@query("f13_review_count", line_sql("""
  case l_orderkey % 4 when 0 then l_partkey * 7 when 1 then l_suppkey * 1000 + l_linenumber * 100
    when 2 then l_suppkey * 1000 end as value,
  case l_orderkey % 4 when 0 then l_partkey * 7 when 1 then (l_suppkey * 10 + l_linenumber) * 1000
    when 2 then l_suppkey * 1000 end as legacy"""))
def _(spark, sf):
    rows = lines(spark, sf).withColumn(
        "t",
        F.expr("""case l_orderkey % 4 when 0 then concat('(', replace(format_number(l_partkey * 7, 0), ',', '.'), ')')
            when 1 then concat(l_suppkey, ',', l_linenumber, ' mil') when 2 then concat('+', l_suppkey, 'Mil avaliações')
            else 'nenhuma' end"""),
    )
    return rows.select(
        *_LINE, text.review_count(F.col("t")).alias("value"),
        text.review_count(F.col("t"), legacy=True).alias("legacy"),
    )


@query("f14_seller_name", with_views(f"select {_KEYS_SQL}, seller from id_products", "id_products"))
def _(spark, sf):
    return pr.id_products(cards_by_id(spark, sf)).select(*_KEYS, "seller")


@query("f15_shipping_label", with_views(f"select {_KEYS_SQL}, shipping from id_products", "id_products"))
def _(spark, sf):
    return pr.id_products(cards_by_id(spark, sf)).select(*_KEYS, "shipping")


@query("f16_has_badge", with_views(f"select {_KEYS_SQL}, has_badge from id_products", "id_products"))
def _(spark, sf):
    return pr.id_products(cards_by_id(spark, sf)).select(*_KEYS, "has_badge")


_OFF = "(cents * cast(round(l_discount * 100) as bigint) {div} 100)"
_D = _OFF.format(div="//")


@query("f17_discount_pct", line_sql(f"""
  case when {_D} > 0 and cents > {_D} then ({_D} * 10000 // cents
    + case when 2 * ({_D} * 10000 % cents) > cents then 1 when 2 * ({_D} * 10000 % cents) < cents then 0
      else ({_D} * 10000 // cents) % 2 end) / 100.0::double end as discount"""))
def _(spark, sf):
    price = F.expr(f"cents - {_OFF.format(div='div')}")
    return lines(spark, sf).select(*_LINE, text.discount_pct(price, F.col("cents")).alias("discount"))


_FIELDS_SQL = ", ".join(pr.TEXT_COLUMNS)


@query("f18_rich_products", with_views(
    f"select {_KEYS_SQL}, {_FIELDS_SQL} from listing_products where layout = 'poly-card'", "listing_products"))
def _(spark, sf):
    cards = rich_cards(spark, sf).filter(F.col("layout") == R.RICH)
    return pr.rich_products(cards).select(*_KEYS, *pr.TEXT_COLUMNS)


@query("f19_basic_products", with_views(
    f"select {_KEYS_SQL}, {_FIELDS_SQL} from listing_products where layout = 'classic'", "listing_products"))
def _(spark, sf):
    cards = rich_cards(spark, sf).filter(F.col("layout") == R.BASIC)
    return pr.basic_products(cards).select(*_KEYS, *pr.TEXT_COLUMNS)


@query("f20_id_products", with_views(
    f"select {_KEYS_SQL}, item_id, has_badge, {_FIELDS_SQL} from id_products", "id_products"))
def _(spark, sf):
    return pr.id_products(cards_by_id(spark, sf)).select(*_KEYS, "item_id", "has_badge", *pr.TEXT_COLUMNS)


_NORMAL = ", ".join(f"coalesce({c}, 'N/A') as {c}" for c in pr.TEXT_COLUMNS)


@query("f21_normalise_products", with_views(f"""
select platform, search_term, page_number, position_on_page, {_NORMAL} from listing_products""", "listing_products"))
def _(spark, sf):
    return pr.normalise_products(
        pr.listing_products(rich_cards(spark, sf)), ["platform", "search_term"]
    )


@query("f22_title_and_prices", with_views(f"""
select {_KEYS_SQL}, layout, title, price, original_price, discount_percentage from listing_products""",
                                          "listing_products"))
def _(spark, sf):
    return pr.title_and_prices(rich_cards(spark, sf)).select(
        *_KEYS, "layout", "title", "price", "original_price", "discount_percentage"
    )


def _repaired(c: str) -> str:
    for old, new in text.BROKEN_SEQUENCES:
        c = f"replace({c}, '{old}', '{new}')"
    return f"regexp_replace({c}, '[^\\x00-\\x7F]', '?', 'g')"


@query("r5_ascii_text", f"""
select doc_id, {_repaired("concat(text, 'â†’ â†' || chr(144) || ' â†‘ â†“ âœ“ âœ— â˜… â€¢ â€¦ 日本')")} as text,
  {_repaired("lang")} as lang, {_repaired("source")} as source from documents""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.concat("text", F.lit("â†’ â†\u0090 â†‘ â†“ âœ“ âœ— â˜… â€¢ â€¦ 日本")).alias("text"),
        "lang", "source",
    )
    return text.ascii_table(docs)


@query("r6_result_key", """
select o_orderkey, concat(case when o_orderkey % 3 = 0 then 'unknown' else 'mercadolivre' end, '_',
  regexp_replace(replace(concat('Café & ', o_orderpriority, ' nº ', o_custkey, '/x'), ' ', '_'), '[^\\p{L}\\p{N}_-]', '', 'g'),
  '_', strftime(o_orderdate, '%Y%m%d_%H%M%S')) as result_key from orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        text.result_key(
            F.expr("if(o_orderkey % 3 = 0, '', 'mercadolivre')"),
            F.expr("concat('Café & ', o_orderpriority, ' nº ', o_custkey, '/x')"),
            F.col("o_orderdate"),
        ).alias("result_key"),
    )
