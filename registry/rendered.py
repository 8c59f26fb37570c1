"""Result pages rendered from the orders table, and the product rows they stand for.

Each order is one captured page with ``o_orderkey % 5`` cards, ten consecutive orders
are the pages of one search. The html is built per row, without any shuffle. The SQL
side never sees html: it states the fields each card was rendered from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import spread, table

# Spark form of the page keys; {div} is the integer division of the engine.
_TERM = "concat('pedido café ', cast(o_orderkey {div} 10 as string))"
_PAGE = "cast((o_orderkey % 10 * 7 + o_orderkey {div} 10) % 10 + 1 as int)"


def _brl(cents: str) -> str:
    return f"translate(format_number(cast({cents} as decimal(18,0)) / 100, 2), ',.', '.,')"


_P = "(cast(round(o_totalprice * 100) as bigint) + 37 * i)"
_O = f"({_P} + (o_orderkey % 7) * 123457)"
_N = "(o_orderkey + i)"
_ID = "concat(cast(o_orderkey as string), '-', cast(i as string))"

_RICH_CARD = f"""concat(
  '<li class="ui-search-layout__item">\\n<div class="poly-card poly-card--list">',
  case {_N} % 4
    when 0 then concat('<div class="poly-card__portada"><img alt="x" src="https://http2.mlstatic.com/D_NQ_', {_ID}, '_V_.webp"></div>')
    when 1 then concat('<div class="poly-card__portada"><img src="data:image/gif;base64,R0" data-src="//mlstatic.com/D_', {_ID}, '.webp"/></div>')
    when 2 then concat('<figure><img srcset="https://http2.mlstatic.com/D_2X_', {_ID}, '_V_.jpg 2x, https://http2.mlstatic.com/z.jpg 1x"></figure>')
    else '<p><img src="http://example.com/elsewhere.png"></p>' end,
  case when {_N} % 3 = 0 then concat('<h2 class="other">', 'Peça &amp; item <b>', {_ID}, '</b></h2><a href="#top">x</a><a title="t" href="https://www.mercadolivre.com.br/p/', {_ID}, '">ver</a>')
    else concat('<h2 class="poly-box poly-component__title"> <a href="https://produto.mercadolivre.com.br/MLB-', {_ID}, '">Café ', o_orderpriority, ' ', {_ID}, '</a> </h2>') end,
  case when {_N} % 5 <> 0 then concat('<span class="poly-component__seller">Por Loja ', cast(o_custkey as string), '</span>') else '<span class="shop-store"> Loja geral </span>' end,
  case when {_N} % 2 = 0 then concat('<div class="poly-component__price"><s class="andes-money-amount andes-money-amount--previous"><span class="andes-money-amount__fraction">', {_brl(_O)}, '</span></s>') else '<div class="poly-component__price">' end,
  '<div class="poly-price__current"><span class="andes-money-amount"><span class="andes-money-amount__currency">R$</span><span class="andes-money-amount__fraction">', {_brl(_P)}, '</span></span>',
  case when {_N} % 2 = 0 then '<span class="andes-money-amount__discount">12% OFF</span>' else '' end,
  '</div></div><!-- reviews -->',
  case when {_N} % 3 = 1 then concat('<span class="poly-reviews__rating">4.', cast({_N} % 10 as string), '</span><span class="poly-reviews__total">(', cast(o_custkey as string), ' avaliações)</span>') else '<span class="poly-reviews__rating">  </span>' end,
  case when {_N} % 4 < 2 then '<p class="poly-component__shipping">Frete grátis</p>' else '' end,
  case when {_N} % 6 = 0 then concat('<span class="poly-price__installments">em <br>', cast({_N} % 12 + 1 as string), 'x sem juros</span>') else '' end,
  case when {_N} % 8 < 3 then '<span class="poly-component__location">São Paulo</span>' else '' end,
  '</div></li>')"""

_BASIC_CARD = f"""concat(
  '<section><div class="row ui-search-result__wrapper">',
  case when {_N} % 2 = 0 then concat('<figure><img data-src="//mlstatic.com/c/', {_ID}, '_V_.webp" src="data:,"></figure>') else '<figure><img alt="sem endereço"></figure>' end,
  '<p class="poly-component__seller">não lido</p><a href="#topo">r</a>',
  '<a class="ui-search-item__group__element" href="https://lista.mercadolivre.com.br/c/', {_ID}, '"><b>Oferta</b> <i>', {_ID}, '</i></a>',
  '<p>R$ <span class="price-tag-fraction">', {_brl(_P)}, '</span></p>',
  '</div></section>')"""

_ID_CARD = f"""concat(
  '<div data-component-type="s-search-result" class="s-result-item sg-col" data-asin="',
  case when {_N} % 11 = 0 then '' else concat('B', cast(o_orderkey as string), 'X', cast(i as string)) end, '"><div class="sg-col-inner">',
  '<img class="s-image" src="https://m.media-amazon.com/images/I/', {_ID}, '.jpg">',
  '<h2 class="a-size-base-plus s-line-clamp-2">',
  case when {_N} % 13 = 0 then '<span> </span>' when {_N} % 4 = 0 then concat('<a class="a-link-normal" href="/item/dp/', {_ID}, '?ref=sr_1">Artigo ', {_ID}, '</a>')
    when {_N} % 4 = 1 then concat('<a class="a-link-normal" href="/sspa/click?ie=UTF8">Artigo ', {_ID}, '</a>')
    else concat('<span>Artigo ', {_ID}, '</span>') end, '</h2>',
  case when {_N} % 4 = 2 then concat('<a href="/outro/dp/', {_ID}, '/ref=x?y=1">ver</a>') else '' end,
  case {_N} % 5
    when 1 then concat('<span class="a-price"><span class="a-offscreen">R$&nbsp;', {_brl(_P)}, '</span></span>')
    when 2 then '<span class="a-price"><span class="a-price-whole">a partir</span><span class="a-price-fraction">00</span></span>'
    when 3 then concat('<span class="a-price"><span class="a-offscreen">a partir de R$ ', {_brl(_P)}, '</span></span>')
    else concat('<span class="a-price"><span class="a-price-whole">', split_part({_brl(_P)}, ',', 1), '<span class="a-price-decimal">,</span></span><span class="a-price-fraction">', split_part({_brl(_P)}, ',', 2), '</span></span>') end,
  case when {_N} % 3 <> 0 then concat('<span class="a-price a-text-price" data-a-strike="true"><span class="a-offscreen">R$ ', {_brl(_O)}, '</span></span>') else '' end,
  case when {_N} % 6 <> 1 then concat('<i class="a-icon"><span class="a-icon-alt">', cast({_N} % 51 div 10 as string), ',', cast({_N} % 51 % 10 as string), ' de 5 estrelas</span></i>') else '' end,
  case {_N} % 3 when 0 then concat('<span class="a-size-base s-underline-text">(', replace(format_number({_N} * 13 % 100000, 0), ',', '.'), ')</span>')
    when 1 then concat('<span class="a-size-base s-underline-text">', cast({_N} % 90 as string), ',', cast({_N} % 10 as string), ' mil</span>') else '' end,
  case when {_N} % 7 = 0 then '<i class="a-icon a-icon-prime"></i>' else '' end,
  case {_N} % 5 when 0 then concat('<span class="a-size-small a-color-secondary">Loja ', cast(o_custkey as string), '</span>')
    when 1 then concat('<span class="a-size-small a-color-secondary">2 mil compras no mês passado</span><span class="a-size-base">Vendido por Casa ', cast(o_custkey as string), '</span>')
    when 2 then '<div class="a-row"><span>de: AB</span></div>'
    when 4 then '<span class="a-size-base">por: Pix Loja</span>' else '' end,
  case {_N} % 4 when 0 then '<span class="a-color-base">Frete GRÁTIS no app</span>'
    when 1 then '<div class="a-row"><b>Receba amanhã</b></div>'
    when 2 then '<div class="a-row">Frete R$ 10</div>'
    else '<div class="a-row">Frete econômico</div>' end,
  '</div></div>')"""

_COUNT = "cast(o_orderkey % 5 as int)"


def _cards(card: str) -> str:
    return (
        f"if({_COUNT} = 0, '', array_join(transform(sequence(1, greatest({_COUNT}, 1)), "
        f"i -> {card}), '\\n'))"
    )


def _pages(orders: DataFrame, platform: str, html: str, captured: str | None = None) -> DataFrame:
    time = [f"cast({captured} as timestamp) as captured_at"] if captured else []
    return spread(orders).selectExpr(
        *time,
        f"'{platform}' as platform",
        f"{_TERM.format(div='div')} as search_term",
        f"{_PAGE.format(div='div')} as page_number",
        f"""case when o_orderkey % 20 = 0 then null when o_orderkey % 10 = 0 then '  \\n '
            else {html} end as html""",
    )


def listing_pages(spark: SparkSession, sf: str) -> DataFrame:
    return listing_pages_of(table(spark, sf, "orders"))


def id_pages(spark: SparkSession, sf: str) -> DataFrame:
    return id_pages_of(table(spark, sf, "orders"))


def listing_pages_of(orders: DataFrame, captured: str | None = None) -> DataFrame:
    """Pages of the offset-style platform: rich layout, basic on every third order."""
    body = f"if(o_orderkey % 3 = 0, {_cards(_BASIC_CARD)}, {_cards(_RICH_CARD)})"
    html = (
        "concat('<!DOCTYPE html><html><head><title>Busca</title><script>var a = \"<li>\";</script></head>"
        f"<body><ol class=\"ui-search-layout\">', {body}, '</ol></body></html>')"
    )
    return _pages(orders, "mercadolivre", html, captured)


def id_pages_of(orders: DataFrame) -> DataFrame:
    """Pages of the query-style platform; some are block pages or lack the container."""
    pagination = """concat('<div><span class="s-pagination-item s-pagination-disabled">Anterior</span>',
      '<span class="s-pagination-item s-pagination-disabled">99</span>',
      '<span class="s-pagination-item">2</span><span class="s-pagination-item">',
      cast(3 + o_orderkey % 17 as string), '</span><span class="s-pagination-item">Próximo</span></div>')"""
    html = f"""case
      when o_orderkey % 23 = 7 then '<html><body><h4>Enter the characters you see below</h4><p>Sorry, we just need to make sure you are not a <b>Robot</b>. Unusual traffic.</p></body></html>'
      when o_orderkey % 19 = 3 then concat('<html><body><div class="other">', {_cards(_ID_CARD)}, '</div></body></html>')
      else concat('<html><body><div class="s-main-slot s-result-list">', {_cards(_ID_CARD)}, '</div>',
        if(o_orderkey % 4 = 1, '', {pagination}), '</body></html>') end"""
    return _pages(orders, "amazon", html)


# --- the same rows as SQL ---------------------------------------------------------

_DT = "concat('pedido café ', cast(o_orderkey // 10 as varchar))"
_DP = "cast((o_orderkey % 10 * 7 + o_orderkey // 10) % 10 + 1 as integer)"
_DID = "concat(cast(o_orderkey as varchar), '-', cast(i as varchar))"

_BLANK = "o_orderkey % 10 = 0"

LISTING_SQL = {
    "listing_pages": f"""listing_pages as (select *, 'mercadolivre' as platform, {_DT} as search_term,
        {_DP} as page_number, cast(o_orderkey % 5 as integer) as cards,
        case when o_orderkey % 3 = 0 and o_orderkey % 5 > 0 or o_orderkey % 5 = 0 then 'classic'
          else 'poly-card' end as layout from orders)""",
    "listing_products": f"""listing_cards as (select *, o_orderkey + i as n,
        {_P} as cents from listing_pages, unnest(generate_series(1, cards)) u(i)
        where not ({_BLANK})),
    listing_products as (select platform, search_term, page_number, cast(i as integer) as position_on_page, layout,
      case when layout = 'classic' then concat('Oferta', {_DID})
        when n % 3 = 0 then concat('Peça & item', {_DID})
        else concat('Café ', o_orderpriority, ' ', {_DID}) end as title,
      cast(cents as varchar) as price,
      case when layout = 'poly-card' and n % 2 = 0 then cast(cents + (o_orderkey % 7) * 123457 as varchar) end as original_price,
      case when layout = 'poly-card' and n % 2 = 0 then '12% OFF' end as discount_percentage,
      case when layout = 'classic' then null when n % 5 <> 0 then concat('Por Loja ', o_custkey) else 'Loja geral' end as seller,
      case when layout = 'poly-card' and n % 3 = 1 then concat('4.', n % 10) end as rating,
      case when layout = 'poly-card' and n % 3 = 1 then concat('(', o_custkey, ' avaliações)') end as reviews_count,
      case when layout = 'poly-card' and n % 4 < 2 then 'Frete grátis' end as shipping,
      case when layout = 'classic' then concat('https://lista.mercadolivre.com.br/c/', {_DID})
        when n % 3 = 0 then concat('https://www.mercadolivre.com.br/p/', {_DID})
        else concat('https://produto.mercadolivre.com.br/MLB-', {_DID}) end as product_url,
      case when layout = 'classic' then case when n % 2 = 0 then concat('//mlstatic.com/c/', {_DID}, '_2X_.webp') end
        when n % 4 = 0 then concat('https://http2.mlstatic.com/D_NQ_', {_DID}, '_2X_.webp')
        when n % 4 = 1 then concat('//mlstatic.com/D_', {_DID}, '.webp')
        when n % 4 = 2 then concat('https://http2.mlstatic.com/D_2X_', {_DID}, '_V_.jpg') end as image_url,
      case when layout = 'poly-card' and n % 6 = 0 then concat('em', n % 12 + 1, 'x sem juros') end as installments,
      case when layout = 'poly-card' and n % 8 < 3 then 'São Paulo' end as location
      from listing_cards)""",
}

_PCT = """(case when 2 * ({a} * 10000 - {a} * 10000 // {b} * {b}) > {b} then 1
   when 2 * ({a} * 10000 - {a} * 10000 // {b} * {b}) < {b} then 0
   else ({a} * 10000 // {b}) % 2 end + {a} * 10000 // {b}) / 100.0::double"""

ID_SQL = {
    "id_pages": f"""id_pages as (select *, 'amazon' as platform, {_DT} as search_term,
        {_DP} as page_number, {_BLANK} as blank,
        not ({_BLANK}) and o_orderkey % 23 = 7 as blocked,
        not ({_BLANK}) and o_orderkey % 23 <> 7 and o_orderkey % 19 = 3 as no_container,
        case when {_BLANK} or o_orderkey % 23 = 7 then 0 else cast(o_orderkey % 5 as integer) end as cards from orders)""",
    "id_all_cards": f"""id_all_cards as (select *, o_orderkey + i as n, {_P} as cents,
        case when (o_orderkey + i) % 11 <> 0 then concat('B', o_orderkey, 'X', i) end as item_id
        from id_pages, unnest(generate_series(1, cards)) u(i))""",
    "id_products": f"""id_prices as (select *,
        case when n % 5 in (0, 1, 4) then cents end as price_cents,
        case when n % 3 <> 0 then cents + (o_orderkey % 7) * 123457 end as original_cents
      from id_all_cards where not no_container and item_id is not null and n % 13 <> 0),
    id_products as (select platform, search_term, page_number, cast(i as integer) as position_on_page, item_id,
      concat('Artigo ', {_DID}) as title, cast(price_cents as varchar) as price,
      cast(original_cents as varchar) as original_price,
      case when original_cents > price_cents and {_PCT.format(a="(original_cents - price_cents)", b="original_cents")} > 0 then concat(cast({_PCT.format(a="(original_cents - price_cents)", b="original_cents")} as varchar), '%') end as discount_percentage,
      case n % 5 when 0 then concat('Loja ', o_custkey) when 1 then concat('Casa ', o_custkey) when 2 then 'AB' end as seller,
      case when n % 6 <> 1 and n % 51 > 0 then concat(n % 51 // 10, '.', n % 51 % 10) end as rating,
      cast(case n % 3 when 0 then n * 13 % 100000 when 1 then n % 90 * 1000 + n % 10 * 100 else 0 end as varchar) as reviews_count,
      case when n % 7 = 0 then 'Prime' when n % 4 = 0 then 'Frete Grátis' when n % 4 = 1 then 'Receba amanhã'
        when n % 4 = 3 then 'Frete econômico' end as shipping,
      case n % 4 when 0 then concat('https://www.amazon.com.br/item/dp/', {_DID})
        when 2 then concat('https://www.amazon.com.br/outro/dp/', {_DID}, '/ref=x')
        else concat('https://www.amazon.com.br/dp/', item_id) end as product_url,
      concat('https://m.media-amazon.com/images/I/', {_DID}, '.jpg') as image_url,
      null::varchar as installments, null::varchar as location, n % 7 = 0 as has_badge
      from id_prices)""",
}
