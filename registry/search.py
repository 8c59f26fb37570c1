"""Search planning (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscan.functions import links
from shelfscan.operators import pages as pg
from shelfscan.operators.elements import page_elements
from shelfscan.operators.products import card_identity
from shelfscan.plans import search as sp
from shelfscan.plans.sql import register_pages

from . import query
from .rendered import id_pages, listing_pages
from .tables import scratch, table
from .views import with_views

_TERM = "concat(c_mktsegment, ' ã/*~%+&é ', c_custkey)"
_ENCODED = f"replace(replace(url_encode({_TERM}), '%2F', '/'), '*', '%2A')"
_OFFSET = f"""concat('https://lista.mercadolivre.com.br/', {_ENCODED},
  case when page_number > 1 then concat('_Desde_', (page_number - 1) * 50 + 1, '_NoIndex_True') else '' end)"""
_QUERY = f"""concat('https://www.amazon.com.br/s?k=', {_ENCODED},
  case when page_number > 1 then concat('&page=', page_number) else '' end)"""


def terms(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", F.expr(_TERM).alias("search_term"),
        F.expr("cast(c_custkey % 7 as int)").alias("page_number"),
    )


@query("p1_search_plan", f"""
select {_TERM} as search_term, platform, cast(page_number as integer) as page_number,
  case platform when 'amazon' then {_QUERY} else {_OFFSET} end as url
from customer, (values ('mercadolivre'), ('amazon')) p(platform), generate_series(1, 5) g(page_number)""")
def _(spark, sf):
    return sp.search_plan(terms(spark, sf).select("search_term"))


@query("p2_listing_url_offset", f"""
select c_custkey, {_OFFSET} as url from (select *, greatest(c_custkey % 7, 1) as page_number from customer)""")
def _(spark, sf):
    page = F.greatest("page_number", F.lit(1))
    return terms(spark, sf).select(
        "c_custkey", links.listing_url_offset(F.col("search_term"), page).alias("url")
    )


@query("p3_listing_url_query", f"""
select c_custkey, {_QUERY} as url from (select *, c_custkey % 7 as page_number from customer)""")
def _(spark, sf):
    return terms(spark, sf).select(
        "c_custkey", links.listing_url_query(F.col("search_term"), F.col("page_number")).alias("url")
    )


@query("p4_valid_terms", """
select c_custkey, case c_custkey % 5 when 0 then chr(9) || '  ' when 1 then null when 2 then c_name else c_name end as search_term,
  case when c_custkey % 5 < 2 then 'Search term cannot be empty' end as error_message from customer""")
def _(spark, sf):
    raw = table(spark, sf, "customer").selectExpr(
        "c_custkey",
        """case c_custkey % 5 when 0 then '\\t  ' when 1 then null
           when 2 then concat(' \\n', c_name, ' ') else c_name end as search_term""",
    )
    kept, rejected = sp.valid_terms(raw)
    return kept.unionByName(rejected.drop("error_type"), allowMissingColumns=True)


_STATS = """
stats as (select platform, search_term, page_number, blocked, blank as failed,
    (select count(*) from generate_series(1, cards) u(i)
     where not no_container and (o_orderkey + i) % 11 <> 0 and (o_orderkey + i) % 13 <> 0) as products
  from id_pages),
abort_stops as (select search_term, min(page_number) as stop_page from stats
  where blocked or failed or products = 0 group by 1),
skip_stops as (select search_term, min(page_number) as stop_page, arg_min(blocked, page_number) as is_block from stats
  where blocked or (products = 0 and not failed) group by 1)"""


@query("p5_until_first_gap", with_views(f"""
with {_STATS}
select 'abort' as policy, s.search_term, page_number, products, stop_page,
  (select case when blocked then 'blocked' when failed then 'failed' else 'empty' end from stats t
   where t.search_term = s.search_term and t.page_number = a.stop_page) as stop_reason
from stats s left join abort_stops a on s.search_term = a.search_term
where stop_page is null or page_number < stop_page
union all
select 'skip', s.search_term, page_number, products, stop_page,
  case when stop_page is not null then case when is_block then 'blocked' else 'empty' end end
from stats s left join skip_stops k on s.search_term = k.search_term
where not failed and (stop_page is null or page_number < stop_page or (page_number = stop_page and not is_block))""",
                                        "id_pages"))
def _(spark, sf):
    pages = pg.blocked(id_pages(spark, sf)).withColumn("failed", pg.is_blank())
    item, title = card_identity()
    cards = pg.id_cards(page_elements(pages), outer=True)
    stats = pg.extraction_stats(
        cards, ["search_term", "page_number", "blocked", "failed"], item.isNotNull() & title.isNotNull()
    ).withColumnRenamed("successful_extractions", "products")
    # both policies read these rows twice: pages are parsed once for all of them
    path = f"{scratch(spark)}/stats"
    stats.write.parquet(path)
    stats = spark.read.parquet(path)
    kept = [
        sp.until_first_gap(stats, ["search_term"], policy).withColumn("policy", F.lit(policy))
        for policy in ("abort", "skip")
    ]
    return kept[0].unionByName(kept[1]).select(
        "policy", "search_term", "page_number", "products", "stop_page", "stop_reason"
    )


def all_pages(spark, sf):
    """Pages of both platforms, and the given pages as those of a platform without an extractor."""
    foreign = table(spark, sf, "pages").select(
        F.lit("shopee").alias("platform"), F.col("url").alias("search_term"),
        F.lit(1).alias("page_number"), "html",
    )
    return listing_pages(spark, sf).unionByName(id_pages(spark, sf)).unionByName(foreign)


_EXTRACTED = """
select platform, search_term, page_number, position_on_page, title, coalesce(price, 'N/A') as price, null as error_type from listing_products
union all select platform, search_term, page_number, position_on_page, title, coalesce(price, 'N/A'), null from id_products
union all select 'shopee', url, 1, 0,
  'No extractor registered for platform: shopee; available: mercadolivre, amazon', 'N/A', 'ValueError' from pages
union all select platform, search_term, page_number, 0, 'No content received from page', 'N/A', 'NetworkException'
  from (select platform, search_term, page_number, o_orderkey from listing_pages
    union all select platform, search_term, page_number, o_orderkey from id_pages) where o_orderkey % 20 = 0
union all select platform, search_term, page_number, 0, concat('HTML vazio ou inválido na página ', page_number), 'N/A', 'ValidationException'
  from listing_pages where o_orderkey % 20 = 10
union all select platform, search_term, page_number, 0, 'Blocking detected', 'N/A', 'BlockedException' from id_pages where blocked"""


@query("p6_extract_all", with_views(_EXTRACTED, "listing_products", "id_products"))
def _(spark, sf):
    products, rejected = sp.extract_all(all_pages(spark, sf))
    columns = ["platform", "search_term", "page_number", "position_on_page", "title", "price"]
    return products.select(*columns, F.lit(None).cast("string").alias("error_type")).unionByName(
        rejected.select(
            "platform", "search_term", "page_number", F.lit(0).alias("position_on_page"),
            F.col("error_message").alias("title"), F.lit("N/A").alias("price"), "error_type",
        )
    )


@query("p7_extract_in_sql", with_views(_EXTRACTED, "listing_products", "id_products"))
def _(spark, sf):
    register_pages(all_pages(spark, sf), "captured")
    return spark.sql("""
        SELECT platform, search_term, page_number, position_on_page, title, price, CAST(NULL AS STRING) AS error_type
        FROM captured_products
        UNION ALL
        SELECT platform, search_term, page_number, 0, error_message, 'N/A', error_type FROM captured_rejected""")
