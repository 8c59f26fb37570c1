"""Tokenizer, selectors and card extraction on small pages."""

import random

import pytest
from pyspark.sql import functions as F

from shelfscan.operators import elements as el
from shelfscan.operators import pages as pg
from shelfscan.operators import products as pr
from shelfscan.operators.elements import page_elements
from shelfscan.operators.selectors import PAGE, condition, first_match_text, matches, possible
from shelfscan.plans import rules as R
from shelfscan.plans import search as sp

# Rich cards in three shapes: every field by its first rule, by rules further down, and hardly any.
SHELF = """<main><ol><li class="x ui-search-layout__item"><article class="poly-card">
<figure class="poly-card__portada"><a href="#"><img data-src="//mlstatic.com/q/D_88_V_.webp" src="data:,"></a></figure>
<section><p class="poly-component__location">Recife</p><p class="poly-price__installments">6x de <b>R$ 51</b></p>
<s class="andes-money-amount andes-money-amount--previous"><i class="andes-money-amount__fraction">410</i></s>
<div class="poly-price__current"><i>R$</i><i class="andes-money-amount__fraction">306</i></div>
<em class="andes-money-amount__discount">25% OFF</em><em class="poly-component__shipping">Chega na sexta</em></section>
<footer><b class="poly-reviews__rating">4.2</b><b class="poly-reviews__total">(77)</b>
<b class="poly-component__seller">Oficina Sol</b></footer>
<h3 class="poly-component__title">sem <a href="https://produto.mercadolivre.com.br/MLB88">Luminária de papel</a></h3>
</article></li>
<li class="ui-search-layout__item"><div><h2>Vaso <small>azul</small></h2><a href="/local">x</a>
<a href="https://articulo.mercadolibre.com/9">y</a><span class="big-store-name">Barro Ltda</span>
<b class="ui-search-reviews__rating-number">2.5</b><b class="ui-search-reviews__amount">(3)</b>
<span class="the-shipping-text">Retire hoje</span><span class="my-location">Natal</span>
<span class="andes-money-amount__fraction">1.019</span><span class="tiny-discount">5%</span>
<picture><img src="https://mercadolivre.com.br/f/vaso-azul.png"></picture></div></li>
<li class="ui-search-layout__item"><a title="Só o nome"> Rede </a><img src="mini.png"></li></ol></main>"""
LIST = """<table><tr><td><div class="wide ui-search-result__wrapper"><p><b class="ui-search-item__title">Tapete</b></p>
<span class="price-tag-fraction">2.450</span><a>a</a><a href="http://loja.example/t">b</a>
<div class="ui-search-result-image"><img data-lazy="https://mlstatic.com/tapete_V_.jpg"></div></div></td>
<td><div class="ui-search-result__wrapper"><a class="ui-search-item__group__element">Cesto</a></div></td></tr></table>"""


def parsed(spark, *htmls, **options):
    return page_elements(spark.createDataFrame(list(enumerate(htmls, 1)), "page_number int, html string"), **options)


def elements(spark, html):
    return parsed(spark, html).first()


def texts(row):
    return [(e.tag, e.id, e.end, e.depth, row.text[e.text_at:e.text_at + e.text_len]) for e in row.elements]


def test_unclosed_and_stray_tags(spark):
    row = elements(spark, "<div><b>bold <p>para</div></i> tail<br>x")
    assert texts(row) == [
        ("div", 0, 2, 0, "boldpara"), ("b", 1, 2, 1, "boldpara"), ("p", 2, 2, 2, "para"), ("br", 3, 3, 0, ""),
    ]
    assert row.text == "boldparatailx"


def test_script_style_and_comments_are_no_text(spark):
    row = elements(spark, "<p>a<!-- x -->b<script>var t='</p><i>';</script><style>p{}</style> c </p>")
    assert [t[0] for t in texts(row)] == ["p", "script", "style"]
    assert row.text == "abc"


def test_entities_attributes_and_case(spark):
    row = elements(spark, '<A HREF="/x?a=1&amp;b" class=" k1   k2 " data-x>&copy;&nbsp;&lt;é</A><img src=y />')
    link, image = row.elements
    assert link.tag == "a" and link.classes == ["k1", "k2"]
    assert link.attrs == {"href": "/x?a=1&b", "class": "k1 k2", "data-x": ""}
    assert image.attrs["src"] == "y" and image.end == 1
    assert row.text == "© <é"


def test_blank_pages_have_no_elements(spark):
    rows = parsed(spark, None, "", "  ").collect()
    assert all(r.elements == [] and r.text == "" and r.parse_error is None for r in rows)


def test_raw_text_keeps_white_space(spark):
    row = parsed(spark, "<p>unusual</p> <b> traffic\n</b>", raw_text=True).first()
    assert row.raw_text == "unusual  traffic\n"
    assert row.text == "unusualtraffic"


@pytest.mark.parametrize(
    "selector, expected",
    [
        ("p", ["one", "two", "three"]), (".a", ["one", "two"]), ("p.a.b", ["two"]), ("div p", ["one", "two"]),
        ("div > p", ["one"]), ("section>p", ["two"]), ("div section p", ["two"]), ("[data-k]", ["one", "three"]),
        ('[data-k="v 2"]', ["three"]), ('p[data-k*="v"]', ["one", "three"]), ("p.a:not(.b)", ["one"]),
        ("em", []), ('p[class*="a"]', ["one", "two"]),
    ],
)
def test_selectors(spark, selector, expected):
    html = (
        '<div><p class="a" data-k="v">one</p><section><p class="a b">two</p></section></div>'
        '<p data-k="v 2">three</p>'
    )
    df = parsed(spark, html)
    got = df.selectExpr(f"transform({matches(selector, PAGE)}, m -> substring(text, m.text_at + 1, m.text_len)) t").first()
    assert got.t == expected
    first = df.select(F.expr(first_match_text(selector, PAGE))).first()[0]
    assert first == (expected[0] if expected else None)


def test_unsupported_selector_is_refused():
    with pytest.raises(ValueError):
        condition("p:first-child", "elements")


def test_guard_words():
    assert possible("h2 a") is None
    assert possible('a.k:not(.n)[href*="x.y"]') == "contains(card_classes, 'k')"


def products_of(spark, html):
    found = pr.normalise_products(pr.listing_products(pg.product_cards(parsed(spark, html))))
    assert found.columns == pr.PRODUCT_COLUMNS
    return [
        {k: v for k, v in r.asDict().items() if v != "N/A" and k != "page_number"}
        for r in found.orderBy("position_on_page").collect()
    ]


def test_rich_cards_by_first_and_further_rules(spark):
    assert products_of(spark, SHELF) == [
        {
            "title": "Luminária de papel", "price": "30600", "original_price": "41000",
            "discount_percentage": "25% OFF", "seller": "Oficina Sol", "rating": "4.2", "reviews_count": "(77)",
            "shipping": "Chega na sexta", "product_url": "https://produto.mercadolivre.com.br/MLB88",
            "image_url": "//mlstatic.com/q/D_88_2X_.webp", "installments": "6x deR$ 51", "location": "Recife",
            "position_on_page": 1,
        },
        {
            "title": "Vasoazul", "price": "101900", "discount_percentage": "5%", "seller": "Barro Ltda",
            "rating": "2.5", "reviews_count": "(3)", "shipping": "Retire hoje", "location": "Natal",
            "product_url": "https://articulo.mercadolibre.com/9",
            "image_url": "https://mercadolivre.com.br/f/vaso-azul.png", "position_on_page": 2,
        },
        {"title": "Rede", "position_on_page": 3},
    ]


def test_basic_cards(spark):
    assert products_of(spark, LIST) == [
        {
            "title": "Tapete", "price": "245000", "product_url": "http://loja.example/t",
            "image_url": "https://mlstatic.com/tapete_2X_.jpg", "position_on_page": 1,
        },
        {"title": "Cesto", "position_on_page": 2},
    ]


@pytest.mark.parametrize("field", ["seller", "rating", "reviews_count", "shipping", "installments", "location"])
def test_each_class_rule_finds_its_field_alone(spark, field):
    names = [r[1:] for r in R.RICH_RULES[field] if r.startswith(".") and " " not in r]
    cards = "".join(f'<li class="ui-search-layout__item"><q class="{n}">v {i}</q></li>' for i, n in enumerate(names))
    assert [r.get(field) for r in products_of(spark, cards)] == [f"v {i}" for i in range(len(names))]


def test_layouts(spark):
    pages = pg.detect_layout(parsed(spark, LIST, LIST + SHELF, "<p>nothing</p>"))
    layouts = [r.layout for r in pages.orderBy("page_number").collect()]
    assert layouts == ["classic", "poly-card", "classic"]
    rows = pr.title_and_prices(pg.product_cards(pages)).orderBy("page_number", "position_on_page").collect()
    assert [(r.page_number, r.title, r.price) for r in rows] == [
        (1, "Tapete", "245000"), (1, "Cesto", None),
        (2, "Luminária de papel", "30600"), (2, "Vasoazul", "101900"), (2, "Rede", None),
    ]


def test_empty_rich_card_still_gives_a_row(spark):
    page = parsed(spark, '<li class="ui-search-layout__item"><a href="#">x</a></li>')
    row = pr.normalise_products(pr.listing_products(pg.product_cards(page))).first().asDict()
    assert all(row[c] == "N/A" for c in pr.TEXT_COLUMNS)


def id_page(*cards):
    return f'<div class="s-main-slot">{"".join(cards)}</div>'


def id_card(body, asin="B1"):
    title = '<h2 class="a-size-base-plus">T</h2>'
    return f'<div data-component-type="s-search-result" data-asin="{asin}">{title}{body}</div>'


def id_rows(spark, *bodies):
    page = parsed(spark, id_page(*[id_card(b) for b in bodies]))
    return pr.id_products(pg.id_cards(page)).orderBy("position_on_page").collect()


def test_id_cards_need_container_id_and_title(spark):
    good, no_id = id_card(""), id_card("", asin="")
    no_title = '<div data-component-type="s-search-result" data-asin="B2"></div>'
    pages = parsed(spark, id_page(no_id, good, no_title), f"<div>{good}</div>")
    rows = pr.id_products(pg.id_cards(pages)).collect()
    assert [(r.page_number, r.position_on_page, r.item_id) for r in rows] == [(1, 2, "B1")]


def test_both_price_parts_without_a_number_do_not_fall_back(spark):
    full = '<span class="a-price"><span class="a-offscreen">R$ 10,00</span></span>'
    parts = '<span class="a-price-whole">x</span><span class="a-price-fraction">9</span>'
    rows = id_rows(spark, full, parts + full, '<span class="a-price-whole">7</span>' + full)
    assert [r.price for r in rows] == ["1000", None, "1000"]


def test_links(spark):
    rows = id_rows(
        spark,
        '<h2><a href="/x/dp/1?q=1">a</a></h2>',
        '<h2><a>no address</a></h2><a class="a-link-normal" href="/other">b</a>',
        '<a class="a-link-normal" href="https://h/y?z">c</a>',
        '<h2><a href="/sspa/click?u">d</a></h2>',
        "",
    )
    base = "https://www.amazon.com.br"
    assert [r.product_url for r in rows] == [
        f"{base}/x/dp/1", f"{base}/dp/B1", "https://h/y", f"{base}/dp/B1", f"{base}/dp/B1",
    ]


def test_sellers(spark):
    rows = id_rows(
        spark,
        '<span class="a-size-small a-color-secondary">Loja</span>',
        '<span class="a-size-small a-color-secondary">À vista no pix</span><span class="a-size-base">por: Ana Ltda</span>',
        '<span class="a-size-base">de: X</span><span class="a-size-base">por: Y</span>',
        '<span class="a-size-base">vendido por 3 mil</span>',
        '<div class="a-row"><span>Vendido por Casa</span></div>',
    )
    assert [r.seller for r in rows] == ["Loja", "Ana Ltda", "Y", None, "Casa"]


def test_ancestors_outside_the_card_count(spark):
    page = f'<div class="s-main-slot"><div class="a-row">{id_card("<span>de: Fora</span>")}</div></div>'
    row = pr.id_products(pg.id_cards(parsed(spark, page))).first()
    assert row.seller == "Fora"


def test_shipping(spark):
    rows = id_rows(
        spark,
        '<i class="a-icon-prime"></i><div class="a-row">Frete grátis</div>',
        '<div class="a-row">Entrega GRÁTIS amanhã</div>',
        '<div class="a-row">Frete por 10 reais</div><div class="a-row">frete normal</div>',
        f'<div class="a-row">frete {"x" * 120}</div>',
    )
    assert [r.shipping for r in rows] == ["Prime", "Frete Grátis", "frete normal", None]
    assert [r.has_badge for r in rows] == [True, False, False, False]


def test_until_first_gap(spark):
    data = [
        ("s", 1, 5, False, False), ("s", 2, 0, False, True), ("s", 3, 4, False, False), ("s", 4, 0, False, False),
        ("s", 5, 9, False, False), ("t", 1, 3, False, False), ("t", 2, 0, True, False), (None, 1, 2, False, False),
    ]
    pages = spark.createDataFrame(data, "term string, page_number int, products int, blocked boolean, failed boolean")

    def kept(policy):
        return sorted(
            (r.term or "-", r.page_number) for r in sp.until_first_gap(pages, ["term"], policy).collect()
        )

    assert kept("abort") == [("-", 1), ("s", 1), ("t", 1)]
    assert kept("skip") == [("-", 1), ("s", 1), ("s", 3), ("s", 4), ("t", 1)]


def test_rules_from_a_table(spark):
    table = spark.createDataFrame(
        [("x", "title", 2, "h2"), ("x", "title", 1, ".t"), ("y", "title", 1, "p")],
        "layout string, field string, priority int, selector string",
    )
    assert R.rules_from(table, "x") == {"title": [".t", "h2"]}


def test_platform_table(spark):
    got = {r.platform: r.available for r in sp.platform_table(spark).collect()}
    assert got == {"mercadolivre": True, "amazon": True, "shopee": False}


def test_page_stage_does_not_shuffle(spark):
    products = pr.listing_products(pg.product_cards(parsed(spark, SHELF)))
    plan = products._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


MARKUP = [
    "<div>", "</div>", '<p class="a  b">', "</p>", "<br>", "<br/>", '<img src="x&amp;y" alt="q"/>', "<a href=x>", "</a>",
    "text", "a &amp; b", " \n ", "&copy", "<!-- c -->", "<!-- a > b -->", "<!-->", "<script>var a = '<li></p>';</script>",
    "<style>p{}</style>", "<title>t &amp; u</title>", "<title>t<b>u</b></title>", "<template>", "</template>", "< b", "<",
    "<textarea><b></textarea>", "<!DOCTYPE html>", "<?php x ?>", '<A HREF="Q" Class="Z z">', "<script>", "<svg/>", "</script>",
]


def test_plain_markup_reads_as_the_standard_parser_does():
    rng, plain = random.Random(3), 0
    for _ in range(4000):
        html = "".join(rng.choices(MARKUP, k=rng.randint(1, 6)))
        standard = el._Elements()
        standard.feed(html)
        standard.finish()
        page, error = el._parse(html)
        assert error is None
        assert (page.rows, page.stripped, page.raw) == (standard.rows, standard.stripped, standard.raw), html
        plain += el._Elements().read_plain(html)
    assert plain > 400


def test_a_rendered_page_is_plain_markup(spark):
    from registry.rendered import id_pages_of, listing_pages_of

    orders = spark.createDataFrame(
        [(k, 7, 1234.5 + k, "2-HIGH") for k in range(1, 60)],
        "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string",
    )
    for pages in (listing_pages_of(orders), id_pages_of(orders)):
        assert all(el._Elements().read_plain(r.html or "") for r in pages.select("html").collect())


def test_uneven_files_are_dealt_evenly(spark, tmp_path, monkeypatch):
    from registry import tables

    monkeypatch.setattr(tables, "_ROWS_PER_TASK", 100)
    for name, rows in (("a", 3000), ("b", 1), ("c", 1), ("d", 1)):
        spark.range(rows).coalesce(1).write.parquet(f"{tmp_path}/t/{name}.parquet")
    many = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/t").repartition(64, F.lit(1))
    sizes = [len(part) for part in tables.spread(many).rdd.glom().collect()]
    assert len(sizes) >= 31 and max(sizes) <= 110 and sum(sizes) == 3003


def test_a_filter_on_cards_does_not_make_them_again(spark):
    cards = pg.id_cards(parsed(spark, "<div class='s-main-slot'></div>"))
    plan = pr.id_products(cards)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(elements") <= 3 and "Filter (size(" not in plan


def test_rejected_pages_need_no_cards(spark):
    pages = spark.createDataFrame(
        [("amazon", "t", 1, "<p>x</p>"), ("amazon", "t", 2, "<![x["), ("mercadolivre", "t", 3, "<![x["), ("x", "t", 4, "")],
        "platform string, search_term string, page_number int, html string",
    )
    rejected = sp.extract_all(pages)[1]
    assert "posexplode" not in rejected._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.page_number, r.error_type) for r in rejected.collect()) == [
        (2, "ValueError"), (3, "ParsingException"), (4, "ValueError"),
    ]


def test_tags_are_kept_after_many_different_ones(monkeypatch):
    """Tags of one page each do not shut out those that all later pages repeat."""
    from shelfscan.operators import elements

    monkeypatch.setattr(elements, "_KNOWN_LIMIT", 50)
    monkeypatch.setattr(elements, "_PLAIN", {})
    monkeypatch.setattr(elements, "_KNOWN_TAGS", {})
    for i in range(500):
        assert elements.parsed_elements(f'<p class="early"><a href="/{i}">x</a></p>')[1] == "x"
    for _ in range(2):
        rows, text = elements.parsed_elements('<b class="late">y</b>')
        assert (rows[0][2], rows[0][6], text) == ("b", ["late"], "y")
    assert '<b class="late">' in elements._PLAIN and len(elements._PLAIN) <= 50
    broken = '<p class="early"><a href="/{}">x</p><i title=bare>y'
    for i in range(500):
        elements.parsed_elements(broken.format(i))
    elements.parsed_elements('<u class="late">y</u> < <i title=bare>')
    assert len(elements._KNOWN_TAGS) <= 50 and '<u class="late">' in elements._KNOWN_TAGS


def test_checks_of_whole_pages_replace_nothing_and_try_no_alternatives(spark):
    pages = spark.createDataFrame([("amazon", 1, "x")], "platform string, page_number int, html string")
    plan = sp.page_errors(pages)._jdf.queryExecution().analyzed().toString()
    assert "regexp_replace" not in plan and plan.count("RLIKE") == 1
    assert all(f"{word})" in plan for word in R.BLOCK_PHRASES["amazon"])


def test_blank_is_nothing_but_unicode_spaces(spark):
    htmls = [None, "", " \t\r\n\u00a0\u2003", "\u200b", " x\n", "\n<"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "i int, html string")
    assert [r[0] for r in df.orderBy("i").select(pg.is_blank()).collect()] == [True, True, True, False, False, False]


def test_tags_that_differ_in_values_are_read_by_one_shape(monkeypatch):
    """Addresses and item ids make most tags of a page unlike any other's; their form is read once."""
    monkeypatch.setattr(el, "_PLAIN", {})
    monkeypatch.setattr(el, "_SHAPES", {})
    for i in range(100):
        rows, _ = el.parsed_elements(f'<a HREF="/{i}?a&amp;b" class=" k{i}  m"></a><img src="{i}.png"/>')
        assert [(r[2], r[3], r[6]) for r in rows] == [
            ("a", {"href": f"/{i}?a&b", "class": f"k{i} m"}, [f"k{i}", "m"]), ("img", {"src": f"{i}.png"}, []),
        ]
    assert {k for k, v in el._SHAPES.items() if v} == {'<a HREF=" class=">', '<img src="/>'}


def test_pages_read_together_are_as_read_one_by_one():
    rng, nested = random.Random(5), 0
    for k in range(200):
        pages = ["".join(rng.choices(MARKUP, k=rng.randint(0, 9))) for _ in range(rng.randint(0, 40))]
        pages = [f'<div><p class="a">{p}</p></div>' if k % 3 else p for p in pages] + [None]
        one = [el._parse(p) for p in pages]
        want = [
            el._element_arrays([p for p, _ in one]).to_pylist(), ["".join(p.stripped) for p, _ in one],
            [e for _, e in one], ["".join(p.raw) for p, _ in one],
        ]
        assert [c.to_pylist() for c in el._read(pages, True)] == want
        assert el._errors(pages) == want[2]
        nested += int(el._read_nested(pages, False)[0].sum())
    assert nested > 500


def test_marks_say_what_a_rule_says(spark):
    """A mark is set where names, classes and attributes fit, and nowhere else."""
    from shelfscan.operators import marks

    words = sorted({w for c in marks.NUMBERS for k, w, _, v in marks.parts(c) for w in ([w, v] if v else [w])})
    tags = [p[0][1] for p in map(marks.parts, marks.NUMBERS) if p[0][0] == "tag"]
    rng = random.Random(7)
    html = "".join(
        f'<{rng.choice(tags)} {rng.choice(["href", "src", "data-src", "title", "data-a-strike"])}="{rng.choice(["true", "http://x.mlstatic/dp/1", "s-search-result"])}"'
        f' data-component-type="s-search-result" class="{rng.choice(words)} {rng.choice(words)} {rng.choice(words)}">t'
        for _ in range(700)
    )
    page = parsed(spark, html)

    def plain(compound):
        parts = [f"e.tag = '{n}'" if k == "tag" else f"array_contains(e.classes, '{n}')" if k == "cls"
                 else f"NOT array_contains(e.classes, '{n}')" if k == "without"
                 else f"e.attrs['{n}'] IS NOT NULL" if not op
                 else f"e.attrs['{n}'] = '{v}'" if op == "=" else f"contains(e.attrs['{n}'], '{v}')"
                 for k, n, op, v in marks.parts(compound)]
        return " AND ".join(parts)

    same = [
        f"transform(elements, e -> coalesce({plain(c)}, false)) = transform(elements, e -> (e.{marks.bit(c)[0]} & {marks.bit(c)[1]}L) != 0)"
        for c in marks.NUMBERS
    ]
    hits = [f"exists(elements, e -> {plain(c)})" for c in marks.NUMBERS]
    got, found = page.selectExpr(f"array({', '.join(same)}) s", f"array({', '.join(hits)}) h").first()
    assert all(got) and sum(map(bool, found)) > 60


def test_rules_filter_by_marks_and_ancestors_are_looked_for_among_few_elements(spark):
    cards = pg.id_cards(parsed(spark, "<div class='s-main-slot'></div>"))
    plan = pr.id_products(cards)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan
    assert plan.count("marks_") > plan.count("array_contains") + plan.count(".tag")
    assert "filter(_shallow" in plan and "depth" in plan
