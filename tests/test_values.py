"""Single values: prices, links, texts, addresses."""

import re
import string
from decimal import Decimal
from urllib.parse import quote

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfscan.functions import links, text


def column(spark, values, use, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(use(F.col("v"))).collect()]


PRICES = [
    ("preço 7,05", 705), ("R$ 2.308,40", 230840), ("R$ 43", 4300), ("75.020,10", 7502010), ("sem preço", None),
    ("0,07", 7), ("", None), ("R$", None), ("1.002.003,04", 100200304), ("0", 0),
    (None, None), ("89", 8900), ("1,2,3", None), ("19,99", 1999), (",5", 50), ("7,", 700), (",", None),
    ("12,349", 1234),
]


def test_brl_cents(spark):
    assert column(spark, [p for p, _ in PRICES], text.brl_cents) == [c for _, c in PRICES]


def test_brl_cents_legacy_keeps_the_float_error(spark):
    assert column(spark, ["19,99", "100,50"], lambda c: text.brl_cents(c, legacy=True)) == [1998, 10050]


def test_brl_decimal(spark):
    got = column(spark, ["49,90", "1.234,56", "x", ""], text.brl_decimal)
    assert got == [Decimal("49.900000"), Decimal("1234.560000"), None, None]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 10**12), min_size=1, max_size=40))
def test_brl_cents_reads_back_any_price(spark, cents):
    shown = [f"R$ {c // 100:,}".replace(",", ".") + f",{c % 100:02d}" for c in cents]
    assert column(spark, shown, text.brl_cents) == cents


def test_offscreen_price(spark):
    got = column(spark, ["R$ 3.998,00", "R$ 1,50 ", "de R$ 3", "", None], text.offscreen_price)
    assert got == [Decimal(3998), Decimal("1.5"), None, None, None]


def test_split_price(spark):
    df = spark.createDataFrame(
        [("1.859,", "90"), ("", "5"), ("7", ""), ("R$ 7", "00"), (None, "1"), ("1", None)], "w string, f string"
    )
    got = [r[0] for r in df.select(text.split_price(F.col("w"), F.col("f"))).collect()]
    assert got == [Decimal("1859.9"), Decimal("0.5"), Decimal(7), None, None, None]


def test_ratings_and_reviews(spark):
    assert column(spark, ["4,8 de 5 estrelas", "nota 3.5", "5", "x", None], text.rating_value) == [
        4.8, 3.5, 5.0, None, None,
    ]
    reviews = ["(20.154)", "20,1 mil", "2mil", "nada", None]
    assert column(spark, reviews, text.review_count) == [20154, 20100, 2000, None, None]
    assert column(spark, reviews, lambda c: text.review_count(c, legacy=True)) == [
        20154, 201000, 2000, None, None,
    ]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab/._-é", max_size=12), min_size=1, max_size=12))
def test_valid_image_url(spark, middles):
    """Long enough, a start that is accepted, and an accepted host anywhere: all three or not."""
    cases = {}
    for middle in middles:
        for start in ("http", "https://", "//", "/", "ftp://", "", " //", "data:"):
            for host in ("", "example.net", *links.IMAGE_DOMAINS):
                value = start + host + middle
                bare = value.strip()
                accepted = len(bare) >= 10 and bare.startswith(("//", "http"))
                cases[value] = accepted and any(d in bare for d in links.IMAGE_DOMAINS)
    assert column(spark, list(cases), links.valid_image_url) == list(cases.values())
    assert column(spark, [None, " \t "], links.valid_image_url) == [False, False]


def test_image_variant(spark):
    values = ["https://mlstatic.com/a_V_.jpg", "https://mlstatic.com/a_2X_b_V_.jpg", "https://x.com/a_V_.jpg"]
    assert column(spark, values, links.image_variant) == [
        "https://mlstatic.com/a_2X_.jpg", values[1], values[2],
    ]
    assert column(spark, ["a.jpg 2x, b.jpg 1x", "c.jpg"], links.srcset_head) == ["a.jpg", "c.jpg"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=string.printable + "çãé/*~%日", max_size=20), min_size=1, max_size=30))
def test_percent_encoding_equals_quote(spark, terms):
    assert column(spark, terms, links.percent_encoded) == [quote(t) for t in terms]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abc é日😀â†’…", max_size=15), min_size=1, max_size=30))
def test_ascii_text(spark, values):
    def expected(value):
        for old, new in text.BROKEN_SEQUENCES:
            value = value.replace(old, new)
        return value.encode("ascii", errors="replace").decode("ascii")

    assert column(spark, values, text.ascii_text) == [expected(v) for v in values]


@pytest.mark.parametrize("page, end", [(1, ""), (2, "_Desde_51_NoIndex_True"), (5, "_Desde_201_NoIndex_True")])
def test_listing_urls(spark, page, end):
    df = spark.createDataFrame([("café x", page)], "t string, p int")
    row = df.select(
        links.listing_url_offset(F.col("t"), F.col("p")), links.listing_url_query(F.col("t"), F.col("p"))
    ).first()
    assert row[0] == "https://lista.mercadolivre.com.br/caf%C3%A9%20x" + end
    assert row[1] == "https://www.amazon.com.br/s?k=caf%C3%A9%20x" + (f"&page={page}" if page > 1 else "")


def test_result_key(spark):
    row = spark.sql("select timestamp'2025-09-18 11:19:17' t, 'cafeína 15/x' term").select(
        text.result_key(F.lit(None).cast("string"), F.col("term"), F.col("t"))
    ).first()
    assert row[0] == "unknown_cafeína_15x_20250918_111917"


def test_discount(spark):
    df = spark.createDataFrame([(75, 100), (100, 100), (0, 100), (2, 3), (None, 3), (799, 800)], "p long, o long")
    got = [r[0] for r in df.select(text.discount_pct(F.col("p"), F.col("o"))).collect()]
    assert got == [25.0, None, None, 33.33, None, 0.12]


def test_strip_removes_every_unicode_space_and_no_other(spark):
    spaces = [chr(i) for i in range(0x3001) if re.fullmatch(r"\s", chr(i)) and not 0x1C <= i <= 0x1F]
    others = ["\x1c", "\u200b", "\u180e", "\ufeff"]
    given = [None, "", *spaces, *(f"{s}\n a{s}b {s}" for s in spaces), *(f" {o}a{o} " for o in others)]
    expected = [None, "", *("" for _ in spaces), *(f"a{s}b" for s in spaces), *(f"{o}a{o}" for o in others)]
    assert column(spark, given, text.strip) == expected


def test_contains_any(spark):
    words = ["a.b", "por: x", "por:", "(", "até"]
    given = [None, "", "a.b", "axb", "por", "por: y", "1 (", "ATÉ", "xaté"]
    expected = [None, False, True, False, False, True, True, False, True]
    assert column(spark, given, lambda c: text.contains_any(c, words)) == expected
