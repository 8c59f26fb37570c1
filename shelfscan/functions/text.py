"""Locale prices, ratings, review counts, text repair and result keys."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import percent_2dp

MISSING = "N/A"

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"
_MONEY = "decimal(24,6)"

# Broken character sequences and their replacements, applied in this order.
BROKEN_SEQUENCES = [
    ("â†’", "->"),
    ("â†\u0090", "<-"),
    ("â†‘", "^"),
    ("â†“", "v"),
    ("âœ“", "ok"),
    ("âœ—", "x"),
    ("â˜…", "*"),
    ("â€¢", "*"),
    ("â€¦", "..."),
]


# Fixed value: every character that Unicode counts as white space.
_SPACES = "".join(
    map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends; only the ends are read."""
    return F.btrim(c, F.lit(_SPACES))


def _replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether any of the words occurs; the text is evaluated once for all of them.

    Plain searches: an alternation of patterns is tried anew at every character. A word with another
    one in it decides nothing.
    """
    least = [w for w in dict.fromkeys(words) if not any(v in w for v in words if v != w)]
    if not least:
        return c.rlike("|".join(re.escape(word) for word in words))
    return once(c, lambda t: reduce(or_, [F.contains(t, F.lit(word)) for word in least]))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` for an expensive ``value`` that ``use`` mentions several times."""
    return F.get(F.transform(F.array(value), use), 0)


def _number_text(c: Column) -> Column:
    """Digits and one decimal point of a Brazilian price text, null if there is no number."""
    plain = _replace_all(c, [(".", ""), (",", ".")])
    digits = F.regexp_replace(plain, "[^0-9.]", "")
    return F.when(digits.rlike(_NUMBER), digits)


def brl_cents(c: Column, legacy: bool = False) -> Column:
    """``R$ 1.234,56`` to 123456; decimals beyond cents are cut, null without a number.

    ``legacy`` multiplies in floating point first, which loses a cent on some prices.
    """
    number = _number_text(F.nullif(c, F.lit(MISSING)))
    if legacy:
        return (number.cast("double") * 100).cast("bigint")
    whole = F.split_part(number, F.lit("."), F.lit(1))
    cents = F.rpad(F.substring(F.split_part(number, F.lit("."), F.lit(2)), 1, 2), 2, "0")
    return F.concat(whole, cents).try_cast("bigint")


def brl_decimal(c: Column) -> Column:
    """``1.234,56`` to 1234.56, null without a number."""
    return _number_text(c).try_cast(_MONEY)


def split_price(whole: Column, fraction: Column) -> Column:
    """Price from its whole and fraction parts; null when they do not form a number."""
    text = F.concat(F.regexp_replace(whole, "[.,]", ""), F.lit("."), fraction)
    return F.when(text.rlike(_NUMBER), text.try_cast(_MONEY))


def offscreen_price(c: Column) -> Column:
    """Full price text such as ``R$ 3.998,00``; any other text around it makes it null."""
    text = strip(_replace_all(c, [("R$", ""), (".", ""), (",", ".")]))
    return F.when(text.rlike(_NUMBER), text.try_cast(_MONEY))


def to_cents(price: Column, legacy: bool = False) -> Column:
    """Price to whole cents, cut towards zero."""
    if legacy:
        return (price.cast("double") * 100).cast("bigint")
    return (price.cast(_MONEY) * 100).cast("bigint")


def rating_value(c: Column) -> Column:
    """First number of a rating text, comma or point as decimal mark."""
    number = F.regexp_extract(c, "([0-9]+[,.]?[0-9]*)", 1)
    return F.replace(number, F.lit(","), F.lit(".")).try_cast("double")


def review_count(c: Column, legacy: bool = False) -> Column:
    """``(20.154)`` to 20154 and ``20,1 mil`` to 20100.

    ``legacy`` drops the comma before multiplying (201000).
    """
    digits = F.regexp_extract(F.regexp_replace(c, "[.,]", ""), "([0-9]+)", 1).try_cast("bigint")
    thousands = F.contains(F.lower(c), F.lit("mil"))
    if legacy:
        return F.when(thousands, digits * 1000).otherwise(digits)
    number = F.regexp_extract(F.replace(c, F.lit("."), F.lit("")), "([0-9]+(,[0-9]+)?)", 1)
    scaled = F.replace(number, F.lit(","), F.lit(".")).try_cast("decimal(20,6)") * 1000
    return F.when(thousands, scaled.cast("bigint")).otherwise(digits)


def discount_pct(price_cents: Column, original_cents: Column) -> Column:
    """Discount in percent with two decimals, null unless the original price is higher."""
    return F.when(
        (original_cents > price_cents) & (price_cents != 0),
        percent_2dp(original_cents - price_cents, original_cents),
    )


def ascii_text(c: Column) -> Column:
    """Repair known broken sequences, then one ``?`` per remaining non-ASCII character."""
    return F.regexp_replace(_replace_all(c, BROKEN_SEQUENCES), r"[^\x00-\x7F]", "?")


def ascii_table(df: DataFrame) -> DataFrame:
    """Apply :func:`ascii_text` to every string column."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({name: ascii_text(F.col(name)) for name in texts})


def result_key(platform: Column, term: Column, time: Column) -> Column:
    """``platform_term_yyyyMMdd_HHmmss`` with only letters, digits, ``_`` and ``-`` in the term."""
    safe = F.regexp_replace(
        F.replace(F.coalesce(term, F.lit("")), F.lit(" "), F.lit("_")), r"[^\p{L}\p{N}_-]", ""
    )
    return F.concat_ws(
        "_",
        F.coalesce(F.nullif(platform, F.lit("")), F.lit("unknown")),
        safe,
        F.date_format(time, "yyyyMMdd_HHmmss"),
    )
