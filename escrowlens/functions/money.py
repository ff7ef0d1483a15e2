"""Money arithmetic as JVM-side column expressions (no Python UDF).

Money is whole rupiah in ``bigint``.  A rate setting is text; it is used with
all its digits (``EXACT_RATE``: up to 17 decimals), and only the stored ``rate``
column is ``decimal(5,4)``.  Fee products are exact decimals before flooring or
rounding, so binary floating point never decides a rupiah.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the source system.
DEFAULT_COMMISSION_RATE = "0.05"          # fallback rate and seed value
COMMISSION_RATE_KEY = "commission_rate"   # app_settings key
RATE_TYPE = "decimal(5,4)"                # the stored column
EXACT_RATE = "decimal(18,17)"
AMOUNT_TYPE = "decimal(19,0)"             # any bigint; times EXACT_RATE it fits 38 digits
ERR_BAD_NUMBER = 'invalid input syntax for type numeric: "'
ERR_OVERFLOW = "numeric field overflow"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cents(x) -> Column:
    """``cast(round(x * 100) as bigint)``: a double amount to whole units."""
    return F.round(col_(x) * F.lit(100)).cast("bigint")


def parse_rate(text) -> Column:
    """Buyer-side rate of a text setting: as the page does, a missing or
    unparsable value gives the default."""
    return F.coalesce(F.expr(f"try_cast({_sql(text)} as {EXACT_RATE})"),
                      F.lit(DEFAULT_COMMISSION_RATE).cast(EXACT_RATE))


def rate_error(text) -> Column:
    """Why settlement refuses a text setting (null if it doesn't): only a missing
    value has a default; what is no number, doesn't fit the stored column or has
    more than 17 decimals is refused."""
    t = _sql(text)
    return (F.when(F.expr(f"{t} is null"), F.lit(None).cast("string"))
            .when(F.expr(f"try_cast({t} as double) is null"),
                  F.concat(F.lit(ERR_BAD_NUMBER), F.col(text), F.lit('"')))
            .when(F.expr(f"try_cast({t} as {EXACT_RATE}) is null"
                         f" or try_cast(try_cast({t} as {EXACT_RATE}) as {RATE_TYPE}) is null"
                         f" or try_cast({t} as decimal(38,30)) <> try_cast({t} as {EXACT_RATE})"),
                  F.lit(ERR_OVERFLOW)))


def seller_fee(total, rate) -> Column:
    """Seller-side fee: ``floor(total * rate)`` in exact decimal, as bigint."""
    return F.floor(col_(total).cast(AMOUNT_TYPE) * col_(rate).cast(EXACT_RATE)).cast("bigint")


def buyer_fee(price, rate, cap=None) -> Column:
    """Buyer-side fee: ``round(price * rate)`` half up, optionally capped.

    The browser computed ``Math.round(price * rate%/100)``; amounts are
    positive, so half-up decimal rounding gives the same integer without the
    binary-float drift of ``rate * 100``.
    """
    fee = F.round(col_(price).cast(AMOUNT_TYPE) * col_(rate).cast(EXACT_RATE), 0)
    fee = fee.cast("bigint")
    if cap is not None:
        cap_c = col_(cap).cast("bigint")
        fee = F.when((cap_c > 0) & (fee > cap_c), cap_c).otherwise(fee)
    return fee


def percent_label(rate) -> Column:
    """``round(rate * 100)`` as an integer, e.g. 0.05 -> 5."""
    return F.round(col_(rate).cast(EXACT_RATE) * F.lit(100), 0).cast("bigint")


def thousands(n) -> Column:
    """Thousands grouped with commas: 1234567 -> '1,234,567'."""
    return F.format_number(col_(n).cast("bigint"), 0)


def rupiah(n) -> Column:
    """Rupiah label with dot grouping: 1234567 -> 'Rp 1.234.567'."""
    return F.concat(F.lit("Rp "), F.translate(thousands(n), ",", "."))


def _sql(c) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("parse_rate takes a column name")
