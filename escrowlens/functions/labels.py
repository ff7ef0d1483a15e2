"""Display rules of the catalogue, inbox and chat, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from escrowlens.functions.money import col_

# Fixed values of the source system: categories and game subcategories, in
# their listed order.
CATEGORIES = [("digital", "Produk Digital"), ("game", "Produk Game"), ("jasa", "Jasa")]
GAME_SUBCATEGORIES = ["mobile-legends", "free-fire", "pubg-mobile", "valorant",
                      "genshin-impact", "roblox"]
ORDER_STATUSES = ["pending_payment", "paid", "processing", "delivered", "completed",
                  "disputed", "refunded", "cancelled"]
ACTIVE_STATUSES = ["paid", "processing", "delivered"]
REFUNDABLE_STATUSES = ["paid", "processing", "delivered", "disputed"]
ROLES = ["pembeli", "penjual", "admin"]
WALLET_TX_TYPES = ["topup", "escrow_hold", "escrow_release", "refund", "withdrawal"]
# Catalogue card defaults.
DEFAULT_ICON = "📦"
DEFAULT_BADGE = "Instan"
DEFAULT_GRAD = ["#16A37A", "#0E7C5B"]
DEFAULT_RATING = 5
# Indonesian short month names, January to December.
MONTHS_ID = ["Jan", "Feb", "Mar", "Apr", "Mei", "Jun", "Jul", "Agu", "Sep", "Okt",
             "Nov", "Des"]
# Neutral fallbacks for missing names (configurable per call).
DEFAULT_USER_NAME = "Pengguna"
DEFAULT_SELLER_NAME = "Penjual"


def blank_to_null(c) -> Column:
    """Browser truthiness: '' counts as missing."""
    c = col_(c)
    return F.when(c == "", F.lit(None).cast("string")).otherwise(c)


def display_name(full_name, username, fallback: str = DEFAULT_USER_NAME) -> Column:
    """``coalesce(full_name, username, fallback)`` (SQL null rule)."""
    return F.coalesce(col_(full_name), col_(username), F.lit(fallback))


def seller_label(username, full_name, fallback: str = DEFAULT_SELLER_NAME) -> Column:
    """'@' + username when non-empty, else full name when non-empty, else fallback."""
    u = blank_to_null(username)
    return F.when(u.isNotNull(), F.concat(F.lit("@"), u)).otherwise(
        F.coalesce(blank_to_null(full_name), F.lit(fallback)))


def category_label(cat) -> Column:
    m = F.create_map(*[x for k, v in CATEGORIES for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[col_(cat)], col_(cat), F.lit("-"))


def stock_label(stock) -> Column:
    s = col_(stock)
    return (F.when(s.isNull(), F.lit(""))
            .when(s > 0, F.concat(F.lit("Stok tersedia ("), s.cast("string"), F.lit(")")))
            .otherwise(F.lit("Habis")))


def rating_label(rating) -> Column:
    """One decimal, half up on the decimal value (4.25 -> '4.3')."""
    r = F.round(col_(rating).cast("decimal(10,4)"), 1).cast("decimal(10,1)")
    return r.cast("string")


def chat_time_label(ts, asof) -> Column:
    """'HH.mm' on the as-of day, else 'd Mon HH.mm' with Indonesian months."""
    t = col_(ts)
    months = F.array(*[F.lit(m) for m in MONTHS_ID])
    hm = F.date_format(t, "HH.mm")
    other = F.concat(F.dayofmonth(t).cast("string"), F.lit(" "),
                     F.element_at(months, F.month(t)), F.lit(" "), hm)
    return F.when(F.to_date(t) == F.to_date(col_(asof)), hm).otherwise(other)


def photos_or_cover(photos, cover) -> Column:
    p, c = col_(photos), col_(cover)
    return (F.when(p.isNotNull(), p)
            .when(c.isNotNull(), F.array(c))
            .otherwise(F.array().cast("array<string>")))


EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def email_ok(email) -> Column:
    return F.coalesce(F.trim(col_(email)).rlike(EMAIL_PATTERN), F.lit(False))


def landing_page(role) -> Column:
    r = col_(role)
    return (F.when(r == "admin", F.lit("dashboard-admin"))
            .when(r == "penjual", F.lit("dashboard-penjual"))
            .otherwise(F.lit("dashboard-pembeli")))
