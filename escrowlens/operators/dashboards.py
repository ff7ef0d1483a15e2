"""Dashboards and platform statistics (aggregations).

Each dashboard is computed for every user at once.  Measures are aggregated
per key first (partial aggregation on the map side), then joined onto the
profile rows, so a join never multiplies fact rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escrowlens.functions.labels import ACTIVE_STATUSES
from escrowlens.plans.fanout import fanout_closed_form
from escrowlens.plans.joins import one_row

Tables = dict[str, DataFrame]


def _zero():
    return F.lit(0).cast("bigint")


def _is(status: str):
    return F.col("status") == status


def _wallet_cols(t: Tables) -> DataFrame:
    return t["wallets"].select(F.col("user_id").alias("id"),
                               F.col("balance").alias("wallet_balance"),
                               F.col("escrow_hold").alias("wallet_escrow"))


def buyer_dashboard(t: Tables) -> DataFrame:
    """Orders, completed, active and completed spend per buyer, with wallet."""
    per_buyer = t["orders"].groupBy(F.col("buyer_id").alias("id")).agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(_is("completed")).alias("completed_orders"),
        F.count_if(F.col("status").isin(*ACTIVE_STATUSES)).alias("active_orders"),
        F.sum(F.when(_is("completed"), F.col("total_amount"))).alias("total_spent"),
    )
    p = t["profiles"].select("id", "full_name", "role")
    j = p.join(_wallet_cols(t), "id", "left").join(per_buyer, "id", "left")
    return j.select(
        F.col("id").alias("user_id"), "full_name", "role", "wallet_balance", "wallet_escrow",
        F.coalesce("total_orders", _zero()).alias("total_orders"),
        F.coalesce("completed_orders", _zero()).alias("completed_orders"),
        F.coalesce("active_orders", _zero()).alias("active_orders"),
        F.coalesce("total_spent", _zero()).alias("total_spent"),
    )


def _seller_sides(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = t["orders"].groupBy(F.col("seller_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_o"),
        F.count_if(_is("completed")).alias("completed_o"),
        F.count_if(F.col("status").isin(*ACTIVE_STATUSES)).alias("active_o"),
        F.count_if(_is("pending_payment")).alias("pending_o"),
        F.coalesce(F.sum(F.when(_is("completed"), F.col("seller_receives"))), _zero())
         .alias("revenue_o"),
    )
    r = t["reviews"].groupBy(F.col("seller_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_r"),
        F.sum("rating").alias("rating_sum"),
    )
    pr = t["products"].groupBy(F.col("seller_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_p"),
        F.count_if(F.col("is_active")).alias("active_p"),
    )
    return o, r, pr


def _seller_base(t: Tables) -> DataFrame:
    o, r, pr = _seller_sides(t)
    p = t["profiles"].select("id", "full_name", "role")
    return (p.join(_wallet_cols(t), "id", "left").join(o, "id", "left")
            .join(r, "id", "left").join(pr, "id", "left"))


def _avg_rating(sum_col, n_col):
    return F.coalesce(F.round(F.col(sum_col) / F.col(n_col), 4), F.lit(0.0))


def seller_dashboard(t: Tables) -> DataFrame:
    """Seller dashboard with every measure counted once."""
    j = _seller_base(t)
    c = lambda x: F.coalesce(F.col(x), _zero())
    return j.select(
        F.col("id").alias("user_id"), "full_name", "role", "wallet_balance", "wallet_escrow",
        c("n_o").alias("total_orders"), c("completed_o").alias("completed_orders"),
        c("active_o").alias("active_orders"), c("pending_o").alias("pending_orders"),
        c("revenue_o").alias("total_revenue"),
        _avg_rating("rating_sum", "n_r").alias("avg_rating"),
        c("n_r").alias("total_reviews"), c("active_p").alias("active_products"),
    )


def seller_dashboard_asis(t: Tables) -> DataFrame:
    """Seller dashboard exactly as the source view computes it.

    The view left-joins orders, reviews and products on the seller alone, so
    each measure is repeated once per row of the other two sides.  The closed
    form multiplies each side's aggregate by the other sides' row counts
    (``max(n, 1)``) instead of building the n_o * n_r * n_p rows.
    """
    j = _seller_base(t)
    sides = {"o": "n_o", "r": "n_r", "p": "n_p"}
    m = fanout_closed_form(sides)
    c = lambda x: F.coalesce(F.col(x), _zero())
    return j.select(
        F.col("id").alias("user_id"), "full_name", "role", "wallet_balance", "wallet_escrow",
        m("o", c("n_o")).alias("total_orders"),
        m("o", c("completed_o")).alias("completed_orders"),
        m("o", c("active_o")).alias("active_orders"),
        m("o", c("pending_o")).alias("pending_orders"),
        m("o", c("revenue_o")).alias("total_revenue"),
        _avg_rating("rating_sum", "n_r").alias("avg_rating"),
        m("r", c("n_r")).alias("total_reviews"),
        m("p", c("active_p")).alias("active_products"),
    )


def admin_stats_v1(t: Tables) -> DataFrame:
    """Platform stats, first version: one aggregate per table, combined."""
    prof = t["profiles"].agg(
        F.count_if(F.col("role") == "pembeli").alias("total_buyers"),
        F.count_if(F.col("role") == "penjual").alias("total_sellers"),
        F.count_if(F.col("is_suspended")).alias("total_suspended"))
    prod = t["products"].agg(F.count_if(F.col("is_active")).alias("active_products"))
    o = t["orders"].agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(_is("completed")).alias("completed_orders"),
        F.count_if(_is("disputed")).alias("disputed_orders"),
        F.count_if(_is("pending_payment")).alias("pending_orders"),
        F.coalesce(F.sum(F.when(_is("completed"), F.col("total_amount"))), _zero())
         .alias("gmv_completed"),
        F.coalesce(F.sum(F.when(_is("completed"), F.col("platform_fee"))), _zero())
         .alias("platform_revenue"))
    w = t["wallets"].agg(
        F.coalesce(F.sum("escrow_hold"), _zero()).alias("total_escrow_held"),
        F.coalesce(F.sum("balance"), _zero()).alias("total_wallet_balance"))
    return one_row(prof, prod, o, w)


def admin_singleton_balance(t: Tables) -> DataFrame:
    """The admin wallet's balance: its oldest row when several exist."""
    aw = t["admin_wallet"]
    return aw.agg(F.coalesce(F.min_by("balance", F.struct("created_at", "id")), _zero())
                  .alias("admin_balance"))


def admin_stats_v2(t: Tables, exact_distinct: bool = True) -> DataFrame:
    """Platform stats, current version: one pass over orders plus scalars."""
    buyers = (F.count_distinct("buyer_id") if exact_distinct
              else F.approx_count_distinct("buyer_id"))
    o = t["orders"].agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(_is("completed")).alias("completed_orders"),
        F.count_if(_is("pending_payment")).alias("pending_orders"),
        F.count_if(_is("disputed")).alias("disputed_orders"),
        F.coalesce(F.sum(F.when(_is("completed"), F.col("total_amount"))), _zero())
         .alias("gmv_completed"),
        F.coalesce(F.sum(F.when(_is("completed"), F.col("platform_fee"))), _zero())
         .alias("platform_revenue"),
        F.coalesce(F.sum(F.when(F.col("status").isin("paid", "processing"),
                                F.col("total_amount"))), _zero()).alias("total_escrow_held"),
        buyers.alias("total_buyers"))
    w = t["wallets"].agg(F.coalesce(F.sum("balance"), _zero()).alias("total_wallet_balance"))
    aw = admin_singleton_balance(t).withColumnRenamed("admin_balance",
                                                      "admin_commission_balance")
    prof = t["profiles"].agg(
        F.count_if(F.col("role") == "penjual").alias("total_sellers"),
        F.count_if(F.col("is_suspended")).alias("total_suspended"))
    out = one_row(o, w, aw, prof)
    return out.select("total_orders", "completed_orders", "pending_orders", "disputed_orders",
                      "gmv_completed", "platform_revenue", "total_escrow_held",
                      "total_wallet_balance", "admin_commission_balance", "total_buyers",
                      "total_sellers", "total_suspended")


def commission_summary(t: Tables, asof: str) -> DataFrame:
    """Settled commission in total, on the as-of day and in its month.

    The day and month tests read ``created_at`` (as the source does), and
    "now" is the ``asof`` parameter so the result is repeatable.
    """
    now = F.lit(asof).cast("timestamp_ntz")
    settled = F.col("status") == "settled"
    fee = F.col("fee_amount")
    c = t["platform_commission"].agg(
        F.coalesce(F.sum(F.when(settled, fee)), _zero()).alias("total_commission"),
        F.coalesce(F.sum(F.when(settled & (F.to_date("created_at") == F.to_date(now)), fee)),
                   _zero()).alias("today_commission"),
        F.coalesce(F.sum(F.when(settled & (F.col("created_at") >= F.date_trunc("month", now)),
                                fee)), _zero()).alias("month_commission"))
    return one_row(c, admin_singleton_balance(t))


def gmv_by_period(t: Tables, unit: str = "day") -> DataFrame:
    """Completed-order GMV and fee per day or ISO week of order creation."""
    period = F.date_trunc(unit, F.col("created_at")).cast("date")
    o = t["orders"].filter(_is("completed"))
    return o.groupBy(period.alias("period")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("total_amount").alias("gmv"),
        F.sum("platform_fee").alias("fees"))


def gmv_rollup(t: Tables) -> DataFrame:
    """D14 with D1's and D2's groupings in one scan of orders: completed GMV by day, by
    ISO week, by month, by seller, by month and seller, and in all (``level``).  Day
    totals are formed first, so the sets are expanded over them and not over orders."""
    o = t["orders"].filter(_is("completed"))
    of_day = o.groupBy(F.to_date("created_at").alias("day"), "seller_id").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("total_amount").alias("gmv"),
        F.sum("platform_fee").alias("fees"))
    d = of_day.select("*", F.date_trunc("week", "day").cast("date").alias("week"),
                      F.trunc("day", "month").alias("month"))
    keys = [F.col(c) for c in ("day", "week", "month", "seller_id")]
    day, week, month, seller = keys
    sets = [[day], [week], [month], [seller], [month, seller], []]
    g = d.groupingSets(sets, *keys).agg(
        F.grouping_id().alias("_g"), F.sum("orders").alias("orders"), F.sum("gmv").alias("gmv"),
        F.sum("fees").alias("fees"))
    # one bit per key, set where the key is left out
    named = {0b0111: "day", 0b1011: "week", 0b1101: "month", 0b1110: "seller", 0b1100: "month, seller", 0b1111: "all"}
    level = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])
    return g.select(level[F.col("_g").cast("int")].alias("level"), "day", "week", "month", "seller_id", "orders", "gmv", "fees")


# ---------------------------------------------------------------- D7 over any dates

NUMBER_BUCKETS = 4096


def numbered(df: DataFrame, col: str) -> DataFrame:
    """The distinct values of ``col`` (nulls left out) with a dense number ``n`` from 0.

    Values are numbered inside hash buckets; the buckets' offsets come from a window
    over at most ``NUMBER_BUCKETS`` counts, so no task sees all values.
    """
    one = df.select(col).filter(F.col(col).isNotNull()).distinct().withColumn(
        "_b", F.pmod(F.xxhash64(col), F.lit(NUMBER_BUCKETS)))
    sizes = one.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(col)) - 1
    return (one.withColumn("_i", inside).join(F.broadcast(starts), "_b")  # at most NUMBER_BUCKETS rows
            .select(col, (F.col("_at") + F.col("_i")).cast("bigint").alias("n")))


def daily_buyers(t: Tables, numbers: DataFrame) -> DataFrame:
    """D7 that can be merged: per day and block of 32,768 buyer numbers, a bitmap of
    the buyers who ordered (day, block, buyers).  A day is added by its own rows."""
    o = t["orders"].select("buyer_id", F.to_date("created_at").alias("day")).join(numbers, "buyer_id")
    return o.groupBy("day", F.bitmap_bucket_number("n").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("buyers"))


def distinct_buyers(daily: DataFrame, period: Column, name: str) -> DataFrame:
    """Exact distinct buyers of each ``period`` (an expression over ``day``) from the
    daily bitmaps alone: bitmaps are merged per block, then counted."""
    merged = daily.groupBy(period.alias(name), "block").agg(F.bitmap_or_agg("buyers").alias("buyers"))
    return merged.groupBy(name).agg(F.sum(F.bitmap_count("buyers")).alias("buyers"))
