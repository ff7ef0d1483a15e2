"""State-changing procedures re-aimed as batch command-table operators (§2.J).

Each operator takes the base tables and a DataFrame of commands (one row per
call of the source procedure) and returns a ``dict`` of frames: per-command
outcomes (ok, error), the changed rows of the affected tables, and the derived
ledger, audit and notification rows.  The guards run in the source's order.

Batch semantics: commands apply in ``(requested_at, cmd_id)`` order.  Effects
that depend on earlier commands of the same key use partial aggregates
(``min``/``max_by`` of a struct, map-side combined) or the range-bucketed
running operators of ``plans.prefix`` - never a list collected per key.
Money effects of different wallets are independent, so an order touching a
buyer and a seller is exploded into one delta per wallet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escrowlens.functions.labels import ORDER_STATUSES, REFUNDABLE_STATUSES, ROLES
from escrowlens.functions.money import (RATE_TYPE, parse_rate, percent_label, rate_error,
                                        seller_fee, thousands)
from escrowlens.operators.catalog import rate_setting
from escrowlens.plans.fold import ordered_guarded_fold
from escrowlens.plans.joins import growing, one_row
from escrowlens.plans.prefix import RANGE, previous_value, running_clamped, running_sum

Tables = dict[str, DataFrame]
ORDER = ["requested_at", "cmd_id"]

# Fixed values of the source system: refusal messages, ledger descriptions and
# notification texts, exactly as the procedures write them.
ERR_NOT_ADMIN = "Tidak punya akses admin."
ERR_ORDER_NOT_FOUND_SETTLE = "Order tidak ditemukan"
ERR_NO_ADMIN_WALLET = "admin_wallet belum ada row sama sekali."
ERR_SETTLE_PREFIX = "Gagal proses komisi: "
ERR_CONFIRM = "Pesanan tidak ditemukan atau belum berstatus delivered."
ERR_ORDER_NOT_FOUND = "Pesanan tidak ditemukan."
ERR_NOT_REFUNDABLE = "Status pesanan tidak bisa direfund ("
ERR_USER_NOT_FOUND = "Pengguna tidak ditemukan."
ERR_BAD_ROLE = "Role tidak valid."
ERR_PRODUCT_NOT_FOUND = "Produk tidak ditemukan."
ERR_UNAUTHENTICATED = "Tidak terautentikasi."
ERR_SELF_CHAT = "Tidak bisa membuat percakapan dengan diri sendiri."
ERR_ZERO_AMOUNT = "Jumlah tidak boleh nol."
ERR_NO_REASON = "Alasan wajib diisi untuk audit."
ERR_NO_WALLET = "Dompet pengguna tidak ditemukan."
ERR_BAD_STATUS = ('invalid input value for enum order_status: "', '"')
# A null amount makes the balance null, which the wallets table refuses.
ERR_NULL_AMOUNT = 'null value in column "balance" of relation "wallets" violates not-null constraint'
# The wallets table constraint (balance >= 0) fires before the procedure's own
# negative-balance test, so a refused debit reports the constraint.
ERR_NEGATIVE = 'new row for relation "wallets" violates check constraint "wallets_balance_check"'
# Ledger descriptions (text before the variable part).
DESC_SALE = ("Penjualan order #", " (komisi ", "%)")
DESC_RELEASE = "Dana rekber cair — "
DESC_REFUND = "Refund admin - "
DESC_REFUND_V1 = "Refund admin — "
DESC_ADJUST = "Penyesuaian admin — "
# Notification titles and body pieces.
TITLE_RELEASED = "✅ Dana rekber cair!"
BODY_RELEASED = ('Pembeli konfirmasi terima pesanan "', '". Dana Rp ',
                 " sudah masuk ke saldo kamu.")
TITLE_COMPLETED = "🎉 Pesanan selesai!"
BODY_COMPLETED = ('Pesanan "', '" sudah kamu konfirmasi selesai.')
TITLE_REFUND_BUYER = "Dana Dikembalikan"
BODY_REFUND_BUYER = ('Pesanan "', '" direfund oleh admin.')
TITLE_REFUND_SELLER = "Pesanan Direfund Admin"
BODY_REFUND_SELLER = ('Pesanan "', '" direfund ke pembeli oleh admin.')
TITLE_REFUND_BUYER_V1 = "💸 Dana Dikembalikan"
TITLE_REFUND_SELLER_V1 = "⚠️ Pesanan Direfund Admin"
ERR_NO_LEDGER_WALLET = ('null value in column "wallet_id" of relation "wallet_transactions" '
                        "violates not-null constraint")
REASON_NOTE = " Alasan: "
TITLE_TOPUP = "💰 Saldo Ditambahkan"
TITLE_DEBIT = "⚠️ Saldo Dikurangi"
BODY_ADJUST = ("Saldo kamu disesuaikan admin sebesar Rp ", ". Alasan: ")
TITLE_SUSPENDED = "⚠️ Akun Disuspend"
BODY_SUSPENDED = "Akun kamu disuspend oleh admin."


class Outputs(dict):
    """The frames an operator returns, each built on first access."""

    def __init__(self, **builders):
        super().__init__()
        self._builders = builders

    def __missing__(self, name: str) -> DataFrame:
        df = self._builders[name]()
        self[name] = df
        return df

    def keys(self):
        return self._builders.keys()


def _split():
    """Bucket for the two-level running operators: balanced range buckets, so
    a hot seller or wallet (even on one day) is split across tasks."""
    return RANGE


def _json(**fields) -> Column:
    """``json_build_object`` equivalent: nulls kept, compact text."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]),
                     {"ignoreNullFields": "false"})


ACTOR_SALTS = 32


def _with_admin(cmds: DataFrame, t: Tables) -> DataFrame:
    """Commands with ``is_admin``.

    A batch may name one actor throughout.  The admins are few, so the join is
    a broadcast whenever their measured size allows; beyond it, they are
    repeated for every salt and the commands of one actor go to as many tasks.
    """
    admins = t["profiles"].filter(F.col("role") == "admin").select(
        F.col("id").alias("actor_id"), F.lit(True).alias("_admin"),
        F.explode(F.sequence(F.lit(0), F.lit(ACTOR_SALTS - 1))).alias("_salt"))
    salted = cmds.withColumn("_salt", F.pmod(F.xxhash64(*cmds.columns), F.lit(ACTOR_SALTS)).cast("int"))
    return salted.join(admins, ["actor_id", "_salt"], "left").withColumn(
        "is_admin", F.coalesce("_admin", F.lit(False))).drop("_admin", "_salt")


def _first_per(df: DataFrame, key: str, cond: Column | None = None, out: str = "is_first"
               ) -> DataFrame:
    """Flag the first row (in ORDER) per key among rows meeting ``cond``.

    ``min(struct)`` is a partial aggregate, so a hot key costs one combined
    value per map task rather than a window over all its rows.
    """
    d = df if cond is None else df.filter(cond)
    first = d.groupBy(key).agg(F.min(F.struct(*ORDER)).alias("_first"))
    j = df.join(first, key, "left")
    hit = F.struct(*ORDER) == F.col("_first")
    if cond is not None:
        hit = hit & cond
    return j.withColumn(out, F.coalesce(hit, F.lit(False))).drop("_first")


def _audit(df: DataFrame, action: Column, target_type: str, target: str, detail: Column
           ) -> DataFrame:
    return df.select(F.col("actor_id").alias("admin_id"), action.alias("action"),
                     F.lit(target_type).alias("target_type"),
                     F.col(target).cast("string").alias("target_id"),
                     detail.alias("detail"), F.col("requested_at").alias("created_at"),
                     F.col("cmd_id").alias("source_cmd"))


def _notice(df: DataFrame, user: Column, title: Column, body: Column, kind: str,
            ref: Column | None = None) -> DataFrame:
    return df.select(user.alias("user_id"), title.alias("title"), body.alias("body"),
                     F.lit(kind).alias("type"),
                     (ref if ref is not None else F.lit(None).cast("string"))
                     .alias("ref_order_id"),
                     F.col("requested_at").alias("created_at"),
                     F.col("cmd_id").alias("source_cmd"))


def _wallet_id(user: Column, existing: Column) -> Column:
    """Existing wallet id, else the id of the wallet created on demand."""
    return F.coalesce(existing, F.concat(F.lit("W-"), user))


# ---------------------------------------------------------------- J4 settle


def settle_commission(t: Tables, commands: DataFrame) -> dict[str, DataFrame]:
    """Settle commission for completed orders (idempotent per order).

    commands: cmd_id, order_id, requested_at.  fee = floor(total * rate) with
    the rate from settings, all its digits; a missing setting means 0.05, one
    that is no rate refuses every command.  The seller is the product's.  An
    order already settled, or settled by an earlier command of the batch, is
    reported ok but not credited again (``applied`` = false).  The fees go to
    the oldest admin wallet row.  ``commission`` is the whole table afterwards,
    ``commission_changes`` its new and changed rows.
    """
    rate = rate_setting(t).select(parse_rate("value").alias("rate"),
                                  rate_error("value").alias("_rate_error"))
    aw = t["admin_wallet"].agg(F.count(F.lit(1)).alias("_n_aw"))
    o = t["orders"].select(F.col("id").alias("order_id"), "total_amount", "product_id")
    p = t["products"].select(F.col("id").alias("product_id"),
                             F.col("seller_id").alias("p_seller"))
    settled = t["platform_commission"].filter(F.col("status") == "settled") \
        .select("order_id", F.lit(True).alias("_already"))
    # Whether a command can succeed depends on its order and the settings only,
    # so the first command of an order is found on the commands alone.  All
    # order-id joins come first, directly on the scans (orders and commission
    # share a bucketed layout, and commands projected from orders keep it); the
    # one-row settings come after, so they do not hide that layout.  An order
    # whose product is gone keeps p_seller null -> "not found".
    c = _first_per(commands, "order_id").join(o, "order_id", "left") \
        .join(settled, "order_id", "left").crossJoin(F.broadcast(one_row(rate, aw)))
    # Orders without a product meet nothing: a key of their own spreads them.
    c = c.withColumn("_product", F.coalesce("product_id", -F.abs(F.xxhash64("order_id")) - 1))
    c = c.join(growing(p.withColumnRenamed("product_id", "_product")), "_product", "left").drop("_product") \
        .withColumn("p_seller", F.when(F.col("product_id").isNotNull(), F.col("p_seller")))
    err = (F.when(F.col("_rate_error").isNotNull(), F.col("_rate_error"))
           .when(F.col("p_seller").isNull(), F.lit(ERR_ORDER_NOT_FOUND_SETTLE))
           .when(F.col("_n_aw") == 0, F.lit(ERR_NO_ADMIN_WALLET)))
    c = c.withColumn("error", err).withColumn("ok", F.col("error").isNull())
    fee = seller_fee("total_amount", "rate")
    c = c.withColumn("fee", F.when(F.col("ok"), fee)) \
         .withColumn("seller_net", F.col("total_amount") - F.col("fee")) \
         .withColumn("applied", F.col("ok") & F.col("is_first")
                     & ~F.coalesce("_already", F.lit(False)))
    outcomes = c.select("cmd_id", "order_id", "ok", "error",
                        F.when(F.col("ok"), F.col("total_amount")).alias("gross"),
                        "fee", "seller_net", "applied")

    # An order without a product is refused: its rows need not meet the products.
    applied = c.filter(F.col("applied") & F.col("product_id").isNotNull())
    w = t["wallets"].select(F.col("user_id").alias("p_seller"), F.col("id").alias("_wid"),
                            F.col("balance").alias("_bal0"))
    wallet = _wallet_id(F.col("p_seller"), F.col("_wid")).alias("wallet_id")
    before = F.coalesce("_bal0", F.lit(0).cast("bigint"))

    def ledger():
        # The wallets meet the sellers' sums, not the sales.  Where a seller has several
        # wallets, each sale is credited to each in turn.
        of = Window.partitionBy("p_seller")
        owned = w.filter(F.col("p_seller").isNotNull()).withColumns(
            {"_n": F.count(F.lit(1)).over(of), "_nth": F.row_number().over(of.orderBy("_wid", "_bal0"))})
        sales = applied.select("p_seller", "order_id", *ORDER, "seller_net", "rate")
        r = running_sum(sales, "p_seller", ORDER, "seller_net", "_run", bucket=_split(), per_key=owned)
        net = F.coalesce("seller_net", F.lit(0).cast("bigint"))  # no amount, no credit
        run = (F.col("_run") - net) * F.coalesce("_n", F.lit(1)) + net * F.coalesce("_nth", F.lit(1))
        return r.select(
            wallet, F.lit("escrow_release").alias("type"),
            F.col("seller_net").alias("amount"),
            (before + run).alias("balance_after"),
            F.concat(F.lit(DESC_SALE[0]), F.left(F.col("order_id"), F.lit(8)),
                     F.lit(DESC_SALE[1]), percent_label(F.col("rate")).cast("string"),
                     F.lit(DESC_SALE[2])).alias("description"),
            F.col("order_id").alias("ref_order_id"), F.col("requested_at").alias("created_at"),
            F.col("cmd_id").alias("source_cmd"))

    def wallets():
        sums = applied.groupBy("p_seller").agg(F.sum("seller_net").alias("_net"))
        return sums.join(w, "p_seller", "left").groupBy(F.col("p_seller").alias("user_id"), wallet).agg(
            F.first(before).alias("balance_before"),
            F.sum("_net").alias("credited")).withColumn(
            "balance_after", F.col("balance_before") + F.col("credited"))

    def commission(how="full"):
        new = applied.select("order_id", F.col("total_amount").alias("_gross"), F.col("rate").alias("_rate"),
                             F.col("fee").alias("_fee"), F.col("seller_net").alias("_net"),
                             F.col("requested_at").alias("_at"))
        both = t["platform_commission"].join(new, "order_id", how)
        fresh = F.col("_at").isNotNull()
        return both.select(
            F.coalesce("id", F.concat(F.lit("PC-"), "order_id")).alias("id"), "order_id",
            F.coalesce("gross_amount", "_gross").alias("gross_amount"),
            F.coalesce("rate", F.col("_rate").cast(RATE_TYPE)).cast(RATE_TYPE).alias("rate"),
            F.when(fresh, F.col("_fee")).otherwise(F.col("fee_amount")).alias("fee_amount"),
            F.when(fresh, F.col("_net")).otherwise(F.col("seller_net")).alias("seller_net"),
            F.when(fresh, F.lit("settled")).otherwise(F.col("status")).alias("status"),
            F.when(fresh, F.col("_at")).otherwise(F.col("settled_at")).alias("settled_at"),
            F.when(F.col("id").isNull(), F.col("_at")).otherwise(F.col("created_at"))
            .alias("created_at"))

    def admin_wallet():
        fees = applied.agg(F.sum("fee").alias("_fees"), F.max("requested_at").alias("_at"))
        oldest = t["admin_wallet"].agg(F.min_by("id", F.struct(
            F.col("created_at").isNull().alias("n"), "created_at", "id")).alias("_oldest"))
        hit = (F.col("id") == F.col("_oldest")) & F.col("_fees").isNotNull()
        return t["admin_wallet"].crossJoin(F.broadcast(one_row(fees, oldest))).select(
            "id", F.when(hit, F.col("balance") + F.col("_fees")).otherwise(F.col("balance")).alias("balance"),
            "created_at", F.when(hit, F.col("_at")).otherwise(F.col("updated_at")).alias("updated_at"))

    def orders():
        return applied.select("order_id", F.col("fee").alias("platform_fee"),
                              F.col("rate").cast(RATE_TYPE).alias("commission_rate"),
                              F.col("seller_net").alias("seller_payout"))

    return Outputs(outcomes=lambda: outcomes, ledger=ledger, wallets=wallets,
                   commission=commission, commission_changes=lambda: commission("right"),
                   admin_wallet=admin_wallet, orders=orders)


# ---------------------------------------------------------------- J5 status


def _bad_status() -> Column:
    """Refusal of a status outside the domain (null inside it)."""
    text = F.coalesce("new_status", F.lit(""))
    return F.when(~F.coalesce(F.col("new_status").isin(*ORDER_STATUSES), F.lit(False)),
                  F.concat(F.lit(ERR_BAD_STATUS[0]), text, F.lit(ERR_BAD_STATUS[1])))


def apply_status(t: Tables, commands: DataFrame) -> dict[str, DataFrame]:
    """Admin status changes (current version): a change to 'completed' settles
    commission first and is refused, status unchanged, when settlement fails.

    commands: cmd_id, order_id, new_status, note, actor_id, requested_at.  The
    rate setting is read before anything is changed, so one that is no rate
    refuses every command.  The settlement's ledger rows, wallets, commission
    table, admin wallet and order fees come with the status changes.
    """
    rate = rate_setting(t).select(rate_error("value").alias("_rate_error"))
    c = _with_admin(commands, t).crossJoin(F.broadcast(rate))  # one row
    to_settle = c.filter(F.col("is_admin") & (F.col("new_status") == "completed")) \
        .select("cmd_id", "order_id", "requested_at")
    s = settle_commission(t, to_settle)
    so = s["outcomes"].select("cmd_id", F.col("ok").alias("_sok"), F.col("error").alias("_serr"))
    c = c.join(so, "cmd_id", "left")
    err = (F.when(~F.col("is_admin"), F.lit(ERR_NOT_ADMIN))
           .when(F.col("_rate_error").isNotNull(), F.col("_rate_error"))
           .when(_bad_status().isNotNull(), _bad_status())
           .when((F.col("new_status") == "completed") & ~F.coalesce("_sok", F.lit(False)),
                 F.concat(F.lit(ERR_SETTLE_PREFIX), F.coalesce("_serr", F.lit("")))))
    c = c.withColumn("error", err).withColumn("ok", F.col("error").isNull())
    outcomes = c.select("cmd_id", "order_id", "new_status", "ok", "error")
    okc = c.filter("ok")
    last = okc.groupBy("order_id").agg(
        F.max_by("new_status", F.struct(*ORDER)).alias("status"))
    orders_after = t["orders"].select(F.col("id").alias("order_id"),
                                      F.col("status").alias("old_status")) \
        .join(last, "order_id")
    audit = _audit(okc, F.lit("update_order_status"), "order", "order_id",
                   _json(new_status=F.col("new_status"), note=F.col("note")))
    return Outputs(outcomes=lambda: outcomes, orders=lambda: orders_after,
                   audit=lambda: audit, settlement=lambda: s["outcomes"],
                   ledger=lambda: s["ledger"], wallets=lambda: s["wallets"],
                   commission=lambda: s["commission"], admin_wallet=lambda: s["admin_wallet"],
                   order_fees=lambda: s["orders"])


def apply_status_v1(t: Tables, commands: DataFrame) -> dict[str, DataFrame]:
    """Admin status changes, first version: no settlement; the status is forced,
    the note replaces the delivery note when given, and delivered_at /
    completed_at are stamped with the command time.  The audit keeps from/to.

    commands: cmd_id, order_id, new_status, note, actor_id, requested_at.
    """
    o = t["orders"].select(F.col("id").alias("order_id"), F.col("status").alias("_old0"),
                           F.col("delivery_note").alias("_note0"),
                           F.col("delivered_at").alias("_del0"),
                           F.col("completed_at").alias("_comp0"))
    c = _with_admin(commands.join(o, "order_id", "left"), t)
    err = (F.when(_bad_status().isNotNull(), _bad_status())
           .when(~F.col("is_admin"), F.lit(ERR_NOT_ADMIN))
           .when(F.col("_old0").isNull(), F.lit(ERR_ORDER_NOT_FOUND)))
    c = c.withColumn("error", err).withColumn("ok", F.col("error").isNull())
    okc = previous_value(c.filter("ok"), "order_id", ORDER, "new_status", "_prev",
                         bucket=_split())
    okc = okc.withColumn("from_status", F.coalesce("_prev", "_old0"))
    outcomes = c.filter(~F.col("ok")).select(
        "cmd_id", "order_id", "ok", "error", F.lit(None).cast("string").alias("from_status"),
        F.lit(None).cast("string").alias("to_status")).unionByName(
        okc.select("cmd_id", "order_id", "ok", "error", "from_status",
                   F.col("new_status").alias("to_status")))
    order = F.struct(*ORDER)
    fin = okc.groupBy("order_id").agg(
        F.max_by("new_status", order).alias("status"),
        F.max_by("note", F.when(F.col("note").isNotNull(), order)).alias("_note"),
        F.max(F.when(F.col("new_status") == "delivered", F.col("requested_at"))).alias("_d"),
        F.max(F.when(F.col("new_status") == "completed", F.col("requested_at"))).alias("_c"),
        F.first("_note0").alias("_note0"), F.first("_del0").alias("_del0"),
        F.first("_comp0").alias("_comp0"))
    orders_after = fin.select("order_id", "status",
                              F.coalesce("_note", "_note0").alias("delivery_note"),
                              F.coalesce("_d", "_del0").alias("delivered_at"),
                              F.coalesce("_c", "_comp0").alias("completed_at"))
    audit = _audit(okc, F.lit("update_order_status"), "order", "order_id",
                   _json(**{"from": F.col("from_status"), "to": F.col("new_status"),
                            "note": F.col("note")}))
    return {"outcomes": outcomes, "orders": orders_after, "audit": audit}


# ---------------------------------------------------------------- J6 confirm


def confirm_orders(t: Tables, commands: DataFrame) -> dict[str, DataFrame]:
    """Buyer confirms receipt: delivered -> completed, escrow released to seller.

    commands: cmd_id, order_id, caller_id, requested_at.  Only the buyer of a
    delivered order may confirm; a second confirmation of the same order in
    the batch finds it completed.  The seller's balance and total_in grow by
    seller_receives; escrow_hold drops by the total, floored at zero at every
    step.  A seller without a wallet gets no ledger row (the source updated
    and selected by user id).
    """
    o = t["orders"].select(F.col("id").alias("order_id"), "buyer_id", "seller_id", "status",
                           "total_amount", "seller_receives", "product_title")
    c = commands.join(o, "order_id", "left")
    elig = F.coalesce((F.col("status") == "delivered")
                      & (F.col("buyer_id") == F.col("caller_id")), F.lit(False))
    c = _first_per(c, "order_id", elig, "ok")
    c = c.withColumn("error", F.when(~F.col("ok"), F.lit(ERR_CONFIRM)))
    outcomes = c.select("cmd_id", "order_id", "caller_id", "ok", "error")
    okc = c.filter("ok")
    w = t["wallets"].select(F.col("user_id").alias("seller_id"), F.col("id").alias("wallet_id"),
                            F.col("balance").alias("_bal0"), F.col("escrow_hold").alias("_esc0"),
                            F.col("total_in").alias("_in0"))
    a = okc.join(w, "seller_id").withColumn("_neg_total", -F.col("total_amount"))

    def ledger():
        r = running_sum(a, "seller_id", ORDER, "seller_receives", "_run", bucket=_split())
        return r.select("wallet_id", F.lit("escrow_release").alias("type"),
                        F.col("seller_receives").alias("amount"),
                        (F.col("_bal0") + F.col("_run")).alias("balance_after"),
                        F.concat(F.lit(DESC_RELEASE), "product_title")
                        .alias("description"),
                        F.col("order_id").alias("ref_order_id"),
                        F.col("requested_at").alias("created_at"),
                        F.col("cmd_id").alias("source_cmd"))

    def wallets():
        # Balance and total_in only add up; only the escrow floor needs order.
        r = running_clamped(a, "seller_id", ORDER, "_neg_total", "escrow_after",
                            start=F.col("_esc0"), bucket=_split())
        return r.groupBy(F.col("seller_id").alias("user_id"), "wallet_id").agg(
            (F.first("_bal0") + F.sum("seller_receives")).alias("balance"),
            F.max_by("escrow_after", F.struct(*ORDER)).alias("escrow_hold"),
            (F.first("_in0") + F.sum("seller_receives")).alias("total_in"))
    seller_n = _notice(okc, F.col("seller_id"), F.lit(TITLE_RELEASED),
                       F.concat(F.lit(BODY_RELEASED[0]), "product_title",
                                F.lit(BODY_RELEASED[1]), thousands("seller_receives"),
                                F.lit(BODY_RELEASED[2])),
                       "success", F.col("order_id"))
    buyer_n = _notice(okc, F.col("buyer_id"), F.lit(TITLE_COMPLETED),
                      F.concat(F.lit(BODY_COMPLETED[0]), "product_title",
                               F.lit(BODY_COMPLETED[1])),
                      "success", F.col("order_id"))
    orders_after = okc.select("order_id", F.lit("completed").alias("status"),
                              F.col("requested_at").alias("completed_at"))
    return Outputs(outcomes=lambda: outcomes, ledger=ledger, wallets=wallets,
                   notifications=lambda: seller_n.unionByName(buyer_n),
                   orders=lambda: orders_after)


# ---------------------------------------------------------------- J7 refund


def refund_orders(t: Tables, commands: DataFrame, first_version: bool = False
                  ) -> dict[str, DataFrame]:
    """Admin force refund (current version).

    ``first_version`` refunds as the first version did: other texts, and no
    wallet is created - a buyer without one makes the ledger insert fail, which
    refuses the command, and a seller without one keeps none.

    commands: cmd_id, order_id, reason, actor_id, requested_at.  Guards:
    admin, order exists, status refundable (a second refund in the batch sees
    'refunded').  Buyer and seller wallets are created on demand; the seller's
    escrow drops by the total (floored at zero), the buyer's balance and
    total_in grow by it.
    """
    o = t["orders"].select(F.col("id").alias("order_id"), "buyer_id", "seller_id", "status",
                           "total_amount", "product_title")
    # Which command of an order comes first among those of admins is known from
    # the commands; whether it can be refunded, from the order.
    c = _first_per(_with_admin(commands, t), "order_id", F.col("is_admin"))
    c = c.join(o, "order_id", "left")
    found = F.col("buyer_id").isNotNull()
    refundable = F.col("status").isin(*REFUNDABLE_STATUSES)
    err = (F.when(~F.col("is_admin"), F.lit(ERR_NOT_ADMIN))
           .when(~found, F.lit(ERR_ORDER_NOT_FOUND))
           .when(~refundable, F.concat(F.lit(ERR_NOT_REFUNDABLE), "status", F.lit(").")))
           )
    if first_version:
        owners = t["wallets"].select(F.col("user_id").alias("buyer_id"), F.lit(True).alias("_owns"))
        c = c.join(owners, "buyer_id", "left")
        err = err.when(F.col("_owns").isNull(), F.lit(ERR_NO_LEDGER_WALLET))
    c = c.withColumn("error", err.when(~F.col("is_first"), F.lit(ERR_NOT_REFUNDABLE + "refunded).")))
    c = c.withColumn("ok", F.col("error").isNull())
    outcomes = c.select("cmd_id", "order_id", "ok", "error")
    okc = c.filter("ok")
    wl = t["wallets"].select(F.col("user_id"), F.col("id").alias("_wid"),
                             F.col("balance").alias("_bal0"), F.col("escrow_hold").alias("_esc0"),
                             F.col("total_in").alias("_in0"))
    description = DESC_REFUND_V1 if first_version else DESC_REFUND
    titles = ((TITLE_REFUND_BUYER_V1, TITLE_REFUND_SELLER_V1) if first_version
              else (TITLE_REFUND_BUYER, TITLE_REFUND_SELLER))
    zero = F.lit(0).cast("bigint")
    # Buyer side: balance and total_in grow.
    b = okc.withColumnRenamed("buyer_id", "user_id").join(wl, "user_id", "left")
    b = b.withColumn("wallet_id", _wallet_id(F.col("user_id"), F.col("_wid"))) \
         .withColumn("_bal0", F.coalesce("_bal0", zero)).withColumn("_in0",
                                                                    F.coalesce("_in0", zero))
    reason_sfx = F.coalesce(F.concat(F.lit(" ("), "reason", F.lit(")")), F.lit(""))

    def ledger():
        r = running_sum(b, "user_id", ORDER, "total_amount", "_run", bucket=_split())
        return r.select("wallet_id", F.lit("refund").alias("type"),
                        F.col("total_amount").alias("amount"),
                        (F.col("_bal0") + F.col("_run")).alias("balance_after"),
                        F.concat(F.lit(description), "product_title", reason_sfx)
                        .alias("description"), F.col("order_id").alias("ref_order_id"),
                        F.col("requested_at").alias("created_at"),
                        F.col("cmd_id").alias("source_cmd"))

    def wallets():
        # Buyers: balance and total_in only add up (no order needed).
        buyers = b.groupBy("user_id", "wallet_id").agg(
            (F.first("_bal0") + F.sum("total_amount")).alias("balance"),
            (F.first("_in0") + F.sum("total_amount")).alias("total_in"))
        # Sellers: escrow released in order, floored at zero.
        s = okc.withColumnRenamed("seller_id", "user_id").join(
            wl, "user_id", "inner" if first_version else "left")
        s = s.withColumn("wallet_id", _wallet_id(F.col("user_id"), F.col("_wid"))) \
             .withColumn("_esc0", F.coalesce("_esc0", zero)) \
             .withColumn("_neg_total", -F.col("total_amount"))
        s = running_clamped(s, "user_id", ORDER, "_neg_total", "escrow_after",
                            start=F.col("_esc0"), bucket=_split())
        sellers = s.groupBy("user_id", "wallet_id").agg(
            F.max_by("escrow_after", F.struct(*ORDER)).alias("escrow_hold"))
        both = buyers.join(sellers, ["user_id", "wallet_id"], "full")
        cur = t["wallets"].select(F.col("user_id"), F.col("balance").alias("_b"),
                                  F.col("escrow_hold").alias("_e"),
                                  F.col("total_in").alias("_i"))
        return both.join(cur, "user_id", "left").select(
            "user_id", "wallet_id",
            F.coalesce("balance", "_b", zero).alias("balance"),
            F.coalesce("escrow_hold", "_e", zero).alias("escrow_hold"),
            F.coalesce("total_in", "_i", zero).alias("total_in"))

    reason_note = F.coalesce(F.concat(F.lit(REASON_NOTE), "reason"), F.lit(""))
    notes = _notice(okc, F.col("buyer_id"), F.lit(titles[0]),
                    F.concat(F.lit(BODY_REFUND_BUYER[0]), "product_title",
                             F.lit(BODY_REFUND_BUYER[1]), reason_note),
                    "info", F.col("order_id")).unionByName(
        _notice(okc, F.col("seller_id"), F.lit(titles[1]),
                F.concat(F.lit(BODY_REFUND_SELLER[0]), "product_title",
                         F.lit(BODY_REFUND_SELLER[1]), reason_note),
                "warning", F.col("order_id")))
    audit = _audit(okc, F.lit("force_refund"), "order", "order_id",
                   _json(amount=F.col("total_amount"), reason=F.col("reason")))
    orders_after = okc.select("order_id", F.lit("refunded").alias("status"))
    return Outputs(outcomes=lambda: outcomes, ledger=ledger, wallets=wallets,
                   notifications=lambda: notes, audit=lambda: audit,
                   orders=lambda: orders_after)


# ---------------------------------------------------------------- J8 adjust


def adjust_wallets(t: Tables, commands: DataFrame, create_missing: bool = True
                   ) -> dict[str, DataFrame]:
    """Admin balance adjustments applied in ``seq`` order per user.

    commands: seq, actor_id, user_id, amount (signed), reason, created_at.
    Refused: non-admin, zero amount, blank reason, or a result below zero
    (the balance >= 0 constraint); a refused command changes nothing and
    later ones see the unchanged balance.  A missing wallet is created on
    the first accepted command.
    """
    c = _with_admin(commands, t)
    w = t["wallets"].select("user_id", F.col("id").alias("_wid"),
                            F.col("balance").alias("start_balance"))
    c = c.join(w, "user_id", "left")
    pre = (F.when(~F.col("is_admin"), F.lit(ERR_NOT_ADMIN))
           .when(F.col("amount") == 0, F.lit(ERR_ZERO_AMOUNT))
           .when(F.col("reason").isNull() | (F.trim("reason") == ""), F.lit(ERR_NO_REASON)))
    if not create_missing:
        pre = pre.when(F.col("_wid").isNull(), F.lit(ERR_NO_WALLET))
    pre = pre.when(F.col("amount").isNull(), F.lit(ERR_NULL_AMOUNT))
    c = c.withColumn("pre_error", pre).withColumn(
        "start_balance", F.coalesce("start_balance", F.lit(0).cast("bigint")))
    c = c.withColumn("wallet_id", _wallet_id(F.col("user_id"), F.col("_wid"))).drop("_wid")
    f = ordered_guarded_fold(c, "user_id", ["seq"], refusal=ERR_NEGATIVE)
    acc = f.filter("ok")
    zero = F.lit(0).cast("bigint")

    def outcomes():
        return f.selectExpr("seq", "user_id", "amount", "ok", "error", "if(ok, new_balance, null) as new_balance")

    def final():
        moved = acc.groupBy("user_id", "wallet_id").agg(
            F.max_by("new_balance", "seq").alias("balance"),
            F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(zero)).alias("_in"),
            F.sum(F.when(F.col("amount") < 0, -F.col("amount")).otherwise(zero)).alias("_out"))
        old = t["wallets"].select("user_id", F.col("total_in").alias("_in0"),
                                  F.col("total_out").alias("_out0"))
        return moved.join(old, "user_id", "left").select(
            "user_id", "wallet_id", "balance", (F.coalesce("_in0", zero) + F.col("_in")).alias("total_in"),
            (F.coalesce("_out0", zero) + F.col("_out")).alias("total_out"))

    def accepted():
        return acc.withColumns({"requested_at": F.col("created_at"),
                                "cmd_id": F.concat(F.lit("AJ-"), F.col("seq").cast("string"))})

    def ledger():
        return accepted().select("wallet_id",
                                 F.when(F.col("amount") > 0, "topup").otherwise("withdrawal").alias("type"),
                                 F.abs("amount").alias("amount"), F.col("new_balance").alias("balance_after"),
                                 F.concat(F.lit(DESC_ADJUST), "reason").alias("description"),
                                 F.lit(None).cast("string").alias("ref_order_id"),
                                 F.col("requested_at").alias("created_at"),
                                 F.col("cmd_id").alias("source_cmd"))

    def audit():
        return _audit(accepted(), F.lit("adjust_wallet"), "wallet", "wallet_id",
                      _json(amount=F.col("amount"), reason=F.col("reason"), new_balance=F.col("new_balance")))

    def notes():
        return _notice(accepted(), F.col("user_id"),
                       F.when(F.col("amount") > 0, F.lit(TITLE_TOPUP)).otherwise(F.lit(TITLE_DEBIT)),
                       F.concat(F.lit(BODY_ADJUST[0]), thousands(F.abs("amount")),
                                F.lit(BODY_ADJUST[1]), "reason"),
                       "info")

    return Outputs(outcomes=outcomes, wallets=final, ledger=ledger, audit=audit, notifications=notes)


# ---------------------------------------------------------------- J9 suspend


def suspend_users(t: Tables, commands: DataFrame) -> dict[str, DataFrame]:
    """Suspend / unsuspend users.  commands: cmd_id, user_id, suspend, reason,
    actor_id, requested_at.  The audit keeps the flag each command found."""
    c = _with_admin(commands, t)
    p = t["profiles"].select(F.col("id").alias("user_id"),
                             F.col("is_suspended").alias("_flag0"), F.lit(True).alias("_found"))
    c = c.join(p, "user_id", "left")
    found = F.coalesce("_found", F.lit(False))
    c = c.withColumn("error", F.when(~F.col("is_admin"), F.lit(ERR_NOT_ADMIN))
                     .when(~found, F.lit(ERR_USER_NOT_FOUND))) \
         .withColumn("ok", F.col("error").isNull())
    okc = previous_value(c.filter("ok"), "user_id", ORDER, "suspend", "_prev", bucket=_split())
    okc = okc.withColumn("was_suspended", F.coalesce("_prev", "_flag0"))
    outcomes = c.filter(~F.col("ok")).select("cmd_id", "user_id", "ok", "error",
                                             F.lit(None).cast("boolean").alias("was_suspended"))
    outcomes = outcomes.unionByName(okc.select("cmd_id", "user_id", "ok", "error",
                                               "was_suspended"))
    last = okc.groupBy("user_id").agg(
        F.max_by(F.struct("suspend", "reason"), F.struct(*ORDER)).alias("_last"))
    profiles = last.select("user_id", F.col("_last.suspend").alias("is_suspended"),
                           F.when(F.col("_last.suspend"), F.col("_last.reason"))
                           .alias("suspended_reason"))
    audit = _audit(okc, F.when(F.col("suspend"), "suspend_user").otherwise("unsuspend_user"),
                   "user", "user_id",
                   _json(reason=F.col("reason"), was_suspended=F.col("was_suspended")))
    notes = _notice(okc.filter("suspend"), F.col("user_id"), F.lit(TITLE_SUSPENDED),
                    F.concat(F.lit(BODY_SUSPENDED),
                             F.coalesce(F.concat(F.lit(REASON_NOTE), "reason"), F.lit(""))),
                    "warning")
    return {"outcomes": outcomes, "profiles": profiles, "audit": audit, "notifications": notes}


# ---------------------------------------------------------------- J10 roles


def change_roles(t: Tables, commands: DataFrame) -> dict[str, DataFrame]:
    """Change user roles.  commands: cmd_id, user_id, new_role, actor_id,
    requested_at.  Role domain is checked before existence; the audit's
    'from' is the role left by the previous accepted command."""
    c = _with_admin(commands, t)
    p = t["profiles"].select(F.col("id").alias("user_id"), F.col("role").alias("_role0"))
    c = c.join(p, "user_id", "left")
    c = c.withColumn("error", F.when(~F.col("is_admin"), F.lit(ERR_NOT_ADMIN))
                     .when(~F.col("new_role").isin(*ROLES) | F.col("new_role").isNull(),
                           F.lit(ERR_BAD_ROLE))
                     .when(F.col("_role0").isNull(), F.lit(ERR_USER_NOT_FOUND))) \
         .withColumn("ok", F.col("error").isNull())
    okc = previous_value(c.filter("ok"), "user_id", ORDER, "new_role", "_prev", bucket=_split())
    okc = okc.withColumn("from_role", F.coalesce("_prev", "_role0"))
    outcomes = c.filter(~F.col("ok")).select(
        "cmd_id", "user_id", "ok", "error", F.lit(None).cast("string").alias("from_role"),
        F.lit(None).cast("string").alias("to_role")).unionByName(
        okc.select("cmd_id", "user_id", "ok", "error", "from_role",
                   F.col("new_role").alias("to_role")))
    roles = okc.groupBy("user_id").agg(F.max_by("new_role", F.struct(*ORDER)).alias("role"))
    audit = _audit(okc, F.lit("change_role"), "user", "user_id",
                   _json(**{"from": F.col("from_role"), "to": F.col("new_role")}))
    return {"outcomes": outcomes, "profiles": roles, "audit": audit}


# ---------------------------------------------------------------- J11 toggle


def toggle_products(t: Tables, commands: DataFrame) -> dict[str, DataFrame]:
    """Activate / deactivate products.  commands: cmd_id, product_id, active,
    reason, actor_id, requested_at."""
    c = _with_admin(commands, t)
    p = t["products"].select(F.col("id").alias("product_id"), F.lit(True).alias("_found"))
    c = c.join(p, "product_id", "left")
    c = c.withColumn("error", F.when(~F.col("is_admin"), F.lit(ERR_NOT_ADMIN))
                     .when(F.col("_found").isNull(), F.lit(ERR_PRODUCT_NOT_FOUND))) \
         .withColumn("ok", F.col("error").isNull())
    outcomes = c.select("cmd_id", "product_id", "active", "ok", "error")
    okc = c.filter("ok")
    products = okc.groupBy(F.col("product_id").alias("id")).agg(
        F.max_by("active", F.struct(*ORDER)).alias("is_active"))
    audit = _audit(okc, F.when(F.col("active"), "activate_product")
                   .otherwise("deactivate_product"), "product", "product_id",
                   _json(reason=F.col("reason")))
    return {"outcomes": outcomes, "products": products, "audit": audit}


# ---------------------------------------------------------------- J12 pairs


def conversation_pairs(t: Tables, requests: DataFrame) -> dict[str, DataFrame]:
    """Get-or-create conversations for a batch of (me, other, product) requests.

    One conversation per unordered pair; a request with a product sets the
    conversation's product context (the last such request wins); requests
    without one keep the existing context.
    """
    r = requests.withColumn(
        "error", F.when(F.col("me_id").isNull(), F.lit(ERR_UNAUTHENTICATED))
        .when(F.col("me_id") == F.col("other_id"), F.lit(ERR_SELF_CHAT))) \
        .withColumn("ok", F.col("error").isNull()) \
        .withColumn("user_a_id", F.least("me_id", "other_id")) \
        .withColumn("user_b_id", F.greatest("me_id", "other_id"))
    order = F.struct("requested_at", "req_id")
    okr = r.filter("ok")
    pairs = okr.groupBy("user_a_id", "user_b_id").agg(
        F.max_by("product_id", F.when(F.col("product_id").isNotNull(), order))
        .alias("_req_product"),
        F.min(order).alias("_first"))
    ex = t["conversations"].select("user_a_id", "user_b_id", F.col("id").alias("_cid"),
                                   F.col("product_id").alias("_old_product"))
    pairs = pairs.join(ex, ["user_a_id", "user_b_id"], "left").select(
        F.coalesce("_cid", F.concat_ws("-", F.lit("C"), "user_a_id", "user_b_id"))
        .alias("conversation_id"), "user_a_id", "user_b_id",
        F.coalesce("_req_product", "_old_product").alias("product_id"),
        F.col("_cid").isNull().alias("created"))
    outcomes = r.join(pairs.select("user_a_id", "user_b_id", "conversation_id"),
                      ["user_a_id", "user_b_id"], "left").select(
        "req_id", "ok", "error",
        F.when(F.col("ok"), F.col("conversation_id")).alias("conversation_id"))
    return {"outcomes": outcomes, "conversations": pairs}


# ---------------------------------------------------------------- J2 / J3 / A-series


def profiles_from_signups(signups: DataFrame) -> DataFrame:
    """New account -> profile: name from metadata, else the e-mail's local part;
    role from metadata, else buyer."""
    meta = F.col("raw_user_meta_data")
    return signups.select(
        F.col("account_id").alias("id"),
        F.coalesce(F.get_json_object(meta, "$.full_name"),
                   F.split_part(F.col("email"), F.lit("@"), F.lit(1))).alias("full_name"),
        F.coalesce(F.get_json_object(meta, "$.role"), F.lit("pembeli")).alias("role"),
        F.lit(False).alias("is_suspended"), "created_at")


def wallets_ensure(t: Tables) -> DataFrame:
    """Every profile gets a wallet: existing ones kept, empty ones added."""
    w = t["wallets"]
    missing = t["profiles"].select(F.col("id").alias("user_id")).join(
        w.select("user_id"), "user_id", "left_anti")
    zero = F.lit(0).cast("bigint")
    new = missing.select(F.concat(F.lit("W-"), "user_id").alias("id"), "user_id",
                         zero.alias("balance"), zero.alias("escrow_hold"),
                         zero.alias("total_in"), zero.alias("total_out"))
    return w.select(*new.columns).unionByName(new)


def admin_wallet_seed(t: Tables) -> DataFrame:
    """The admin wallet table after 'seed one zero row only if empty'."""
    aw = t["admin_wallet"]
    n = F.broadcast(aw.agg(F.count(F.lit(1)).alias("_n")))
    seed = n.filter(F.col("_n") == 0).select(
        F.lit("AW-seed").alias("id"), F.lit(0).cast("bigint").alias("balance"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    return aw.select(*seed.columns).unionByName(seed)


def messages_clean(t: Tables) -> DataFrame:
    """Message inserts: body trimmed, blank bodies skipped."""
    m = t["messages"].withColumn("body", F.trim("body"))
    return m.filter(F.col("body") != "")


def suspended_accounts(t: Tables) -> DataFrame:
    """Login gate as a report: suspended accounts are refused; others land by role."""
    from escrowlens.functions.labels import landing_page
    p = t["profiles"]
    return p.select("id", "role", "is_suspended",
                    F.when(F.col("is_suspended"), F.lit(None).cast("string"))
                    .otherwise(landing_page("role")).alias("landing"))


def promote_by_email(t: Tables, commands: DataFrame) -> DataFrame:
    """Promote accounts to admin by login e-mail (commands: cmd_id, email).
    Returns the changed profiles with their previous role."""
    acc = t["accounts"].select(F.col("id").alias("user_id"), "email")
    hit = commands.join(acc, "email").select("user_id").distinct()
    p = t["profiles"].select(F.col("id").alias("user_id"), F.col("role").alias("old_role"))
    return p.join(hit, "user_id", "left_semi").withColumn("role", F.lit("admin"))
