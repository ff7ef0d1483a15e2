"""Marketplace tables derived from the driver's Parquet tables.

This module only supplies input rows in the marketplace schema (the mapping
written down in FIXTURES.md §2); it does none of the operators' work.  On a
real deployment the marketplace tables are the base tables and this module is
replaced by plain ``spark.read`` calls.

``load_marketplace`` materialises a mapped table when it is first used, once per
session and source folder, as Parquet under the session's checkpoint folder, so
every operator starts from a written table (short lineage, survives executor loss)
instead of re-running the fixture joins, and a job writes only the tables that it
reads.  ``orders`` and
``platform_commission`` are written as bucketed, sorted external tables on the
order id (same bucket count), so joins on the order id read co-located
buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from escrowlens.functions.labels import GAME_SUBCATEGORIES
from escrowlens.functions.money import DEFAULT_COMMISSION_RATE, RATE_TYPE, cents, seller_fee
from escrowlens.session import scratch_path
from escrowlens.sources.driver import read_table

MARKET_TABLES = ["orders", "profiles", "accounts", "wallets", "products", "reviews",
                 "platform_commission", "app_settings", "admin_wallet", "conversations",
                 "messages", "forum_messages", "wallet_transactions", "admin_logs",
                 "wallet_commands", "status_events", "events", "order_events"]

BASE_DAY = "2001-01-01 00:00:00"
CHAT_DAY = "2024-01-01 00:00:00"
ADMIN_CUSTOMERS = (0, 1)
NO_WALLET_MOD, NO_WALLET_REM = 50, 49
NO_USERNAME_MOD = 7
DELETED_PRODUCT_LINE = 7
ADMIN_ACTIONS = [("suspend_user", "user"), ("change_role", "user"),
                 ("update_order_status", "order"), ("force_refund", "order"),
                 ("adjust_wallet", "wallet"), ("deactivate_product", "product")]

_cache: dict[tuple, MarketPaths] = {}
_frames: dict[tuple, dict[str, DataFrame]] = {}

# Storage layout: tables joined on the order id are bucketed (hash on the
# order id, same bucket count) and sorted, so those joins read co-located
# buckets instead of shuffling both sides.
CO_LOCATED = {"orders": "id", "platform_commission": "order_id"}


def _s(x) -> F.Column:
    return F.col(x).cast("string") if isinstance(x, str) else x.cast("string")


def _null(t: str) -> F.Column:
    return F.lit(None).cast(t)


def _ts(text: str) -> F.Column:
    return F.lit(text).cast("timestamp_ntz")


def _count_frame(df: DataFrame, name: str) -> DataFrame:
    """A one-row frame holding a row count (broadcast-safe by construction)."""
    return F.broadcast(df.agg(F.count(F.lit(1)).alias(name)))


STATUSES = ["completed", "delivered", "processing", "paid", "pending_payment", "cancelled",
            "refunded", "disputed"]


def order_status(o_status, finished, rflag) -> F.Column:
    """The number in ``STATUSES`` of an order's status: a number travels lighter than its name."""
    o, li, r = F.col(o_status), F.col(finished), F.col(rflag)
    n = {name: F.lit(k).cast("byte") for k, name in enumerate(STATUSES)}
    return (F.when(o == "F", F.when(li, n["completed"]).otherwise(n["delivered"]))
            .when(o == "O", F.when(li, n["processing"])
                  .when(r == 1, n["paid"]).when(r == 2, n["pending_payment"])
                  .otherwise(n["cancelled"]))
            .when(o == "P", F.when(li, F.when(r == 1, n["paid"])
                                   .when(r == 2, n["delivered"]).otherwise(n["refunded"]))
                  .when(r == 1, n["processing"]).when(r == 2, n["pending_payment"])
                  .otherwise(n["disputed"])))


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined line items, numbers and flags as whole numbers: what ``order_lines``
    derives from.  They are made before the joins, as they travel lighter."""
    li = read_table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_linestatus"])
    li = li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.col("l_quantity").cast("bigint").alias("quantity"), cents("l_extendedprice").alias("total_amount"),
        F.coalesce(F.col("l_linestatus") == "F", F.lit(False)).alias("_finished"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(0)
         .cast("byte").alias("_flag"))
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus",
                                             "o_orderdate"])
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name"])
    j = li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey", "o_orderdate",
        "quantity", "total_amount", order_status("o_orderstatus", "_finished", "_flag").alias("status"))
    return j.join(p, j.l_partkey == p.p_partkey).drop("p_partkey")


def line_id() -> F.Column:
    return F.concat_ws("-", *map(_s, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                      "quantity", "total_amount")))


def order_lines(rows: DataFrame) -> DataFrame:
    """One marketplace order per line item (plus the line number, for reviews)."""
    j = rows.select(
        line_id().alias("id"),
        F.concat(F.lit("B"), _s("o_custkey")).alias("buyer_id"),
        F.concat(F.lit("S"), _s("l_suppkey")).alias("seller_id"),
        F.when(F.col("l_linenumber") == DELETED_PRODUCT_LINE, _null("bigint"))
         .otherwise(F.col("l_partkey")).alias("product_id"),
        F.col("p_name").alias("product_title"),
        "quantity", "total_amount",
        F.get(F.array(*map(F.lit, STATUSES)), F.col("status")).alias("status"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        F.col("l_linenumber").alias("line_number"),
    )
    return with_times(j)


def with_times(j: DataFrame) -> DataFrame:
    """Orders with the times of delivery and completion, which follow from the status."""
    delivered = F.when(F.col("status").isin("delivered", "completed"),
                       F.timestamp_add("HOUR", F.col("quantity"), F.col("created_at")))
    j = j.withColumn("delivered_at", delivered)
    j = j.withColumn("completed_at", F.when(F.col("status") == "completed",
                                            F.timestamp_add("DAY", F.lit(1),
                                                            F.col("delivered_at"))))
    return j


# What is written of an order; the other columns follow from these when it is read.
STORED_ORDER = ["id", "buyer_id", "seller_id", "product_id", "product_title", "quantity",
                "total_amount", "platform_fee", "status", "created_at"]


def stored_orders(lines: DataFrame) -> DataFrame:
    return lines.withColumn("platform_fee", F.expr("total_amount * 500 div 10000")).select(*STORED_ORDER)


def orders_table(stored: DataFrame) -> DataFrame:
    """The orders table as it stands after the commission columns were added."""
    rate = F.lit(DEFAULT_COMMISSION_RATE).cast(RATE_TYPE)
    settled = (F.col("status") == "completed") & F.col("product_id").isNotNull()
    return with_times(stored).select(
        "id", "buyer_id", "seller_id", "product_id", "product_title",
        F.expr("total_amount div quantity").alias("product_price"),
        "quantity", "total_amount", "platform_fee",
        (F.col("total_amount") - F.col("platform_fee")).alias("seller_receives"),
        "status",
        _null("string").alias("midtrans_order_id"),
        _null("string").alias("buyer_note"),
        _null("string").alias("delivery_note"),
        "delivered_at", "completed_at",
        _null("timestamp_ntz").alias("auto_complete_at"),
        "created_at",
        F.coalesce("completed_at", "delivered_at", "created_at").alias("updated_at"),
        rate.alias("commission_rate"),
        F.when(settled, F.col("total_amount") - seller_fee("total_amount", rate))
         .otherwise(F.lit(0).cast("bigint")).alias("seller_payout"),
    )


def order_events_table(orders: DataFrame) -> DataFrame:
    """Status-change feed of orders: a 'delivered' event at delivered_at and,
    for completed orders, a 'completed' event at completed_at."""
    d = orders.filter(F.col("delivered_at").isNotNull()).select(
        F.col("id").alias("order_id"), F.lit("delivered").alias("status"),
        F.col("delivered_at").alias("ts"))
    c = orders.filter(F.col("completed_at").isNotNull()).select(
        F.col("id").alias("order_id"), F.lit("completed").alias("status"),
        F.col("completed_at").alias("ts"))
    return d.unionByName(c)


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_acctbal"])
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_acctbal"])
    c = c.select(F.lit("B").alias("kind"), F.col("c_custkey").alias("key"),
                 F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"))
    s = s.select(F.lit("S").alias("kind"), F.col("s_suppkey").alias("key"),
                 F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return c.unionByName(s).withColumn("id", F.concat(F.col("kind"), _s("key")))


def profiles_table(people: DataFrame) -> DataFrame:
    role = (F.when((F.col("kind") == "B") & F.col("key").isin(*ADMIN_CUSTOMERS), "admin")
            .when(F.col("kind") == "B", "pembeli").otherwise("penjual"))
    return people.select(
        "id",
        F.col("name").alias("full_name"),
        F.when(F.col("key") % NO_USERNAME_MOD == 0, _null("string"))
         .otherwise(F.lower("name")).alias("username"),
        role.alias("role"),
        _null("string").alias("avatar_url"),
        (F.col("acctbal") < 0).alias("is_suspended"),
        _null("string").alias("suspended_reason"),
    )


def accounts_table(people: DataFrame) -> DataFrame:
    local = F.regexp_replace(F.lower("name"), "#", ".")
    return people.select("id", F.concat(local, F.lit("@mail.test")).alias("email"))


def wallets_table(people: DataFrame, orders: DataFrame) -> DataFrame:
    held = (orders.filter(F.col("status").isin("paid", "processing"))
            .groupBy(F.col("seller_id").alias("user_id"))
            .agg(F.sum("total_amount").alias("escrow_hold")))
    w = people.filter(F.col("key") % NO_WALLET_MOD != NO_WALLET_REM)
    w = w.select(F.concat(F.lit("W-"), F.col("id")).alias("id"), F.col("id").alias("user_id"),
                 F.greatest(cents("acctbal"), F.lit(0).cast("bigint")).alias("balance"))
    w = w.join(held, "user_id", "left")
    return w.select("id", "user_id", "balance",
                    F.coalesce("escrow_hold", F.lit(0).cast("bigint")).alias("escrow_hold"),
                    F.lit(0).cast("bigint").alias("total_in"),
                    F.lit(0).cast("bigint").alias("total_out"))


def products_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_type", "p_size",
                                           "p_retailprice"])
    n_s = _count_frame(read_table(spark, sf_dir, "supplier", ["s_suppkey"]), "n_s")
    p = p.crossJoin(n_s)
    cat = (F.when(F.col("p_type").isin("ECONOMY", "MEDIUM"), "digital")
           .when(F.col("p_type").isin("STANDARD", "SMALL"), "game").otherwise("jasa"))
    subs = F.array(*[F.lit(x) for x in GAME_SUBCATEGORIES])
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("S"), _s(F.col("p_partkey") % F.col("n_s"))).alias("seller_id"),
        F.col("p_name").alias("title"),
        _null("string").alias("description"),
        cat.alias("category"),
        F.when(cat == "game", F.element_at(subs, (F.col("p_partkey") % 6 + 1).cast("int")))
         .alias("subcategory"),
        cents("p_retailprice").alias("price"),
        (F.col("p_size") - 1).alias("stock"),
        F.lit("Instan").alias("badge"),
        _null("string").alias("icon"),
        F.lit("#16A37A").alias("grad_start"),
        F.lit("#0E7C5B").alias("grad_end"),
        (F.col("p_partkey") % 10 != 0).alias("is_active"),
        F.lit(0).cast("bigint").alias("rating_sum"),
        F.lit(0).cast("bigint").alias("rating_count"),
        F.lit(0).cast("bigint").alias("sold_count"),
        F.timestamp_add("MINUTE", F.col("p_partkey"), _ts(BASE_DAY)).alias("created_at"),
        _null("array<string>").alias("photos"),
        _null("string").alias("cover_image"),
    )


def reviews_table(lines: DataFrame) -> DataFrame:
    r = lines.filter((F.col("status") == "completed") & (F.col("line_number") % 2 == 0))
    return r.select(
        F.concat(F.lit("R-"), F.col("id")).alias("id"),
        F.col("id").alias("order_id"), "buyer_id", "seller_id", "product_id",
        (F.col("quantity") % 5 + 1).alias("rating"),
        _null("string").alias("comment"),
        F.col("completed_at").alias("created_at"),
    )


def commission_table(orders: DataFrame) -> DataFrame:
    rate = F.lit(DEFAULT_COMMISSION_RATE).cast(RATE_TYPE)
    c = orders.filter((F.col("status") == "completed") & F.col("product_id").isNotNull())
    fee = seller_fee("total_amount", rate)
    return c.select(
        F.concat(F.lit("PC-"), F.col("id")).alias("id"),
        F.col("id").alias("order_id"),
        F.col("total_amount").alias("gross_amount"),
        rate.alias("rate"),
        fee.alias("fee_amount"),
        (F.col("total_amount") - fee).alias("seller_net"),
        F.lit("settled").alias("status"),
        F.col("completed_at").alias("settled_at"),
        F.col("completed_at").alias("created_at"),
    )


def app_settings_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("commission_rate", DEFAULT_COMMISSION_RATE)], "key string, value string"
    ).withColumn("updated_at", _ts(BASE_DAY))


def admin_wallet_table(commission: DataFrame) -> DataFrame:
    return commission.filter(F.col("status") == "settled").agg(
        F.coalesce(F.sum("fee_amount"), F.lit(0).cast("bigint")).alias("balance")
    ).select(F.lit("AW-1").alias("id"), "balance", _ts(BASE_DAY).alias("created_at"),
             _ts(BASE_DAY).alias("updated_at"))


def chat_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    n_c = _count_frame(read_table(spark, sf_dir, "customer", ["c_custkey"]), "n_c")
    n_s = _count_frame(read_table(spark, sf_dir, "supplier", ["s_suppkey"]), "n_s")
    n_p = _count_frame(read_table(spark, sf_dir, "part", ["p_partkey"]), "n_p")
    ids = conv.select("conv_id").distinct().crossJoin(n_c).crossJoin(n_s).crossJoin(n_p)
    a = F.concat(F.lit("B"), _s(F.col("conv_id") * 7 % F.col("n_c")))
    b = F.concat(F.lit("S"), _s(F.col("conv_id") % F.col("n_s")))
    start = F.timestamp_add("HOUR", F.col("conv_id"), _ts(CHAT_DAY))
    conversations = ids.select(
        F.concat(F.lit("C"), _s("conv_id")).alias("id"),
        F.least(a, b).alias("user_a_id"), F.greatest(a, b).alias("user_b_id"),
        (F.col("conv_id") % F.col("n_p")).alias("product_id"),
        _null("string").alias("last_message"),
        start.alias("last_message_at"),
        start.alias("created_at"),
        F.col("conv_id"),
    )
    msgs = conv.filter(F.col("role") != "system")
    last = msgs.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    m = msgs.join(last, "conv_id").join(
        conversations.select("conv_id", "user_a_id", "user_b_id"), "conv_id")
    messages = m.select(
        F.concat_ws("-", _s("conv_id"), _s("turn")).alias("id"),
        F.concat(F.lit("C"), _s("conv_id")).alias("conversation_id"),
        F.when(F.col("role") == "user", F.col("user_a_id")).otherwise(F.col("user_b_id"))
         .alias("sender_id"),
        F.col("text").alias("body"),
        (F.col("turn") < F.col("last_turn")).alias("is_read"),
        F.timestamp_add("MINUTE", F.col("turn"),
                        F.timestamp_add("HOUR", F.col("conv_id"), _ts(CHAT_DAY)))
         .alias("created_at"),
    )
    return conversations.drop("conv_id"), messages


def event_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type",
                                              "value", "props"])
    ev = ev.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    user = F.concat(F.lit("B"), _s("user_id"))
    forum = ev.filter(F.col("event_type") == "click").select(
        F.concat(F.lit("F"), _s("event_id")).alias("id"),
        F.concat(F.lit("room-"), _s(F.col("user_id") % 5)).alias("room_id"),
        user.alias("sender_id"),
        _null("string").alias("sender_name"),
        F.lit("pembeli").alias("sender_role"),
        F.col("props").alias("body"),
        _null("string").alias("image_url"),
        F.col("ts").alias("created_at"),
    )
    cmds = ev.filter(F.col("event_type").isin("purchase", "error")).select(
        F.col("event_id").alias("seq"),
        F.lit("B0").alias("actor_id"),
        user.alias("user_id"),
        F.when(F.col("event_type") == "purchase", cents("value"))
         .otherwise(-cents("value")).alias("amount"),
        F.concat(F.lit("event "), F.col("event_type")).alias("reason"),
        F.col("ts").alias("created_at"),
    )
    # Ledger as recorded: balance_after stamped by a running sum, except that
    # escrow_release rows count their amount twice (the stamping error of two
    # of the source's settlement copies), which the reconciliation must find.
    led = ev.filter(F.col("event_type").isin("purchase", "error", "click"))
    tx_type = (F.when(F.col("event_type") == "purchase", "topup")
               .when(F.col("event_type") == "error", "withdrawal")
               .otherwise("escrow_release"))
    signed = F.when(F.col("event_type") == "error", -cents("value")).otherwise(cents("value"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(
        Window.unboundedPreceding, 0)
    stamped = F.sum(signed).over(w) + F.when(F.col("event_type") == "click", cents("value")) \
        .otherwise(F.lit(0).cast("bigint"))
    ledger = led.select(
        F.concat(F.lit("T"), _s("event_id")).alias("id"),
        F.concat(F.lit("W-"), user).alias("wallet_id"),
        tx_type.alias("type"),
        cents("value").alias("amount"),
        stamped.alias("balance_after"),
        F.concat(F.lit("event "), F.col("event_type")).alias("description"),
        _null("string").alias("ref_order_id"),
        F.col("ts").alias("created_at"),
    )
    acts = F.array(*[F.lit(a) for a, _ in ADMIN_ACTIONS])
    kinds = F.array(*[F.lit(k) for _, k in ADMIN_ACTIONS])
    idx = (F.col("event_id") % len(ADMIN_ACTIONS) + 1).cast("int")
    logs = ev.filter(F.col("event_type") == "signup").select(
        F.concat(F.lit("L"), _s("event_id")).alias("id"),
        F.lit("B0").alias("admin_id"),
        F.element_at(acts, idx).alias("action"),
        F.element_at(kinds, idx).alias("target_type"),
        user.alias("target_id"),
        F.col("props").alias("detail"),
        F.col("ts").alias("created_at"),
    )
    status = (F.when(F.col("event_type") == "purchase", "paid")
              .when(F.col("event_type") == "click", "processing")
              .when(F.col("event_type") == "view", "delivered")
              .when(F.col("event_type") == "error", "disputed").otherwise("completed"))
    se = ev.select("event_id", F.col("user_id").alias("order_key"),
                   status.alias("status"), "ts")
    se = se.unionByName(se.filter(F.col("event_id") % 10 == 0))
    return {"forum_messages": forum, "wallet_commands": cmds, "wallet_transactions": ledger,
            "admin_logs": logs, "status_events": se, "events": ev}


def build_table(spark: SparkSession, sf_dir: str, name: str, orders: DataFrame | None = None) -> DataFrame:
    """One marketplace table as a lazy DataFrame over the driver tables, or over
    ``orders`` where that table is at hand."""
    if name == "app_settings":
        return app_settings_table(spark)
    if name == "products":
        return products_table(spark, sf_dir)
    if name in ("conversations", "messages"):
        return dict(zip(("conversations", "messages"), chat_tables(spark, sf_dir), strict=True))[name]
    if name in ("profiles", "accounts"):
        return {"profiles": profiles_table, "accounts": accounts_table}[name](_people(spark, sf_dir))
    if name == "reviews":
        return reviews_table(order_lines(line_rows(spark, sf_dir)))
    if name in ("orders", "wallets", "platform_commission", "admin_wallet", "order_events"):
        o = orders if orders is not None else orders_table(stored_orders(order_lines(line_rows(spark, sf_dir))))
        return {"orders": lambda: o, "wallets": lambda: wallets_table(_people(spark, sf_dir), o),
                "platform_commission": lambda: commission_table(o),
                "admin_wallet": lambda: admin_wallet_table(commission_table(o)),
                "order_events": lambda: order_events_table(o)}[name]()
    return event_tables(spark, sf_dir)[name]


def build_marketplace(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All marketplace tables as lazy DataFrames over the driver tables."""
    return {name: build_table(spark, sf_dir, name) for name in MARKET_TABLES}


def load_marketplace(spark: SparkSession, sf_dir: str, materialize: bool = True
                     ) -> dict[str, DataFrame]:
    """Marketplace tables, each written once per session and folder when first used,
    then read back."""
    if not materialize:
        return build_marketplace(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    tables = _frames.get(key)
    if tables is None:
        paths = marketplace_paths(spark, sf_dir)
        tables = _frames[key] = MarketTables(spark, paths, paths.catalog)
    return tables


class MarketTables(dict):
    """Table name -> DataFrame, read on first use and then reused, so a query
    only writes, lists and opens the folders it touches (and the file index of
    each folder is built once per session)."""

    def __init__(self, spark: SparkSession, paths: dict[str, str],
                 catalog: dict[str, str] | None = None):
        super().__init__()
        self._spark, self._paths = spark, paths
        self._catalog = {} if catalog is None else catalog

    def __missing__(self, name: str) -> DataFrame:
        path = self._paths[name]           # written now, unless it was
        if name in self._catalog:          # bucketed: the planner sees the layout
            df = bucketed_table(self._spark, self._catalog, name)
        else:
            df = self._spark.read.parquet(path)
        self[name] = df
        return df


def bucketed_table(spark: SparkSession, catalog: dict[str, str], name: str) -> DataFrame:
    df = spark.table(catalog[name])
    return orders_table(df) if name == "orders" else df


# A task sorts one bucket as it writes: so few rows stay in a small executor's memory.
ROWS_PER_BUCKET = 250_000


class MarketPaths(dict):
    """Table name -> folder of the written table.  A table is written when its folder
    is first asked for, so a job pays for the tables that it reads and no others."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._spark, self._sf_dir = spark, sf_dir
        self._base = scratch_path(spark, "market")
        self._tag = "escrowlens_" + self._base.rstrip("/").rsplit("-", 1)[-1]
        self.catalog: dict[str, str] = {}

    def __missing__(self, name: str) -> str:
        if name not in MARKET_TABLES:
            raise KeyError(name)
        path = f"{self._base}/{name}"
        if name == "orders":
            # The narrow rows travel; the columns that follow from them are made after.
            n = self._buckets()
            placed = line_rows(self._spark, self._sf_dir).repartition(n, line_id())
            self._bucketed(stored_orders(order_lines(placed)), name, path, n)
        elif name in CO_LOCATED:
            df = build_table(self._spark, self._sf_dir, name, self._orders(write=True))
            n = self._buckets()
            self._bucketed(df.repartition(n, F.col(CO_LOCATED[name])), name, path, n)
        else:
            df = build_table(self._spark, self._sf_dir, name, self._orders())
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self[name] = path
        return path

    def _orders(self, write: bool = False) -> DataFrame | None:
        """The written orders table; where it isn't, none, or it is written now."""
        if write:
            self["orders"]
        return bucketed_table(self._spark, self.catalog, "orders") if "orders" in self else None

    def _buckets(self) -> int:
        """Same bucket count for every co-located table, sized by row count (a
        footer-only count), so a bucket stays near ``ROWS_PER_BUCKET``."""
        n_lines = read_table(self._spark, self._sf_dir, "lineitem").count()
        return max(8, -(-n_lines // ROWS_PER_BUCKET))

    def _bucketed(self, df: DataFrame, name: str, path: str, n: int) -> None:
        """Write as a bucketed external table.  ``df`` has one partition per bucket
        (same hash as the bucketing), so each bucket is a single sorted file and joins
        skip the sort too."""
        col, tname = CO_LOCATED[name], f"{self._tag}_{name}"
        df.write.mode("overwrite").bucketBy(n, col).sortBy(col).option("compression", "zstd").option("path", path).saveAsTable(tname)
        self.catalog[name] = tname


def marketplace_paths(spark: SparkSession, sf_dir: str) -> MarketPaths:
    """Folders of the materialised marketplace tables (written on first use)."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    paths = _cache.get(key)
    if paths is None:
        paths = _cache[key] = MarketPaths(spark, sf_dir)
    return paths
