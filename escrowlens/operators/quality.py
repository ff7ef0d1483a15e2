"""Data-quality report: the source's CHECK / UNIQUE / FK / domain rules (§2 J1, H24).

One row per (rule, table, row key) that breaks a rule.  All row-level rules of
a table run in one scan (each row yields the names of the rules it breaks);
uniqueness is ``groupBy().count() > 1`` (partial aggregation); foreign keys are
anti joins, with several keys into the same parent sharing one anti join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from escrowlens.functions.labels import ORDER_STATUSES, ROLES, WALLET_TX_TYPES, email_ok
from escrowlens.session import scratch_path
from escrowlens.sources.schemas import SCHEMAS
from escrowlens.sources.versions import append_batch

Tables = dict[str, DataFrame]


def _rows(df: DataFrame, rule: str, table: str, key: str, bad: Column) -> DataFrame:
    return df.filter(F.coalesce(bad, F.lit(False))).select(
        F.lit(rule).alias("rule"), F.lit(table).alias("table_name"),
        F.col(key).cast("string").alias("row_key"))


def _dupes(df: DataFrame, rule: str, table: str, key: str) -> DataFrame:
    d = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return _rows(d, rule, table, key, F.col("_n") > 1)


def _orphans(df: DataFrame, rule: str, table: str, key: str, fk: str,
             parent: DataFrame, pk: str) -> DataFrame:
    p = parent.select(F.col(pk).alias(fk))
    o = df.filter(F.col(fk).isNotNull()).join(p, fk, "left_anti")
    return o.select(F.lit(rule).alias("rule"), F.lit(table).alias("table_name"),
                    F.col(key).cast("string").alias("row_key"))


def _row_rules(df: DataFrame, table: str, key: str, rules: dict[str, Column]) -> DataFrame:
    """All row-level rules of one table in a single scan: each row yields the
    names of the rules it breaks (array of optional names, nulls dropped)."""
    conds = {r: F.coalesce(c, F.lit(False)) for r, c in rules.items()}
    any_bad = reduce(lambda a, b: a | b, conds.values())
    names = F.array(*[F.when(c, F.lit(r)) for r, c in conds.items()])
    # Filter first (few rows break a rule), then one output row per broken
    # rule; explode and filters stay inside whole-stage codegen.
    return df.filter(any_bad).select(F.col(key).cast("string").alias("row_key"),
                                     F.explode(names).alias("rule")) \
        .filter(F.col("rule").isNotNull()) \
        .select("rule", F.lit(table).alias("table_name"), "row_key")


def _party_orphans(df: DataFrame, table: str, key: str, fks: dict[str, str],
                   parent: DataFrame, pk: str) -> DataFrame:
    """Several foreign keys into the same parent in one anti join: each row
    becomes one (rule, reference) row per non-null key column."""
    refs = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(c).alias("ref"))
                     for rule, c in fks.items()])
    x = df.select(F.col(key).cast("string").alias("row_key"), F.explode(refs).alias("_r")) \
        .select("row_key", "_r.rule", F.col("_r.ref").alias("ref")).filter(F.col("ref").isNotNull())
    p = parent.select(F.col(pk).alias("ref"))
    return x.join(p, "ref", "left_anti").select("rule", F.lit(table).alias("table_name"),
                                                "row_key")


def _checks(table: str) -> dict[str, Column]:
    """The first report's row-level rules of one table."""
    return {
        "profiles": {"profiles_role_check": ~F.col("role").isin(*ROLES)},
        "wallets": {"wallets_balance_check": F.col("balance") < 0},
        "products": {"products_price_check": F.col("price") <= 0},
        "orders": {
            "order_status_enum": ~F.col("status").isin(*ORDER_STATUSES),
            "orders_total_is_price_x_qty":
                F.col("total_amount") != F.col("product_price") * F.col("quantity"),
            "orders_receives_is_total_minus_fee":
                F.col("seller_receives") != F.col("total_amount") - F.col("platform_fee")},
        "reviews": {"reviews_rating_check": ~F.col("rating").between(1, 5)},
        "conversations": {
            "different_users": F.col("user_a_id") == F.col("user_b_id"),
            "ordered_pair": F.col("user_a_id") >= F.col("user_b_id")},
        "messages": {"messages_body_check": F.char_length(F.trim("body")) == 0},
        "wallet_transactions": {
            "wallet_tx_type_enum": ~F.col("type").isin(*WALLET_TX_TYPES),
            "wallet_tx_amount_positive": F.col("amount") < 0},
        "accounts": {"accounts_email_format": ~email_ok("email")},
    }.get(table, {})


def quality_violations(t: Tables) -> DataFrame:
    pr, w, o = t["profiles"], t["wallets"], t["orders"]
    led, cv = t["wallet_transactions"], t["conversations"]
    parts = [_row_rules(t[name], name, "id", _checks(name)) for name in (
        "profiles", "wallets", "products", "orders", "reviews", "conversations", "messages",
        "wallet_transactions", "accounts")]
    parts += [
        _dupes(pr, "profiles_username_key", "profiles", "username"),
        _dupes(w, "wallets_user_id_key", "wallets", "user_id"),
        _orphans(w, "wallets_user_id_fkey", "wallets", "id", "user_id", pr, "id"),
        _party_orphans(o, "orders", "id", {"orders_buyer_id_fkey": "buyer_id",
                                           "orders_seller_id_fkey": "seller_id"}, pr, "id"),
        _dupes(t["reviews"], "reviews_order_id_key", "reviews", "order_id"),
        _orphans(led, "wallet_tx_wallet_id_fkey", "wallet_transactions", "id", "wallet_id",
                 w, "id"),
    ]
    pairs = cv.groupBy("user_a_id", "user_b_id").agg(
        F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    parts.append(pairs.select(F.lit("conversations_pair_unique").alias("rule"),
                              F.lit("conversations").alias("table_name"),
                              F.concat_ws("|", "user_a_id", "user_b_id").alias("row_key")))
    return reduce(DataFrame.unionByName, parts)


# Fixed values of the source's tables: columns declared NOT NULL, references
# and value lists that the first report doesn't have.
NOT_NULL = {
    "profiles": ["role", "is_suspended"],
    "wallets": ["user_id", "balance", "escrow_hold", "total_in", "total_out"],
    "wallet_transactions": ["wallet_id", "type", "amount", "balance_after", "created_at"],
    "products": ["seller_id", "title", "category", "price", "is_active", "created_at"],
    "orders": ["buyer_id", "seller_id", "product_title", "product_price", "quantity", "total_amount",
               "platform_fee", "seller_receives", "status", "created_at"],
    "reviews": ["order_id", "buyer_id", "seller_id", "rating", "created_at"],
    "conversations": ["user_a_id", "user_b_id", "created_at"],
    "messages": ["conversation_id", "sender_id", "body", "is_read", "created_at"],
    "forum_messages": ["room_id", "sender_id", "body", "created_at"],
    "admin_logs": ["admin_id", "action", "target_type", "target_id", "created_at"],
    "platform_commission": ["order_id", "gross_amount", "rate", "fee_amount", "seller_net", "status",
                            "created_at"],
    "admin_wallet": ["balance"],
}
REFERENCES = [  # (table, column, table referred to)
    ("products", "seller_id", "profiles"), ("orders", "product_id", "products"),
    ("reviews", "order_id", "orders"), ("reviews", "buyer_id", "profiles"),
    ("reviews", "seller_id", "profiles"), ("reviews", "product_id", "products"),
    ("conversations", "user_a_id", "profiles"), ("conversations", "user_b_id", "profiles"),
    ("conversations", "product_id", "products"), ("messages", "conversation_id", "conversations"),
    ("messages", "sender_id", "profiles"), ("forum_messages", "sender_id", "profiles"),
    ("admin_logs", "admin_id", "profiles"), ("wallet_transactions", "ref_order_id", "orders"),
    ("platform_commission", "order_id", "orders"),
]
VALUES = {
    ("forum_messages", "sender_role"): ["pembeli", "penjual"],
    ("platform_commission", "status"): ["pending", "settled", "refunded"],
    ("notifications", "type"): ["info", "success", "warning", "error"],
}


def _declared_rules(table: str) -> dict[str, Column]:
    rules = {f"{table}_{c}_not_null": F.col(c).isNull() for c in NOT_NULL.get(table, [])}
    return rules | {f"{table}_{c}_check": ~F.col(c).isin(*v) for (of, c), v in VALUES.items() if of == table}


def integrity_violations(t: Tables) -> DataFrame:
    """NOT NULL, value-list and remaining foreign-key rules.

    Row rules take one scan per table; references into the same table share one
    anti join, whatever tables they come from.
    """
    parts = [_row_rules(t[name], name, "id", _declared_rules(name)) for name in NOT_NULL]
    for parent in dict.fromkeys(p for _, _, p in REFERENCES):
        refs = []
        for table in dict.fromkeys(c for c, _, p in REFERENCES if p == parent):
            cols = [c for x, c, p in REFERENCES if (x, p) == (table, parent)]
            each = F.array(*[F.struct(F.lit(f"{table}_{c}_fkey").alias("rule"),
                                      F.col(c).cast("string").alias("ref")) for c in cols])
            refs.append(t[table].select(F.lit(table).alias("table_name"), F.col("id").cast("string").alias("row_key"),
                                        F.explode(each).alias("_r"))
                        .select("table_name", "row_key", "_r.rule", "_r.ref").filter("ref is not null"))
        known = t[parent].select(F.col("id").cast("string").alias("ref"))
        parts.append(reduce(DataFrame.unionByName, refs).join(known, "ref", "left_anti")
                     .select("rule", "table_name", "row_key"))
    twice = t["platform_commission"].groupBy("order_id").count().filter("count > 1 and order_id is not null")
    parts.append(twice.select(F.lit("platform_commission_order_id_key").alias("rule"),
                              F.lit("platform_commission").alias("table_name"),
                              F.col("order_id").alias("row_key")))
    return reduce(DataFrame.unionByName, parts)


def notification_violations(t: Tables, notifications: DataFrame) -> DataFrame:
    """The rules of notifications (source_cmd, user_id, title, body, type, ref_order_id)."""
    n = notifications.withColumn("id", F.concat_ws("|", "source_cmd", "user_id"))
    needed = {f"notifications_{c}_not_null": F.col(c).isNull() for c in ("user_id", "title", "body", "type")}
    return reduce(DataFrame.unionByName, [
        _row_rules(n, "notifications", "id", needed | _declared_rules("notifications")),
        _orphans(n, "notifications_user_id_fkey", "notifications", "id", "user_id", t["profiles"], "id"),
        _orphans(n, "notifications_ref_order_id_fkey", "notifications", "id", "ref_order_id", t["orders"], "id")])


# Rules between rows, by the column that they look up: (table, column, table referred
# to, rule) and (table, columns, rule).
_FOREIGN = [("wallets", "user_id", "profiles", "wallets_user_id_fkey"),
            ("orders", "buyer_id", "profiles", "orders_buyer_id_fkey"),
            ("orders", "seller_id", "profiles", "orders_seller_id_fkey"),
            ("wallet_transactions", "wallet_id", "wallets", "wallet_tx_wallet_id_fkey"),
            *[(c, x, p, f"{c}_{x}_fkey") for c, x, p in REFERENCES]]
_UNIQUE = [("profiles", ["username"], "profiles_username_key"),
           ("wallets", ["user_id"], "wallets_user_id_key"),
           ("reviews", ["order_id"], "reviews_order_id_key"),
           ("conversations", ["user_a_id", "user_b_id"], "conversations_pair_unique"),
           ("platform_commission", ["order_id"], "platform_commission_order_id_key")]


VIOLATION = "rule string, table_name string, row_key string"


def row_checks(table: str) -> dict[str, Column]:
    """All row-level rules of one table, by name."""
    return _checks(table) | _declared_rules(table)


def _unique_value(cols: list[str]) -> Column:
    """The looked-up value of a uniqueness rule: null only where a lone column is."""
    if len(cols) == 1:
        return F.col(cols[0]).cast("string")
    return F.to_json(F.struct(*cols))


def _keys(df: DataFrame, table: str, lookups: set[str]) -> DataFrame | None:
    """(lookup, value) of all keys of a table that some of ``lookups`` need: one scan."""
    found = []
    if table in lookups:
        found.append(F.struct(F.lit(table).alias("lookup"), F.col("id").cast("string").alias("value")))
    for of, cols, rule in _UNIQUE:
        if of == table and rule in lookups:
            found.append(F.struct(F.lit(rule).alias("lookup"), _unique_value(cols).alias("value")))
    if not found:
        return None
    return df.select(F.explode(F.array(*found)).alias("_k")).select("_k.lookup", "_k.value") \
        .filter("value is not null")


def arrival_violations(t: Tables, new: Tables) -> DataFrame:
    """The rules that a batch of new rows breaks (rule, table_name, row_key).

    ``t`` holds the tables before the batch, ``new`` the rows that arrive, by table;
    they may refer to each other.  The result is what both full reports over old and new
    rows would say in addition to the reports over the old rows: broken row rules and
    references of the new rows, and keys that only the batch makes double.  (Old rows
    whose missing parent now arrives are no violations any more; they are not listed.)

    All lookups share one join: the distinct references and keys of the batch are its
    small side, against the key columns of the tables that they point into, each scanned
    once and reduced before any shuffle, by a broadcast where the batch's measured size
    allows it and else by Spark's runtime Bloom filter.  What the batch looks up and what
    the join finds (no more rows than were looked up) are written to the shared folder,
    so the tables of the batch and the old ones are read once each.
    """
    spark = next(iter(t.values())).sparkSession
    nothing = spark.createDataFrame([], VIOLATION)
    broken = [_row_rules(df, name, "id", row_checks(name)) for name, df in new.items() if row_checks(name)]
    broken = reduce(DataFrame.unionByName, broken, nothing)
    asks = []
    for name, df in new.items():
        mine = [(x, p, rule) for c, x, p, rule in _FOREIGN if c == name]
        key = F.col("id").cast("string")
        one = [_ask(rule, key, p, F.col(x).cast("string"), True) for x, p, rule in mine]
        one += [_ask(rule, F.concat_ws("|", *cols), rule, _unique_value(cols), False)
                for of, cols, rule in _UNIQUE if of == name]
        if one:
            asks.append(df.select(F.lit(name).alias("table_name"), F.explode(F.array(*one)).alias("_a"))
                        .select("table_name", "_a.*").filter("value is not null"))
    if not asks:
        return broken
    asked = _staged(reduce(DataFrame.unionByName, asks), "asked")
    lookups = {p for c, _, p, _ in _FOREIGN if c in new} | {r for c, _, r in _UNIQUE if c in new}
    wanted = asked.select("lookup", "value").distinct()
    held = [k for name in SCHEMAS if name in t and (k := _keys(t[name], name, lookups)) is not None]
    held = _staged(reduce(DataFrame.unionByName, held).join(wanted, ["lookup", "value"], "left_semi")
                   .groupBy("lookup", "value").agg(F.count(F.lit(1)).alias("n_old")), "held")
    known = [k for name in new if name in lookups and (k := _keys(new[name], name, {name})) is not None]
    known = reduce(DataFrame.unionByName, known, held.select("lookup", "value"))
    refs = asked.filter("is_ref")
    lost = refs.select("lookup", "value").distinct().join(known, ["lookup", "value"], "left_anti")
    orphans = refs.join(lost, ["lookup", "value"], "left_semi").select("rule", "table_name", "row_key")
    had = F.coalesce("n_old", F.lit(0))
    doubles = asked.filter("not is_ref").groupBy("table_name", "lookup", "value").agg(
        F.min("row_key").alias("row_key"), F.count(F.lit(1)).alias("n_new")) \
        .join(held, ["lookup", "value"], "left").filter((had <= 1) & (had + F.col("n_new") > 1)) \
        .select(F.col("lookup").alias("rule"), "table_name", "row_key")
    return broken.unionByName(orphans).unionByName(doubles)


def _ask(rule: str, row_key: Column, lookup: str, value: Column, is_ref: bool) -> Column:
    return F.struct(F.lit(rule).alias("rule"), row_key.alias("row_key"), F.lit(lookup).alias("lookup"),
                    value.alias("value"), F.lit(is_ref).alias("is_ref"))


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_checked(rows: DataFrame, table: str, path: str, batch_id: int) -> dict[str, int]:
    """Append a batch (a repeated one replaces itself) and count, in the same pass, its
    rows and those that break each row-level rule of ``table``."""
    seen = Observation(f"{table}-{batch_id}")
    broken = [F.count_if(c).alias(rule) for rule, c in row_checks(table).items()]
    append_batch(rows.observe(seen, F.count(F.lit(1)).alias("rows"), *broken), path, batch_id)
    return seen.get
