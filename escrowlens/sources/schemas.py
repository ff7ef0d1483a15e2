"""Declared schemas of the marketplace tables and schema evolution (§2 A2, A3).

Schemas are DDL strings (Spark's own syntax), so ``spark.read.schema(...)``
reads without inference.  ``ensure_columns`` is the "add column if not
exists, with default" step of the source's migration scripts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

SCHEMAS = {
    "profiles": "id string, full_name string, username string, role string, "
                "avatar_url string, is_suspended boolean, suspended_reason string",
    "wallets": "id string, user_id string, balance bigint, escrow_hold bigint, "
               "total_in bigint, total_out bigint",
    "wallet_transactions": "id string, wallet_id string, type string, amount bigint, "
                           "balance_after bigint, description string, ref_order_id string, "
                           "created_at timestamp_ntz",
    "products": "id bigint, seller_id string, title string, description string, "
                "category string, subcategory string, price bigint, stock int, badge string, "
                "icon string, grad_start string, grad_end string, is_active boolean, "
                "rating_sum bigint, rating_count bigint, sold_count bigint, "
                "created_at timestamp_ntz, photos array<string>, cover_image string",
    "orders": "id string, buyer_id string, seller_id string, product_id bigint, "
              "product_title string, product_price bigint, quantity bigint, "
              "total_amount bigint, platform_fee bigint, seller_receives bigint, "
              "status string, midtrans_order_id string, buyer_note string, "
              "delivery_note string, delivered_at timestamp_ntz, completed_at timestamp_ntz, "
              "auto_complete_at timestamp_ntz, created_at timestamp_ntz, "
              "updated_at timestamp_ntz, commission_rate decimal(5,4), seller_payout bigint",
    "notifications": "user_id string, title string, body string, type string, "
                     "ref_order_id string, created_at timestamp_ntz",
    "reviews": "id string, order_id string, buyer_id string, seller_id string, "
               "product_id bigint, rating bigint, comment string, created_at timestamp_ntz",
    "admin_logs": "id string, admin_id string, action string, target_type string, "
                  "target_id string, detail string, created_at timestamp_ntz",
    "conversations": "id string, user_a_id string, user_b_id string, product_id bigint, "
                     "last_message string, last_message_at timestamp_ntz, "
                     "created_at timestamp_ntz",
    "messages": "id string, conversation_id string, sender_id string, body string, "
                "is_read boolean, created_at timestamp_ntz",
    "forum_messages": "id string, room_id string, sender_id string, sender_name string, "
                      "sender_role string, body string, image_url string, "
                      "created_at timestamp_ntz",
    "platform_commission": "id string, order_id string, gross_amount bigint, "
                           "rate decimal(5,4), fee_amount bigint, seller_net bigint, "
                           "status string, settled_at timestamp_ntz, created_at timestamp_ntz",
    "admin_wallet": "id string, balance bigint, created_at timestamp_ntz, "
                    "updated_at timestamp_ntz",
    "app_settings": "key string, value string, updated_at timestamp_ntz",
}

# Columns added to orders by the commission migration: (name, type, default).
ORDER_EVOLUTION = [("platform_fee", "bigint", 0),
                   ("commission_rate", "decimal(5,4)", "0.05"),
                   ("seller_payout", "bigint", 0)]


def schema(name: str) -> StructType:
    return _parse_datatype_string(SCHEMAS[name])


def ensure_columns(df: DataFrame, spec) -> DataFrame:
    """Add each (name, type, default) column that the frame lacks."""
    present = set(df.columns)
    missing = {n: F.lit(d).cast(t) for n, t, d in spec if n not in present}
    return df.withColumns(missing) if missing else df


def evolved_schema(name: str, added=ORDER_EVOLUTION) -> StructType:
    """The declared schema with the added columns' defaults as column defaults for
    files written before them (the metadata that ALTER TABLE ... ADD COLUMNS ... DEFAULT
    keeps in a Spark table)."""
    default = {n: f"CAST('{d}' AS {t})" for n, t, d in added}
    return StructType([
        StructField(f.name, f.dataType, True, {"CURRENT_DEFAULT": default[f.name], "EXISTS_DEFAULT": default[f.name]})
        if f.name in default else f for f in schema(name).fields])


def read_evolved(spark: SparkSession, name: str, *paths: str, added=ORDER_EVOLUTION) -> DataFrame:
    """One read of Parquet folders with files from before and after the added columns.

    A file that lacks an added column gives its default, a null that a newer file stores
    stays null, and narrower integers of older files are widened.  Decided per file by
    the scan, so no footer passes the driver, filters on the added columns are pushed
    into the newer files, and nothing is unioned or rewritten."""
    return spark.read.schema(evolved_schema(name, added)).parquet(*paths)


# The defaults of the source's tables, as SQL text; "now" is the
# time given by the caller.
DEFAULTS = {
    "profiles": {"role": "'pembeli'", "is_suspended": "false"},
    "wallets": {"balance": "0", "escrow_hold": "0", "total_in": "0", "total_out": "0"},
    "wallet_transactions": {"created_at": "now"},
    "products": {"stock": "1", "badge": "'Instan'", "grad_start": "'#16A37A'", "grad_end": "'#0E7C5B'",
                 "is_active": "true", "rating_sum": "0", "rating_count": "0", "sold_count": "0",
                 "created_at": "now"},
    "orders": {"quantity": "1", "platform_fee": "0", "status": "'pending_payment'",
               "commission_rate": "0.05", "seller_payout": "0", "created_at": "now", "updated_at": "now"},
    "notifications": {"type": "'info'", "created_at": "now"},
    "reviews": {"created_at": "now"},
    "admin_logs": {"created_at": "now"},
    "conversations": {"last_message_at": "now", "created_at": "now"},
    "messages": {"is_read": "false", "created_at": "now"},
    "forum_messages": {"sender_role": "'pembeli'", "body": "''", "created_at": "now"},
    "platform_commission": {"rate": "0.05", "status": "'pending'", "created_at": "now"},
    "admin_wallet": {"balance": "0", "updated_at": "now"},
}


def conform(df: DataFrame, table: str, now: str) -> DataFrame:
    """Rows as an insert into ``table`` makes them: the declared columns in
    order and type, a column that the frame lacks set to its default."""
    cols = []
    for f in schema(table).fields:
        if f.name in df.columns:
            value = F.col(f.name)
        else:
            text = DEFAULTS.get(table, {}).get(f.name, "null")
            value = F.lit(now) if text == "now" else F.expr(text)
        cols.append(value.cast(f.dataType).alias(f.name))
    return df.select(*cols)
