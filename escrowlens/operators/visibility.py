"""Row-visibility reports: which viewer may read which row (§2 B12-B17).

The source enforced these as row policies for one caller.  Here each rule is
a join that lists (viewer_id, row_id) for every viewer at once - a secure-view
/ access-audit job.  Permissive rules combine by union.  "Admin sees all" is
reported as one wildcard grant per admin (row_id null, all_rows true) rather
than admins x rows, which would copy every table once per admin.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escrowlens.plans.joins import explode_parties

Tables = dict[str, DataFrame]


def _grant(df: DataFrame, viewer: str, row: str) -> DataFrame:
    return df.select(F.col(viewer).alias("viewer_id"), F.col(row).cast("string").alias("row_id"),
                     F.lit(False).alias("all_rows"))


def admin_grants(t: Tables) -> DataFrame:
    a = t["profiles"].filter(F.col("role") == "admin")
    return a.select(F.col("id").alias("viewer_id"), F.lit(None).cast("string").alias("row_id"),
                    F.lit(True).alias("all_rows"))


def _known(df: DataFrame, t: Tables) -> DataFrame:
    """Keep grants whose viewer is a profile (semi join)."""
    p = t["profiles"].select(F.col("id").alias("viewer_id"))
    return df.join(p, "viewer_id", "left_semi")


def visible_wallets(t: Tables) -> DataFrame:
    """Owner equality: a wallet is visible to its user (plus admin grants)."""
    own = _known(_grant(t["wallets"], "user_id", "id"), t)
    return own.unionByName(admin_grants(t))


def visible_notifications(t: Tables, notifications: DataFrame) -> DataFrame:
    """Owner equality on notifications (row id = source command and title)."""
    n = notifications.withColumn("_rid", F.concat_ws("|", "source_cmd", "user_id", "title"))
    return _known(_grant(n, "user_id", "_rid"), t)


def visible_orders(t: Tables) -> DataFrame:
    """Either participant: buyer or seller sees the order.

    ``buyer = me OR seller = me`` is not a hash-join key; each order becomes
    one row per distinct participant and joins on equality.
    """
    o = explode_parties(t["orders"].select("id", "buyer_id", "seller_id"), "id",
                        ["buyer_id", "seller_id"], "viewer_id")
    return _known(_grant(o, "viewer_id", "id"), t)


def visible_orders_admin(t: Tables) -> DataFrame:
    """Participants plus the admin wildcard grants."""
    return visible_orders(t).unionByName(admin_grants(t))


def visible_ledger(t: Tables) -> DataFrame:
    """Membership through the own wallet: ledger row -> wallet -> owner."""
    w = t["wallets"].select(F.col("id").alias("wallet_id"), F.col("user_id").alias("viewer_id"))
    led = t["wallet_transactions"].select("id", "wallet_id").join(w, "wallet_id")
    return _known(_grant(led, "viewer_id", "id"), t)


def visible_messages(t: Tables) -> DataFrame:
    """Membership through own conversations: message -> conversation -> participants."""
    c = explode_parties(t["conversations"].select("id", "user_a_id", "user_b_id"), "id",
                        ["user_a_id", "user_b_id"], "viewer_id") \
        .select(F.col("id").alias("conversation_id"), "viewer_id")
    m = t["messages"].select("id", "conversation_id").join(c, "conversation_id")
    return _known(_grant(m, "viewer_id", "id"), t)


def messages_rejected(t: Tables, attempts: DataFrame) -> DataFrame:
    """Insert check: the sender must be the caller and a participant.

    attempts: attempt_id, caller_id, sender_id, conversation_id, body.
    """
    c = explode_parties(t["conversations"].select("id", "user_a_id", "user_b_id"), "id",
                        ["user_a_id", "user_b_id"], "caller_id") \
        .select(F.col("id").alias("conversation_id"), "caller_id",
                F.lit(True).alias("_member"))
    j = attempts.join(c, ["conversation_id", "caller_id"], "left")
    reason = (F.when(F.col("sender_id") != F.col("caller_id"), F.lit("sender is not the caller"))
              .when(F.col("_member").isNull(), F.lit("caller is not a participant")))
    return j.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(
        "attempt_id", "caller_id", "sender_id", "conversation_id", "reason")


def messages_accepted(t: Tables, attempts: DataFrame) -> DataFrame:
    """The attempts that pass the insert check of messages."""
    gone = messages_rejected(t, attempts).select("attempt_id")
    return attempts.join(gone, "attempt_id", "left_anti").select(
        "attempt_id", "sender_id", "conversation_id", "body", "created_at")


def forum_inserts(attempts: DataFrame) -> DataFrame:
    """Insert check of the forum: the sender must be the caller.

    attempts: attempt_id, caller_id, sender_id; adds ``accepted``.
    """
    same = F.coalesce(F.col("sender_id") == F.col("caller_id"), F.lit(False))
    return attempts.select("attempt_id", "caller_id", "sender_id", same.alias("accepted"))


def visible_conversations(t: Tables) -> DataFrame:
    """Either participant sees the conversation (and may open it)."""
    c = explode_parties(t["conversations"].select("id", "user_a_id", "user_b_id"), "id",
                        ["user_a_id", "user_b_id"], "viewer_id")
    return _known(_grant(c, "viewer_id", "id"), t)


# What the source's policies give besides the joins above.
OWNER_POLICIES = [  # (policy, table, owner column, what the owner may do)
    ("profiles_update_own", "profiles", "id", "update"),
    ("wallets_own", "wallets", "user_id", "all"),
    ("products_manage_own", "products", "seller_id", "all"),
    ("reviews_own", "reviews", "buyer_id", "all"),
    ("forum_delete_own", "forum_messages", "sender_id", "delete"),
]
READ_BY_ALL = ["profiles", "products", "reviews", "forum_messages"]
ADMIN_TABLES = ["profiles", "orders", "products", "wallets", "wallet_transactions", "reviews",
                "notifications", "admin_logs", "platform_commission", "admin_wallet", "app_settings"]


def owner_rows(t: Tables) -> DataFrame:
    """Who owns which row: policy, table_name, command, viewer_id, row_id."""
    frames = [t[table].select(F.lit(policy).alias("policy"), F.lit(table).alias("table_name"),
                              F.lit(command).alias("command"), F.col(owner).alias("viewer_id"),
                              F.col("id").cast("string").alias("row_id"))
              for policy, table, owner, command in OWNER_POLICIES]
    return _known(reduce(DataFrame.unionByName, frames), t).select(
        "policy", "table_name", "command", "viewer_id", "row_id")


def table_grants(t: Tables) -> DataFrame:
    """Whole tables a viewer may use: all viewers read the public tables (one
    row with a null viewer), every admin does everything with the admin tables."""
    names = lambda tables: F.explode(F.array(*map(F.lit, tables))).alias("table_name")
    admins = t["profiles"].filter(F.col("role") == "admin").select(
        F.col("id").alias("viewer_id"), names(ADMIN_TABLES), F.lit("all").alias("command"))
    public = t["profiles"].sparkSession.range(1).select(
        F.lit(None).cast("string").alias("viewer_id"), names(READ_BY_ALL), F.lit("select").alias("command"))
    return admins.unionByName(public)
