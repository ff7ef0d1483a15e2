"""Command tables derived from the marketplace tables (test input only).

A command table is a batch of calls to one procedure of the source system,
one row per call.  These builders only produce rows in the command schema;
the operators in ``operators.commands`` do the work and must be right for any
rows of that schema.  Each batch is applied in ``(requested_at, cmd_id)``
order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]
ROLE_CHOICES = ["pembeli", "penjual", "admin", "moderator"]
TOGGLE_ASOF = "2001-08-01 00:00:00"


def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def settle_commands(t: Tables) -> DataFrame:
    o = t["orders"].filter(F.col("status").isin("completed", "delivered"))
    return o.select(F.concat(F.lit("ST-"), "id").alias("cmd_id"), F.col("id").alias("order_id"),
                    F.coalesce("completed_at", "delivered_at", "created_at").alias("requested_at"))


def status_commands(t: Tables) -> DataFrame:
    o = t["orders"].filter(F.col("status").isin("delivered", "paid", "processing"))
    new = (F.when(F.col("quantity") == 17, "not_a_status")
           .when(F.col("status") == "delivered", "completed")
           .when(F.col("status") == "paid", "processing").otherwise("delivered"))
    return o.select(F.concat(F.lit("SS-"), "id").alias("cmd_id"), F.col("id").alias("order_id"),
                    new.alias("new_status"), F.concat(F.lit("batch "), "status").alias("note"),
                    F.when(F.col("quantity") == 13, "B2").otherwise("B0").alias("actor_id"),
                    F.col("updated_at").alias("requested_at"))


def confirm_commands(t: Tables) -> DataFrame:
    o = t["orders"].filter(F.col("status").isin("delivered", "processing"))
    caller = F.when(F.col("quantity") == 7, F.col("seller_id")).otherwise(F.col("buyer_id"))
    return o.select(F.concat(F.lit("CF-"), "id").alias("cmd_id"), F.col("id").alias("order_id"),
                    caller.alias("caller_id"), F.col("updated_at").alias("requested_at"))


def refund_commands(t: Tables) -> DataFrame:
    o = t["orders"]
    first = o.filter(F.col("status").isin("disputed", "completed", "cancelled", "paid")).select(
        F.concat(F.lit("RF-"), "id").alias("cmd_id"), F.col("id").alias("order_id"),
        F.when(F.col("quantity") % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("sengketa "), "status")).alias("reason"),
        F.lit("B0").alias("actor_id"), F.col("updated_at").alias("requested_at"))
    again = o.filter((F.col("status") == "disputed") & (F.col("quantity") == 11)).select(
        F.concat(F.lit("RF2-"), "id").alias("cmd_id"), F.col("id").alias("order_id"),
        F.lit("ulang").alias("reason"), F.lit("B0").alias("actor_id"),
        F.timestamp_add("HOUR", F.lit(1), F.col("updated_at")).alias("requested_at"))
    return first.unionByName(again)


def suspend_commands(t: Tables, events: DataFrame) -> DataFrame:
    v = events.filter(F.col("event_type") == "view")
    sus = F.col("value") >= 25
    return v.select(F.concat(F.lit("SU-"), _s("event_id")).alias("cmd_id"),
                    F.concat(F.lit("B"), _s("user_id")).alias("user_id"),
                    sus.alias("suspend"),
                    F.when(sus, F.concat(F.lit("spam "), "props")).alias("reason"),
                    F.lit("B0").alias("actor_id"),
                    F.col("ts").cast("timestamp_ntz").alias("requested_at"))


def role_commands(t: Tables, events: DataFrame) -> DataFrame:
    s = events.filter(F.col("event_type") == "signup")
    roles = F.array(*[F.lit(r) for r in ROLE_CHOICES])
    return s.select(F.concat(F.lit("RO-"), _s("event_id")).alias("cmd_id"),
                    F.concat(F.lit("B"), _s("user_id")).alias("user_id"),
                    F.element_at(roles, (F.col("event_id") % 4 + 1).cast("int"))
                     .alias("new_role"),
                    F.lit("B0").alias("actor_id"),
                    F.col("ts").cast("timestamp_ntz").alias("requested_at"))


def toggle_commands(t: Tables) -> DataFrame:
    p = t["products"]
    at = F.lit(TOGGLE_ASOF).cast("timestamp_ntz")
    real = p.filter(F.col("stock") < 5).select(
        F.concat(F.lit("TG-"), _s("id")).alias("cmd_id"), F.col("id").alias("product_id"),
        (~F.col("is_active")).alias("active"),
        F.concat(F.lit("stok "), _s("stock")).alias("reason"),
        F.lit("B0").alias("actor_id"), at.alias("requested_at"))
    ghost = p.filter(F.col("stock") == 0).select(
        F.concat(F.lit("TGX-"), _s("id")).alias("cmd_id"),
        (F.lit(-1) - F.col("id")).alias("product_id"), F.lit(False).alias("active"),
        F.lit(None).cast("string").alias("reason"), F.lit("B0").alias("actor_id"),
        at.alias("requested_at"))
    return real.unionByName(ghost)


def conversation_requests(t: Tables, events: DataFrame, n_s: DataFrame, n_p: DataFrame
                          ) -> DataFrame:
    e = events.filter(F.col("event_type").isin("click", "error")).crossJoin(n_s).crossJoin(n_p)
    me = F.concat(F.lit("B"), _s("user_id"))
    other = F.when((F.col("event_type") == "error") & (F.col("value") < 5), me).otherwise(
        F.concat(F.lit("S"), _s(F.col("user_id") % F.col("n_s"))))
    prod = F.when(F.col("value") < 20, F.lit(None).cast("bigint")).otherwise(
        F.col("event_id") % F.col("n_p"))
    return e.select(F.concat(F.lit("CR-"), _s("event_id")).alias("req_id"), me.alias("me_id"),
                    other.alias("other_id"), prod.alias("product_id"),
                    F.col("ts").cast("timestamp_ntz").alias("requested_at"))


def signups(events: DataFrame) -> DataFrame:
    s = events.filter(F.col("event_type") == "signup")
    return s.select(F.concat(F.lit("U"), _s("event_id")).alias("account_id"),
                    F.concat(F.lit("user"), _s("user_id"), F.lit("@mail.test")).alias("email"),
                    F.col("props").alias("raw_user_meta_data"),
                    F.col("ts").cast("timestamp_ntz").alias("created_at"))


def conversation_reads(t: Tables) -> DataFrame:
    """Each participant opens each conversation once, a few minutes in."""
    c = t["conversations"]
    a = c.select(F.col("id").alias("conversation_id"), F.col("user_a_id").alias("viewer_id"),
                 F.timestamp_add("MINUTE", F.lit(3), F.col("created_at")).alias("read_at"))
    b = c.select(F.col("id").alias("conversation_id"), F.col("user_b_id").alias("viewer_id"),
                 F.timestamp_add("MINUTE", F.lit(5), F.col("created_at")).alias("read_at"))
    return a.unionByName(b)


def message_attempts(t: Tables, events: DataFrame) -> DataFrame:
    """Message inserts by users into conversations chosen by the event id:
    the caller is the claimed sender except for 'error' events, which claim
    another user's id."""
    n = t["conversations"].agg(F.count(F.lit(1)).alias("_n_conv"))
    v = events.filter(F.col("event_type").isin("view", "error")).crossJoin(F.broadcast(n))
    caller = F.concat(F.lit("B"), _s("user_id"))
    sender = F.when(F.col("event_type") == "error",
                    F.concat(F.lit("B"), _s(F.col("user_id") + 1))).otherwise(caller)
    return v.select(F.concat(F.lit("MA-"), _s("event_id")).alias("attempt_id"),
                    caller.alias("caller_id"), sender.alias("sender_id"),
                    F.concat(F.lit("C"), _s(F.col("event_id") % F.col("_n_conv")))
                    .alias("conversation_id"),
                    F.col("props").alias("body"),
                    F.col("ts").cast("timestamp_ntz").alias("created_at"))


def payment_notices(t: Tables) -> DataFrame:
    """Payment notices of orders, some delivered twice, some older than the order."""
    o = t["orders"].filter(F.col("status").isin("pending_payment", "paid", "cancelled"))
    hours = F.when(F.col("quantity") % 5 == 0, -24).otherwise(1)
    once = o.select(F.concat(F.lit("PN-"), "id").alias("event_id"), F.col("id").alias("order_id"),
                    F.when(F.col("quantity") % 4 == 0, "expired").otherwise("paid").alias("status"),
                    F.timestamp_add("HOUR", hours, F.col("created_at")).alias("ts"))
    return once.unionByName(once.join(o.filter(F.col("quantity") % 3 == 0).select(
        F.col("id").alias("order_id")), "order_id", "left_semi").select(*once.columns))
