"""Chat and forum: inbox, unread counts, last message, pages (§2 C6-C8, D8, D13,
F7-F9, I5, I6 batch side).

The inbox is computed for every participant at once: each conversation is
exploded into its two (viewer, other) rows, which turns the source's
``CASE``-in-``ON`` join into an equi-join on the other user.  Unread counts
never explode messages: per conversation, "unread not sent by me" equals all
unread minus those I sent, both partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escrowlens.functions.labels import display_name
from escrowlens.plans.prefix import RANGE, bucketed, running_sum

Tables = dict[str, DataFrame]
PAGE_SIZE = 200
AUDIT_RECENT = 100
MSG_ORDER = ["created_at", "id"]


def conversation_last_message(t: Tables) -> DataFrame:
    """Last message and its time per conversation (by created_at, then id)."""
    m = t["messages"]
    last = m.groupBy("conversation_id").agg(
        F.max_by("body", F.struct(*MSG_ORDER)).alias("last_message"),
        F.max("created_at").alias("last_message_at"))
    return last


def _per_conversation(t: Tables) -> DataFrame:
    """One row per conversation: its columns, its latest message and what is
    unread for either side.

    Messages are read once: a partial aggregate per (conversation, sender) with
    the unread count and the latest message, then one row per conversation.
    "Unread and not sent by me" is all unread less those I sent, so messages
    are never copied per viewer.
    """
    sent = t["messages"].filter(F.col("sender_id").isNotNull()).groupBy(
        "conversation_id", "sender_id").agg(
        F.count_if(~F.col("is_read")).alias("_unread"),
        F.max(F.struct("created_at", "id", "body")).alias("_last"))
    c = t["conversations"].select(F.col("id").alias("conversation_id"), "user_a_id", "user_b_id",
                                  "product_id", "last_message", "last_message_at")
    by = lambda side: F.coalesce(F.sum(F.when(F.col("sender_id") == F.col(side), F.col("_unread"))),
                                 F.lit(0).cast("bigint"))
    every = F.coalesce(F.sum("_unread"), F.lit(0).cast("bigint"))
    return c.join(sent, "conversation_id", "left").groupBy(*c.columns).agg(
        F.max("_last").alias("_l"), (every - by("user_a_id")).alias("_for_a"),
        (every - by("user_b_id")).alias("_for_b"))


def _viewer_rows(t: Tables) -> DataFrame:
    """Two rows per conversation: the viewer, the other user, the viewer's unread."""
    side = lambda me, other, unread: F.struct(
        F.col(me).alias("viewer_id"), F.col(other).alias("other_user_id"),
        F.col(unread).alias("unread_count"))
    return _per_conversation(t).select(
        "conversation_id", "product_id",
        F.coalesce("_l.body", "last_message").alias("last_message"),
        F.coalesce("_l.created_at", "last_message_at").alias("last_message_at"),
        F.explode(F.array(side("user_a_id", "user_b_id", "_for_a"),
                          side("user_b_id", "user_a_id", "_for_b"))).alias("_p")) \
        .select("conversation_id", "product_id", "last_message", "last_message_at", "_p.*")


def inbox_unread(t: Tables) -> DataFrame:
    """Unread messages per (conversation, viewer): not read and not sent by the
    viewer, i.e. all unread minus the viewer's own unread."""
    return _viewer_rows(t).select("conversation_id", "viewer_id", "unread_count")


def inbox(t: Tables, newest_first: bool = True) -> DataFrame:
    """Every participant's inbox rows, with the other user, product and unread
    count, latest conversation first.

    last_message / last_message_at are what the insert trigger maintains:
    the latest message of the conversation, else the stored values.
    """
    other = t["profiles"].select(F.col("id").alias("other_user_id"),
                                 display_name("full_name", "username").alias("other_name"),
                                 F.col("avatar_url").alias("other_avatar"))
    prod = t["products"].select(F.col("id").alias("product_id"),
                                F.col("title").alias("product_title"),
                                F.col("icon").alias("product_icon"))
    j = _viewer_rows(t).join(other, "other_user_id").join(prod, "product_id", "left")
    out = j.select("viewer_id", "conversation_id", "last_message", "last_message_at",
                   "product_id", "product_title", "product_icon", "other_user_id",
                   "other_name", "other_avatar", "unread_count")
    if newest_first:
        out = out.orderBy(F.col("last_message_at").desc_nulls_last(), "conversation_id", "viewer_id")
    return out


def conversation_page(t: Tables, k: int = PAGE_SIZE) -> DataFrame:
    """The oldest ``k`` messages of every conversation, with their position.

    Positions are counted per (conversation, bucket) and offset by the counts
    of earlier buckets (range buckets: balanced even for one huge
    conversation); buckets that start at or past position ``k`` are dropped
    before the per-row window runs, so a long conversation costs only the
    part that can still contribute.
    """
    from pyspark.sql import Window
    m = bucketed(t["messages"], "conversation_id", MSG_ORDER, RANGE)
    per_b = m.groupBy("conversation_id", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.partitionBy("conversation_id").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    per_b = per_b.withColumn("_off", F.coalesce(F.sum("_n").over(wb), F.lit(0))) \
        .filter(F.col("_off") < k).select("conversation_id", "_bucket", "_off")
    kept = m.join(per_b, ["conversation_id", "_bucket"])
    wl = Window.partitionBy("conversation_id", "_bucket").orderBy(*MSG_ORDER)
    kept = kept.withColumn("position", F.row_number().over(wl) + F.col("_off"))
    return kept.filter(F.col("position") <= k).select(
        "conversation_id", "id", "sender_id", "body", "created_at",
        F.col("position").cast("bigint").alias("position"))


def mark_read(t: Tables, reads: DataFrame) -> DataFrame:
    """Messages after a batch of 'viewer opened the conversation at read_at'
    events: an incoming message (sent by the other participant) created up to
    the viewer's latest open becomes read.

    The reads are first folded onto the (small) conversations table as one
    row per conversation with each participant's latest open, so the messages
    table takes part in a single join on the conversation id.
    """
    last_open = reads.groupBy("conversation_id", "viewer_id").agg(
        F.max("read_at").alias("_read_at"))
    c = t["conversations"].select(F.col("id").alias("conversation_id"), "user_a_id",
                                  "user_b_id")
    a = last_open.select("conversation_id", F.col("viewer_id").alias("user_a_id"),
                         F.col("_read_at").alias("_a_read"))
    b = last_open.select("conversation_id", F.col("viewer_id").alias("user_b_id"),
                         F.col("_read_at").alias("_b_read"))
    opens = c.join(a, ["conversation_id", "user_a_id"], "left") \
        .join(b, ["conversation_id", "user_b_id"], "left")
    m = t["messages"].join(opens, "conversation_id", "left")
    # The other participant's latest open decides for an incoming message.
    read_by_other = (F.when(F.col("sender_id") == F.col("user_a_id"), F.col("_b_read"))
                     .when(F.col("sender_id") == F.col("user_b_id"), F.col("_a_read")))
    hit = F.coalesce(F.col("created_at") <= read_by_other, F.lit(False))
    return m.select("id", "conversation_id", "sender_id", "created_at",
                    (F.col("is_read") | hit).alias("is_read"))


def forum_room_history(t: Tables) -> DataFrame:
    """Forum messages with their position in the room (ordered by created_at, id);
    positions are computed per (room, range bucket) and offset, so a busy room
    spreads over tasks."""
    f = t["forum_messages"].select("room_id", "id", "sender_id", "created_at",
                                   F.lit(1).cast("bigint").alias("_one"))
    r = running_sum(f, "room_id", MSG_ORDER, "_one", "position", bucket=RANGE)
    return r.drop("_one")


def forum_hourly(t: Tables) -> DataFrame:
    """Messages per room per hour (tumbling window; an addition to the source)."""
    f = t["forum_messages"]
    return f.groupBy("room_id", F.date_trunc("hour", "created_at").alias("hour")).agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_distinct("sender_id").alias("senders"))


def audit_recent(t: Tables, n: int = AUDIT_RECENT) -> DataFrame:
    """The latest ``n`` admin actions (top-k: per-partition top-n, one merge)."""
    return t["admin_logs"].orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def message_labels(t: Tables, asof: str) -> DataFrame:
    """Chat time label of every message relative to ``asof``."""
    from escrowlens.functions.labels import chat_time_label
    m = t["messages"]
    return m.select("id", "conversation_id", "created_at",
                    chat_time_label("created_at", F.lit(asof).cast("timestamp_ntz"))
                    .alias("time_label"))
