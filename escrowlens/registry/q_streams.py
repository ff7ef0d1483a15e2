"""Registered streaming queries.  Each runs a Structured
Streaming query with ``availableNow`` over the materialised table folders and
returns its sink; the oracle is the batch result the stream must converge to."""

from __future__ import annotations

from pyspark.sql import functions as F

from escrowlens.registry.core import register
from escrowlens.session import scratch_path
from escrowlens.sources import commands as src
from escrowlens.sources.marketplace import marketplace_paths
from escrowlens.sources.versions import VersionedTable
from escrowlens.streaming import streams as st

ASOF = "2001-08-01 00:00:00"
ORDERS_PER_PART = 20_000


STEPS = 4
ROWS_PER_FILE = 1_000_000


def _in_steps(rows, order, name):
    """Rows as a feed folder of ``STEPS`` files, one per micro-batch."""
    path = scratch_path(rows.sparkSession, f"feed-{name}")
    rows.repartitionByRange(STEPS, order).write.parquet(path)
    return path


def _in_order(rows, order, name):
    """As ``_in_steps``, the files written one step after the other, oldest rows first:
    the state store's watermark drops what comes too late.  Returns the folder and
    the files of a step, the same number for each."""
    path = scratch_path(rows.sparkSession, f"feed-{name}")
    at = F.unix_millis(F.col(order).cast("timestamp"))
    cuts = rows.select(at.cast("double").alias("at")).approxQuantile("at", [k / STEPS for k in range(1, STEPS)], 0.01)
    sides = [(F.lit(True) if low is None else at >= low) & (F.lit(True) if high is None else at < high)
             for low, high in zip([None, *cuts], [*cuts, None], strict=True)]
    sizes = rows.agg(*[F.count_if(side) for side in sides]).first()
    # Rows are dealt round, far more than files, so no file of a step stays empty.
    files = max(1, min([n for n in sizes if n], default=0) // ROWS_PER_FILE)
    for side, n in zip(sides, sizes, strict=True):
        if n or not any(sizes):
            rows.filter(side).repartition(files).write.mode("append").parquet(path)
    return path, files


def _run_timers(t, spark, name, base):
    """Run the delivery timers over the order events in steps."""
    events = t["order_events"]
    path, files = _in_order(events, "ts", name)
    feed = st.order_event_feed(spark, path, max_files=files)
    parts = max(1, -(-events.count() // ORDERS_PER_PART))
    return st.run_timers(st.auto_complete_timers(feed, n_parts=parts), base, most_states=parts)


def _paths(spark, sf_dir):
    return marketplace_paths(spark, sf_dir)


@register("stream_messages", """
SELECT id, conversation_id, sender_id, body, is_read, created_at FROM m_messages
WHERE trim(body) <> ''
""", needs_session=True)
def stream_messages(t, spark, sf_dir):
    """Change feed of new messages for all conversations (dedup by id, no blanks)."""
    path = _in_steps(t["messages"], "created_at", "messages")
    feed = st.not_blank(st.message_feed(spark, path, max_files=1))
    return _all(st.run_dedup(feed, "id", "created_at", "messages"), "id")


def _all(parts, id_col):
    """The written rows, as they are, and the dead letters that aren't among them."""
    rows, late = parts
    lost = late.dropDuplicates([id_col]).join(rows.select(id_col), id_col, "left_anti")
    return rows.unionByName(lost.select(*rows.columns))


def _status_events(spark, sf_dir, name):
    feed = st.status_feed(spark, _paths(spark, sf_dir)["status_events"])
    return _all(st.run_dedup(feed, "event_id", "ts", name), "event_id")


@register("stream_dedup", """
SELECT DISTINCT event_id, order_key, status, ts FROM m_status_events
""", needs_session=True)
def stream_dedup(t, spark, sf_dir):
    """At-least-once status notifications reduced to one per event id."""
    return _status_events(spark, sf_dir, "status")


@register("stream_dispute_alerts", """
SELECT DISTINCT event_id, order_key, status, ts FROM m_status_events
WHERE status = 'disputed'
""", needs_session=True)
def stream_dispute_alerts(t, spark, sf_dir):
    """One alert per notification moving an order to disputed."""
    path = _in_steps(t["status_events"], "ts", "disputes")
    feed = st.status_feed(spark, path, max_files=1).filter("status = 'disputed'")
    return _all(st.run_dedup(feed, "event_id", "ts", "disputes"), "event_id")


@register("stream_last_message", """
SELECT conversation_id, body AS last_message, created_at AS last_message_at
FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id
                                   ORDER BY created_at DESC, id DESC) AS rn
      FROM m_messages) WHERE rn = 1
""", needs_session=True)
def stream_last_message(t, spark, sf_dir):
    """Last message per conversation, merged from the micro-batches."""
    feed = st.message_feed(spark, _in_steps(t["messages"], "created_at", "last-message"), max_files=1)
    last = st.run_merged(feed, st.last_message_partial, st.merge_last_message, "last-message", compact_every=2)
    return last.select("conversation_id", "last.body", "last.created_at").toDF(
        "conversation_id", "last_message", "last_message_at").withColumn(
        "last_message_at", F.col("last_message_at").cast("timestamp_ntz"))


@register("stream_unread", """
, rd AS (SELECT id AS conversation_id, user_a_id AS viewer_id, created_at + INTERVAL 3 MINUTE AS read_at
         FROM m_conversations
         UNION ALL SELECT id, user_b_id, created_at + INTERVAL 5 MINUTE FROM m_conversations)
SELECT m.conversation_id, v.viewer_id, count(*) AS unread_count
FROM m_messages m
JOIN (SELECT id, unnest([user_a_id, user_b_id]) AS viewer_id FROM m_conversations) v ON v.id = m.conversation_id
WHERE NOT m.is_read AND m.sender_id <> v.viewer_id
  AND NOT EXISTS (SELECT 1 FROM rd WHERE rd.conversation_id = m.conversation_id
                  AND rd.viewer_id = v.viewer_id AND rd.read_at >= m.created_at)
GROUP BY 1, 2
""", needs_session=True)
def stream_unread(t, spark, sf_dir):
    """Live unread count per (conversation, viewer): both feeds in one stream of
    several micro-batches over an incrementally updated state."""
    messages = _in_steps(t["messages"], "created_at", "unread-messages")
    reads = _in_steps(src.conversation_reads(t), "read_at", "unread-reads")
    return st.run_unread(
        st.message_feed(spark, messages, max_files=1),
        st.feed(spark, reads, "conversation_id string, viewer_id string, read_at timestamp_ntz", "read_at", max_files=1),
        t["conversations"], "query", n_parts=4)


@register("stream_forum", """
SELECT room_id, date_trunc('hour', created_at) AS window_start,
       date_trunc('hour', created_at) + INTERVAL 1 HOUR AS window_end, count(*) AS messages
FROM m_forum GROUP BY 1, 2, 3
""", needs_session=True)
def stream_forum(t, spark, sf_dir):
    """Forum messages per room per hour from the forum change feed."""
    feed = st.forum_feed(spark, _in_steps(t["forum_messages"], "created_at", "forum"), max_files=1)
    return st.run_merged(feed, st.forum_window_partial, st.merge_forum_windows, "forum", compact_every=2)


@register("stream_order_status", """
, d AS (SELECT DISTINCT event_id, order_key, status, ts FROM m_status_events)
SELECT order_key,
       (SELECT d2.status FROM d d2 WHERE d2.order_key = d.order_key
        ORDER BY d2.ts DESC, d2.event_id DESC LIMIT 1) AS status,
       max(ts) AS status_at, count(*) AS notifications
FROM d GROUP BY order_key
""", needs_session=True)
def stream_order_status(t, spark, sf_dir):
    """Latest status per order from de-duplicated notifications, late ones too."""
    return st.latest_status(_status_events(spark, sf_dir, "order-status"))


PAYMENTS_SQL = """
, pn AS (SELECT id AS order_id, CASE WHEN quantity % 4 = 0 THEN 'expired' ELSE 'paid' END AS status,
                created_at + to_hours(CASE WHEN quantity % 5 = 0 THEN -24 ELSE 1 END) AS ts
         FROM m_orders WHERE status IN ('pending_payment', 'paid', 'cancelled')),
paid AS (SELECT o.id AS order_id, o.status AS old_status, pn.ts AS updated_at, 'paid' AS status
         FROM m_orders o JOIN pn ON pn.order_id = o.id
         WHERE o.status = 'pending_payment' AND pn.status = 'paid' AND pn.ts >= o.created_at)
"""


def _notices(t, spark, name):
    path = _in_steps(src.payment_notices(t), "ts", name)
    return st.feed(spark, path, "event_id string, order_id string, status string, ts timestamp_ntz", "ts", max_files=1)


@register("stream_payments", PAYMENTS_SQL + "SELECT * FROM paid", needs_session=True)
def stream_payments(t, spark, sf_dir):
    """Orders that payment notices move from pending_payment to paid."""
    notices = _all(st.run_dedup(_notices(t, spark, "payments"), "event_id", "ts", "payments", horizon_hours=24 * 60), "event_id")
    return st.apply_payments(t["orders"], notices)


@register("orders_after_payments", PAYMENTS_SQL + """
SELECT o.id, o.buyer_id, o.total_amount, coalesce(p.status, o.status) AS status, o.created_at,
       coalesce(p.updated_at, o.created_at) AS updated_at
FROM m_orders o LEFT JOIN paid p ON p.order_id = o.id
""", needs_session=True)
def orders_after_payments(t, spark, sf_dir):
    """The orders table itself after the payment notices: each micro-batch replaces
    the orders it moves, in the ranges of order numbers that hold them."""
    rows = t["orders"].select("id", "buyer_id", "total_amount", "status", "created_at",
                              F.col("created_at").alias("updated_at"))
    part = F.floor(F.split_part("id", F.lit("-"), F.lit(1)).cast("bigint") / ORDERS_PER_PART)
    orders = VersionedTable.create(rows, "orders", ["id"], part)
    return st.run_payments(_notices(t, spark, "paid-orders"), orders, "query")


@register("orders_auto_complete_due", f"""
SELECT id, buyer_id, seller_id, delivered_at, delivered_at + INTERVAL 3 DAY AS due_at
FROM m_orders
WHERE status = 'delivered' AND delivered_at IS NOT NULL
  AND delivered_at + INTERVAL 3 DAY <= TIMESTAMP '{ASOF}'
""")
def orders_auto_complete_due(t):
    """Delivered orders past their 3-day auto-completion time at the as-of date."""
    return st.auto_complete_due(t["orders"], ASOF)


AUTO_SQL = """
, e AS (SELECT order_id, status, ts,
               lead(ts) OVER (PARTITION BY order_id ORDER BY ts, status) AS next_ts
        FROM m_order_events),
wm AS (SELECT max(ts) - INTERVAL 1 DAY AS watermark FROM m_order_events)
SELECT order_id, ts AS delivered_at, ts + INTERVAL 3 DAY AS due_at
FROM e, wm
WHERE status = 'delivered'
  AND ((next_ts IS NOT NULL AND next_ts > ts + INTERVAL 3 DAY)
       OR (next_ts IS NULL AND ts + INTERVAL 3 DAY < wm.watermark))
"""


@register("stream_auto_complete", AUTO_SQL, needs_session=True)
def stream_auto_complete(t, spark, sf_dir):
    """Event-time timers, declarative per micro-batch with a versioned timer table:
    orders still delivered 3 days after delivery."""
    from escrowlens.streaming.timers import run_auto_complete
    p = _paths(spark, sf_dir)
    return run_auto_complete(st.order_event_feed(spark, p["order_events"]), "auto-complete")


@register("stream_auto_complete_state", AUTO_SQL, needs_session=True)
def stream_auto_complete_state(t, spark, sf_dir):
    """The same timers in a RocksDB state store (transformWithState, event time), over
    several micro-batches."""
    return _run_timers(t, spark, "order-events", scratch_path(spark, "auto-complete-state"))


@register("armed_timers", """
, e AS (SELECT order_id, status, ts, lead(ts) OVER (PARTITION BY order_id ORDER BY ts, status) AS next_ts
        FROM m_order_events),
wm AS (SELECT max(ts) - INTERVAL 1 DAY AS watermark FROM m_order_events)
SELECT order_id, ts AS delivered_at FROM e, wm
WHERE status = 'delivered' AND next_ts IS NULL AND ts + INTERVAL 3 DAY >= wm.watermark
""", needs_session=True)
def armed_timers(t, spark, sf_dir):
    """Audit of the timers still armed, read back from the state store."""
    base = scratch_path(spark, "armed-timers")
    _run_timers(t, spark, "armed-events", base)
    return st.armed_timers(spark, base)
