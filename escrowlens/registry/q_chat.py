"""Registered chat, forum, visibility and quality queries (SURVEY §2 B12-B17,
C6-C8, D8, D13, F7-F9, I5, I6 batch side, J1, J13)."""

from __future__ import annotations

import re

from escrowlens.operators import chat as ch
from escrowlens.operators import commands as cm
from escrowlens.operators import quality as qa
from escrowlens.operators import visibility as vis
from escrowlens.registry.core import register
from escrowlens.registry.q_commands import CONFIRM, CONFIRM_NOTES
from escrowlens.sources import commands as src

LAST = """
, lm AS (SELECT conversation_id, body AS last_message, created_at AS last_message_at
         FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id
                                            ORDER BY created_at DESC, id DESC) AS rn
               FROM m_messages) WHERE rn = 1),
v AS (SELECT id AS conversation_id, product_id, last_message, last_message_at,
             user_a_id AS viewer_id, user_b_id AS other_user_id FROM m_conversations
      UNION ALL
      SELECT id, product_id, last_message, last_message_at, user_b_id, user_a_id
      FROM m_conversations)
"""
UNREAD = """(SELECT count(*) FROM m_messages m WHERE m.conversation_id = v.conversation_id
              AND m.sender_id <> v.viewer_id AND NOT m.is_read)"""

register("conversation_last_message", LAST + "SELECT * FROM lm")(ch.conversation_last_message)

register("inbox_unread", LAST + f"""
SELECT v.conversation_id, v.viewer_id, {UNREAD} AS unread_count FROM v
""")(ch.inbox_unread)

register("inbox", LAST + f"""
SELECT v.viewer_id, v.conversation_id,
       coalesce(lm.last_message, v.last_message) AS last_message,
       coalesce(lm.last_message_at, v.last_message_at) AS last_message_at,
       v.product_id, pr.title AS product_title, pr.icon AS product_icon, v.other_user_id,
       coalesce(o.full_name, o.username, 'Pengguna') AS other_name,
       o.avatar_url AS other_avatar, {UNREAD} AS unread_count
FROM v JOIN m_profiles o ON o.id = v.other_user_id
LEFT JOIN m_products pr ON pr.id = v.product_id
LEFT JOIN lm ON lm.conversation_id = v.conversation_id
""")(ch.inbox)

register("conversation_page", """
SELECT conversation_id, id, sender_id, body, created_at, position
FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id)
                  AS position FROM m_messages)
WHERE position <= 200
""")(ch.conversation_page)


@register("mark_read", """
, rd AS (SELECT id AS conversation_id, user_a_id AS viewer_id,
                created_at + INTERVAL 3 MINUTE AS read_at FROM m_conversations
         UNION ALL
         SELECT id, user_b_id, created_at + INTERVAL 5 MINUTE FROM m_conversations)
SELECT m.id, m.conversation_id, m.sender_id, m.created_at,
       m.is_read OR EXISTS (
         SELECT 1 FROM rd JOIN m_conversations c ON c.id = rd.conversation_id
         WHERE rd.conversation_id = m.conversation_id AND rd.viewer_id <> m.sender_id
           AND (rd.viewer_id = c.user_a_id OR rd.viewer_id = c.user_b_id)
           AND m.created_at <= rd.read_at) AS is_read
FROM m_messages m
""")
def mark_read(t):
    """Messages after participants open their conversations."""
    return ch.mark_read(t, src.conversation_reads(t))


register("forum_room_history", """
SELECT room_id, id, sender_id, created_at,
       row_number() OVER (PARTITION BY room_id ORDER BY created_at, id) AS position
FROM m_forum
""")(ch.forum_room_history)

register("forum_hourly", """
SELECT room_id, date_trunc('hour', created_at) AS hour, count(*) AS messages,
       count(DISTINCT sender_id) AS senders
FROM m_forum GROUP BY 1, 2
""")(ch.forum_hourly)

register("audit_recent", """
SELECT * FROM m_admin_logs ORDER BY created_at DESC, id DESC LIMIT 100
""")(ch.audit_recent)

PROFILE_IDS = "(SELECT id FROM m_profiles)"
ADMIN_GRANTS = """
SELECT id AS viewer_id, CAST(NULL AS VARCHAR) AS row_id, true AS all_rows
FROM m_profiles WHERE role = 'admin'
"""
ORDER_PARTIES = f"""
SELECT buyer_id AS viewer_id, id AS row_id, false AS all_rows FROM m_orders
WHERE buyer_id IN {PROFILE_IDS}
UNION ALL
SELECT seller_id, id, false FROM m_orders
WHERE seller_id <> buyer_id AND seller_id IN {PROFILE_IDS}
"""

register("visible_wallets", f"""
SELECT user_id AS viewer_id, id AS row_id, false AS all_rows FROM m_wallets
WHERE user_id IN {PROFILE_IDS}
UNION ALL {ADMIN_GRANTS}
""")(vis.visible_wallets)

register("visible_orders", ORDER_PARTIES)(vis.visible_orders)

register("visible_orders_admin", ORDER_PARTIES + " UNION ALL " + ADMIN_GRANTS)(
    vis.visible_orders_admin)

register("visible_ledger", f"""
SELECT w.user_id AS viewer_id, l.id AS row_id, false AS all_rows
FROM m_ledger l JOIN m_wallets w ON w.id = l.wallet_id
WHERE w.user_id IN {PROFILE_IDS}
""")(vis.visible_ledger)

register("visible_messages", f"""
SELECT c.user_a_id AS viewer_id, m.id AS row_id, false AS all_rows
FROM m_messages m JOIN m_conversations c ON c.id = m.conversation_id
WHERE c.user_a_id IN {PROFILE_IDS}
UNION ALL
SELECT c.user_b_id, m.id, false
FROM m_messages m JOIN m_conversations c ON c.id = m.conversation_id
WHERE c.user_b_id <> c.user_a_id AND c.user_b_id IN {PROFILE_IDS}
""")(vis.visible_messages)


@register("visible_notifications", CONFIRM + f"""
SELECT user_id AS viewer_id, source_cmd || '|' || user_id || '|' || title AS row_id,
       false AS all_rows
FROM ({CONFIRM_NOTES}) n WHERE user_id IN {PROFILE_IDS}
""")
def visible_notifications(t):
    """Notifications visible to their owner (owner-equality rule)."""
    notes = cm.confirm_orders(t, src.confirm_commands(t))["notifications"]
    return vis.visible_notifications(t, notes)


ATTEMPTS = """
, ma AS (SELECT 'MA-' || event_id AS attempt_id, 'B' || user_id AS caller_id,
                CASE WHEN event_type = 'error' THEN 'B' || (user_id + 1)
                     ELSE 'B' || user_id END AS sender_id,
                'C' || (event_id % (SELECT count(*) FROM m_conversations)) AS conversation_id,
                props AS body, ts AS created_at
         FROM m_events WHERE event_type IN ('view', 'error')),
refused AS (
  SELECT attempt_id, caller_id, sender_id, conversation_id,
         CASE WHEN sender_id <> caller_id THEN 'sender is not the caller'
              ELSE 'caller is not a participant' END AS reason
  FROM ma
  WHERE sender_id <> caller_id
     OR NOT EXISTS (SELECT 1 FROM m_conversations c WHERE c.id = ma.conversation_id
                    AND (c.user_a_id = ma.caller_id OR c.user_b_id = ma.caller_id)))
"""


@register("messages_rejected", ATTEMPTS + "SELECT * FROM refused")
def messages_rejected(t):
    """Message inserts refused by the insert check (sender is caller and participant)."""
    return vis.messages_rejected(t, src.message_attempts(t, t["events"]))


@register("messages_accepted", ATTEMPTS + """
SELECT attempt_id, sender_id, conversation_id, body, created_at FROM ma
WHERE attempt_id NOT IN (SELECT attempt_id FROM refused)
""")
def messages_accepted(t):
    """Message inserts that pass the insert check."""
    return vis.messages_accepted(t, src.message_attempts(t, t["events"]))


@register("forum_inserts", ATTEMPTS + """
SELECT attempt_id, caller_id, sender_id, sender_id = caller_id AS accepted FROM ma
""")
def forum_inserts(t):
    """Forum inserts by the rule that the sender is the caller."""
    return vis.forum_inserts(src.message_attempts(t, t["events"]))


register("visible_conversations", f"""
SELECT who AS viewer_id, id AS row_id, false AS all_rows
FROM (SELECT id, unnest(list_distinct([user_a_id, user_b_id])) AS who FROM m_conversations)
WHERE who IN {PROFILE_IDS}
""")(vis.visible_conversations)

_OWNED = [("profiles_update_own", "profiles", "m_profiles", "id", "update"),
          ("wallets_own", "wallets", "m_wallets", "user_id", "all"),
          ("products_manage_own", "products", "m_products", "seller_id", "all"),
          ("reviews_own", "reviews", "m_reviews", "buyer_id", "all"),
          ("forum_delete_own", "forum_messages", "m_forum", "sender_id", "delete")]
register("owner_rows", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{p}' AS policy, '{n}' AS table_name, '{c}' AS command, {o} AS viewer_id, id::VARCHAR AS row_id FROM {m}"
    for p, n, m, o, c in _OWNED) + f") WHERE viewer_id IN {PROFILE_IDS}")(vis.owner_rows)

register("table_grants", """
SELECT id AS viewer_id, unnest(['admin_logs', 'admin_wallet', 'app_settings', 'notifications', 'orders',
         'platform_commission', 'products', 'profiles', 'reviews', 'wallet_transactions', 'wallets']) AS table_name,
       'all' AS command
FROM m_profiles WHERE role = 'admin'
UNION ALL SELECT NULL, unnest(['forum_messages', 'products', 'profiles', 'reviews']), 'select'
""")(vis.table_grants)


def _r(rule, table, key, src_, where):
    return (f"SELECT '{rule}' AS rule, '{table}' AS table_name, CAST({key} AS VARCHAR) "
            f"AS row_key FROM {src_} WHERE coalesce({where}, false)")


def _d(rule, table, key, src_):
    return (f"SELECT '{rule}', '{table}', CAST({key} AS VARCHAR) FROM {src_} "
            f"WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(*) > 1")


def _o(rule, table, key, src_, fk, parent, pk):
    return (f"SELECT '{rule}', '{table}', CAST({key} AS VARCHAR) FROM {src_} x "
            f"WHERE x.{fk} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {parent} p WHERE p.{pk} = x.{fk})")


QUALITY = " UNION ALL ".join([
    _r("profiles_role_check", "profiles", "id", "m_profiles",
       "role NOT IN ('pembeli', 'penjual', 'admin')"),
    _d("profiles_username_key", "profiles", "username", "m_profiles"),
    _r("wallets_balance_check", "wallets", "id", "m_wallets", "balance < 0"),
    _d("wallets_user_id_key", "wallets", "user_id", "m_wallets"),
    _o("wallets_user_id_fkey", "wallets", "id", "m_wallets", "user_id", "m_profiles", "id"),
    _r("products_price_check", "products", "id", "m_products", "price <= 0"),
    _r("order_status_enum", "orders", "id", "m_orders",
       "status NOT IN ('pending_payment', 'paid', 'processing', 'delivered', 'completed', "
       "'disputed', 'refunded', 'cancelled')"),
    _r("orders_total_is_price_x_qty", "orders", "id", "m_orders",
       "total_amount <> product_price * quantity"),
    _r("orders_receives_is_total_minus_fee", "orders", "id", "m_orders",
       "seller_receives <> total_amount - platform_fee"),
    _o("orders_buyer_id_fkey", "orders", "id", "m_orders", "buyer_id", "m_profiles", "id"),
    _o("orders_seller_id_fkey", "orders", "id", "m_orders", "seller_id", "m_profiles", "id"),
    _r("reviews_rating_check", "reviews", "id", "m_reviews", "NOT (rating BETWEEN 1 AND 5)"),
    _d("reviews_order_id_key", "reviews", "order_id", "m_reviews"),
    _r("different_users", "conversations", "id", "m_conversations", "user_a_id = user_b_id"),
    _r("ordered_pair", "conversations", "id", "m_conversations", "user_a_id >= user_b_id"),
    _r("messages_body_check", "messages", "id", "m_messages", "length(trim(body)) = 0"),
    _o("wallet_tx_wallet_id_fkey", "wallet_transactions", "id", "m_ledger", "wallet_id",
       "m_wallets", "id"),
    _r("wallet_tx_type_enum", "wallet_transactions", "id", "m_ledger",
       "type NOT IN ('topup', 'escrow_hold', 'escrow_release', 'refund', 'withdrawal')"),
    _r("wallet_tx_amount_positive", "wallet_transactions", "id", "m_ledger", "amount < 0"),
    _r("accounts_email_format", "accounts", "id", "m_accounts",
       "NOT coalesce(regexp_full_match(trim(email), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$'), false)"),
    "SELECT 'conversations_pair_unique', 'conversations', user_a_id || '|' || user_b_id "
    "FROM m_conversations GROUP BY user_a_id, user_b_id HAVING count(*) > 1",
])

register("quality_violations", QUALITY)(qa.quality_violations)


CHAT_ASOF = "2024-01-03 12:00:00"


@register("message_labels", f"""
SELECT id, conversation_id, created_at,
       CASE WHEN CAST(created_at AS DATE) = CAST(TIMESTAMP '{CHAT_ASOF}' AS DATE)
            THEN strftime(created_at, '%H.%M')
            ELSE day(created_at) || ' ' ||
                 (['Jan','Feb','Mar','Apr','Mei','Jun','Jul','Agu','Sep','Okt','Nov',
                   'Des'])[month(created_at)] || ' ' || strftime(created_at, '%H.%M')
       END AS time_label
FROM m_messages
""")
def message_labels(t):
    """Chat time labels: HH.mm on the as-of day, else day, month and time."""
    return ch.message_labels(t, CHAT_ASOF)


# table: its CTE, columns that may not be null
_NEEDED = {
    "profiles": ("m_profiles", "role is_suspended"),
    "wallets": ("m_wallets", "user_id balance escrow_hold total_in total_out"),
    "wallet_transactions": ("m_ledger", "wallet_id type amount balance_after created_at"),
    "products": ("m_products", "seller_id title category price is_active created_at"),
    "orders": ("m_orders", "buyer_id seller_id product_title product_price quantity total_amount "
                           "platform_fee seller_receives status created_at"),
    "reviews": ("m_reviews", "order_id buyer_id seller_id rating created_at"),
    "conversations": ("m_conversations", "user_a_id user_b_id created_at"),
    "messages": ("m_messages", "conversation_id sender_id body is_read created_at"),
    "forum_messages": ("m_forum", "room_id sender_id body created_at"),
    "admin_logs": ("m_admin_logs", "admin_id action target_type target_id created_at"),
    "platform_commission": ("m_commission", "order_id gross_amount rate fee_amount seller_net status created_at"),
    "admin_wallet": ("m_admin_wallet", "balance"),
}
_REFERS = """products.seller_id>profiles orders.product_id>products reviews.order_id>orders
reviews.buyer_id>profiles reviews.seller_id>profiles reviews.product_id>products
conversations.user_a_id>profiles conversations.user_b_id>profiles conversations.product_id>products
messages.conversation_id>conversations messages.sender_id>profiles forum_messages.sender_id>profiles
admin_logs.admin_id>profiles wallet_transactions.ref_order_id>orders platform_commission.order_id>orders"""


def _integrity() -> str:
    parts = [_r(f"{t}_{c}_not_null", t, "id", cte, f"{c} IS NULL")
             for t, (cte, cols) in _NEEDED.items() for c in cols.split()]
    for ref in _REFERS.split():
        child, parent = ref.split(">")
        table, col = child.split(".")
        parts.append(_o(f"{table}_{col}_fkey", table, "id", _NEEDED[table][0], col, _NEEDED[parent][0], "id"))
    parts.append(_r("forum_messages_sender_role_check", "forum_messages", "id", "m_forum",
                    "sender_role NOT IN ('penjual', 'pembeli')"))
    parts.append(_r("platform_commission_status_check", "platform_commission", "id", "m_commission",
                    "status NOT IN ('refunded', 'settled', 'pending')"))
    parts.append(_d("platform_commission_order_id_key", "platform_commission", "order_id", "m_commission"))
    return " UNION ALL ".join(parts)


register("integrity_violations", _integrity())(qa.integrity_violations)


# Rows that arrive and parents that never do, for the report on arrivals.
_ARRIVING = "CAST(id AS STRING) LIKE '%3'"
_LOST = {"profiles": "id LIKE '%41'", "products": "CAST(id AS STRING) LIKE '%5'"}
_CHECKED = {n: cte for n, (cte, _) in _NEEDED.items()} | {"accounts": "m_accounts"}


def _report_before_and_after() -> str:
    report = QUALITY + " UNION ALL " + _integrity()
    ctes = "".join(f""",
{cte.replace("m_", "f_", 1)} AS (SELECT * FROM {cte} WHERE NOT coalesce({_LOST.get(n, "false")}, false)),
{cte.replace("m_", "b_", 1)} AS (SELECT * FROM {cte.replace("m_", "f_", 1)} WHERE NOT coalesce({_ARRIVING}, false))"""
                   for n, cte in _CHECKED.items())
    of = lambda prefix: "(" + re.sub(r"\bm_(?=[a-z_]+\b)", prefix, report) + ")"
    return ctes + f"\nSELECT * FROM {of('f_')} EXCEPT ALL SELECT * FROM {of('b_')}"


@register("arrival_violations", _report_before_and_after())
def arrival_violations(t):
    """Rules that a tenth of every table, arriving as one batch, breaks: what the full
    reports say after the batch and didn't before."""
    kept = {n: t[n].filter(f"not coalesce({_LOST.get(n, 'false')}, false)") for n in _CHECKED}
    old = {n: df.filter(f"not coalesce({_ARRIVING}, false)") for n, df in kept.items()}
    return qa.arrival_violations(old, {n: df.filter(_ARRIVING) for n, df in kept.items()})


@register("notification_violations", CONFIRM + f"""
, n AS (SELECT source_cmd || '|' || user_id AS id, * FROM ({CONFIRM_NOTES}))
SELECT 'notifications_user_id_fkey' AS rule, 'notifications' AS table_name, id AS row_key
FROM n WHERE user_id NOT IN {PROFILE_IDS}
UNION ALL
SELECT 'notifications_type_check', 'notifications', id FROM n
WHERE type NOT IN ('info', 'success', 'warning', 'error')
""")
def notification_violations(t):
    """Rules of the notifications that order confirmations write."""
    notes = cm.confirm_orders(t, src.confirm_commands(t))["notifications"]
    return qa.notification_violations(t, notes)
