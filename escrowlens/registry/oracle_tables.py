"""The marketplace mapping of FIXTURES.md §2 written as DuckDB SQL.

Used only by the correctness oracle: every oracle query is ``WITH <these
CTEs> <query>``, so the oracle derives the marketplace tables from the driver
views independently of the Spark code.  CTE names carry an ``m_`` prefix
because the driver views already use the names ``orders`` and
``conversations``.
"""

from __future__ import annotations

CTES = r"""
m_lines0 AS (
  SELECT concat_ws('-', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
                   CAST(l.l_quantity AS BIGINT),
                   CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS id,
         'B' || o.o_custkey AS buyer_id,
         'S' || l.l_suppkey AS seller_id,
         CASE WHEN l.l_linenumber = 7 THEN NULL ELSE l.l_partkey END AS product_id,
         p.p_name AS product_title,
         CAST(l.l_quantity AS BIGINT) AS quantity,
         CAST(round(l.l_extendedprice * 100) AS BIGINT) AS total_amount,
         CASE o.o_orderstatus
           WHEN 'F' THEN CASE WHEN l.l_linestatus = 'F' THEN 'completed' ELSE 'delivered' END
           WHEN 'O' THEN CASE WHEN l.l_linestatus = 'F' THEN 'processing'
                              WHEN l.l_returnflag = 'A' THEN 'paid'
                              WHEN l.l_returnflag = 'N' THEN 'pending_payment'
                              ELSE 'cancelled' END
           WHEN 'P' THEN CASE WHEN l.l_linestatus = 'F' THEN
                                CASE WHEN l.l_returnflag = 'A' THEN 'paid'
                                     WHEN l.l_returnflag = 'N' THEN 'delivered'
                                     ELSE 'refunded' END
                              WHEN l.l_returnflag = 'A' THEN 'processing'
                              WHEN l.l_returnflag = 'N' THEN 'pending_payment'
                              ELSE 'disputed' END
         END AS status,
         CAST(o.o_orderdate AS TIMESTAMP) AS created_at,
         l.l_linenumber AS line_number
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
m_lines1 AS (
  SELECT *, CASE WHEN status IN ('delivered', 'completed')
                 THEN created_at + to_hours(quantity) END AS delivered_at
  FROM m_lines0
),
m_lines AS (
  SELECT *, CASE WHEN status = 'completed' THEN delivered_at + INTERVAL 1 DAY END AS completed_at
  FROM m_lines1
),
m_orders AS (
  SELECT id, buyer_id, seller_id, product_id, product_title,
         total_amount // quantity AS product_price, quantity, total_amount,
         total_amount * 500 // 10000 AS platform_fee,
         total_amount - total_amount * 500 // 10000 AS seller_receives,
         status,
         CAST(NULL AS VARCHAR) AS midtrans_order_id,
         CAST(NULL AS VARCHAR) AS buyer_note,
         CAST(NULL AS VARCHAR) AS delivery_note,
         delivered_at, completed_at,
         CAST(NULL AS TIMESTAMP) AS auto_complete_at,
         created_at,
         coalesce(completed_at, delivered_at, created_at) AS updated_at,
         CAST(0.05 AS DECIMAL(5,4)) AS commission_rate,
         CASE WHEN status = 'completed' AND product_id IS NOT NULL
              THEN total_amount - total_amount * 500 // 10000 ELSE 0 END AS seller_payout
  FROM m_lines
),
m_people AS (
  SELECT 'B' AS kind, c_custkey AS key, c_name AS name, c_acctbal AS acctbal FROM customer
  UNION ALL
  SELECT 'S' AS kind, s_suppkey AS key, s_name AS name, s_acctbal AS acctbal FROM supplier
),
m_profiles AS (
  SELECT kind || key AS id, name AS full_name,
         CASE WHEN key % 7 = 0 THEN NULL ELSE lower(name) END AS username,
         CASE WHEN kind = 'B' AND key IN (0, 1) THEN 'admin'
              WHEN kind = 'B' THEN 'pembeli' ELSE 'penjual' END AS role,
         CAST(NULL AS VARCHAR) AS avatar_url,
         acctbal < 0 AS is_suspended,
         CAST(NULL AS VARCHAR) AS suspended_reason
  FROM m_people
),
m_accounts AS (
  SELECT kind || key AS id, replace(lower(name), '#', '.') || '@mail.test' AS email
  FROM m_people
),
m_wallets AS (
  SELECT 'W-' || p.kind || p.key AS id, p.kind || p.key AS user_id,
         greatest(CAST(round(p.acctbal * 100) AS BIGINT), 0) AS balance,
         CAST(coalesce(h.escrow_hold, 0) AS BIGINT) AS escrow_hold,
         CAST(0 AS BIGINT) AS total_in, CAST(0 AS BIGINT) AS total_out
  FROM m_people p
  LEFT JOIN (SELECT seller_id, sum(total_amount) AS escrow_hold FROM m_orders
             WHERE status IN ('paid', 'processing') GROUP BY seller_id) h
    ON h.seller_id = p.kind || p.key
  WHERE p.key % 50 <> 49
),
m_products AS (
  SELECT p_partkey AS id,
         'S' || (p_partkey % (SELECT count(*) FROM supplier)) AS seller_id,
         p_name AS title, CAST(NULL AS VARCHAR) AS description,
         CASE WHEN p_type IN ('ECONOMY', 'MEDIUM') THEN 'digital'
              WHEN p_type IN ('STANDARD', 'SMALL') THEN 'game' ELSE 'jasa' END AS category,
         CASE WHEN p_type IN ('STANDARD', 'SMALL') THEN
           (['mobile-legends', 'free-fire', 'pubg-mobile', 'valorant', 'genshin-impact',
             'roblox'])[p_partkey % 6 + 1] END AS subcategory,
         CAST(round(p_retailprice * 100) AS BIGINT) AS price,
         p_size - 1 AS stock,
         'Instan' AS badge, CAST(NULL AS VARCHAR) AS icon,
         '#16A37A' AS grad_start, '#0E7C5B' AS grad_end,
         p_partkey % 10 <> 0 AS is_active,
         CAST(0 AS BIGINT) AS rating_sum, CAST(0 AS BIGINT) AS rating_count,
         CAST(0 AS BIGINT) AS sold_count,
         TIMESTAMP '2001-01-01 00:00:00' + to_minutes(p_partkey) AS created_at,
         CAST(NULL AS VARCHAR[]) AS photos, CAST(NULL AS VARCHAR) AS cover_image
  FROM part
),
m_reviews AS (
  SELECT 'R-' || id AS id, id AS order_id, buyer_id, seller_id, product_id,
         quantity % 5 + 1 AS rating, CAST(NULL AS VARCHAR) AS comment,
         completed_at AS created_at
  FROM m_lines WHERE status = 'completed' AND line_number % 2 = 0
),
m_commission AS (
  SELECT 'PC-' || id AS id, id AS order_id, total_amount AS gross_amount,
         CAST(0.05 AS DECIMAL(5,4)) AS rate,
         total_amount * 500 // 10000 AS fee_amount,
         total_amount - total_amount * 500 // 10000 AS seller_net,
         'settled' AS status, completed_at AS settled_at, completed_at AS created_at
  FROM m_orders WHERE status = 'completed' AND product_id IS NOT NULL
),
m_settings AS (
  SELECT 'commission_rate' AS key, '0.05' AS value,
         TIMESTAMP '2001-01-01 00:00:00' AS updated_at
),
m_admin_wallet AS (
  SELECT 'AW-1' AS id, CAST(coalesce(sum(fee_amount), 0) AS BIGINT) AS balance,
         TIMESTAMP '2001-01-01 00:00:00' AS created_at,
         TIMESTAMP '2001-01-01 00:00:00' AS updated_at
  FROM m_commission WHERE status = 'settled'
),
m_conv_base AS (
  SELECT conv_id, least(a, b) AS user_a_id, greatest(a, b) AS user_b_id,
         conv_id % (SELECT count(*) FROM part) AS product_id
  FROM (SELECT conv_id,
               'B' || (conv_id * 7 % (SELECT count(*) FROM customer)) AS a,
               'S' || (conv_id % (SELECT count(*) FROM supplier)) AS b
        FROM (SELECT DISTINCT conv_id FROM conversations))
),
m_conversations AS (
  SELECT 'C' || conv_id AS id, user_a_id, user_b_id, product_id,
         CAST(NULL AS VARCHAR) AS last_message,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) AS last_message_at,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) AS created_at
  FROM m_conv_base
),
m_messages AS (
  SELECT c.conv_id || '-' || c.turn AS id, 'C' || c.conv_id AS conversation_id,
         CASE WHEN c.role = 'user' THEN v.user_a_id ELSE v.user_b_id END AS sender_id,
         c.text AS body, c.turn < l.last_turn AS is_read,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(c.conv_id) + to_minutes(c.turn)
           AS created_at
  FROM conversations c
  JOIN (SELECT conv_id, max(turn) AS last_turn FROM conversations
        WHERE role <> 'system' GROUP BY conv_id) l ON l.conv_id = c.conv_id
  JOIN m_conv_base v ON v.conv_id = c.conv_id
  WHERE c.role <> 'system'
),
m_events AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value, props,
         CAST(round(value * 100) AS BIGINT) AS cents
  FROM events
),
m_forum AS (
  SELECT 'F' || event_id AS id, 'room-' || (user_id % 5) AS room_id,
         'B' || user_id AS sender_id, CAST(NULL AS VARCHAR) AS sender_name,
         'pembeli' AS sender_role, props AS body, CAST(NULL AS VARCHAR) AS image_url,
         ts AS created_at
  FROM m_events WHERE event_type = 'click'
),
m_wallet_commands AS (
  SELECT event_id AS seq, 'B0' AS actor_id, 'B' || user_id AS user_id,
         CASE WHEN event_type = 'purchase' THEN cents ELSE -cents END AS amount,
         'event ' || event_type AS reason, ts AS created_at
  FROM m_events WHERE event_type IN ('purchase', 'error')
),
m_ledger AS (
  SELECT 'T' || event_id AS id, 'W-B' || user_id AS wallet_id,
         CASE event_type WHEN 'purchase' THEN 'topup' WHEN 'error' THEN 'withdrawal'
              ELSE 'escrow_release' END AS type,
         cents AS amount,
         CAST(sum(CASE WHEN event_type = 'error' THEN -cents ELSE cents END)
              OVER (PARTITION BY user_id ORDER BY ts, event_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
           + CASE WHEN event_type = 'click' THEN cents ELSE 0 END AS balance_after,
         'event ' || event_type AS description, CAST(NULL AS VARCHAR) AS ref_order_id,
         ts AS created_at
  FROM m_events WHERE event_type IN ('purchase', 'error', 'click')
),
m_admin_logs AS (
  SELECT 'L' || event_id AS id, 'B0' AS admin_id,
         (['suspend_user', 'change_role', 'update_order_status', 'force_refund',
           'adjust_wallet', 'deactivate_product'])[event_id % 6 + 1] AS action,
         (['user', 'user', 'order', 'order', 'wallet', 'product'])[event_id % 6 + 1]
           AS target_type,
         'B' || user_id AS target_id, props AS detail, ts AS created_at
  FROM m_events WHERE event_type = 'signup'
),
m_status_events AS (
  SELECT event_id, user_id AS order_key,
         CASE event_type WHEN 'purchase' THEN 'paid' WHEN 'click' THEN 'processing'
              WHEN 'view' THEN 'delivered' WHEN 'error' THEN 'disputed'
              ELSE 'completed' END AS status,
         ts
  FROM m_events
  UNION ALL
  SELECT event_id, user_id AS order_key,
         CASE event_type WHEN 'purchase' THEN 'paid' WHEN 'click' THEN 'processing'
              WHEN 'view' THEN 'delivered' WHEN 'error' THEN 'disputed'
              ELSE 'completed' END AS status,
         ts
  FROM m_events WHERE event_id % 10 = 0
),
m_order_events AS (
  SELECT id AS order_id, 'delivered' AS status, delivered_at AS ts FROM m_orders
  WHERE delivered_at IS NOT NULL
  UNION ALL
  SELECT id, 'completed', completed_at FROM m_orders WHERE completed_at IS NOT NULL
),
m_settle_cmds AS (
  SELECT 'ST-' || id AS cmd_id, id AS order_id,
         coalesce(completed_at, delivered_at, created_at) AS requested_at
  FROM m_orders WHERE status IN ('completed', 'delivered')
),
m_status_cmds AS (
  SELECT 'SS-' || id AS cmd_id, id AS order_id,
         CASE WHEN quantity = 17 THEN 'not_a_status' WHEN status = 'delivered' THEN 'completed'
              WHEN status = 'paid' THEN 'processing' ELSE 'delivered' END AS new_status,
         'batch ' || status AS note,
         CASE WHEN quantity = 13 THEN 'B2' ELSE 'B0' END AS actor_id,
         updated_at AS requested_at
  FROM m_orders WHERE status IN ('delivered', 'paid', 'processing')
),
m_confirm_cmds AS (
  SELECT 'CF-' || id AS cmd_id, id AS order_id,
         CASE WHEN quantity = 7 THEN seller_id ELSE buyer_id END AS caller_id,
         updated_at AS requested_at
  FROM m_orders WHERE status IN ('delivered', 'processing')
),
m_refund_cmds AS (
  SELECT 'RF-' || id AS cmd_id, id AS order_id,
         CASE WHEN quantity % 3 = 0 THEN NULL ELSE 'sengketa ' || status END AS reason,
         'B0' AS actor_id, updated_at AS requested_at
  FROM m_orders WHERE status IN ('disputed', 'completed', 'cancelled', 'paid')
  UNION ALL
  SELECT 'RF2-' || id AS cmd_id, id AS order_id, 'ulang' AS reason, 'B0' AS actor_id,
         updated_at + INTERVAL 1 HOUR AS requested_at
  FROM m_orders WHERE status = 'disputed' AND quantity = 11
),
m_suspend_cmds AS (
  SELECT 'SU-' || event_id AS cmd_id, 'B' || user_id AS user_id, value >= 25 AS suspend,
         CASE WHEN value >= 25 THEN 'spam ' || props END AS reason,
         'B0' AS actor_id, ts AS requested_at
  FROM m_events WHERE event_type = 'view'
),
m_role_cmds AS (
  SELECT 'RO-' || event_id AS cmd_id, 'B' || user_id AS user_id,
         (['pembeli', 'penjual', 'admin', 'moderator'])[event_id % 4 + 1] AS new_role,
         'B0' AS actor_id, ts AS requested_at
  FROM m_events WHERE event_type = 'signup'
),
m_toggle_cmds AS (
  SELECT 'TG-' || id AS cmd_id, id AS product_id, NOT is_active AS active,
         'stok ' || stock AS reason, 'B0' AS actor_id,
         TIMESTAMP '2001-08-01 00:00:00' AS requested_at
  FROM m_products WHERE stock < 5
  UNION ALL
  SELECT 'TGX-' || id AS cmd_id, -1 - id AS product_id, false AS active,
         CAST(NULL AS VARCHAR) AS reason, 'B0' AS actor_id,
         TIMESTAMP '2001-08-01 00:00:00' AS requested_at
  FROM m_products WHERE stock = 0
),
m_conv_requests AS (
  SELECT 'CR-' || event_id AS req_id, 'B' || user_id AS me_id,
         CASE WHEN event_type = 'error' AND value < 5 THEN 'B' || user_id
              ELSE 'S' || (user_id % (SELECT count(*) FROM supplier)) END AS other_id,
         CASE WHEN value < 20 THEN NULL ELSE event_id % (SELECT count(*) FROM part) END
           AS product_id,
         ts AS requested_at
  FROM m_events WHERE event_type IN ('click', 'error')
),
m_signups AS (
  SELECT 'U' || event_id AS account_id, 'user' || user_id || '@mail.test' AS email,
         props AS raw_user_meta_data, ts AS created_at
  FROM m_events WHERE event_type = 'signup'
)
"""


def with_tables(query: str) -> str:
    """Prefix a query with the marketplace CTEs (it may add CTEs of its own
    by starting with ``, name AS (...)``)."""
    q = query.strip()
    head = "WITH"
    if q.startswith("RECURSIVE"):
        head, q = "WITH RECURSIVE", q[len("RECURSIVE"):].strip()
    if q.startswith(","):
        return head + CTES + q
    return head + CTES + "\n" + q
