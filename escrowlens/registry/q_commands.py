"""Registered command-table operators.

Oracle SQL states each procedure the plain way (row_number for "first per
order", lag for "previous", recursive CTEs for floors and refusals), so it is
independent of the Spark formulation (partial aggregates, day buckets,
streaming fold).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from escrowlens.operators import audit_details as ad
from escrowlens.operators import commands as cm
from escrowlens.registry.core import register
from escrowlens.session import scratch_path
from escrowlens.sources import commands as src
from escrowlens.sources.schemas import ORDER_EVOLUTION, conform, ensure_columns, read_evolved
from escrowlens.sources.versions import VersionedTable, append_batch, appended

SETTING = "(SELECT value FROM m_settings WHERE key = 'commission_rate' ORDER BY updated_at DESC LIMIT 1)"
ADMIN_ERR = "'Tidak punya akses admin.'"
RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def settle_ctes(source: str, setting: str = SETTING) -> str:
    """Settlement of the commands in ``source`` under the text of a rate setting."""
    return f"""
, s_set AS (SELECT {setting} AS txt),
s_rate AS (SELECT coalesce(try_cast(txt AS DECIMAL(18,17)), CAST(0.05 AS DECIMAL(18,17))) AS rate,
                  CASE WHEN txt IS NULL THEN NULL
                       WHEN try_cast(txt AS DOUBLE) IS NULL
                         THEN 'invalid input syntax for type numeric: "' || txt || '"'
                       WHEN abs(try_cast(txt AS DOUBLE)) >= 9.99995 THEN 'numeric field overflow'
                  END AS rate_error
           FROM s_set),
s_op AS (SELECT o.id AS order_id, o.total_amount, p.seller_id AS p_seller
           FROM m_orders o JOIN m_products p ON p.id = o.product_id),
s_c AS (SELECT c.cmd_id, c.order_id, c.requested_at, s_op.total_amount, s_op.p_seller,
               rate, rate_error, (SELECT count(*) FROM m_admin_wallet) AS n_aw,
               c.order_id IN (SELECT order_id FROM m_commission WHERE status = 'settled')
                 AS already
        FROM {source} c CROSS JOIN s_rate LEFT JOIN s_op ON s_op.order_id = c.order_id),
s_e AS (SELECT *, CASE WHEN rate_error IS NOT NULL THEN rate_error
                       WHEN p_seller IS NULL THEN 'Order tidak ditemukan'
                       WHEN n_aw = 0 THEN 'admin_wallet belum ada row sama sekali.' END
                    AS error
        FROM s_c),
s_f AS (SELECT *, error IS NULL AS ok,
               error IS NULL AND row_number() OVER (PARTITION BY order_id, error IS NULL
                                                    ORDER BY requested_at, cmd_id) = 1
                 AS is_first,
               CASE WHEN error IS NULL THEN CAST(floor(total_amount * rate) AS BIGINT) END
                 AS fee
        FROM s_e),
s_out AS (SELECT cmd_id, order_id, ok, error, CASE WHEN ok THEN total_amount END AS gross,
                 fee, total_amount - fee AS seller_net, is_first AND NOT already AS applied
          FROM s_f),
s_a AS (SELECT s_f.*, total_amount - fee AS net, coalesce(w.balance, 0) AS bal0,
               coalesce(w.id, 'W-' || p_seller) AS wallet_id
        FROM s_f LEFT JOIN m_wallets w ON w.user_id = s_f.p_seller
        WHERE is_first AND NOT already)
"""


SETTLED_LEDGER = f"""
SELECT wallet_id, 'escrow_release' AS type, net AS amount,
       bal0 + CAST(sum(net) OVER (PARTITION BY p_seller ORDER BY requested_at, cmd_id {RUN})
                   AS BIGINT) AS balance_after,
       'Penjualan order #' || left(order_id, 8) || ' (komisi '
         || CAST(round(rate * 100) AS BIGINT) || '%)' AS description,
       order_id AS ref_order_id, requested_at AS created_at, cmd_id AS source_cmd
FROM s_a
"""
SETTLED_WALLETS = """
SELECT p_seller AS user_id, wallet_id, bal0 AS balance_before,
       CAST(sum(net) AS BIGINT) AS credited, bal0 + CAST(sum(net) AS BIGINT) AS balance_after
FROM s_a GROUP BY p_seller, wallet_id, bal0
"""
SETTLED_COMMISSION = """
, n AS (SELECT order_id, total_amount AS gross_amount, CAST(rate AS DECIMAL(5,4)) AS rate,
               fee AS fee_amount, net AS seller_net, requested_at FROM s_a)
SELECT id, order_id, gross_amount, CAST(rate AS DOUBLE) AS rate, fee_amount, seller_net,
       status, settled_at, created_at
FROM m_commission WHERE order_id NOT IN (SELECT order_id FROM n)
UNION ALL
SELECT coalesce(o.id, 'PC-' || n.order_id), n.order_id,
       coalesce(o.gross_amount, n.gross_amount), CAST(coalesce(o.rate, n.rate) AS DOUBLE),
       n.fee_amount, n.seller_net, 'settled', n.requested_at,
       coalesce(o.created_at, n.requested_at)
FROM n LEFT JOIN m_commission o ON o.order_id = n.order_id
"""
SETTLED_ADMIN_WALLET = """
, a_all AS (SELECT * FROM m_admin_wallet {more}),
a_hit AS (SELECT id FROM a_all ORDER BY created_at NULLS LAST, id LIMIT 1),
a_sum AS (SELECT CAST(sum(fee) AS BIGINT) AS fees, max(requested_at) AS done_at FROM s_a)
SELECT a_all.id, CASE WHEN a_all.id = a_hit.id THEN balance + coalesce(fees, 0) ELSE balance END AS balance,
       created_at, CASE WHEN a_all.id = a_hit.id THEN coalesce(done_at, updated_at) ELSE updated_at END AS updated_at
FROM a_all, a_hit, a_sum
"""


ORDERS_PER_PART = 20_000
SETTLE = settle_ctes("m_settle_cmds")


def _cmds(t):
    return src.settle_commands(t)


register("settle_commission", SETTLE + "SELECT * FROM s_out")(
    lambda t: cm.settle_commission(t, _cmds(t))["outcomes"])

register("settle_ledger", SETTLE + SETTLED_LEDGER)(
    lambda t: cm.settle_commission(t, _cmds(t))["ledger"])

register("settle_wallets", SETTLE + SETTLED_WALLETS)(
    lambda t: cm.settle_commission(t, _cmds(t))["wallets"])

register("commission_upsert", SETTLE + SETTLED_COMMISSION)(
    lambda t: cm.settle_commission(t, _cmds(t))["commission"])

register("settle_admin_wallet", SETTLE + SETTLED_ADMIN_WALLET.format(more=""))(
    lambda t: cm.settle_commission(t, _cmds(t))["admin_wallet"])


def _with_setting(t, value):
    """The tables with another text in the rate setting."""
    return {**{k: t[k] for k in ("orders", "products", "wallets", "platform_commission", "admin_wallet")},
            "app_settings": t["app_settings"].withColumn("value", F.lit(value))}


def _two_admin_wallets(t):
    """The tables with a younger admin wallet row beside the first."""
    young = t["admin_wallet"].select(
        F.lit("AW-0").alias("id"), F.lit(7).cast("bigint").alias("balance"),
        F.timestamp_add("DAY", F.lit(1), F.col("created_at")).alias("created_at"), "updated_at")
    return {**_with_setting(t, "0.00125"), "admin_wallet": t["admin_wallet"].unionByName(young)}


register("settle_exact_rate", settle_ctes("m_settle_cmds", "'0.00125'") + "SELECT * FROM s_out")(
    lambda t: cm.settle_commission(_with_setting(t, "0.00125"), _cmds(t))["outcomes"])

register("settle_exact_rate_commission", settle_ctes("m_settle_cmds", "'0.00125'") + SETTLED_COMMISSION)(
    lambda t: cm.settle_commission(_with_setting(t, "0.00125"), _cmds(t))["commission"])

register("settle_bad_rate", settle_ctes("m_settle_cmds", "'abc'") + "SELECT * FROM s_out")(
    lambda t: cm.settle_commission(_with_setting(t, "abc"), _cmds(t))["outcomes"])

register("settle_oldest_admin_wallet", settle_ctes("m_settle_cmds", "'0.00125'") + SETTLED_ADMIN_WALLET.format(
    more="UNION ALL SELECT 'AW-0', 7, created_at + INTERVAL 1 DAY, updated_at FROM m_admin_wallet"))(
    lambda t: cm.settle_commission(_two_admin_wallets(t), _cmds(t))["admin_wallet"])


@register("commission_published", SETTLE + SETTLED_COMMISSION, needs_session=True)
def commission_published(t, spark, sf_dir):
    """The commission table after settlement: only the ranges of order numbers with a
    settled order are written anew; the batch, settled once and kept, is repeated, as
    after a failure."""
    rows = cm.settle_commission(t, _cmds(t))["commission_changes"]
    part = F.floor(F.split_part("order_id", F.lit("-"), F.lit(1)).cast("bigint") / ORDERS_PER_PART)
    before = t["platform_commission"].select(*[F.col(f.name).cast(f.dataType) for f in rows.schema.fields])
    table = VersionedTable.create(before, "commission", ["order_id"], part)
    path = scratch_path(spark, "settled-commission")
    append_batch(rows, path, 1)
    for _ in range(2):
        table.upsert(appended(spark, path, rows.schema), 1)
    return table.read()


@register("ledger_appended", SETTLE + """
SELECT id, wallet_id, type, amount, balance_after, description, ref_order_id, created_at FROM m_ledger
UNION ALL
SELECT source_cmd, wallet_id, type, amount, balance_after, description, ref_order_id, created_at
FROM (""" + SETTLED_LEDGER + ")", needs_session=True)
def ledger_appended(t, spark, sf_dir):
    """The ledger with the settlement's rows appended, as the table's readers see it."""
    path = scratch_path(spark, "table-ledger")
    old = t["wallet_transactions"]
    append_batch(old, path, 0)
    new = cm.settle_commission(t, _cmds(t))["ledger"].withColumnRenamed("source_cmd", "id")
    for _ in range(2):  # the job is repeated, its rows are not
        append_batch(conform(new, "wallet_transactions", "2001-08-01 00:00:00").select(*old.columns), path, 1)
    return appended(spark, path, old.schema)

# ---------------------------------------------------------------- J5

STATUS = f"""
, st AS (SELECT s.*, coalesce(p.role = 'admin', false) AS is_admin
         FROM m_status_cmds s LEFT JOIN m_profiles p ON p.id = s.actor_id),
sc AS (SELECT cmd_id, order_id, requested_at FROM st
       WHERE is_admin AND new_status = 'completed')
{settle_ctes("sc")}
, st_o AS (SELECT st.*, CASE WHEN NOT st.is_admin THEN {ADMIN_ERR}
                             WHEN s_rate.rate_error IS NOT NULL THEN s_rate.rate_error
                             WHEN st.new_status IS NULL OR st.new_status NOT IN (
                               'pending_payment', 'paid', 'processing', 'delivered', 'completed',
                               'cancelled', 'disputed', 'refunded')
                             THEN 'invalid input value for enum order_status: "' || coalesce(st.new_status, '') || '"'
                             WHEN st.new_status = 'completed' AND NOT coalesce(s_out.ok, false)
                             THEN 'Gagal proses komisi: ' || coalesce(s_out.error, '') END
                          AS error
           FROM st CROSS JOIN s_rate LEFT JOIN s_out ON s_out.cmd_id = st.cmd_id)
"""

register("apply_status", STATUS + """
SELECT cmd_id, order_id, new_status, error IS NULL AS ok, error FROM st_o
""")(lambda t: cm.apply_status(t, src.status_commands(t))["outcomes"])

register("apply_status_orders", STATUS + """
, l AS (SELECT order_id, new_status,
               row_number() OVER (PARTITION BY order_id ORDER BY requested_at DESC,
                                  cmd_id DESC) AS rn
        FROM st_o WHERE error IS NULL)
SELECT o.id AS order_id, o.status AS old_status, l.new_status AS status
FROM m_orders o JOIN l ON l.order_id = o.id AND l.rn = 1
""")(lambda t: cm.apply_status(t, src.status_commands(t))["orders"])

for _name, _sql in (("ledger", SETTLED_LEDGER), ("wallets", SETTLED_WALLETS),
                    ("commission", SETTLED_COMMISSION),
                    ("admin_wallet", SETTLED_ADMIN_WALLET.format(more=""))):
    register(f"apply_status_{_name}", STATUS + _sql)(
        lambda t, _name=_name: cm.apply_status(t, src.status_commands(t))[_name])

# ---------------------------------------------------------------- J6

CONFIRM = """
, cf AS (SELECT c.*, o.buyer_id, o.seller_id, o.status, o.total_amount, o.seller_receives,
                o.product_title,
                coalesce(o.status = 'delivered' AND o.buyer_id = c.caller_id, false) AS elig
         FROM m_confirm_cmds c LEFT JOIN m_orders o ON o.id = c.order_id),
cf_f AS (SELECT *, elig AND row_number() OVER (PARTITION BY order_id, elig
                                               ORDER BY requested_at, cmd_id) = 1 AS ok
         FROM cf),
cf_a AS (SELECT cf_f.*, w.id AS wallet_id, w.balance AS bal0, w.escrow_hold AS esc0,
                w.total_in AS in0,
                row_number() OVER (PARTITION BY cf_f.seller_id
                                   ORDER BY requested_at, cmd_id) AS rn
         FROM cf_f JOIN m_wallets w ON w.user_id = cf_f.seller_id WHERE ok)
"""
CONFIRM_NOTES = """
SELECT seller_id AS user_id, '✅ Dana rekber cair!' AS title,
       'Pembeli konfirmasi terima pesanan "' || product_title || '". Dana Rp '
         || format('{:,}', seller_receives) || ' sudah masuk ke saldo kamu.' AS body,
       'success' AS type, order_id AS ref_order_id, requested_at AS created_at,
       cmd_id AS source_cmd
FROM cf_f WHERE ok
UNION ALL
SELECT buyer_id, '🎉 Pesanan selesai!',
       'Pesanan "' || product_title || '" sudah kamu konfirmasi selesai.', 'success',
       order_id, requested_at, cmd_id
FROM cf_f WHERE ok
"""

register("confirm_orders", CONFIRM + """
SELECT cmd_id, order_id, caller_id, ok,
       CASE WHEN NOT ok THEN 'Pesanan tidak ditemukan atau belum berstatus delivered.' END
         AS error
FROM cf_f
""")(lambda t: cm.confirm_orders(t, src.confirm_commands(t))["outcomes"])

register("confirm_ledger", CONFIRM + f"""
SELECT wallet_id, 'escrow_release' AS type, seller_receives AS amount,
       bal0 + CAST(sum(seller_receives) OVER (PARTITION BY seller_id
                                              ORDER BY requested_at, cmd_id {RUN})
                   AS BIGINT) AS balance_after,
       'Dana rekber cair — ' || product_title AS description, order_id AS ref_order_id,
       requested_at AS created_at, cmd_id AS source_cmd
FROM cf_a
""")(lambda t: cm.confirm_orders(t, src.confirm_commands(t))["ledger"])

register("confirm_wallets", "RECURSIVE" + CONFIRM + """
, cf_rec AS (
  SELECT seller_id, rn, greatest(esc0 - total_amount, 0) AS esc FROM cf_a WHERE rn = 1
  UNION ALL
  SELECT a.seller_id, a.rn, greatest(r.esc - a.total_amount, 0)
  FROM cf_rec r JOIN cf_a a ON a.seller_id = r.seller_id AND a.rn = r.rn + 1),
g AS (SELECT seller_id, wallet_id, max(rn) AS n,
             bal0 + CAST(sum(seller_receives) AS BIGINT) AS balance,
             in0 + CAST(sum(seller_receives) AS BIGINT) AS total_in
      FROM cf_a GROUP BY seller_id, wallet_id, bal0, in0)
SELECT g.seller_id AS user_id, g.wallet_id, g.balance, CAST(r.esc AS BIGINT) AS escrow_hold,
       g.total_in
FROM g JOIN cf_rec r ON r.seller_id = g.seller_id AND r.rn = g.n
""")(lambda t: cm.confirm_orders(t, src.confirm_commands(t))["wallets"])

register("confirm_notifications", CONFIRM + CONFIRM_NOTES)(
    lambda t: cm.confirm_orders(t, src.confirm_commands(t))["notifications"])

# ---------------------------------------------------------------- J7

REFUND = f"""
, rf AS (SELECT c.*, coalesce(a.role = 'admin', false) AS is_admin, o.buyer_id, o.seller_id,
                o.status, o.total_amount, o.product_title
         FROM m_refund_cmds c LEFT JOIN m_profiles a ON a.id = c.actor_id
         LEFT JOIN m_orders o ON o.id = c.order_id),
rf_e AS (SELECT *, is_admin AND buyer_id IS NOT NULL
                   AND coalesce(status IN ('paid', 'processing', 'delivered', 'disputed'), false)
                   AS elig
         FROM rf),
rf_f AS (SELECT *, elig AND row_number() OVER (PARTITION BY order_id, elig
                                               ORDER BY requested_at, cmd_id) = 1 AS ok
         FROM rf_e),
rf_o AS (SELECT *, CASE WHEN NOT is_admin THEN {ADMIN_ERR}
                        WHEN buyer_id IS NULL THEN 'Pesanan tidak ditemukan.'
                        WHEN status NOT IN ('paid', 'processing', 'delivered', 'disputed')
                          THEN 'Status pesanan tidak bisa direfund (' || status || ').'
                        WHEN NOT ok THEN 'Status pesanan tidak bisa direfund (refunded).'
                   END AS error
         FROM rf_f),
rb AS (SELECT rf_o.*, coalesce(w.id, 'W-' || buyer_id) AS wallet_id,
              coalesce(w.balance, 0) AS bal0, coalesce(w.total_in, 0) AS in0
       FROM rf_o LEFT JOIN m_wallets w ON w.user_id = rf_o.buyer_id WHERE ok)
"""
REFUND_NOTES = """
SELECT buyer_id AS user_id, 'Dana Dikembalikan' AS title,
       'Pesanan "' || product_title || '" direfund oleh admin.'
         || coalesce(' Alasan: ' || reason, '') AS body,
       'info' AS type, order_id AS ref_order_id, requested_at AS created_at,
       cmd_id AS source_cmd
FROM rf_o WHERE ok
UNION ALL
SELECT seller_id, 'Pesanan Direfund Admin',
       'Pesanan "' || product_title || '" direfund ke pembeli oleh admin.'
         || coalesce(' Alasan: ' || reason, ''),
       'warning', order_id, requested_at, cmd_id
FROM rf_o WHERE ok
"""
REFUND_AUDIT = """
SELECT actor_id AS admin_id, 'force_refund' AS action, 'order' AS target_type,
       order_id AS target_id,
       CAST(json_object('amount', total_amount, 'reason', reason) AS VARCHAR) AS detail,
       requested_at AS created_at, cmd_id AS source_cmd
FROM rf_o WHERE ok
"""

register("refund_orders", REFUND + "SELECT cmd_id, order_id, ok, error FROM rf_o")(
    lambda t: cm.refund_orders(t, src.refund_commands(t))["outcomes"])

register("refund_ledger", REFUND + f"""
SELECT wallet_id, 'refund' AS type, total_amount AS amount,
       bal0 + CAST(sum(total_amount) OVER (PARTITION BY buyer_id
                                           ORDER BY requested_at, cmd_id {RUN}) AS BIGINT)
         AS balance_after,
       'Refund admin - ' || product_title || coalesce(' (' || reason || ')', '')
         AS description,
       order_id AS ref_order_id, requested_at AS created_at, cmd_id AS source_cmd
FROM rb
""")(lambda t: cm.refund_orders(t, src.refund_commands(t))["ledger"])

register("refund_wallets", "RECURSIVE" + REFUND + """
, rs AS (SELECT rf_o.*, coalesce(w.id, 'W-' || seller_id) AS wallet_id,
                coalesce(w.escrow_hold, 0) AS esc0,
                row_number() OVER (PARTITION BY seller_id ORDER BY requested_at, cmd_id) AS rn
         FROM rf_o LEFT JOIN m_wallets w ON w.user_id = rf_o.seller_id WHERE ok),
rf_rec AS (
  SELECT seller_id, rn, greatest(esc0 - total_amount, 0) AS esc FROM rs WHERE rn = 1
  UNION ALL
  SELECT s.seller_id, s.rn, greatest(r.esc - s.total_amount, 0)
  FROM rf_rec r JOIN rs s ON s.seller_id = r.seller_id AND s.rn = r.rn + 1),
sel AS (SELECT m.seller_id AS user_id, m.wallet_id, CAST(r.esc AS BIGINT) AS escrow_hold
        FROM (SELECT seller_id, wallet_id, max(rn) AS n FROM rs GROUP BY 1, 2) m
        JOIN rf_rec r ON r.seller_id = m.seller_id AND r.rn = m.n),
buy AS (SELECT buyer_id AS user_id, wallet_id,
               bal0 + CAST(sum(total_amount) AS BIGINT) AS balance,
               in0 + CAST(sum(total_amount) AS BIGINT) AS total_in
        FROM rb GROUP BY buyer_id, wallet_id, bal0, in0),
bs AS (SELECT coalesce(b.user_id, s.user_id) AS user_id,
              coalesce(b.wallet_id, s.wallet_id) AS wallet_id,
              b.balance, s.escrow_hold, b.total_in
       FROM buy b FULL OUTER JOIN sel s ON s.user_id = b.user_id AND s.wallet_id = b.wallet_id)
SELECT x.user_id, x.wallet_id, coalesce(x.balance, w.balance, 0) AS balance,
       coalesce(x.escrow_hold, w.escrow_hold, 0) AS escrow_hold,
       coalesce(x.total_in, w.total_in, 0) AS total_in
FROM bs x LEFT JOIN m_wallets w ON w.user_id = x.user_id
""")(lambda t: cm.refund_orders(t, src.refund_commands(t))["wallets"])

register("refund_notifications", REFUND + REFUND_NOTES)(
    lambda t: cm.refund_orders(t, src.refund_commands(t))["notifications"])

register("refund_audit", REFUND + REFUND_AUDIT)(
    lambda t: cm.refund_orders(t, src.refund_commands(t))["audit"])

REFUND_V1 = REFUND.replace("rf_o AS (SELECT *, CASE", """rf_w AS (SELECT rf_f.*, EXISTS (SELECT 1 FROM m_wallets w
                WHERE w.user_id = rf_f.buyer_id) AS owns FROM rf_f),
rf_o AS (SELECT * REPLACE (ok AND owns AS ok), CASE""").replace(
    "                        WHEN NOT ok THEN", """                        WHEN NOT owns THEN 'null value in column "wallet_id" of relation '
                          || '"wallet_transactions" violates not-null constraint'
                        WHEN NOT ok THEN""").replace("FROM rf_f),\nrb AS", "FROM rf_w),\nrb AS")

register("refund_orders_v1", REFUND_V1 + "SELECT cmd_id, order_id, ok, error FROM rf_o")(
    lambda t: cm.refund_orders(t, src.refund_commands(t), first_version=True)["outcomes"])

register("refund_ledger_v1", REFUND_V1 + f"""
SELECT wallet_id, 'refund' AS type, total_amount AS amount,
       bal0 + CAST(sum(total_amount) OVER (PARTITION BY buyer_id
                                           ORDER BY requested_at, cmd_id {RUN}) AS BIGINT)
         AS balance_after,
       concat('Refund admin — ', product_title, ' (' || reason || ')') AS description,
       order_id AS ref_order_id, requested_at AS created_at, cmd_id AS source_cmd
FROM rb
""")(lambda t: cm.refund_orders(t, src.refund_commands(t), first_version=True)["ledger"])

register("refund_notifications_v1", REFUND_V1 + REFUND_NOTES.replace(
    "'Dana Dikembalikan'", "'💸 Dana Dikembalikan'").replace(
    "'Pesanan Direfund Admin'", "'⚠️ Pesanan Direfund Admin'"))(
    lambda t: cm.refund_orders(t, src.refund_commands(t), first_version=True)["notifications"])

# ---------------------------------------------------------------- J8

NEG = 'new row for relation "wallets" violates check constraint "wallets_balance_check"'
ADJUST = f"""
, aj AS (SELECT c.*, coalesce(a.role = 'admin', false) AS is_admin, w.id AS wid,
                coalesce(w.balance, 0) AS start_balance, w.total_in AS in0, w.total_out AS out0,
                row_number() OVER (PARTITION BY c.user_id ORDER BY c.seq) AS rn
         FROM m_wallet_commands c LEFT JOIN m_profiles a ON a.id = c.actor_id
         LEFT JOIN m_wallets w ON w.user_id = c.user_id),
aj_p AS (SELECT *, CASE WHEN NOT is_admin THEN {ADMIN_ERR}
                        WHEN amount = 0 THEN 'Jumlah tidak boleh nol.'
                        WHEN reason IS NULL OR trim(reason) = ''
                          THEN 'Alasan wajib diisi untuk audit.'
                        WHEN amount IS NULL THEN 'null value in column "balance" of relation '
                          || '"wallets" violates not-null constraint' END AS pre_error
         FROM aj),
aj_r AS (
  SELECT user_id, rn, seq,
         CASE WHEN pre_error IS NULL AND start_balance + amount >= 0
              THEN start_balance + amount ELSE start_balance END AS bal,
         coalesce(pre_error, CASE WHEN start_balance + amount < 0 THEN '{NEG}' END) AS error
  FROM aj_p WHERE rn = 1
  UNION ALL
  SELECT p.user_id, p.rn, p.seq,
         CASE WHEN p.pre_error IS NULL AND r.bal + p.amount >= 0
              THEN r.bal + p.amount ELSE r.bal END,
         coalesce(p.pre_error, CASE WHEN r.bal + p.amount < 0 THEN '{NEG}' END)
  FROM aj_r r JOIN aj_p p ON p.user_id = r.user_id AND p.rn = r.rn + 1),
aj_x AS (SELECT p.*, r.bal, r.error, coalesce(p.wid, 'W-' || p.user_id) AS wallet_id
         FROM aj_p p JOIN aj_r r ON r.user_id = p.user_id AND r.rn = p.rn)
"""
ADJUST_NOTES = """
SELECT user_id, CASE WHEN amount > 0 THEN '💰 Saldo Ditambahkan'
                     ELSE '⚠️ Saldo Dikurangi' END AS title,
       'Saldo kamu disesuaikan admin sebesar Rp ' || format('{:,}', abs(amount))
         || '. Alasan: ' || reason AS body,
       'info' AS type, CAST(NULL AS VARCHAR) AS ref_order_id, created_at,
       'AJ-' || seq AS source_cmd
FROM aj_x WHERE error IS NULL
"""
ADJUST_AUDIT = """
SELECT actor_id AS admin_id, 'adjust_wallet' AS action, 'wallet' AS target_type,
       wallet_id AS target_id,
       CAST(json_object('amount', amount, 'reason', reason, 'new_balance', bal) AS VARCHAR)
         AS detail,
       created_at, 'AJ-' || seq AS source_cmd
FROM aj_x WHERE error IS NULL
"""

register("adjust_wallets", "RECURSIVE" + ADJUST + """
SELECT seq, user_id, amount, error IS NULL AS ok, error,
       CASE WHEN error IS NULL THEN bal END AS new_balance
FROM aj_x
""")(lambda t: cm.adjust_wallets(t, t["wallet_commands"])["outcomes"])

register("adjust_wallets_final", "RECURSIVE" + ADJUST + """
SELECT user_id, wallet_id, arg_max(bal, seq) AS balance,
       CAST(coalesce(any_value(in0), 0) + sum(CASE WHEN amount > 0 THEN amount ELSE 0 END)
            AS BIGINT) AS total_in,
       CAST(coalesce(any_value(out0), 0) + sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END)
            AS BIGINT) AS total_out
FROM aj_x WHERE error IS NULL GROUP BY user_id, wallet_id
""")(lambda t: cm.adjust_wallets(t, t["wallet_commands"])["wallets"])

WIDE = """
, wide AS (SELECT * REPLACE (CASE WHEN seq % 97 = 0 THEN NULL WHEN seq % 89 = 0
                                  THEN amount + 9007199254740993 ELSE amount END AS amount)
           FROM m_wallet_commands)
"""
ADJUST_WIDE = WIDE + ADJUST.replace("FROM m_wallet_commands c", "FROM wide c")


def _wide(t):
    """The wallet commands with null amounts and amounts beyond 2**53 among them."""
    seq, amount = F.col("seq"), F.col("amount")
    return t["wallet_commands"].withColumn("amount", F.when(seq % 97 == 0, F.lit(None)).when(
        seq % 89 == 0, amount + F.lit(9007199254740993)).otherwise(amount))


register("adjust_wallets_wide", "RECURSIVE" + ADJUST_WIDE + """
SELECT seq, user_id, amount, error IS NULL AS ok, error,
       CASE WHEN error IS NULL THEN bal END AS new_balance
FROM aj_x
""")(lambda t: cm.adjust_wallets(t, _wide(t))["outcomes"])

register("adjust_wallets_wide_final", "RECURSIVE" + ADJUST_WIDE + """
SELECT user_id, wallet_id, arg_max(bal, seq) AS balance,
       CAST(coalesce(any_value(in0), 0) + sum(CASE WHEN amount > 0 THEN amount ELSE 0 END)
            AS BIGINT) AS total_in,
       CAST(coalesce(any_value(out0), 0) + sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END)
            AS BIGINT) AS total_out
FROM aj_x WHERE error IS NULL GROUP BY user_id, wallet_id
""")(lambda t: cm.adjust_wallets(t, _wide(t))["wallets"])

register("adjust_ledger", "RECURSIVE" + ADJUST + """
SELECT wallet_id, CASE WHEN amount > 0 THEN 'topup' ELSE 'withdrawal' END AS type,
       abs(amount) AS amount, bal AS balance_after,
       'Penyesuaian admin — ' || reason AS description,
       CAST(NULL AS VARCHAR) AS ref_order_id, created_at, 'AJ-' || seq AS source_cmd
FROM aj_x WHERE error IS NULL
""")(lambda t: cm.adjust_wallets(t, t["wallet_commands"])["ledger"])

# ---------------------------------------------------------------- J9

SUSPEND = f"""
, su AS (SELECT c.*, coalesce(a.role = 'admin', false) AS is_admin,
                p.id IS NOT NULL AS found, p.is_suspended AS flag0
         FROM m_suspend_cmds c LEFT JOIN m_profiles a ON a.id = c.actor_id
         LEFT JOIN m_profiles p ON p.id = c.user_id),
su_e AS (SELECT *, CASE WHEN NOT is_admin THEN {ADMIN_ERR}
                        WHEN NOT found THEN 'Pengguna tidak ditemukan.' END AS error FROM su),
su_ok AS (SELECT *, coalesce(lag(suspend) OVER (PARTITION BY user_id
                                                ORDER BY requested_at, cmd_id), flag0)
                      AS was_suspended
          FROM su_e WHERE error IS NULL)
"""
SUSPEND_NOTES = """
SELECT user_id, '⚠️ Akun Disuspend' AS title,
       'Akun kamu disuspend oleh admin.' || coalesce(' Alasan: ' || reason, '') AS body,
       'warning' AS type, CAST(NULL AS VARCHAR) AS ref_order_id, requested_at AS created_at,
       cmd_id AS source_cmd
FROM su_ok WHERE suspend
"""
SUSPEND_AUDIT = """
SELECT actor_id AS admin_id,
       CASE WHEN suspend THEN 'suspend_user' ELSE 'unsuspend_user' END AS action,
       'user' AS target_type, user_id AS target_id,
       CAST(json_object('reason', reason, 'was_suspended', was_suspended) AS VARCHAR)
         AS detail,
       requested_at AS created_at, cmd_id AS source_cmd
FROM su_ok
"""


def _events(t):
    return t["events"]


register("suspend_users", SUSPEND + """
SELECT cmd_id, user_id, false AS ok, error, CAST(NULL AS BOOLEAN) AS was_suspended
FROM su_e WHERE error IS NOT NULL
UNION ALL
SELECT cmd_id, user_id, true AS ok, error, was_suspended FROM su_ok
""")(lambda t: cm.suspend_users(t, src.suspend_commands(t, _events(t)))["outcomes"])

register("suspend_profiles", SUSPEND + """
SELECT user_id, suspend AS is_suspended, CASE WHEN suspend THEN reason END AS suspended_reason
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY requested_at DESC,
                                   cmd_id DESC) AS rn FROM su_ok) WHERE rn = 1
""")(lambda t: cm.suspend_users(t, src.suspend_commands(t, _events(t)))["profiles"])

register("suspend_notifications", SUSPEND + SUSPEND_NOTES)(
    lambda t: cm.suspend_users(t, src.suspend_commands(t, _events(t)))["notifications"])

# ---------------------------------------------------------------- J10

ROLES = f"""
, ro AS (SELECT c.*, coalesce(a.role = 'admin', false) AS is_admin, p.role AS role0
         FROM m_role_cmds c LEFT JOIN m_profiles a ON a.id = c.actor_id
         LEFT JOIN m_profiles p ON p.id = c.user_id),
ro_e AS (SELECT *, CASE WHEN NOT is_admin THEN {ADMIN_ERR}
                        WHEN new_role IS NULL OR new_role NOT IN ('pembeli', 'penjual', 'admin')
                          THEN 'Role tidak valid.'
                        WHEN role0 IS NULL THEN 'Pengguna tidak ditemukan.' END AS error
         FROM ro),
ro_ok AS (SELECT *, coalesce(lag(new_role) OVER (PARTITION BY user_id
                                                 ORDER BY requested_at, cmd_id), role0)
                      AS from_role
          FROM ro_e WHERE error IS NULL)
"""
ROLES_AUDIT = """
SELECT actor_id AS admin_id, 'change_role' AS action, 'user' AS target_type,
       user_id AS target_id,
       CAST(json_object('from', from_role, 'to', new_role) AS VARCHAR) AS detail,
       requested_at AS created_at, cmd_id AS source_cmd
FROM ro_ok
"""

register("change_roles", ROLES + """
SELECT cmd_id, user_id, false AS ok, error, CAST(NULL AS VARCHAR) AS from_role,
       CAST(NULL AS VARCHAR) AS to_role
FROM ro_e WHERE error IS NOT NULL
UNION ALL
SELECT cmd_id, user_id, true, error, from_role, new_role FROM ro_ok
""")(lambda t: cm.change_roles(t, src.role_commands(t, _events(t)))["outcomes"])

register("roles_after", ROLES + """
SELECT user_id, new_role AS role
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY requested_at DESC,
                                   cmd_id DESC) AS rn FROM ro_ok) WHERE rn = 1
""")(lambda t: cm.change_roles(t, src.role_commands(t, _events(t)))["profiles"])

# ---------------------------------------------------------------- J11

TOGGLE = f"""
, tg AS (SELECT c.*, coalesce(a.role = 'admin', false) AS is_admin, p.id IS NOT NULL AS found
         FROM m_toggle_cmds c LEFT JOIN m_profiles a ON a.id = c.actor_id
         LEFT JOIN m_products p ON p.id = c.product_id),
tg_e AS (SELECT *, CASE WHEN NOT is_admin THEN {ADMIN_ERR}
                        WHEN NOT found THEN 'Produk tidak ditemukan.' END AS error FROM tg)
"""
TOGGLE_AUDIT = """
SELECT actor_id AS admin_id,
       CASE WHEN active THEN 'activate_product' ELSE 'deactivate_product' END AS action,
       'product' AS target_type, CAST(product_id AS VARCHAR) AS target_id,
       CAST(json_object('reason', reason) AS VARCHAR) AS detail,
       requested_at AS created_at, cmd_id AS source_cmd
FROM tg_e WHERE error IS NULL
"""

register("toggle_products", TOGGLE + """
SELECT cmd_id, product_id, active, error IS NULL AS ok, error FROM tg_e
""")(lambda t: cm.toggle_products(t, src.toggle_commands(t))["outcomes"])

register("products_after", TOGGLE + """
SELECT product_id AS id, active AS is_active
FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY requested_at DESC,
                                   cmd_id DESC) AS rn FROM tg_e WHERE error IS NULL)
WHERE rn = 1
""")(lambda t: cm.toggle_products(t, src.toggle_commands(t))["products"])

# ---------------------------------------------------------------- J16 / J17

STATUS_AUDIT = """
SELECT actor_id AS admin_id, 'update_order_status' AS action, 'order' AS target_type,
       order_id AS target_id,
       CAST(json_object('new_status', new_status, 'note', note) AS VARCHAR) AS detail,
       requested_at AS created_at, cmd_id AS source_cmd
FROM st_o WHERE error IS NULL
"""


def _all_audit(t):
    ev = _events(t)
    parts = [cm.apply_status(t, src.status_commands(t))["audit"],
             cm.refund_orders(t, src.refund_commands(t))["audit"],
             cm.adjust_wallets(t, t["wallet_commands"])["audit"],
             cm.suspend_users(t, src.suspend_commands(t, ev))["audit"],
             cm.change_roles(t, src.role_commands(t, ev))["audit"],
             cm.toggle_products(t, src.toggle_commands(t))["audit"]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _all_notes(t):
    ev = _events(t)
    parts = [cm.confirm_orders(t, src.confirm_commands(t))["notifications"],
             cm.refund_orders(t, src.refund_commands(t))["notifications"],
             cm.adjust_wallets(t, t["wallet_commands"])["notifications"],
             cm.suspend_users(t, src.suspend_commands(t, ev))["notifications"]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


register("audit_rows", "RECURSIVE" + STATUS + REFUND + ADJUST + SUSPEND + ROLES + TOGGLE
         + STATUS_AUDIT + " UNION ALL " + REFUND_AUDIT + " UNION ALL " + ADJUST_AUDIT
         + " UNION ALL " + SUSPEND_AUDIT + " UNION ALL " + ROLES_AUDIT + " UNION ALL "
         + TOGGLE_AUDIT)(_all_audit)

register("notification_rows", "RECURSIVE" + CONFIRM + REFUND + ADJUST + SUSPEND
         + CONFIRM_NOTES + " UNION ALL " + REFUND_NOTES + " UNION ALL " + ADJUST_NOTES
         + " UNION ALL " + SUSPEND_NOTES)(_all_notes)

# ---------------------------------------------------------------- J12

PAIRS = """
, cr AS (SELECT r.*, CASE WHEN me_id IS NULL THEN 'Tidak terautentikasi.'
                          WHEN me_id = other_id
                            THEN 'Tidak bisa membuat percakapan dengan diri sendiri.' END
                       AS error,
                least(me_id, other_id) AS user_a_id, greatest(me_id, other_id) AS user_b_id
         FROM m_conv_requests r),
cp_last AS (SELECT user_a_id, user_b_id, product_id
            FROM (SELECT *, row_number() OVER (PARTITION BY user_a_id, user_b_id
                                               ORDER BY requested_at DESC, req_id DESC) AS rn
                  FROM cr WHERE error IS NULL AND product_id IS NOT NULL) WHERE rn = 1),
cp AS (SELECT DISTINCT user_a_id, user_b_id FROM cr WHERE error IS NULL),
pairs AS (SELECT coalesce(c.id, 'C-' || cp.user_a_id || '-' || cp.user_b_id)
                   AS conversation_id,
                 cp.user_a_id, cp.user_b_id, coalesce(l.product_id, c.product_id) AS product_id,
                 c.id IS NULL AS created
          FROM cp LEFT JOIN cp_last l ON l.user_a_id = cp.user_a_id
                                     AND l.user_b_id = cp.user_b_id
          LEFT JOIN m_conversations c ON c.user_a_id = cp.user_a_id
                                     AND c.user_b_id = cp.user_b_id)
"""


def _pairs(t):
    return cm.conversation_pairs(t, src.conversation_requests(
        t, _events(t),
        t["profiles"].filter(F.col("id").startswith("S")).agg(F.count(F.lit(1)).alias("n_s")),
        t["products"].agg(F.count(F.lit(1)).alias("n_p"))))


register("conversations_pairs", PAIRS + "SELECT * FROM pairs")(
    lambda t: _pairs(t)["conversations"])

register("conversation_requests", PAIRS + """
SELECT cr.req_id, cr.error IS NULL AS ok, cr.error,
       CASE WHEN cr.error IS NULL THEN p.conversation_id END AS conversation_id
FROM cr LEFT JOIN pairs p ON p.user_a_id = cr.user_a_id AND p.user_b_id = cr.user_b_id
""")(lambda t: _pairs(t)["outcomes"])

# ---------------------------------------------------------------- J2, J3, J13, J18, A3, A9


@register("profiles_from_signups", """
SELECT account_id AS id,
       coalesce(json_extract_string(raw_user_meta_data, '$.full_name'),
                split_part(email, '@', 1)) AS full_name,
       coalesce(json_extract_string(raw_user_meta_data, '$.role'), 'pembeli') AS role,
       false AS is_suspended, created_at
FROM m_signups
""")
def profiles_from_signups(t):
    """New accounts -> profiles (name and role from metadata, with fallbacks)."""
    return cm.profiles_from_signups(src.signups(_events(t)))


register("wallets_ensure", """
SELECT id, user_id, balance, escrow_hold, total_in, total_out FROM m_wallets
UNION ALL
SELECT 'W-' || p.id, p.id, 0, 0, 0, 0 FROM m_profiles p
WHERE p.id NOT IN (SELECT user_id FROM m_wallets)
""")(cm.wallets_ensure)

register("admin_wallet_seed", """
SELECT id, balance, created_at, updated_at FROM m_admin_wallet
UNION ALL
SELECT 'AW-seed', 0, CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP)
WHERE NOT EXISTS (SELECT 1 FROM m_admin_wallet)
""")(cm.admin_wallet_seed)

register("messages_clean", """
SELECT id, conversation_id, sender_id, trim(body) AS body, is_read, created_at
FROM m_messages WHERE trim(body) <> ''
""")(cm.messages_clean)

register("suspended_accounts", """
SELECT id, role, is_suspended,
       CASE WHEN is_suspended THEN NULL WHEN role = 'admin' THEN 'dashboard-admin'
            WHEN role = 'penjual' THEN 'dashboard-penjual' ELSE 'dashboard-pembeli' END
         AS landing
FROM m_profiles
""")(cm.suspended_accounts)


@register("orders_evolved", """
SELECT * EXCLUDE (commission_rate, seller_payout), CAST(0.05 AS DOUBLE) AS commission_rate,
       CAST(0 AS BIGINT) AS seller_payout
FROM m_orders
""")
def orders_evolved(t):
    """Orders as first declared, brought to the current schema by adding the
    commission columns with their defaults where absent."""
    base = t["orders"].drop("commission_rate", "seller_payout")
    return ensure_columns(base, ORDER_EVOLUTION)


MIGRATED = "1996-01-01 00:00:00"


@register("orders_mixed_files", f"""
SELECT * EXCLUDE (platform_fee, commission_rate, seller_payout),
       CASE WHEN created_at < TIMESTAMP '{MIGRATED}' THEN 0 ELSE nullif(platform_fee, 0) END AS platform_fee,
       CASE WHEN created_at < TIMESTAMP '{MIGRATED}' THEN 0.05 ELSE CAST(commission_rate AS DOUBLE) END
         AS commission_rate,
       CASE WHEN created_at < TIMESTAMP '{MIGRATED}' THEN 0 ELSE seller_payout END AS seller_payout
FROM m_orders
WHERE created_at >= TIMESTAMP '{MIGRATED}' OR quantity > 5
""")
def orders_mixed_files(t):
    """Orders in files from before and after the commission columns, read as one: older
    files give the defaults, nulls of newer files stay."""
    o = t["orders"].filter("created_at is not null")
    before = F.col("created_at") < F.lit(MIGRATED).cast("timestamp_ntz")
    path = scratch_path(o.sparkSession, "orders-files")
    (o.filter(before & (F.col("quantity") > 5)).drop("platform_fee", "commission_rate", "seller_payout")
     .withColumn("quantity", F.col("quantity").cast("int")).write.parquet(f"{path}/old"))
    (o.filter(~before).withColumn("platform_fee", F.expr("nullif(platform_fee, 0)"))
     .write.parquet(f"{path}/new"))
    return read_evolved(o.sparkSession, "orders", f"{path}/old", f"{path}/new").select(*o.columns)


# ---------------------------------------------------------------- H4, H5 audit details

register("audit_details_typed", "RECURSIVE" + STATUS + REFUND + ADJUST + SUSPEND + ROLES + TOGGLE
         + ", au AS (" + STATUS_AUDIT + " UNION ALL " + REFUND_AUDIT + " UNION ALL " + ADJUST_AUDIT
         + " UNION ALL " + SUSPEND_AUDIT + " UNION ALL " + ROLES_AUDIT + " UNION ALL "
         + TOGGLE_AUDIT + """)
SELECT source_cmd, action, target_id, json_valid(detail) AS readable,
       TRY_CAST(detail->>'$.amount' AS BIGINT) AS amount,
       TRY_CAST(detail->>'$.new_balance' AS BIGINT) AS new_balance,
       detail->>'$.reason' AS reason, detail->>'$.note' AS note,
       detail->>'$.from' AS from_value,
       coalesce(detail->>'$.to', detail->>'$.new_status') AS to_value,
       TRY_CAST(detail->>'$.was_suspended' AS BOOLEAN) AS was_suspended
FROM au""")(lambda t: ad.typed_details(_all_audit(t), "source_cmd"))

# Audit rows with faults: cut texts, a number as text, no details at all.
FAULTY_SQL = """
CASE WHEN id LIKE '%3' THEN left(detail, 5)
     WHEN id LIKE '%5' THEN '{"amount": "many", "reason": null, "new_balance": 7}'
     WHEN id LIKE '%6' THEN '[1]'
     WHEN id LIKE '%8' THEN NULL
     WHEN id LIKE '%9' THEN '{"from": "a", "to": "b", "amount": 12.5, "reason": true}'
     ELSE detail END"""


@register("audit_detail_drift", f"""
, l AS (SELECT id, action, {FAULTY_SQL} AS detail FROM m_admin_logs),
j AS (SELECT id, action, CASE WHEN json_valid(detail) THEN detail END AS d, detail IS NULL AS none FROM l),
o AS (SELECT id, action, d FROM j WHERE json_type(d) = 'OBJECT'),
want(action, field, kind) AS (VALUES
  ('update_order_status', 'note', 'STRING'), ('force_refund', 'amount', 'BIGINT'),
  ('force_refund', 'reason', 'STRING'), ('adjust_wallet', 'amount', 'BIGINT'),
  ('adjust_wallet', 'reason', 'STRING'), ('adjust_wallet', 'new_balance', 'BIGINT'),
  ('suspend_user', 'reason', 'STRING'), ('suspend_user', 'was_suspended', 'BOOLEAN'),
  ('unsuspend_user', 'reason', 'STRING'), ('unsuspend_user', 'was_suspended', 'BOOLEAN'),
  ('change_role', 'from', 'STRING'), ('change_role', 'to', 'STRING'),
  ('activate_product', 'reason', 'STRING'), ('deactivate_product', 'reason', 'STRING')),
extra(action, field) AS (VALUES ('update_order_status', 'new_status'), ('update_order_status', 'from'),
  ('update_order_status', 'to')),
f AS (SELECT id, action, unnest(json_keys(d)) AS field, d FROM o),
k AS (SELECT id, action, field,
             CASE json_type(d, '$.' || field) WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT'
                  WHEN 'NULL' THEN 'VOID' WHEN 'DOUBLE' THEN 'DECIMAL' ELSE json_type(d, '$.' || field) END AS kind
      FROM f),
x AS (SELECT action, CAST(NULL AS VARCHAR) AS field, 'no detail' AS problem FROM j WHERE none
      UNION ALL SELECT action, NULL, 'unreadable' FROM j WHERE d IS NULL AND NOT none
      UNION ALL SELECT action, NULL, 'no object' FROM j WHERE d IS NOT NULL AND json_type(d) <> 'OBJECT'
      UNION ALL SELECT o.action, w.field, 'missing' FROM o JOIN want w USING (action)
      WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.id = o.id AND k.field = w.field)
      UNION ALL SELECT k.action, k.field, 'type ' || k.kind FROM k JOIN want w USING (action, field)
      WHERE k.kind NOT IN (w.kind, 'VOID')
      UNION ALL SELECT k.action, k.field, 'type ' || k.kind FROM k JOIN extra USING (action, field)
      WHERE k.kind NOT IN ('STRING', 'VOID')
      UNION ALL SELECT k.action, k.field, 'unexpected ' || k.kind FROM k
      WHERE NOT EXISTS (SELECT 1 FROM want w WHERE w.action = k.action AND w.field = k.field)
        AND NOT EXISTS (SELECT 1 FROM extra e WHERE e.action = k.action AND e.field = k.field))
SELECT action, field, problem, count(*) AS n FROM x GROUP BY ALL
""")
def audit_detail_drift(t):
    """Audit details that are not what their action writes, counted by field and fault."""
    return ad.detail_drift(t["admin_logs"].withColumn("detail", F.expr(FAULTY_SQL)))


# ---------------------------------------------------------------- J15, E3 key, A10

@register("promote_admins", """
, pc AS (SELECT 'PR-' || id AS cmd_id, email FROM m_accounts WHERE id LIKE 'S%0'),
hit AS (SELECT pc.cmd_id, a.id AS user_id FROM pc JOIN m_accounts a ON a.email = pc.email)
SELECT p.id AS user_id, p.role AS old_role, 'admin' AS role
FROM m_profiles p WHERE p.id IN (SELECT user_id FROM hit)
""")
def promote_admins(t):
    """Promote accounts to admin by e-mail: role change joined through accounts."""
    from escrowlens.operators.commands import promote_by_email
    acc = t["accounts"]
    cmds = acc.filter(F.col("id").like("S%0")).select(
        F.concat(F.lit("PR-"), "id").alias("cmd_id"), "email")
    return promote_by_email(t, cmds)


register("wallet_adjust_fold", "RECURSIVE" + ADJUST + """
SELECT seq, user_id, amount, error IS NULL AS ok, error,
       CASE WHEN error IS NULL THEN bal END AS new_balance
FROM aj_x
""")(lambda t: cm.adjust_wallets(t, t["wallet_commands"])["outcomes"])


@register("export_csv", REFUND + REFUND_AUDIT)
def export_csv(t):
    """Audit rows of a refund batch exported as CSV and read back."""
    from escrowlens.sources.sinks import export_csv as export
    audit = cm.refund_orders(t, src.refund_commands(t))["audit"]
    path = export(audit, "refund-audit")
    spark = audit.sparkSession
    return spark.read.schema(audit.schema).option("header", True).csv(path)


# ---------------------------------------------------------------- J5 v1, J8 v1

STATUS_V1 = f"""
, v1 AS (SELECT s.*, coalesce(a.role = 'admin', false) AS is_admin, o.status AS old0,
                o.delivery_note AS note0, o.delivered_at AS del0, o.completed_at AS comp0
         FROM m_status_cmds s LEFT JOIN m_profiles a ON a.id = s.actor_id
         LEFT JOIN m_orders o ON o.id = s.order_id),
v1_e AS (SELECT *, CASE WHEN new_status IS NULL OR new_status NOT IN
                          ('pending_payment', 'paid', 'processing', 'delivered', 'completed',
                           'disputed', 'refunded', 'cancelled')
                        THEN 'invalid input value for enum order_status: "'
                             || coalesce(new_status, '') || '"'
                        WHEN NOT is_admin THEN {ADMIN_ERR}
                        WHEN old0 IS NULL THEN 'Pesanan tidak ditemukan.' END AS error
         FROM v1),
v1_ok AS (SELECT *, coalesce(lag(new_status) OVER (PARTITION BY order_id
                                                   ORDER BY requested_at, cmd_id), old0)
                      AS from_status
          FROM v1_e WHERE error IS NULL)
"""

register("apply_status_v1", STATUS_V1 + """
SELECT cmd_id, order_id, false AS ok, error, CAST(NULL AS VARCHAR) AS from_status,
       CAST(NULL AS VARCHAR) AS to_status
FROM v1_e WHERE error IS NOT NULL
UNION ALL
SELECT cmd_id, order_id, true, error, from_status, new_status FROM v1_ok
""")(lambda t: cm.apply_status_v1(t, src.status_commands(t))["outcomes"])

register("apply_status_v1_orders", STATUS_V1 + """
, last AS (SELECT order_id, new_status AS status
           FROM (SELECT *, row_number() OVER (PARTITION BY order_id
                                              ORDER BY requested_at DESC, cmd_id DESC) AS rn
                 FROM v1_ok) WHERE rn = 1),
lnote AS (SELECT order_id, note
          FROM (SELECT *, row_number() OVER (PARTITION BY order_id
                                             ORDER BY requested_at DESC, cmd_id DESC) AS rn
                FROM v1_ok WHERE note IS NOT NULL) WHERE rn = 1),
g AS (SELECT order_id, any_value(note0) AS note0, any_value(del0) AS del0,
             any_value(comp0) AS comp0,
             max(CASE WHEN new_status = 'delivered' THEN requested_at END) AS d,
             max(CASE WHEN new_status = 'completed' THEN requested_at END) AS c
      FROM v1_ok GROUP BY order_id)
SELECT g.order_id, last.status, coalesce(lnote.note, g.note0) AS delivery_note,
       coalesce(g.d, g.del0) AS delivered_at, coalesce(g.c, g.comp0) AS completed_at
FROM g JOIN last ON last.order_id = g.order_id
LEFT JOIN lnote ON lnote.order_id = g.order_id
""")(lambda t: cm.apply_status_v1(t, src.status_commands(t))["orders"])

ADJUST_V1 = ADJUST.replace(
    "WHEN amount IS NULL THEN",
    "WHEN wid IS NULL THEN 'Dompet pengguna tidak ditemukan.' WHEN amount IS NULL THEN")
assert ADJUST_V1 != ADJUST

register("adjust_wallets_v1", "RECURSIVE" + ADJUST_V1 + """
SELECT seq, user_id, amount, error IS NULL AS ok, error,
       CASE WHEN error IS NULL THEN bal END AS new_balance
FROM aj_x
""")(lambda t: cm.adjust_wallets(t, t["wallet_commands"], create_missing=False)["outcomes"])
