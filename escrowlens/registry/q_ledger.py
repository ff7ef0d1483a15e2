"""Registered ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from escrowlens.operators import ledger as lg
from escrowlens.operators.verified import VerifiedLedger
from escrowlens.registry.core import register

SIGNED = "CASE WHEN type IN ('withdrawal', 'escrow_hold') THEN -amount ELSE amount END"
RUNNING = f"""
, r AS (
  SELECT id, wallet_id, type, created_at, {SIGNED} AS delta, balance_after,
         CAST(sum({SIGNED}) OVER (PARTITION BY wallet_id ORDER BY created_at, id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              AS BIGINT) AS running_balance
  FROM m_ledger)
"""

register("ledger_running_balance", RUNNING + "SELECT * FROM r")(lg.ledger_running_balance)

MISMATCHES = RUNNING + """
, s AS (SELECT *, lag(balance_after) OVER (PARTITION BY wallet_id ORDER BY created_at, id)
                    AS prev_stored FROM r)
SELECT id, wallet_id, type, created_at, delta, balance_after AS stored_balance,
       running_balance AS expected_balance, balance_after - running_balance AS difference,
       coalesce(balance_after - prev_stored <> delta, balance_after <> delta) AS step_mismatch
FROM s
WHERE balance_after - running_balance <> 0
   OR coalesce(balance_after - prev_stored <> delta, balance_after <> delta)
"""
register("ledger_mismatches", MISMATCHES)(lg.ledger_mismatches)


@register("ledger_mismatches_by_batch", MISMATCHES, needs_session=True)
def ledger_mismatches_by_batch(t, spark, sf_dir):
    """The ledger reconciled in three batches from verified balances; the last batch brings
    late rows for some of the days checked before."""
    led = t["wallet_transactions"]
    late = F.coalesce(F.col("id").endswith("7") & F.col("wallet_id").endswith("3"), F.lit(False))
    middle = led.agg(F.percentile_approx(F.unix_micros(F.col("created_at").cast("timestamp")), 0.6)).first()[0]
    early = F.unix_micros(F.col("created_at").cast("timestamp")) < F.lit(middle)
    checked = VerifiedLedger(spark)
    for number, rows in enumerate([~late & early, ~late & ~early, late], 1):
        checked.reconcile(led.filter(rows), number)
    return checked.mismatches()


register("wallet_totals", f"""
SELECT wallet_id,
       CAST(coalesce(sum(amount) FILTER (WHERE type IN ('topup', 'escrow_release', 'refund')),
                     0) AS BIGINT) AS total_in,
       CAST(coalesce(sum(amount) FILTER (WHERE type IN ('withdrawal', 'escrow_hold')), 0)
            AS BIGINT) AS total_out,
       CAST(sum({SIGNED}) AS BIGINT) AS net, count(*) AS n_tx
FROM m_ledger GROUP BY wallet_id
""")(lg.wallet_totals)

# Independent oracle: the sequential fold greatest(prev + amount, 0).
register("escrow_running", """RECURSIVE
, c AS (SELECT seq, user_id, amount, created_at,
               row_number() OVER (PARTITION BY user_id ORDER BY created_at, seq) AS rn
        FROM m_wallet_commands),
rec AS (
  SELECT user_id, rn, seq, amount, created_at, greatest(amount, 0) AS escrow_after
  FROM c WHERE rn = 1
  UNION ALL
  SELECT c.user_id, c.rn, c.seq, c.amount, c.created_at,
         greatest(rec.escrow_after + c.amount, 0)
  FROM rec JOIN c ON c.user_id = rec.user_id AND c.rn = rec.rn + 1)
SELECT seq, user_id, amount, created_at, CAST(escrow_after AS BIGINT) AS escrow_after FROM rec
""")(lg.escrow_running)


register("wallet_running_totals", """
SELECT id, wallet_id, type, created_at, amount,
       CAST(sum(CASE WHEN type IN ('escrow_release', 'refund', 'topup') THEN amount ELSE 0 END) OVER w AS BIGINT) AS total_in,
       CAST(sum(CASE WHEN type IN ('escrow_hold', 'withdrawal') THEN amount ELSE 0 END) OVER w AS BIGINT) AS total_out
FROM m_ledger
WINDOW w AS (PARTITION BY wallet_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)
""")(lg.wallet_running_totals)
