"""Wallet ledger: running balances, escrow floor, reconciliation, totals (§2.E).

The source kept running state row by row inside procedures; over a ledger
table that state is a window per wallet.  All running values here go through
``plans.prefix``, which splits a hot wallet into balanced range buckets (or by
day) so no single wallet is one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escrowlens.plans.prefix import (RANGE, bucketed, previous_value, running_clamped,
                                    running_sum)

Tables = dict[str, DataFrame]

INFLOW_TYPES = ["topup", "escrow_release", "refund"]
OUTFLOW_TYPES = ["withdrawal", "escrow_hold"]
LEDGER_ORDER = ["created_at", "id"]


def signed_amount(type_col: str = "type", amount_col: str = "amount"):
    """Ledger amounts are stored positive; the type gives the direction."""
    return F.when(F.col(type_col).isin(*OUTFLOW_TYPES), -F.col(amount_col)) \
        .otherwise(F.col(amount_col))


def day_bucket(ts: str = "created_at"):
    return F.to_date(F.col(ts))


def split_bucket(split: str, ts: str = "created_at"):
    """How a key's rows are split for the two-level running operators:
    'range' (balanced by sampling; safe for any skew), 'day' (calendar day of
    ``ts``; no extra shuffle), or 'none' (one window per key)."""
    return {"range": RANGE, "day": day_bucket(ts), "none": None}[split]


def ledger_running_balance(t: Tables, split: str = "range") -> DataFrame:
    """Balance after each ledger row, recomputed from the signed amounts."""
    led = t["wallet_transactions"].select("id", "wallet_id", "type", "created_at",
                                          signed_amount().alias("delta"), "balance_after")
    return running_sum(led, "wallet_id", LEDGER_ORDER, "delta", "running_balance",
                       bucket=split_bucket(split))


def ledger_mismatches(t: Tables, split: str = "range") -> DataFrame:
    """Rows whose stored balance_after disagrees with the recomputed balance,
    or whose step from the previous row is not the row's own amount.  The
    running sum and the previous-row lookup share one bucketing pass."""
    return _mismatches(_recomputed(t["wallet_transactions"], split))


def _recomputed(led: DataFrame, split: str, *carried: str) -> DataFrame:
    led = led.select("id", "wallet_id", "type", "created_at",
                     signed_amount().alias("delta"), "balance_after", *carried)
    bucket = split_bucket(split)
    if bucket is not None:
        led = bucketed(led, "wallet_id", LEDGER_ORDER, bucket).withColumnRenamed(
            "_bucket", "_b")
        bucket = F.col("_b")
    r = running_sum(led, "wallet_id", LEDGER_ORDER, "delta", "running_balance", bucket=bucket)
    return previous_value(r, "wallet_id", LEDGER_ORDER, "balance_after", "prev_stored",
                          bucket=bucket)


def _mismatches(r: DataFrame) -> DataFrame:
    step_bad = F.coalesce(F.col("balance_after") - F.col("prev_stored") != F.col("delta"),
                          F.col("balance_after") != F.col("delta"))
    out = r.select("id", "wallet_id", "type", "created_at", "delta",
                   F.col("balance_after").alias("stored_balance"),
                   F.col("running_balance").alias("expected_balance"),
                   (F.col("balance_after") - F.col("running_balance")).alias("difference"),
                   step_bad.alias("step_mismatch"))
    return out.filter((F.col("difference") != 0) | F.col("step_mismatch"))


def wallet_totals(t: Tables) -> DataFrame:
    """Per wallet: money in, money out, net and row count (partial aggregates)."""
    led = t["wallet_transactions"]
    return led.groupBy("wallet_id").agg(
        F.coalesce(F.sum(F.when(F.col("type").isin(*INFLOW_TYPES), F.col("amount"))),
                   F.lit(0).cast("bigint")).alias("total_in"),
        F.coalesce(F.sum(F.when(F.col("type").isin(*OUTFLOW_TYPES), F.col("amount"))),
                   F.lit(0).cast("bigint")).alias("total_out"),
        F.sum(signed_amount()).alias("net"),
        F.count(F.lit(1)).alias("n_tx"))


def wallet_running_totals(t: Tables, split: str = "range") -> DataFrame:
    """Money in and money out of the wallet up to and including each ledger row."""
    led = t["wallet_transactions"].select("id", "wallet_id", "type", "created_at", "amount")
    zero = F.lit(0).cast("bigint")
    side = lambda kinds: F.when(F.col("type").isin(*kinds), F.col("amount")).otherwise(zero)
    led = led.withColumns({"_in": side(INFLOW_TYPES), "_out": side(OUTFLOW_TYPES)})
    bucket = split_bucket(split)
    if bucket is not None:
        led = bucketed(led, "wallet_id", LEDGER_ORDER, bucket).withColumnRenamed("_bucket", "_b")
        bucket = F.col("_b")
    led = running_sum(led, "wallet_id", LEDGER_ORDER, "_in", "total_in", bucket=bucket)
    led = running_sum(led, "wallet_id", LEDGER_ORDER, "_out", "total_out", bucket=bucket)
    return led.select("id", "wallet_id", "type", "created_at", "amount", "total_in", "total_out")


def escrow_running(t: Tables, split: str = "range") -> DataFrame:
    """Escrow held per wallet after each movement, floored at zero at every step.

    Holds are the positive movements and releases the negative ones; a
    release larger than what is held leaves zero (``greatest(x - amt, 0)``),
    and later holds start from there.
    """
    mv = t["wallet_commands"].select("seq", "user_id", "amount", "created_at")
    return running_clamped(mv, "user_id", ["created_at", "seq"], "amount", "escrow_after",
                           bucket=split_bucket(split))
