"""Reconciliation batch by batch against the full pass."""

import datetime as dt
import random

from conftest import table, ts
from escrowlens.operators.ledger import ledger_mismatches
from escrowlens.operators.verified import VerifiedLedger

T0 = ts("2024-01-01 10:00:00")


def _row(rnd, i, first, last):
    amount = rnd.randrange(0, 4)
    return {"id": f"L{i:03}", "wallet_id": f"W{rnd.choice([0, 0, 0, 1, 2])}", "amount": amount,
            "type": rnd.choice(["topup", "withdrawal"]), "balance_after": rnd.choice([None, 0, amount, 3]),
            "created_at": T0 + dt.timedelta(days=rnd.randrange(first, last), hours=rnd.randrange(3))}


def _same(checked, led):
    want = sorted(map(repr, ledger_mismatches({"wallet_transactions": led}).collect()))
    assert sorted(map(repr, checked.mismatches().select(
        "id", "wallet_id", "type", "created_at", "delta", "stored_balance", "expected_balance", "difference",
        "step_mismatch").collect())) == want
    assert want


def test_batches_with_late_rows_equal_the_full_pass(spark):
    rnd = random.Random(2)
    checked, rows = VerifiedLedger(spark), []
    for number, (first, last) in enumerate([(0, 6), (6, 9), (2, 9)], 1):   # the third is late
        batch = [_row(rnd, 100 * number + i, first, last) for i in range(20)]
        rows += batch
        for _ in range(2 if number == 2 else 1):                           # a repeated batch
            checked.reconcile(table(spark, "wallet_transactions", batch), number)
    _same(checked, table(spark, "wallet_transactions", rows))
    # A batch of one wallet and day reads that wallet from that day on, days pruned as folders.
    one = {"id": "Z", "wallet_id": "W1", "amount": 1, "type": "topup", "created_at": T0 + dt.timedelta(days=8)}
    checked.reconcile(table(spark, "wallet_transactions", [one]), 4)
    suffix = checked.suffix(4)
    assert {(r["wallet_id"], r["day"]) for r in suffix.collect()} == {("W1", dt.date(2024, 1, 9))}
    files = {f.split("day=")[1][:10] for f in suffix.inputFiles() if "day=" in f}
    plan = suffix._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and files
    _same(checked, table(spark, "wallet_transactions", rows + [one]))


def test_nothing_yet(spark):
    assert VerifiedLedger(spark).mismatches().count() == 0
