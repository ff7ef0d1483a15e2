"""Reconciliation that goes on from verified balances (§2 E4, E1).

``ledger_mismatches`` recomputes every wallet from its first row.  Here each batch of
ledger rows is checked from the newest anchor before it: the recomputed balance and the
stored one after the last row of a wallet's day.

Under its folder, by batch number (a repeated batch writes the same folders again):

* ``rows/b=<n>/day=<day>/``: the ledger rows of the batch;
* ``since/b=<n>/``: the wallets of the batch and their earliest day in it;
* ``anchors/b=<n>/``: wallet, day, recomputed and stored balance;
* ``found/b=<n>/``: the mismatches.

A batch reads, of the wallets it holds, the ledger days from its earliest day on (the
others are pruned as folders) and the anchors before that.  A late row thereby renews all
anchors and mismatches of its wallet from its day on; those of former batches give way to
them by batch number.  Nothing is changed in place, and nothing but one date passes the
driver.  Batches come in the order of their numbers; the newest may be repeated.  Rows need a wallet and a time, as the table declares; ids are unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from escrowlens.operators.ledger import _mismatches, _recomputed
from escrowlens.session import scratch_path
from escrowlens.sources.schemas import SCHEMAS
from escrowlens.sources.versions import append_batch, batches_in

SINCE = "wallet_id string, low date"
ANCHOR = "wallet_id string, day date, balance bigint, stored bigint"
FOUND = ("id string, wallet_id string, type string, created_at timestamp_ntz, delta bigint, "
         "stored_balance bigint, expected_balance bigint, difference bigint, step_mismatch boolean")


class VerifiedLedger:
    def __init__(self, spark: SparkSession, base: str | None = None):
        self.spark, self.base = spark, base or scratch_path(spark, "verified-ledger")

    def _read(self, kind: str, schema: str, upto: int | None = None) -> DataFrame:
        """The rows of a kind with ``b``, the batch that wrote them."""
        known = [b for b in batches_in(self.spark, f"{self.base}/{kind}") if upto is None or b <= upto]
        out = self.spark.createDataFrame([], f"{schema}, b int")
        if known:   # one read; the batch is a folder of the common base
            out = self.spark.read.schema(f"{schema}, b int").option("basePath", f"{self.base}/{kind}").parquet(
                *[f"{self.base}/{kind}/b={b}" for b in known])
        return out

    def suffix(self, batch_id: int) -> DataFrame:
        """The ledger rows that a batch has to check, with its wallets' ``low``."""
        since = self.spark.read.schema(SINCE).parquet(f"{self.base}/since/b={batch_id}")
        least = since.agg(F.min("low")).first()[0]
        rows = self._read("rows", SCHEMAS["wallet_transactions"] + ", day date", batch_id)
        return rows.filter(F.col("day") >= F.lit(least)).join(since, "wallet_id").filter("day >= low").drop("b")

    def reconcile(self, rows: DataFrame, batch_id: int, split: str = "range") -> None:
        """Append a batch of ledger rows and check what follows the anchors before it."""
        dated = rows.withColumn("day", F.to_date("created_at"))
        (dated.repartitionByRange("day", "id").write.mode("overwrite").partitionBy("day")
         .parquet(f"{self.base}/rows/b={batch_id}"))
        append_batch(dated.groupBy("wallet_id").agg(F.min("day").alias("low")), f"{self.base}/since", batch_id)
        suffix = self.suffix(batch_id)
        since = self.spark.read.schema(SINCE).parquet(f"{self.base}/since/b={batch_id}")
        # The newest anchor before a wallet's low day; of one day, the newest batch's.
        before = self._read("anchors", ANCHOR, batch_id - 1).join(since, "wallet_id").filter("day < low") \
            .groupBy("wallet_id").agg(F.max_by(F.struct("balance", "stored"), F.struct("day", "b")).alias("_a")) \
            .select("wallet_id", F.col("_a.balance").alias("_from"), F.col("_a.stored").alias("_stored"))
        r = _recomputed(suffix, split, "day").join(before, "wallet_id", "left").withColumns({
            "running_balance": F.col("running_balance") + F.coalesce("_from", F.lit(0)),
            "prev_stored": F.coalesce("prev_stored", "_stored")})
        path = scratch_path(self.spark, "recomputed")
        r.select("id", "wallet_id", "type", "created_at", "delta", "balance_after", "running_balance",
                 "prev_stored", "day").write.parquet(path)
        r = self.spark.read.parquet(path)
        last = F.struct("created_at", "id")
        append_batch(r.groupBy("wallet_id", "day").agg(F.max_by("running_balance", last).alias("balance"),
                                                       F.max_by("balance_after", last).alias("stored")),
                     f"{self.base}/anchors", batch_id)
        append_batch(_mismatches(r), f"{self.base}/found", batch_id)

    def mismatches(self) -> DataFrame:
        """The rows of ``ledger_mismatches`` over all batches: each batch's, without those
        that a later batch has checked again."""
        found = self._read("found", FOUND)
        done = batches_in(self.spark, f"{self.base}/found")
        again = self._read("since", SINCE, done[-1] if done else 0).select("wallet_id", "low", F.col("b").alias("_later"))
        old = (found["wallet_id"] == again["wallet_id"]) & (F.col("_later") > F.col("b")) \
            & (F.to_date("created_at") >= F.col("low"))
        return found.join(again, old, "left_anti").drop("b")
