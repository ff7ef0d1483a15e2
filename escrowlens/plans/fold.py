"""Ordered per-key fold whose step depends on the running state.

A wallet adjustment is refused when it would take the balance below zero, and
later commands see the balance *without* the refused ones.  The step function
``b -> b + a if b + a >= 0 else b`` is not monotone, so a run of commands has no
bounded summary and which commands are refused has to be found in order.  But
only that: a refused command adds its amount back to the plain running balance of
everything after it, so

    balance = opening + running sum + correction

where the correction is the total of the refused amounts so far.  The rows with
their columns never leave the JVM; what is found in order is a few bits.

1. Commands are cut into range buckets (``plans.prefix``), so a hot key is split.
   Sum and lowest running sum per (key, bucket) and a window over the buckets give
   each bucket's plain opening balance.
2. A correction never falls, so a bucket whose plain balance stays at zero or more
   has no refusal whatever came before: it is skipped by its sum alone.  (Where a
   key's credits could pass the bigint range, all its buckets are opened.)
3. The other buckets are packed, in the JVM, into arrays of at most ``SEGMENT``
   amounts.  Arrays and skipped sums of a key go through one sequential pass
   (``mapInArrow``): it jumps over skipped buckets and folds the arrays, and
   returns per array the correction before it and a bit per refused command.
4. Rows of opened buckets join their segment's bits, dealt out by (key, bucket,
   segment); rows of skipped buckets take the correction of their bucket.  Keys
   without a possible refusal take no part in 3, and nothing runs in Python.

The bucketed commands and the bucket table are written once to the session's
shared folder, so the commands' own plan runs once however many outputs use the
fold.  A hot wallet with refusals throughout thus costs one task 8 bytes and some tens
of nanoseconds a command in step 3; the work on its rows is spread evenly.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escrowlens.plans.prefix import RANGE, bucketed
from escrowlens.session import scratch_path

LARGEST = 2 ** 63 - 1
ERR_RANGE = "bigint out of range"
SEGMENT = 512  # commands per array: eight 64-bit words of refusal bits
WIDE = "decimal(38,0)"  # sums beyond a bigint must not wrap


def opened(balance: int, amounts: list[int]) -> tuple[int, int, list[int]]:
    """Fold one array: the balance after it, the total of the refused amounts
    (with the sign turned) and the places refused."""
    refused, added = [], 0
    for place, amount in enumerate(amounts):
        new = balance + amount
        if 0 <= new <= LARGEST:
            balance = new
        else:
            refused.append(place)
            added -= amount
    return balance, added, refused


def refusal_bits(refused: list[int]) -> np.ndarray:
    """Places as 64-bit words."""
    bits = np.zeros(SEGMENT, np.uint8)
    bits[refused] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, bucket, segment, opening, total, amounts) of each key in order ->
    (key, bucket, segment, correction before it, refusal bits)."""
    current, balance, added = object(), 0, 0  # no key is equal to a fresh object
    wide = pa.decimal128(38, 0)
    for batch in batches:
        before, words = [], []
        amounts = batch.column("_amounts")
        for at, (name, opening, total) in enumerate(zip(
                *(batch.column(c).to_pylist() for c in ("_k", "_opening", "_total")), strict=True)):
            if name != current:
                current, balance, added = name, opening, 0
            before.append(Decimal(added))
            if amounts[at].is_valid:
                balance, more, refused = opened(balance, amounts[at].values.to_pylist())
                added += more
                words.append(refusal_bits(refused) if refused else None)
            else:
                balance += total
                words.append(None)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("_k", "_b", "_segment")), pa.array(before, wide),
             pa.array(words, pa.list_(pa.int64()))], names=["_k3", "_b3", "_s3", "_added", "_bits"])


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered_guarded_fold(commands: DataFrame, key: str, order: list[str],
                         refusal: str = "balance below zero") -> DataFrame:
    """Apply signed ``amount`` commands per ``key`` in ``order`` with a floor.

    ``commands`` must carry ``amount`` (bigint), ``start_balance`` (bigint, not
    null, constant per key) and ``pre_error`` (string; a non-null value refuses
    the row before the balance test; rows with a null amount must have one).
    Adds ok, error (``refusal`` when the balance would go below zero),
    balance_before and new_balance (the balance after the row, unchanged when
    refused).  A null key is a key like any other.
    """
    columns = [f"`{c}`" for c in commands.columns if c not in ("start_balance", "pre_error")]
    k, by = f"`{key}`", ", ".join(f"`{c}`" for c in order)
    d = bucketed(commands.withColumn("_step", F.expr("if(pre_error is null, coalesce(amount, 0L), 0L)")),
                 key, order, RANGE)
    inside = f"over (partition by {k}, _bucket order by {by} rows unbounded preceding)"
    placed = _written(d.selectExpr(
        *columns, "start_balance", "pre_error", "_bucket", "_step",
        f"sum(cast(_step as {WIDE})) {inside} as _sum", f"row_number() {inside} - 1 as _place"), "fold-rows")

    # 1. and 2.: buckets, their plain opening balance, and which to open
    per = placed.groupBy(F.expr(f"{k} as _k"), F.expr("_bucket as _b")).agg(F.expr(f"""struct(
        sum(cast(_step as {WIDE})) as total, min(_sum) as low, first(start_balance) as start,
        sum(cast(greatest(_step, 0L) as {WIDE})) as credits)""").alias("s")).select("_k", "_b", "s.*")
    per = per.selectExpr(
        "_k", "_b", "total", "low", f"start + sum(credits) over (partition by _k) > {LARGEST} as wide",
        f"""cast(start + coalesce(sum(total) over (partition by _k order by _b
            rows between unbounded preceding and 1 preceding), 0) as {WIDE}) as _at""")
    per = per.selectExpr("_k", "_b", "total", "_at", "wide or _at + low < 0 as _open")
    per = _written(per.selectExpr("*", "min(if(_open, _b, null)) over (partition by _k) as _first"), "fold-buckets")

    # 3.: arrays of the opened buckets and sums of the skipped ones, in order
    skipped = per.filter("_b >= _first and not _open").selectExpr(
        "_k", "_b", "-1 as _segment", "cast(_at as bigint) as _opening", "cast(total as bigint) as _total",
        "cast(null as array<bigint>) as _amounts")
    opening = per.filter("_open").selectExpr("_k", "_b", "cast(if(_b = _first, _at, null) as bigint) as _opening")
    packed = (placed.selectExpr(f"{k} as _k1", "_bucket", "_place", "_step")
              .join(opening, F.expr("_k1 <=> _k and _bucket = _b"))
              .groupBy("_k", "_b", F.expr(f"cast(_place div {SEGMENT} as int) as _segment"))
              .agg(F.expr("max(_opening) as _opening"), F.expr("0L as _total"), F.expr(
                  "transform(array_sort(collect_list(struct(_place, _step))), x -> x._step) as _amounts")))
    kind = commands.schema[key].dataType.simpleString()
    found = (skipped.unionByName(packed).repartition("_k").sortWithinPartitions("_k", "_b", "_segment")
             .mapInArrow(_corrections, f"_k3 {kind}, _b3 int, _s3 int, _added {WIDE}, _bits array<bigint>"))

    # 4.: rows before any possible refusal of their key, and those after it
    rows = placed.join(per.select("_k", "_b", "_at", "_open", "_first"), F.expr(f"{k} <=> _k and _bucket = _b"))
    kept = [*columns, "pre_error", "_at + _sum as _plain"]
    before_any = rows.filter("_first is null or _b < _first").selectExpr(
        *kept, f"cast(0 as {WIDE}) as _added", "false as _refused")
    after = (rows.filter("_b >= _first")
             .withColumn("_segment", F.expr(f"if(_open, cast(_place div {SEGMENT} as int), -1)"))
             .join(found, F.expr("_k <=> _k3 and _b = _b3 and _segment = _s3"))
             .withColumn("_refused", F.expr(f"""coalesce(shiftright(get(_bits, cast(_place % {SEGMENT} div 64 as int)),
                                                cast(_place % 64 as int)) & 1L = 1L, false)""")))
    after = after.selectExpr(*kept, f"""cast(_added - sum(cast(if(_refused, _step, 0L) as {WIDE})) over (
        partition by _k, _b, _segment order by _place rows unbounded preceding) as {WIDE}) as _added""", "_refused")
    told = refusal.replace("\\", "\\\\").replace("'", "\\'")
    every = before_any.unionByName(after).withColumn("new_balance", F.expr("cast(_plain + _added as bigint)"))
    every = every.withColumn("error", F.expr(f"""coalesce(pre_error, if(_refused,
        if(cast(new_balance as {WIDE}) + amount < 0, '{told}', '{ERR_RANGE}'), null))"""))
    return every.selectExpr(*columns, "error is null as ok", "error",
                            "if(error is null, new_balance - amount, new_balance) as balance_before", "new_balance")
