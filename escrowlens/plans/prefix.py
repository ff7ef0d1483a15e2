"""Running sums and floor-clamped running balances that split hot keys.

A plain ``Window.partitionBy(key).orderBy(...)`` puts every row of a key in
one task; a wallet holding a third of all ledger rows would then be a single
task.  Both operators here take a *bucket* column that is non-decreasing in
the row order (by default the calendar day of the timestamp) and compute in
two levels:

1. ``groupBy(key, bucket)`` partial aggregates (map-side combine);
2. a window over the bucket table only (one row per key and bucket) gives
   each bucket its offset - the sum of all earlier buckets of that key;
3. a window inside ``(key, bucket)`` gives the local running value, and the
   offset is added.

Step 3 partitions by ``(key, bucket)``, so one hot key spreads over as many
tasks as it has buckets; the join with the offsets is on the same columns and
reuses that partitioning (``_keyed`` sees to null keys).

A day can itself be hot (one key, one day, a third of all rows).  Passing
``bucket=RANGE`` instead cuts the rows of a key at some of its own rows: those
whose hash of (key, order) is 0 modulo ``SPLIT_ROWS``.  So a bucket holds about
``SPLIT_ROWS`` rows whatever the key's size, a small key is one bucket, and even a
single timestamp is split by the tie-break column.  Which rows are cuts is a
function of the rows alone, so every branch of a plan finds the same ones.  At most
``MOST_CUTS`` of them (the smallest hashes) travel in one broadcast: beyond
``SPLIT_ROWS * MOST_CUTS`` rows buckets grow, to a 65,536th of the table.  A row's
bucket is a binary search in the cuts of its key, non-decreasing in the order by
construction, so the result is exact; the price is one more pass over the key and
order columns.  Nothing runs while the DataFrame is built and nothing is written.

Floor at zero (``e_i = max(e_{i-1} + d_i, 0)``, ``e_0 = w0``) has the closed
form ``e_i = S_i - least(-w0, min_{j<=i} S_j)`` with ``S`` the running sum of
``d``, so it needs a running minimum as well as a running sum; both split the
same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = "range"
SPLIT_ROWS = 1 << 15
MOST_CUTS = 1 << 16


def _order(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _cuts(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """_ck (key), _cuts (sorted points at which its rows are cut): at most
    ``MOST_CUTS`` points in all."""
    points = df.select(F.col(key).alias("_ck"), F.struct(*order).alias("_p"),
                       F.xxhash64(key, *order).alias("_h"))
    return (points.filter(F.pmod("_h", F.lit(SPLIT_ROWS)) == 0)
            .orderBy("_h", "_ck", "_p").limit(MOST_CUTS)
            .groupBy("_ck").agg(F.array_sort(F.collect_set("_p")).alias("_cuts")))


def bucketed(df: DataFrame, key: str, order: list, bucket) -> DataFrame:
    """``df`` with a ``_bucket`` column that is non-decreasing in the order of each
    key; a range bucket is the number of its key's cuts up to the row."""
    if isinstance(bucket, str) and bucket == RANGE:
        jumps = ", ".join(str(1 << k) for k in reversed(range(MOST_CUTS.bit_length())))
        point = "struct(" + ", ".join(f"`{c}`" for c in order) + ")"
        place = F.expr(f"if(_cuts is null, 0, aggregate(array({jumps}), 0, (at, jump) -> "
                       f"if(get(_cuts, at + jump - 1) <= {point}, at + jump, at)))")
        cuts = F.broadcast(_cuts(df, key, order))  # at most MOST_CUTS points
        return (df.join(cuts, F.col(key).eqNullSafe(F.col("_ck")), "left")
                .withColumn("_bucket", place).drop("_ck", "_cuts"))
    return df.withColumn("_bucket", bucket)


KEY = ["_k", "_kn"]


def _keyed(df: DataFrame, key: str) -> DataFrame:
    """``df`` with its key as ``KEY``, a value that is never null and whether it was: windows
    and joins on them match a null key with itself and need the same partitioning, so the
    rows are shuffled once for both."""
    kind = df.schema[key].dataType
    blank = F.lit("" if kind.typeName() == "string" else 0).cast(kind)
    return df.withColumns({"_k": F.coalesce(key, blank), "_kn": F.col(key).isNull()}).drop(key)


def _unkeyed(key: str) -> Column:
    return F.when(~F.col("_kn"), F.col("_k")).alias(key)


def _on_bucket(rows: DataFrame, per_bucket: DataFrame) -> DataFrame:
    """Rows with the values of their bucket."""
    return rows.join(per_bucket, [*KEY, "_bucket"])


def running_sum(df: DataFrame, key: str, order: list, value: str, out: str,
                bucket: Column | None = None, per_key: DataFrame | None = None) -> DataFrame:
    """Add ``out`` = running sum of ``value`` per ``key`` in ``order``.

    The result is left-joined with ``per_key`` (``key`` and other columns); with buckets that
    takes no shuffle of the rows, as the join is made on the buckets' offsets.
    """
    if bucket is None:
        w = Window.partitionBy(key).orderBy(*_order(order)).rowsBetween(
            Window.unboundedPreceding, 0)
        d = df.withColumn(out, F.sum(value).over(w))
        return d if per_key is None else d.join(per_key, key, "left")
    b = "_bucket"
    kind = "bigint" if df.schema[value].dataType.typeName() == "long" else df.schema[value].dataType
    d = _keyed(bucketed(df, key, order, bucket), key)
    totals = d.groupBy(*KEY, b).agg(F.sum(value).alias("_bsum"))
    wb = Window.partitionBy(*KEY).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*KEY, b, F.coalesce(F.sum("_bsum").over(wb), F.lit(0)).alias("_off"))
    more = []
    if per_key is not None:
        more = [c for c in per_key.columns if c != key]
        offsets = offsets.join(per_key, ~F.col("_kn") & (F.col("_k") == F.col(key)), "left").drop(key)
    wl = Window.partitionBy(*KEY, b).orderBy(*_order(order)).rowsBetween(
        Window.unboundedPreceding, 0)
    local = d.withColumn("_local", F.sum(value).over(wl))
    total = (F.col("_local") + F.col("_off")).cast(kind).alias(out)
    return _on_bucket(local, offsets).select(
        *[_unkeyed(key) if c == key else c for c in df.columns], *more, total)


def running_clamped(df: DataFrame, key: str, order: list, delta: str, out: str,
                    start: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """Add ``out`` = balance after each row when it may never drop below zero.

    ``start`` is the opening balance per key (a column constant within a key;
    0 when omitted).
    """
    w0 = start if start is not None else F.lit(0).cast("bigint")
    d = df.withColumn("_w0", w0)
    if bucket is None:
        w = Window.partitionBy(key).orderBy(*_order(order)).rowsBetween(
            Window.unboundedPreceding, 0)
        d = d.withColumn("_s", F.sum(delta).over(w))
        d = d.withColumn("_m", F.min("_s").over(w))
    else:
        b = "_bucket"
        d = _keyed(bucketed(d, key, order, bucket), key)
        wl = Window.partitionBy(*KEY, b).orderBy(*_order(order)).rowsBetween(
            Window.unboundedPreceding, 0)
        d = d.withColumn("_ls", F.sum(delta).over(wl)).withColumn("_lm", F.min("_ls").over(wl))
        per_b = d.groupBy(*KEY, b).agg(F.sum(delta).alias("_bsum"), F.min("_ls").alias("_bmin"))
        wb = Window.partitionBy(*KEY).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
        per_b = per_b.withColumn("_off", F.coalesce(F.sum("_bsum").over(wb), F.lit(0))
                                 .cast("bigint"))
        # Lowest running sum reached in any earlier bucket of the key.
        per_b = per_b.withColumn("_pmin", F.min(F.col("_off") + F.col("_bmin")).over(wb))
        d = _on_bucket(d, per_b.select(*KEY, b, "_off", "_pmin"))
        d = d.withColumn("_s", F.col("_ls") + F.col("_off"))
        m = F.col("_lm") + F.col("_off")
        d = d.withColumn("_m", F.when(F.col("_pmin").isNull(), m)
                         .otherwise(F.least(m, F.col("_pmin"))))
        d = d.select(*[_unkeyed(key) if c == key else c for c in df.columns], "_w0", "_s", "_m")
    res = F.col("_w0") + F.col("_s") - F.least(F.lit(0).cast("bigint"),
                                               F.col("_w0") + F.col("_m"))
    return d.withColumn(out, res).drop("_w0", "_s", "_m")


def previous_value(df: DataFrame, key: str, order: list, value: str, out: str,
                   bucket: Column | None = None, following: bool = False) -> DataFrame:
    """Add ``out`` = ``value`` of the previous row of the same key (the next row
    when ``following``), null at the edge - ``lag`` / ``lead`` split by bucket
    like the running sums: the neighbour is the local one, or for a bucket's
    first (last) row the last (first) row of the nearest earlier (later)
    bucket of the key."""
    ordc = _order(order)
    shift = F.lead if following else F.lag
    if bucket is None:
        return df.withColumn(out, shift(value).over(Window.partitionBy(key).orderBy(*ordc)))
    b = "_bucket"
    d = _keyed(bucketed(df, key, order, bucket), key)
    edge = F.min_by if following else F.max_by
    last = d.groupBy(*KEY, b).agg(edge(value, F.struct(*ordc)).alias("_bedge"))
    wb = Window.partitionBy(*KEY).orderBy(b)
    last = last.select(*KEY, b, shift("_bedge").over(wb).alias("_bnext"))
    wl = Window.partitionBy(*KEY, b).orderBy(*ordc)
    d = d.withColumn("_edge", shift(F.lit(1)).over(wl).isNull()) \
         .withColumn("_local", shift(value).over(wl))
    found = F.when(F.col("_edge"), F.col("_bnext")).otherwise(F.col("_local")).alias(out)
    return _on_bucket(d, last).select(*[_unkeyed(key) if c == key else c for c in df.columns], found)
