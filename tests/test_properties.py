"""Parallel formulations against plain sequential folds (property tests)."""

from __future__ import annotations

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import pytest

from escrowlens.plans import fold, prefix
from escrowlens.plans.fold import ordered_guarded_fold
from escrowlens.plans.prefix import RANGE, previous_value, running_clamped, running_sum

BASE = dt.datetime(2024, 1, 1)
rows_strategy = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 4), st.integers(-50, 50)),
    min_size=1, max_size=40)
SETTINGS = settings(max_examples=15, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


def _frame(spark, rows):
    data = [(k, i, BASE + dt.timedelta(days=day, seconds=i), v)
            for i, (k, day, v) in enumerate(rows)]
    return spark.createDataFrame(data, "k string, seq long, ts timestamp_ntz, v long")


def _python_by_key(rows, step, start=0):
    state, out = {}, {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1], i))
    for i in order:
        k, _, v = rows[i]
        state[k], out[i] = step(state.get(k, start), v)
    return out


@SETTINGS
@given(rows=rows_strategy)
def test_bucketed_running_sum_matches_fold(spark, rows):
    df = _frame(spark, rows)
    got = {r["seq"]: r["s"] for r in running_sum(
        df, "k", ["ts", "seq"], "v", "s", bucket=F.to_date("ts")).collect()}
    exp = _python_by_key(rows, lambda b, v: (b + v, b + v))
    assert got == exp


@SETTINGS
@given(rows=rows_strategy, start=st.integers(0, 30))
def test_bucketed_clamp_matches_fold(spark, rows, start):
    df = _frame(spark, rows)
    got = {r["seq"]: r["e"] for r in running_clamped(
        df, "k", ["ts", "seq"], "v", "e", start=F.lit(start).cast("bigint"),
        bucket=F.to_date("ts")).collect()}
    exp = _python_by_key(rows, lambda b, v: (max(b + v, 0), max(b + v, 0)), start)
    assert got == exp
    plain = {r["seq"]: r["e"] for r in running_clamped(
        df, "k", ["ts", "seq"], "v", "e", start=F.lit(start).cast("bigint")).collect()}
    assert plain == exp


@SETTINGS
@given(rows=rows_strategy)
def test_bucketed_previous_value_matches_lag(spark, rows):
    df = _frame(spark, rows)
    got = {r["seq"]: r["p"] for r in previous_value(
        df, "k", ["ts", "seq"], "v", "p", bucket=F.to_date("ts")).collect()}
    exp = _python_by_key(rows, lambda prev, v: (v, prev), None)
    assert got == exp


@SETTINGS
@given(rows=rows_strategy, start=st.integers(0, 30))
def test_guarded_fold_matches_sequential(spark, rows, start):
    df = _frame(spark, rows).select(
        "k", "seq", F.col("v").alias("amount"), F.lit(start).cast("bigint").alias("start_balance"),
        F.when(F.col("v") == 0, F.lit("zero")).alias("pre_error"))
    got = {r["seq"]: (r["ok"], r["new_balance"])
           for r in ordered_guarded_fold(df, "k", ["seq"]).collect()}

    def step(b, v):
        if v == 0:
            return b, (False, b)
        if b + v < 0:
            return b, (False, b)
        return b + v, (True, b + v)
    order_rows = [(k, i, v) for i, (k, _, v) in enumerate(rows)]
    exp = _python_by_key(order_rows, step, start)
    assert got == exp


@SETTINGS
@given(rows=rows_strategy)
def test_bucketed_next_value_matches_lead(spark, rows):
    df = _frame(spark, rows)
    got = {r["seq"]: r["n"] for r in previous_value(
        df, "k", ["ts", "seq"], "v", "n", bucket=F.to_date("ts"), following=True).collect()}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1], i))
    exp, last = {}, {}
    for i in reversed(order):
        k = rows[i][0]
        exp[i] = last.get(k)
        last[k] = rows[i][2]
    assert got == exp


@SETTINGS
@given(rows=rows_strategy, start=st.integers(0, 30))
def test_range_buckets_match_fold(spark, rows, start):
    """Range-partition buckets: exact for running sum, clamp and lag."""
    df = _frame(spark, rows)
    got = {r["seq"]: r["s"] for r in running_sum(
        df, "k", ["ts", "seq"], "v", "s", bucket=RANGE).collect()}
    assert got == _python_by_key(rows, lambda b, v: (b + v, b + v))
    got = {r["seq"]: r["e"] for r in running_clamped(
        df, "k", ["ts", "seq"], "v", "e", start=F.lit(start).cast("bigint"),
        bucket=RANGE).collect()}
    assert got == _python_by_key(rows, lambda b, v: (max(b + v, 0), max(b + v, 0)), start)
    got = {r["seq"]: r["p"] for r in previous_value(
        df, "k", ["ts", "seq"], "v", "p", bucket=RANGE).collect()}
    assert got == _python_by_key(rows, lambda prev, v: (v, prev), None)


def test_range_buckets_split_one_hot_key_and_day(spark, monkeypatch):
    """One key, one day, many rows: the range buckets spread it over tasks."""
    import datetime as _dt
    rows = [("hot", i, _dt.datetime(2024, 1, 1, 12), (i % 7) - 3) for i in range(4000)]
    rows += [("cold", i, _dt.datetime(2024, 1, 2), 1) for i in range(4000, 4010)]
    df = spark.createDataFrame(rows, "k string, seq long, ts timestamp_ntz, v long")
    from escrowlens.plans.prefix import bucketed
    monkeypatch.setattr(prefix, "SPLIT_ROWS", 256)  # as if the hot key were large
    buckets = bucketed(df, "k", ["ts", "seq"], RANGE).filter("k = 'hot'").select("_bucket").distinct().count()
    got = running_clamped(df, "k", ["ts", "seq"], "v", "e", bucket=RANGE)
    res = {r["seq"]: r["e"] for r in got.filter("k = 'hot'").collect()}
    assert buckets > 4
    exp, b = {}, 0
    for k, seq, _, v in rows[:4000]:
        b = max(b + v, 0)
        exp[seq] = b
    assert res == exp


def test_guarded_fold_carries_state_across_arrow_batches(spark):
    """A long wallet split over many tiny Arrow batches folds like one run."""
    import random
    rnd = random.Random(7)
    rows = [("hot" if i % 5 else f"k{i % 3}", i, BASE, rnd.randint(-40, 40))
            for i in range(300)]
    df = spark.createDataFrame(rows, "k string, seq long, ts timestamp_ntz, v long").select(
        "k", "seq", F.col("v").alias("amount"), F.lit(10).cast("bigint").alias("start_balance"),
        F.lit(None).cast("string").alias("pre_error"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["seq"]: (r["ok"], r["new_balance"])
               for r in ordered_guarded_fold(df, "k", ["seq"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    bal, exp = {}, {}
    for k, seq, _, v in rows:
        b = bal.get(k, 10)
        if b + v >= 0:
            bal[k] = b + v
            exp[seq] = (True, b + v)
        else:
            exp[seq] = (False, b)
    assert got == exp


def _fold_frame(spark, rows, start=10):
    return spark.createDataFrame(rows, "k string, seq long, amount long").select(
        "*", F.lit(start).cast("bigint").alias("start_balance"), F.lit(None).cast("string").alias("pre_error"))


def _fold_by_hand(rows, start=10):
    bal, exp = {}, {}
    for k, seq, v in rows:
        b = bal.setdefault(k, start)
        ok = 0 <= b + v < 2 ** 63
        bal[k] = b + v if ok else b
        exp[seq] = (ok, b, bal[k])
    return exp


def _folded(df):
    return {r["seq"]: (r["ok"], r["balance_before"], r["new_balance"])
            for r in ordered_guarded_fold(df, "k", ["seq"]).collect()}


@pytest.mark.parametrize("split, segment", [(64, 64), (97, 128), (1 << 15, 512)])
def test_hot_wallet_with_refusals_throughout_is_split(spark, monkeypatch, split, segment):
    """A third of the rows in one wallet that refuses all the time: equal to the
    sequential fold, over many buckets and segments."""
    import random
    monkeypatch.setattr(prefix, "SPLIT_ROWS", split)
    monkeypatch.setattr(fold, "SEGMENT", segment)
    rnd = random.Random(split)
    rows = [("hot" if i % 3 == 0 else f"k{i % 40}", i, rnd.randint(-50, 30) if i % 9 else rnd.randint(0, 150))
            for i in range(6000)]
    rows += [("rich", 6000 + i, -3 if i % 2 else 5) for i in range(500)]  # never refused
    rows += [(None, 7000 + i, 1 - 2 * (i % 2)) for i in range(20)]
    exp = _fold_by_hand(rows)
    assert sum(not ok for ok, _, _ in exp.values()) > 500
    assert _folded(_fold_frame(spark, rows)) == exp
    parts = prefix.bucketed(_fold_frame(spark, rows), "k", ["seq"], prefix.RANGE).groupBy("k", "_bucket").count()
    sizes = [r["count"] for r in parts.filter("k = 'hot'").collect()]
    assert sum(sizes) == 2000 and (len(sizes) > 8 or split > 2000)


def test_fold_near_the_bigint_range(spark, monkeypatch):
    monkeypatch.setattr(prefix, "SPLIT_ROWS", 4)
    top = 2 ** 63 - 1
    rows = [("a", i, v) for i, v in enumerate([top - 10, 5, -top, top, 1, -3, -top, top - 20, 30, -9, top, -4])]
    rows += [("b", 100 + i, v) for i, v in enumerate([-11, top, -5, 20, -top] * 5)]
    assert _folded(_fold_frame(spark, rows)) == _fold_by_hand(rows)


def test_rows_never_enter_python_and_keys_without_refusal_have_no_array(spark, monkeypatch):
    """Only (key, bucket, segment, amounts) of opened buckets meet mapInArrow."""
    monkeypatch.setattr(prefix, "SPLIT_ROWS", 50)
    rows = [("hot", i, 5 if i % 2 else -4) for i in range(3000)] + [("bad", i, -1) for i in range(3000, 3020)]
    out = ordered_guarded_fold(_fold_frame(spark, rows).withColumn("payload", F.lit("x")), "k", ["seq"])
    assert {r["seq"]: (r["ok"], r["balance_before"], r["new_balance"]) for r in out.collect()} == _fold_by_hand(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    arrow = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert len(arrow) == 1 and "payload" not in arrow[0]
    real = fold._corrections
    monkeypatch.setattr(fold, "_corrections", lambda batches: real(passed_on(batches)))
    count = spark.sparkContext.accumulator(0)

    def passed_on(batches):
        for b in batches:
            count.add(b.num_rows)
            yield b
    ordered_guarded_fold(_fold_frame(spark, rows), "k", ["seq"]).collect()
    assert count.value == 1  # one array: the wallet "bad"
