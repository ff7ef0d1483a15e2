"""Streaming: duplicate and late events across micro-batches (FIXTURES §3 'late')."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from escrowlens.streaming import streams as st

SCHEMA = st.STATUS_EVENT_SCHEMA


def test_duplicate_and_late_events(spark):
    base = tempfile.mkdtemp(prefix="feed-")
    src, out = os.path.join(base, "in"), os.path.join(base, "out")
    t0 = dt.datetime(2024, 1, 10, 12, 0)
    first = [(1, 7, "paid", t0), (2, 7, "processing", t0 + dt.timedelta(days=3))]
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(os.path.join(src, "b1"))

    def run():
        q = (st.dedup_events(st.feed(spark, src + "/*", SCHEMA, "ts"), delay="1 day")
             .writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", out + "-ckpt").trigger(availableNow=True).start())
        q.awaitTermination()

    run()
    # Second delivery: a duplicate of event 2 and an event 5 days older than the
    # newest seen (beyond the 1-day watermark), plus one fresh event.
    second = [(2, 7, "processing", t0 + dt.timedelta(days=3)),
              (3, 8, "paid", t0 - dt.timedelta(days=2)),
              (4, 8, "disputed", t0 + dt.timedelta(days=3, hours=1))]
    spark.createDataFrame(second, SCHEMA).coalesce(1).write.parquet(os.path.join(src, "b2"))
    run()
    got = sorted(r["event_id"] for r in spark.read.parquet(out).collect())
    assert got == [1, 2, 4]


def _files(spark, rows_of_files, schema, prefix):
    base = tempfile.mkdtemp(prefix=prefix)
    for i, rows in enumerate(rows_of_files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(base, f"f{i}"))
    return base + "/*"


def test_dedup_keeps_late_rows_as_dead_letters(spark):
    t0, day = dt.datetime(2024, 1, 10), dt.timedelta(days=1)
    files = [[(1, 7, "paid", t0), (2, 7, "processing", t0 + day / 2), (2, 7, "processing", t0 + day / 2)],
             [(2, 7, "processing", t0 + day / 2), (3, 8, "paid", t0 + 5 * day)],
             [(3, 8, "paid", t0 + 5 * day), (4, 9, "paid", t0 - day), (1, 7, "paid", t0)]]
    feed = st.feed(spark, _files(spark, files, SCHEMA, "feed-"), SCHEMA, "ts", max_files=1)
    rows, late = st.run_dedup(feed, "event_id", "ts", "t-dedup")
    assert sorted(r["event_id"] for r in rows.collect()) == [1, 2, 3]
    assert sorted(r["event_id"] for r in late.collect()) == [1, 4]


def test_replayed_micro_batches_write_the_same_again(spark):
    t0 = dt.datetime(2024, 1, 10)
    schema = SCHEMA.replace("timestamp_ntz", "timestamp")
    batches = [spark.createDataFrame([(k, k, "paid", t0 + dt.timedelta(hours=k)), (0, 0, "paid", t0)], schema)
               for k in (1, 2, 3)]
    base = tempfile.mkdtemp(prefix="steps-")
    dedup = st.dedup_step(base, "event_id", "ts", 24)
    merged = st.merged_step(base, lambda b: b.groupBy("status").count(),
                            lambda p: p.groupBy("status").agg(F.sum("count").alias("count")), compact_every=2)
    for k in (0, 0, 1, 2, 1, 2):  # the first is replayed, then the last two
        dedup(batches[k], k)
        merged(batches[k], k)
    got = spark.read.parquet(base + "/rows").select("event_id", "b").collect()
    assert sorted((r["event_id"], r["b"]) for r in got) == [(0, 0), (1, 0), (2, 1), (3, 2)]
    total = st._merged(spark, base, spark.read.parquet(base + "/part").drop("b").schema,
                       lambda p: p.groupBy("status").agg(F.sum("count").alias("count")))
    assert [r["count"] for r in total.collect()] == [6]


def test_last_message_merged_over_batches_equals_batch(spark):
    from escrowlens.operators.chat import conversation_last_message
    rows = [(f"m{k}", f"C{k % 3}", "a", f"text {k}", False, dt.datetime(2024, 1, 1, (k * 7) % 24)) for k in range(9)]
    schema = ("id string, conversation_id string, sender_id string, body string, "
              "is_read boolean, created_at timestamp_ntz")
    path = _files(spark, [[r] for r in rows], schema, "msgs-")
    feed = st.feed(spark, path, schema, "created_at", max_files=1)
    got = st.run_merged(feed, st.last_message_partial, st.merge_last_message, "t-last", compact_every=4)
    got = got.select("conversation_id", "last.body", F.col("last.created_at").cast("timestamp_ntz"))
    exp = conversation_last_message({"messages": spark.createDataFrame(rows, schema)})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_work_of_a_micro_batch_stays_constant_over_fifty_batches(spark, monkeypatch):
    """Deduplication opens the folders of the horizon alone, merging the newest fold
    and what follows it; older partials are gone."""
    t0 = dt.datetime(2024, 1, 1)
    schema = SCHEMA.replace("timestamp_ntz", "timestamp")
    base = tempfile.mkdtemp(prefix="long-")
    dedup = st.dedup_step(base, "event_id", "ts", 24)
    total = lambda p: p.groupBy("status").agg(F.sum("count").alias("count"))
    merged = st.merged_step(base, lambda b: b.groupBy("status").count(), total, compact_every=5)
    opened, real = [], st.exists
    monkeypatch.setattr(st, "exists", lambda s, p: opened[-1].append(p) or real(s, p))
    for k in range(50):
        rows = [(k, k, "paid", t0 + dt.timedelta(hours=8 * k)), (max(k - 1, 0), 0, "paid", t0 + dt.timedelta(hours=8 * max(k - 1, 0)))]
        opened.append([])
        batch = spark.createDataFrame(rows, schema).coalesce(1)
        dedup(batch, k)
        merged(batch, k)
    assert max(map(len, opened)) <= 3 and len(opened[-1]) >= 2
    rows = spark.read.parquet(base + "/rows").collect()
    assert sorted(r["event_id"] for r in rows) == list(range(50))
    assert len(st.batches_in(spark, base + "/part")) <= 10 and len(st.batches_in(spark, base + "/full")) <= 2
    schema = spark.read.parquet(base + "/part").drop("b").schema
    assert [r["count"] for r in st._merged(spark, base, schema, total).collect()] == [100]


def _unread_by_hand(messages, reads, sides):
    read = {}
    for c, v, at in reads:
        read[c, v] = max(read.get((c, v), at), at)
    got = {}
    for m in {m[0]: m for m in messages}.values():
        i, c, sender, is_read, at = m
        for v in sides[c]:
            if not is_read and v != sender and at > read.get((c, v), dt.datetime.min):
                got[c, v] = got.get((c, v), 0) + 1
    return got


def test_live_unread_after_each_of_five_micro_batches(spark):
    """Both feeds move together; late and repeated rows of either; a replayed batch."""
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    m_schema = "id string, conversation_id string, sender_id string, is_read boolean, created_at timestamp"
    r_schema = "conversation_id string, viewer_id string, read_at timestamp"
    sides = {f"c{k}": (f"a{k}", f"b{k}") for k in range(6)}
    conversations = spark.createDataFrame([(c, *v) for c, v in sides.items()], "id string, user_a_id string, user_b_id string")
    import random
    rnd = random.Random(4)
    state = st.unread_state(spark, "t", 3)
    step = st.unread_step(state, conversations)
    messages, reads = [], []
    for k in range(5):
        new_m = [(f"m{k}-{i}", f"c{rnd.randrange(6)}", None, rnd.random() < 0.1, at(rnd.randint(max(0, 20 * k - 30), 20 * k + 20)))
                 for i in range(30)]
        new_m = [(i, c, sides[c][rnd.randrange(2)], r, t) for i, c, _, r, t in new_m]
        new_m += rnd.sample(messages, min(len(messages), 15)) + new_m[:3]  # repeated
        new_r = [(c, sides[c][rnd.randrange(2)], at(rnd.randint(max(0, 20 * k - 40), 20 * k + 15)))
                 for c in rnd.sample(sorted(sides), 3)]
        messages, reads = messages + new_m, reads + new_r
        batch = st.unread_feed(spark.createDataFrame(new_m, m_schema), spark.createDataFrame(new_r, r_schema))
        for _ in range(2 if k in (2, 4) else 1):  # the third and the last are replayed
            step(batch, k)
        got = {(r["conversation_id"], r["viewer_id"]): r["unread_count"] for r in st.unread_now(state).collect()}
        assert got == _unread_by_hand(messages, reads, sides), k
    assert got


def test_payments_change_orders_and_a_replay_changes_nothing(spark):
    from escrowlens.sources.versions import VersionedTable
    at = lambda d: dt.datetime(2024, 1, d)
    rows = [(k, "pending_payment" if k % 3 else "processing", at(5), at(5)) for k in range(400)]
    table = VersionedTable.create(spark.createDataFrame(rows, "id long, status string, created_at timestamp, updated_at timestamp"),
                                  "t-orders", ["id"], F.floor(F.col("id") / 10))
    step = st.payment_step(table)
    notice = lambda *r: spark.createDataFrame(r, "order_id long, status string, ts timestamp")
    first = notice((1, "paid", at(7)), (1, "paid", at(6)), (2, "expired", at(6)), (3, "paid", at(6)), (4, "paid", at(4)), (None, "paid", at(6)))
    step(first, 0)
    step(first, 0)  # replayed after a failure
    step(notice((1, "paid", at(9)), (5, "paid", at(8))), 1)  # the first one delivered again
    now = {r["id"]: (r["status"], r["updated_at"]) for r in table.read().collect()}
    assert len(now) == 400
    changed = {k: v for k, v in now.items() if v != (rows[k][1], at(5))}
    assert changed == {1: ("paid", at(6)), 5: ("paid", at(8))}


def test_upsert_rewrites_only_the_parts_of_a_batch(spark):
    """A 1 % batch of neighbouring keys rewrites under 5 % of the files; a job that
    dies half-way leaves the table as it was; the same batch again gives the same table."""
    from escrowlens.sources.versions import VersionedTable, append_batch, appended, batches_in, remove
    base = spark.range(10_000).selectExpr("id", "id * 2 as v")
    table = VersionedTable.create(base, "t-upsert", ["id"], F.floor(F.col("id") / 100))
    assert len(table._parts()) == 100
    changes = spark.range(1_000, 1_100).selectExpr("id", "-id as v").unionByName(spark.range(20_000, 20_001).selectExpr("id", "id as v"))
    gone = spark.range(50, 52)
    table.upsert(changes, 1, gone=gone)
    want = {k: 2 * k for k in range(10_000) if k not in (50, 51)} | {k: -k for k in range(1_000, 1_100)} | {20_000: 20_000}
    read = lambda: {r["id"]: r["v"] for r in table.read().collect()}
    assert read() == want and table.read().count() == len(want)
    now = table._parts()
    assert sum(b == 1 for b in now.values()) == 3 and len(now) == 101  # of 100 parts: 10, 0 and the new one
    table.upsert(changes, 1, gone=gone)  # repeated
    assert read() == want and table._parts() == now
    # killed after its data and before its list: readers don't see it
    table.upsert(spark.range(7, 8).selectExpr("id", "0L as v"), 2)
    remove(spark, f"{table.base}/parts/b=2/_SUCCESS")
    assert read() == want
    table.upsert(spark.range(7, 8).selectExpr("id", "0L as v"), 2)
    assert read() == want | {7: 0}
    table.forget(keep=1)
    assert read() == want | {7: 0} and batches_in(spark, f"{table.base}/parts") == [2]
    log = tempfile.mkdtemp(prefix="append-")
    rows = spark.range(3).selectExpr("id")
    for b in (0, 1, 1, 0):
        append_batch(rows, log, b)
    assert appended(spark, log, rows.schema).count() == 6


def test_payments_write_only_the_orders_that_change(spark):
    """A micro-batch that touches every part writes its changed orders, not the parts;
    folding, a replay and a later upsert give the same table."""
    from escrowlens.sources.versions import VersionedTable, batches_in
    at = dt.datetime(2024, 1, 5)
    rows = [(k, "pending_payment", at, at) for k in range(400)]
    schema = "id long, status string, created_at timestamp, updated_at timestamp"
    table = VersionedTable.create(spark.createDataFrame(rows, schema), "t-over", ["id"], F.floor(F.col("id") / 10))
    step = st.payment_step(table)
    for b in (0, 1, 1):
        paid = [(k, "paid", at + dt.timedelta(days=1 + b)) for k in range(b, 400, 10)]
        step(spark.createDataFrame(paid, "order_id long, status string, ts timestamp"), b)
    assert batches_in(spark, f"{table.base}/data") == [0]
    assert spark.read.parquet(f"{table.base}/over/b=2").count() == 40
    status = lambda: {r["id"]: (r["status"], r["updated_at"]) for r in table.read().collect()}
    want = {k: ("paid", at + dt.timedelta(days=1 + k % 10)) if k % 10 < 2 else ("pending_payment", at) for k in range(400)}
    assert status() == want and table.read().count() == 400
    near = table.near(spark.range(10, 12), 3)
    assert {r["id"]: r["status"] for r in near.collect()} == {k: want[k][0] for k in range(10, 20)}
    more = spark.createDataFrame([(0, "cancelled", at, at), (7, "cancelled", at, at)], schema)
    table.overlay(more, 3, fold_every=3)
    want |= {0: ("cancelled", at), 7: ("cancelled", at)}
    assert status() == want and table.read().count() == 400
    assert batches_in(spark, f"{table.base}/parts") == [0, 3]
    table.overlay(spark.createDataFrame([(1, "refunded", at, at)], schema), 4)
    table.upsert(spark.createDataFrame([(2, "refunded", at, at)], schema), 5, gone=spark.range(3, 4))
    want = {k: ("refunded", at) if k in (1, 2) else v for k, v in want.items() if k != 3}
    assert status() == want
    table.forget(keep=1)
    assert status() == want and batches_in(spark, f"{table.base}/over") == []


def test_live_unread_is_inserts_minus_reads(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    messages = spark.createDataFrame(
        [("m1", "c", "A", False, at(1)), ("m2", "c", "A", False, at(3)), ("m3", "c", "B", False, at(4)),
         ("m4", "c", "A", True, at(5))], "id string, conversation_id string, sender_id string, is_read boolean, "
        "created_at timestamp_ntz")
    reads = spark.createDataFrame([("c", "B", at(2))], "conversation_id string, viewer_id string, read_at timestamp_ntz")
    conv = spark.createDataFrame([("c", "A", "B")], "id string, user_a_id string, user_b_id string")
    got = {r["viewer_id"]: r["unread_count"] for r in st.live_unread(messages, reads, conv).collect()}
    assert got == {"A": 1, "B": 1}


def test_payment_notices_are_guarded(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    orders = spark.createDataFrame([("o1", "pending_payment", at(5)), ("o2", "processing", at(5)),
                                    ("o3", "pending_payment", at(5)), ("o4", "pending_payment", at(5))],
                                   "id string, status string, created_at timestamp_ntz")
    notices = spark.createDataFrame([("o1", "paid", at(7)), ("o1", "paid", at(6)), ("o2", "paid", at(6)),
                                     ("o3", "paid", at(4)), ("o4", "expired", at(6))],
                                    "order_id string, status string, ts timestamp_ntz")
    got = st.apply_payments(orders, notices).collect()
    assert [(r["order_id"], r["old_status"], r["status"], r["updated_at"]) for r in got] == [
        ("o1", "pending_payment", "paid", at(6))]


def test_auto_complete_timers_across_batches(spark):
    """Both timer implementations over three micro-batches equal the rule
    'delivered, then no status change for 3 days, and the watermark passed'."""
    from escrowlens.streaming.timers import run_auto_complete
    schema = st.ORDER_EVENT_SCHEMA
    d = dt.datetime(2024, 3, 1)
    files = [
        [("a", "delivered", d), ("b", "delivered", d), ("c", "delivered", d)],
        [("a", "completed", d + dt.timedelta(days=1)),              # a: disarmed
         ("b", "refunded", d + dt.timedelta(days=5)),               # b: fired before this
         ("d", "delivered", d + dt.timedelta(days=6))],
        [("e", "delivered", d + dt.timedelta(days=20))],            # moves the watermark
    ]
    base = tempfile.mkdtemp(prefix="orders-")
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(base, f"f{i}"))
    feed = st.order_event_feed(spark, base + "/*", max_files=1)
    got = sorted(r["order_id"] for r in run_auto_complete(feed, "t-timers").collect())
    assert got == ["b", "c", "d"]
    # the state-store form, restarted from its checkpoint after every file
    src, out = tempfile.mkdtemp(prefix="events-"), tempfile.mkdtemp(prefix="timers-")
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(src, f"f{i}"))
        fired = st.run_timers(st.auto_complete_timers(st.order_event_feed(spark, src + "/*")), out)
    assert sorted(r["order_id"] for r in fired.collect()) == got
    assert {(r["order_id"], r["delivered_at"]) for r in fired.collect()} == {
        ("b", d), ("c", d), ("d", d + dt.timedelta(days=6))}
    armed = st.armed_timers(spark, out).collect()
    assert [(r["order_id"], r["delivered_at"]) for r in armed] == [("e", d + dt.timedelta(days=20))]
    assert spark.conf.get(st.STORE, "") != st.ROCKS


def test_timers_call_python_once_per_part_not_per_order(spark, tmp_path):
    d, src, out = dt.datetime(2024, 1, 1), str(tmp_path / "feed"), str(tmp_path / "run")
    rows = [(f"o{k}", "delivered", d + dt.timedelta(hours=k)) for k in range(300)]
    rows += [(f"o{k}", "completed", d + dt.timedelta(hours=k, days=1 if k % 2 else 5)) for k in range(100)]
    spark.createDataFrame(rows, st.ORDER_EVENT_SCHEMA).write.parquet(src)
    fired = st.run_timers(st.auto_complete_timers(st.order_event_feed(spark, src), n_parts=3), out, most_states=2)
    newest = 299 - 24
    assert sorted(r["order_id"] for r in fired.collect()) == sorted(
        [f"o{k}" for k in range(0, 100, 2)] + [f"o{k}" for k in range(100, 300) if k + 72 < newest])
    assert {r["order_id"] for r in st.armed_timers(spark, out).collect()} == {
        f"o{k}" for k in range(100, 300) if k + 72 >= newest}
    state = spark.read.format("statestore").option("path", f"{out}/ckpt").option("stateVarName", st.ARMED).load()
    assert state.count() <= 3  # one value a part
