"""Structured Streaming jobs over the change feeds (§2 I1-I4, I6, I7, I9; A4, A5).

The source pushed inserted rows to browsers at most once, per conversation.
Here a change feed is a file source (new Parquet files landing in a table's
folder; a Kafka source plugs into the same transformations), and every
conversation / room / order is handled in one query, with state partitioned by
its key.

Transformations are plain functions of a DataFrame, so the same code runs on a
stream or, in tests, on a static frame.  ``run_*`` helpers start a query with
``trigger(availableNow=True)``, sink into the session's checkpoint folder and
return the sink as a batch DataFrame:

* ``run_dedup`` writes each id once and puts rows later than the horizon in a
  dead-letter folder instead of dropping them;
* ``run_merged`` writes a partial aggregate per micro-batch and merges partials
  by key when read: no state in the stream, nothing is dropped, and every
  ``COMPACT_EVERY`` batches the partials so far are folded into one;
* both write folders named by the batch id, with overwrite, and read only
  earlier ones, so a batch replayed after a failure writes the same again.

Event time must be ``timestamp`` (not ``timestamp_ntz``) for watermarks; the
feeds are cast on read, with the session time zone pinned to UTC.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from escrowlens.plans.joins import perhaps
from escrowlens.session import scratch_path
from escrowlens.sources.schemas import SCHEMAS
from escrowlens.sources.versions import VersionedTable, batches_in, exists, remove

# Late-data policy: ids are compared with those of this much event time before
# the newest seen; older events go to the dead letters (``run_dedup``), or are
# dropped by the state-store forms (``dedup_events`` and its like).
DEFAULT_DELAY = "1 day"
COMPACT_EVERY = 20
STATUS_EVENT_SCHEMA = "event_id bigint, order_key bigint, status string, ts timestamp_ntz"


# ---------------------------------------------------------------- sources


def feed(spark: SparkSession, path: str, schema: str, ts_col: str,
         max_files: int | None = None) -> DataFrame:
    """A table folder as a change feed of inserted rows (file source)."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    df = r.parquet(path)
    return df.withColumn(ts_col, F.col(ts_col).cast("timestamp"))


def message_feed(spark: SparkSession, path: str, **kw) -> DataFrame:
    return feed(spark, path, SCHEMAS["messages"], "created_at", **kw)


def forum_feed(spark: SparkSession, path: str, **kw) -> DataFrame:
    return feed(spark, path, SCHEMAS["forum_messages"], "created_at", **kw)


def status_feed(spark: SparkSession, path: str, **kw) -> DataFrame:
    return feed(spark, path, STATUS_EVENT_SCHEMA, "ts", **kw)


# ---------------------------------------------------------------- transformations


def not_blank(messages: DataFrame) -> DataFrame:
    return messages.filter(F.trim("body") != "")


def new_messages(messages: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """I1 + I2: every conversation's new messages, blank bodies skipped and
    re-deliveries of the same message id dropped."""
    return not_blank(messages).withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id"])


def dedup_events(events: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """I2 / I7: at-least-once deliveries reduced to one row per event id."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def dispute_alerts(events: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """I9: one alert per order moving to 'disputed' (per delivered event)."""
    return dedup_events(events, delay).filter(F.col("status") == "disputed")


def last_message_partial(messages: DataFrame) -> DataFrame:
    """I3: latest message per conversation, to be merged.  Uses event time
    (created_at, id) where the source trigger used arrival order."""
    return messages.groupBy("conversation_id").agg(
        F.max(F.struct("created_at", "id", "body")).alias("last"))


def merge_last_message(parts: DataFrame) -> DataFrame:
    return parts.groupBy("conversation_id").agg(F.max("last").alias("last"))


def forum_window_partial(forum: DataFrame, size: str = "1 hour") -> DataFrame:
    """I6 addition: messages per room per tumbling window, to be merged."""
    return forum.groupBy("room_id", F.window("created_at", size).alias("w")).agg(
        F.count(F.lit(1)).alias("messages")).select(
        "room_id", F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"), "messages")


def merge_forum_windows(parts: DataFrame) -> DataFrame:
    return parts.groupBy("room_id", "window_start", "window_end").agg(
        F.sum("messages").alias("messages"))


def read_partial(reads: DataFrame) -> DataFrame:
    """I4: when each viewer last opened each conversation, to be merged."""
    return reads.groupBy("conversation_id", "viewer_id").agg(F.max("read_at").alias("read_at"))


def merge_reads(parts: DataFrame) -> DataFrame:
    return read_partial(parts)


def live_unread(messages: DataFrame, reads: DataFrame, conversations: DataFrame) -> DataFrame:
    """I4: unread messages per (conversation, viewer) from the sinks of the two
    feeds: inserted unread, not sent by the viewer, and newer than the viewer's
    last opening of the conversation.  Every message counts once."""
    c = conversations.select(
        F.col("id").alias("conversation_id"),
        F.explode(F.array("user_a_id", "user_b_id")).alias("viewer_id"))
    m = messages.filter(~F.col("is_read")).select("conversation_id", "sender_id", "created_at")
    seen = c.join(reads, ["conversation_id", "viewer_id"], "left")
    j = m.join(seen, "conversation_id").filter(
        (F.col("viewer_id") != F.col("sender_id"))
        & (F.col("read_at").isNull() | (F.col("created_at") > F.col("read_at"))))
    return j.groupBy("conversation_id", "viewer_id").agg(F.count(F.lit(1)).alias("unread_count"))


def latest_status(events: DataFrame) -> DataFrame:
    """I7: latest status per order of notifications that occur once each."""
    return events.groupBy("order_key").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"),
        F.max("ts").alias("status_at"),
        F.count(F.lit(1)).alias("notifications"))


def apply_payments(orders: DataFrame, notices: DataFrame) -> DataFrame:
    """I7: the orders that payment notices change.  Only a 'paid' notice moves
    an order, only from pending_payment, and only if it isn't older than the
    order; repeats and stale notices change nothing."""
    paid = notices.filter(F.col("status") == "paid").select("order_id", F.col("ts").alias("paid_at"))
    waiting = orders.filter(F.col("status") == "pending_payment").select(
        F.col("id").alias("order_id"), F.col("status").alias("old_status"), "created_at")
    return waiting.join(paid, "order_id").filter(F.col("paid_at") >= F.col("created_at")) \
        .groupBy("order_id", "old_status").agg(F.min("paid_at").alias("updated_at")) \
        .withColumn("status", F.lit("paid"))


# ---------------------------------------------------------------- runners


def _ntz(df: DataFrame) -> DataFrame:
    """Timestamps back to the tables' zone-less type for output."""
    cols = [F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if f.dataType.simpleString() == "timestamp" else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def run_append(df: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream to completion of the available input."""
    spark = df.sparkSession
    out = scratch_path(spark, f"sink-{name}")
    q = (df.writeStream.format("parquet").outputMode("append")
         .option("path", out).option("checkpointLocation", out + "-ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return _ntz(spark.read.schema(df.schema).parquet(out))


def _run(df: DataFrame, step, base: str) -> None:
    q = (df.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The batch folders under ``path`` (none yet: no rows), with ``b``."""
    fields = [f for f in schema.fields if f.name != "b"]
    wanted = T.StructType([*fields, T.StructField("b", T.LongType())])
    try:
        return spark.read.schema(wanted).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], wanted)


SEEN_SCHEMA = "newest timestamp, slots array<bigint>"


def dedup_step(base: str, id_col: str, ts_col: str, horizon_hours: int):
    """The work of one micro-batch of ``run_dedup``, as a foreachBatch function.

    Rows lie below ``rows/slot=<event time by horizons>/b=<batch>``.  One row per
    batch, in ``seen``, keeps the newest event time so far and the slots that still
    reach into the horizon, so a batch reads those two or three folders and no others.
    """
    slot_of = lambda t: F.floor(F.unix_seconds(t) / (3600 * horizon_hours))

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [b for b in batches_in(spark, f"{base}/seen") if b < batch_id]
        seen = (spark.read.schema(SEEN_SCHEMA).parquet(f"{base}/seen/b={before[-1]}")
                .select(F.unix_micros("newest").alias("newest"), "slots").first() if before else None)  # one row
        last = F.timestamp_micros(F.lit(seen["newest"] if seen else None).cast("bigint"))
        edge = last - F.make_dt_interval(F.lit(0), F.lit(horizon_hours))
        slots = seen["slots"] or [] if seen else []
        rows = batch.persist()  # read once, written three times
        is_late = F.coalesce(F.col(ts_col) < edge, F.lit(False))
        fresh = rows.filter(~is_late).dropDuplicates([id_col])
        held = [p for p in (f"{base}/rows/slot={k}" for k in slots) if exists(spark, p)]
        if held:
            wanted = T.StructType([*batch.schema.fields, T.StructField("b", T.LongType())])
            known = (spark.read.schema(wanted).option("basePath", f"{base}/rows").parquet(*held)
                     .filter((F.col("b") < batch_id) & (F.col(ts_col) >= edge)).select(id_col))
            fresh = fresh.join(known, id_col, "left_anti")
        placed = fresh.withColumns({"slot": slot_of(F.col(ts_col)), "b": F.lit(batch_id)})
        (placed.repartition("slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("slot", "b").parquet(f"{base}/rows"))
        rows.filter(is_late).write.mode("overwrite").parquet(f"{base}/late/b={batch_id}")
        now = rows.agg(F.max(ts_col).alias("m"), F.collect_set(F.when(~is_late, slot_of(F.col(ts_col)))).alias("s"))
        newest = F.greatest("m", last)
        first = slot_of(newest - F.make_dt_interval(F.lit(0), F.lit(horizon_hours)))
        every = F.array_union("s", F.array(*map(F.lit, slots)).cast("array<bigint>"))
        (now.select(newest.alias("newest"), F.filter(every, lambda k: k >= first).alias("slots"))
         .write.mode("overwrite").parquet(f"{base}/seen/b={batch_id}"))
        rows.unpersist()
    return step


def run_dedup(df: DataFrame, id_col: str, ts_col: str, name: str, horizon_hours: int = 24
              ) -> tuple[DataFrame, DataFrame]:
    """Run a feed to the end of the available input; each id is written once.

    An id is compared with the ids written in the last ``horizon_hours`` of
    event time, which is all that a micro-batch reads.  Rows older than that when they arrive are not dropped: they are
    the second result, the dead letters, for the caller to look at or to count.
    """
    base = scratch_path(df.sparkSession, f"dedup-{name}")
    _run(df, dedup_step(base, id_col, ts_col, horizon_hours), base)
    rows, late = (_ntz(_stored(df.sparkSession, f"{base}/{kind}", df.schema).select(*df.columns))
                  for kind in ("rows", "late"))
    return rows, late


def merged_step(base: str, partial, merge, compact_every: int = COMPACT_EVERY):
    """The work of one micro-batch of ``run_merged``, as a foreachBatch function.

    Every ``compact_every`` batches the newest fold and the partials after it become
    a fold; the partials and the fold before that one, which no replay can need any
    more, are removed.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        part = partial(batch)
        part.write.mode("overwrite").parquet(f"{base}/part/b={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            _merged(spark, base, part.schema, merge, batch_id).write.mode("overwrite").parquet(
                f"{base}/full/b={batch_id}")
            folded = batch_id - compact_every
            for kind, last in (("part", folded), ("full", folded - 1)):
                for b in batches_in(spark, f"{base}/{kind}"):
                    if b <= last:
                        remove(spark, f"{base}/{kind}/b={b}")
    return step


def _merged(spark, base, schema, merge, last: int | None = None) -> DataFrame:
    """All partials up to ``last`` merged: the newest fold before it and the
    partials since, read by their paths."""
    full, part = (batches_in(spark, f"{base}/{kind}") for kind in ("full", "part"))
    if last is not None:
        full, part = [b for b in full if b < last], [b for b in part if b <= last]
    at = full[-1] if full else -1
    paths = [f"{base}/full/b={b}" for b in full[-1:]] + [f"{base}/part/b={b}" for b in part if b > at]
    return merge(spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema))


def run_merged(df: DataFrame, partial, merge, name: str, compact_every: int = COMPACT_EVERY
               ) -> DataFrame:
    """Run a feed to the end of the available input; return the merged partials."""
    base = scratch_path(df.sparkSession, f"merged-{name}")
    _run(df, merged_step(base, partial, merge, compact_every), base)
    return _ntz(_merged(df.sparkSession, base, partial(df).schema, merge))


# ---------------------------------------------------------------- I4 (live)

ROOMS_PER_PART = 4096  # parts of the unread state are ranges of hashed conversations
UNREAD_SCHEMA = ("conversation_id string, kind string, viewer_id string, id string, at timestamp")


def unread_feed(messages: DataFrame, reads: DataFrame) -> DataFrame:
    """I4: both feeds as one stream of (conversation_id, kind, viewer_id, id, at).  A
    message names its sender as ``viewer_id``; messages inserted as read are left out."""
    m = messages.filter(~F.col("is_read")).select(
        "conversation_id", F.lit("message").alias("kind"), F.col("sender_id").alias("viewer_id"), "id",
        F.col("created_at").alias("at"))
    r = reads.select("conversation_id", F.lit("read").alias("kind"), "viewer_id",
                     F.lit("").alias("id"), F.col("read_at").alias("at"))
    return m.unionByName(r)


def unread_state(spark: SparkSession, name: str, n_parts: int) -> VersionedTable:
    """The state of live unread counts: per conversation and viewer the latest
    opening, and the messages newer than it."""
    empty = spark.createDataFrame([], UNREAD_SCHEMA)
    part = F.pmod(F.xxhash64("conversation_id"), F.lit(n_parts))
    return VersionedTable.create(empty, f"unread-{name}", ["conversation_id", "kind", "viewer_id", "id"], part)


def unread_step(state: VersionedTable, conversations: DataFrame):
    """One micro-batch of live unread counts, as a foreachBatch function.

    New messages wait for the other participant; a viewer's latest opening removes
    what it covers, whichever comes first.  A repeated message is either still
    waiting (same key) or covered by the opening that removed it, so late and
    repeated rows of either feed need no memory of ids.  Only the parts of the
    conversations in the batch are read and written.
    """
    key = ["conversation_id", "kind", "viewer_id", "id"]

    def step(batch: DataFrame, batch_id: int) -> None:
        new = batch.persist()
        rooms = new.select("conversation_id").distinct()
        sides = conversations.select(F.col("id").alias("conversation_id"),
                                     F.explode(F.array("user_a_id", "user_b_id")).alias("_side"))
        waiting = (new.filter("kind = 'message'").join(sides, "conversation_id")
                   .filter("_side <> viewer_id").drop("viewer_id").withColumnRenamed("_side", "viewer_id"))
        old = state.near(rooms, batch_id + 1).join(rooms, "conversation_id", "left_semi")
        rows = (old.unionByName(waiting.select(*old.columns))
                .unionByName(new.filter("kind = 'read'").select(*old.columns))
                .groupBy(*key).agg(F.max("at").alias("at")))
        opened = rows.filter("kind = 'read'").select("conversation_id", "viewer_id", F.col("at").alias("_read"))
        kept = (rows.join(opened, ["conversation_id", "viewer_id"], "left")
                .filter("kind = 'read' or _read is null or at > _read").select(*old.columns))
        state.upsert(kept, batch_id + 1, gone=old)
        new.unpersist()
    return step


def unread_now(state: VersionedTable) -> DataFrame:
    """Unread messages per (conversation, viewer) after the newest micro-batch."""
    return (state.read().filter("kind = 'message'").groupBy("conversation_id", "viewer_id")
            .agg(F.count(F.lit(1)).alias("unread_count")))


def run_unread(messages: DataFrame, reads: DataFrame, conversations: DataFrame, name: str,
               n_parts: int | None = None) -> DataFrame:
    """I4: run both feeds to the end of the available input; return the counts."""
    spark = messages.sparkSession
    n = n_parts or max(1, -(-conversations.count() // ROOMS_PER_PART))
    state = unread_state(spark, name, n)
    _run(unread_feed(messages, reads), unread_step(state, conversations), scratch_path(spark, f"unread-{name}"))
    return unread_now(state)


# ---------------------------------------------------------------- I7 (orders really change)


def payment_step(orders: VersionedTable):
    """One micro-batch of payment notices applied to the orders table, as a
    foreachBatch function: the parts that hold the named orders are read, the orders
    that the guard lets through are replaced; only these are written.  A notice seen
    again finds its order paid and changes nothing."""
    def step(batch: DataFrame, batch_id: int) -> None:
        notices = batch.persist()
        named = notices.select(F.col("order_id").alias("id")).filter("id is not null").distinct()
        near = orders.near(named, batch_id + 1)
        paid = apply_payments(near, notices).select(
            F.col("order_id").alias("id"), F.col("status").alias("_status"), F.col("updated_at").alias("_at"))
        changed = perhaps(near, paid.select("id"), ["id"]).join(paid, "id").withColumns(
            {"status": F.col("_status"), "updated_at": F.col("_at").cast(near.schema["updated_at"].dataType)})
        orders.overlay(changed.select(*near.columns), batch_id + 1)
        notices.unpersist()
    return step


def run_payments(notices: DataFrame, orders: VersionedTable, name: str) -> DataFrame:
    """I7: run the notices to the end of the available input; return the orders."""
    _run(notices, payment_step(orders), scratch_path(notices.sparkSession, f"payments-{name}"))
    return orders.read()


# ---------------------------------------------------------------- I8 (batch form)

AUTO_COMPLETE_AFTER_DAYS = 3


def auto_complete_due(orders: DataFrame, asof: str) -> DataFrame:
    """Delivered orders whose auto-completion time (delivered + 3 days, a column
    comment in the source that no code implements) has passed at ``asof``."""
    due = F.timestamp_add("DAY", F.lit(AUTO_COMPLETE_AFTER_DAYS), F.col("delivered_at"))
    o = orders.filter((F.col("status") == "delivered") & F.col("delivered_at").isNotNull())
    return o.select("id", "buyer_id", "seller_id", "delivered_at", due.alias("due_at")) \
        .filter(F.col("due_at") <= F.lit(asof).cast("timestamp_ntz"))


# ---------------------------------------------------------------- I8 (stream)

ORDER_EVENT_SCHEMA = "order_id string, status string, ts timestamp_ntz"
AUTO_COMPLETE_OUT = "order_id string, delivered_at timestamp, due_at timestamp"
ARMED = "armed"
TIMER_PARTS = 64
STORE = "spark.sql.streaming.stateStore.providerClass"
STATES = "spark.sql.shuffle.partitions"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def order_event_feed(spark: SparkSession, path: str, **kw) -> DataFrame:
    return feed(spark, path, ORDER_EVENT_SCHEMA, "ts", **kw)


class _DeliveryTimers(StatefulProcessor):
    """The armed timers of one part of the orders: state is their orders and deliveries
    in milliseconds, each kept until its timer fires or a later event disarms it.  The
    state store's own timer stands at the earliest of them."""

    def __init__(self, span_ms: int):
        self.span = span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.armed = handle.getValueState(ARMED, "orders array<string>, delivered_ms array<long>")

    def _held(self):
        import pandas as pd
        orders, ms = self.armed.get() if self.armed.exists() else ([], [])
        return pd.DataFrame({"order_id": pd.Series(orders, dtype=object), "ms": pd.Series(ms, dtype="int64")})

    def _keep(self, old, now) -> None:
        """Make ``now`` the armed timers instead of ``old``."""
        before, after = (None if f.empty else int(f["ms"].min()) + self.span + 1 for f in (old, now))
        if before is not None and before != after:
            self.handle.deleteTimer(before)
        if after is None:
            self.armed.clear()
        else:
            self.armed.update((now["order_id"].tolist(), now["ms"].tolist()))
            if before != after:
                self.handle.registerTimer(after)

    def _due(self, fired):
        import pandas as pd
        at = pd.to_datetime(fired["ms"].astype("int64"), unit="ms")
        yield pd.DataFrame({"order_id": fired["order_id"], "delivered_at": at,
                            "due_at": at + pd.Timedelta(milliseconds=self.span)})

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd
        old = self._held()
        new = pd.concat([part[["order_id", "status", "ms"]] for part in rows], ignore_index=True)
        # Of an order, its armed timer comes first, then its events in their order.
        every = pd.concat([old.assign(status="delivered"), new.sort_values(["ms", "status"])], ignore_index=True)
        number = pd.Series(pd.factorize(every["order_id"], use_na_sentinel=False)[0])
        every = every.loc[number.sort_values(kind="stable").index]
        number = number.loc[every.index]
        last = number.ne(number.shift(-1))
        delivered = every["status"] == "delivered"
        fired = every[delivered & ~last & (every["ms"].shift(-1) > every["ms"] + self.span)]
        self._keep(old, every[delivered & last])
        if not fired.empty:  # would have fired before the next event
            yield from self._due(fired)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        old = self._held()
        due = old["ms"] + self.span < timerValues.getCurrentWatermarkInMs()
        self._keep(old, old[~due])
        if due.any():
            yield from self._due(old[due])

    def close(self) -> None:
        pass


def auto_complete_timers(events: DataFrame, after_days: int = AUTO_COMPLETE_AFTER_DAYS,
                         delay: str = DEFAULT_DELAY, n_parts: int = TIMER_PARTS) -> DataFrame:
    """I8: an event-time timer per order.  A 'delivered' event arms a timer at
    delivered_at + ``after_days``; any later status event of the order before then
    disarms it; when the watermark passes the timer the order is emitted as due for
    auto-completion.  Run it with ``run_timers``, whose state store holds the timers
    on disk.

    Python is called once per part of the orders and batch, not once per order: the
    orders are dealt over ``n_parts`` by hash.  Choose it for some ten thousand orders
    a part; it stays the same for the life of a checkpoint.
    """
    part = F.pmod(F.xxhash64("order_id"), F.lit(n_parts)).alias("part")
    e = events.withWatermark("ts", delay).select(part, "order_id", "status", "ts", F.unix_millis("ts").alias("ms"))
    return e.groupBy("part").transformWithStateInPandas(
        statefulProcessor=_DeliveryTimers(after_days * 86_400_000), outputStructType=AUTO_COMPLETE_OUT,
        outputMode="append", timeMode="eventtime")


def run_timers(df: DataFrame, base: str, most_states: int | None = None) -> DataFrame:
    """Run timers to the end of the available input, with a RocksDB state store for
    this query alone, cut into at most ``most_states`` states; ``base`` holds sink and
    checkpoint, so that a second run goes on from the first.  Returns all rows fired
    so far."""
    spark = df.sparkSession
    before, n_states = spark.conf.get(STORE, None), spark.conf.get(STATES)
    spark.conf.set(STORE, ROCKS)  # both read when the query starts
    spark.conf.set(STATES, str(min(int(n_states), most_states or int(n_states))))
    try:
        q = (df.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
        spark.conf.set(STATES, n_states)
    q.awaitTermination()
    return _ntz(spark.read.schema(df.schema).parquet(f"{base}/out"))


def armed_timers(spark: SparkSession, base: str) -> DataFrame:
    """The timers still armed after the last run below ``base``, read back from its
    state store: order_id, delivered_at."""
    state = (spark.read.format("statestore").option("path", f"{base}/ckpt").option("stateVarName", ARMED).load())
    timer = F.explode(F.arrays_zip("value.orders", "value.delivered_ms")).alias("t")
    return state.select(timer).select(
        F.col("t.orders").alias("order_id"),
        F.timestamp_millis("t.delivered_ms").cast("timestamp_ntz").alias("delivered_at"))
