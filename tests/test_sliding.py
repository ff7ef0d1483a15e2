"""Sliding best sellers, files of several versions and audit details on small tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from conftest import table, ts
from escrowlens.operators import audit_details as ad
from escrowlens.operators import catalog as c
from escrowlens.session import scratch_path
from escrowlens.sources.schemas import read_evolved, schema

T0 = ts("2024-01-01 00:00:00")


def test_every_hour_has_the_top_of_its_24_hours(spark):
    rnd = random.Random(4)
    products = [{"id": i, "is_active": i != 3, "created_at": None if i == 2 else T0 + dt.timedelta(days=i % 4)}
                for i in range(12)]
    sales = [(rnd.choice([None, *range(14)]), rnd.randrange(0, 4),
              T0 + dt.timedelta(minutes=rnd.choice([0, 1, 59, 60]) + 60 * rnd.randrange(70))) for _ in range(60)]
    sales += [(5, 2, T0 + dt.timedelta(days=20, seconds=1))] * 3        # repeated rows, a gap of days
    orders = [{"id": f"o{i}", "product_id": p, "quantity": q, "status": "completed", "completed_at": at}
              for i, (p, q, at) in enumerate(sales)]
    orders += [{"id": "x", "product_id": 1, "quantity": 50, "status": "paid", "completed_at": T0},
               {"id": "y", "product_id": 1, "quantity": 50, "status": "completed"}]
    t = {"products": table(spark, "products", products), "orders": table(spark, "orders", orders)}
    active = {p["id"]: p["created_at"] or dt.datetime.min for p in products if p["is_active"]}
    want, sums, last = [], {}, {}
    for h in range(0, 24 * 23):
        asof = T0 + dt.timedelta(hours=h)
        held = [(p, q) for p, q, at in sales if p in active and asof - dt.timedelta(days=1) <= at <= asof]
        if held:
            sold = {p: sum(q for x, q in held if x == p) for p in active}
            best = sorted(active, key=lambda p: (-sold[p], -(active[p] - dt.datetime.min).total_seconds(), p))[:8]
            want += [(asof, i, p, sold[p]) for i, p in enumerate(best, 1)]
    got = sorted(tuple(r) for r in c.popular_by_hour(t).collect())
    assert got == want
    some = {tuple(r) for r in c.popular_by_hour(t, changes_only=True).collect()}
    assert some < set(want) and {w[0] for w in want if w[0] - dt.timedelta(hours=1) not in {x[0] for x in want}} \
        <= {r[0] for r in some}


def test_no_sales_no_lists(spark):
    t = {"products": table(spark, "products", [{"id": 1, "is_active": True}]), "orders": table(spark, "orders", [])}
    assert c.popular_by_hour(t).count() == 0


def test_files_before_and_after_new_columns(spark):
    path = scratch_path(spark, "files")
    rows = table(spark, "orders", [{"id": "n1", "platform_fee": None, "commission_rate": None, "quantity": 2},
                                   {"id": "n2", "platform_fee": 9, "seller_payout": 4}])
    old = table(spark, "orders", [{"id": "o1", "quantity": 3, "status": "paid"}, {"id": "o2"}])
    rows.write.parquet(path)
    (old.drop("platform_fee", "commission_rate", "seller_payout").withColumn("quantity", F.col("quantity").cast("int"))
     .write.mode("append").parquet(path))                       # both versions in one folder
    df = read_evolved(spark, "orders", path)
    assert df.schema.simpleString() == schema("orders").simpleString()
    got = {r["id"]: (r["platform_fee"], r["commission_rate"] and str(r["commission_rate"]), r["seller_payout"],
                     r["quantity"]) for r in df.collect()}
    assert got == {"n1": (None, None, None, 2), "n2": (9, None, 4, None), "o1": (0, "0.0500", 0, 3),
                   "o2": (0, "0.0500", 0, None)}
    assert {r["id"] for r in df.filter("commission_rate = 0.05").collect()} == {"o1", "o2"}
    assert {r["id"] for r in df.filter("platform_fee = 0 and quantity = 3").collect()} == {"o1"}
    assert {r["id"] for r in df.filter("seller_payout is null").select("id").collect()} == {"n1"}
    assert df.agg(F.sum("platform_fee")).first()[0] == 9


def test_details_by_type_and_their_faults(spark):
    rows = [("1", "adjust_wallet", '{"amount":5,"reason":null,"new_balance":7}'), ("2", "adjust_wallet", '{"amount":"5"}'),
            ("3", "adjust_wallet", "{bad"), ("4", "force_refund", None), ("5", "force_refund", "[1]"),
            ("6", "change_role", '{"from":"a","to":{"x":1},"by":[1]}'), ("7", "unknown", '{"k":true}'),
            ("8", "unknown", "{}"), ("9", None, '{"k":1.5}'), ("10", "update_order_status", '{"note":"n","to":"paid"}')]
    logs = spark.createDataFrame([(i, a, "T", d) for i, a, d in rows],
                                 "id string, action string, target_id string, detail string")
    typed = {r["id"]: r for r in ad.typed_details(logs).collect()}
    assert len(typed) == 10 and (typed["1"]["amount"], typed["1"]["reason"], typed["1"]["new_balance"]) == (5, None, 7)
    assert typed["3"]["readable"] is False and typed["4"]["readable"] is None and typed["10"]["to_value"] == "paid"
    got = {(r["action"], r["field"], r["problem"]): r["n"] for r in ad.detail_drift(logs).collect()}
    assert got == {
        ("adjust_wallet", "amount", "type STRING"): 1, ("adjust_wallet", "reason", "missing"): 1,
        ("adjust_wallet", "new_balance", "missing"): 1, ("adjust_wallet", None, "unreadable"): 1,
        ("force_refund", None, "no detail"): 1, ("force_refund", None, "no object"): 1,
        ("change_role", "to", "type OBJECT"): 1, ("change_role", "by", "unexpected ARRAY"): 1,
        ("unknown", "k", "unexpected BOOLEAN"): 1, (None, "k", "unexpected DECIMAL"): 1}
    assert ad.detail_drift(logs.limit(0)).count() == 0
