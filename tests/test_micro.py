"""Hand-written micro tables for each quirk and error path (FIXTURES.md §3)."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from conftest import table, ts
from escrowlens.operators import catalog as cat
from escrowlens.operators import chat as ch
from escrowlens.operators import commands as cm
from escrowlens.operators import dashboards as d
from escrowlens.operators import ledger as lg

T0 = "2024-01-01 10:00:00"


def _settings(spark, value):
    rows = [] if value is None else [{"key": "commission_rate", "value": value,
                                      "updated_at": ts(T0)}]
    return table(spark, "app_settings", rows)


def _admin_wallet(spark, balance=0):
    return table(spark, "admin_wallet", [{"id": "AW", "balance": balance,
                                          "created_at": ts(T0), "updated_at": ts(T0)}])


def test_fan_out_closed_form_equals_literal_join(spark):
    prof = table(spark, "profiles", [{"id": s, "full_name": s, "role": "penjual"}
                                     for s in ("S1", "S2", "S3", "S4")])
    wal = table(spark, "wallets", [{"id": "W-S1", "user_id": "S1", "balance": 5,
                                    "escrow_hold": 1}])
    orders = table(spark, "orders", [
        {"id": "o1", "seller_id": "S1", "status": "completed", "seller_receives": 100},
        {"id": "o2", "seller_id": "S1", "status": "paid", "seller_receives": 50},
        {"id": "o3", "seller_id": "S1", "status": "pending_payment", "seller_receives": 7},
        {"id": "o4", "seller_id": "S2", "status": "completed", "seller_receives": 9}])
    reviews = table(spark, "reviews", [
        {"id": "r1", "seller_id": "S1", "rating": 5}, {"id": "r2", "seller_id": "S1", "rating": 2},
        {"id": "r3", "seller_id": "S3", "rating": 4}])
    products = table(spark, "products", [
        {"id": 1, "seller_id": "S1", "is_active": True},
        {"id": 2, "seller_id": "S1", "is_active": False},
        {"id": 3, "seller_id": "S3", "is_active": True}])
    t = {"profiles": prof, "wallets": wal, "orders": orders, "reviews": reviews,
         "products": products}
    got = {r["user_id"]: r.asDict() for r in d.seller_dashboard_asis(t).collect()}
    for n, df in t.items():
        df.createOrReplaceTempView(f"fx_{n}")
    lit = spark.sql("""
      SELECT p.id AS user_id, count(o.id) AS total_orders,
             count_if(o.status = 'completed') AS completed_orders,
             count_if(o.status IN ('paid','processing','delivered')) AS active_orders,
             count_if(o.status = 'pending_payment') AS pending_orders,
             coalesce(sum(CASE WHEN o.status = 'completed' THEN o.seller_receives END), 0)
               AS total_revenue,
             coalesce(round(avg(r.rating), 4), 0) AS avg_rating, count(r.id) AS total_reviews,
             count_if(pr.is_active) AS active_products
      FROM fx_profiles p LEFT JOIN fx_orders o ON o.seller_id = p.id
      LEFT JOIN fx_reviews r ON r.seller_id = p.id LEFT JOIN fx_products pr ON pr.seller_id = p.id
      GROUP BY p.id""").collect()
    assert len(lit) == 4
    for r in lit:
        g = got[r["user_id"]]
        for k, v in r.asDict().items():
            assert g[k] == v, (r["user_id"], k, g[k], v)
    # S1: 3 orders x 2 reviews x 2 products.
    assert got["S1"]["total_orders"] == 12 and got["S1"]["total_reviews"] == 12


def test_settle_twice_is_idempotent_and_reports_errors(spark):
    orders = table(spark, "orders", [
        {"id": "O1", "product_id": 1, "total_amount": 10001, "status": "completed"},
        {"id": "O2", "product_id": None, "total_amount": 500, "status": "completed"}])
    products = table(spark, "products", [{"id": 1, "seller_id": "S9"}])
    base = {"orders": orders, "products": products,
            "wallets": table(spark, "wallets", []),
            "platform_commission": table(spark, "platform_commission", []),
            "admin_wallet": _admin_wallet(spark), "app_settings": _settings(spark, None)}
    cmds = spark.createDataFrame(
        [("c1", "O1", ts(T0)), ("c2", "O1", ts("2024-01-02 00:00:00")), ("c3", "O2", ts(T0))],
        "cmd_id string, order_id string, requested_at timestamp_ntz")
    r = cm.settle_commission(base, cmds)
    out = {x["cmd_id"]: x for x in r["outcomes"].collect()}
    assert out["c1"]["ok"] and out["c1"]["applied"] and out["c1"]["fee"] == 500
    assert out["c1"]["seller_net"] == 9501
    assert out["c2"]["ok"] and not out["c2"]["applied"]
    assert not out["c3"]["ok"] and out["c3"]["error"] == cm.ERR_ORDER_NOT_FOUND_SETTLE
    w = r["wallets"].collect()
    assert [(x["user_id"], x["wallet_id"], x["balance_after"]) for x in w] == \
        [("S9", "W-S9", 9501)]
    assert r["admin_wallet"].collect()[0]["balance"] == 500
    # Second batch sees the upserted commission: nothing applied again.
    again = dict(base, platform_commission=r["commission"])
    o2 = cm.settle_commission(again, cmds.filter("cmd_id = 'c1'"))["outcomes"].collect()
    assert o2[0]["ok"] and not o2[0]["applied"]
    # Only a missing rate has a default; one that is no rate refuses the command.
    for value, error in (("abc", 'invalid input syntax for type numeric: "abc"'),
                         ("12.5", "numeric field overflow"), ("1e9", "numeric field overflow")):
        bad = dict(base, app_settings=_settings(spark, value))
        o3 = cm.settle_commission(bad, cmds.filter("cmd_id = 'c1'"))
        row = o3["outcomes"].collect()[0]
        assert not row["ok"] and row["error"] == error and row["fee"] is None
        assert o3["ledger"].count() == o3["wallets"].count() == 0
        assert o3["admin_wallet"].collect()[0]["balance"] == 0
    nine = dict(base, app_settings=_settings(spark, "0.07"))
    o4 = cm.settle_commission(nine, cmds.filter("cmd_id = 'c1'"))["outcomes"].collect()
    assert o4[0]["fee"] == 700  # floor(10001 * 0.07) = 700


def test_refund_states(spark):
    from escrowlens.functions.labels import ORDER_STATUSES
    orders = table(spark, "orders", [
        {"id": f"o-{s}", "buyer_id": "B1", "seller_id": "S1", "status": s,
         "total_amount": 100, "product_title": "x"} for s in ORDER_STATUSES])
    t = {"orders": orders,
         "profiles": table(spark, "profiles", [{"id": "A", "role": "admin"}]),
         "wallets": table(spark, "wallets", [{"id": "W-S1", "user_id": "S1", "balance": 0,
                                              "escrow_hold": 150, "total_in": 0}])}
    rows = [(f"r-{s}", f"o-{s}", None, "A", ts(T0)) for s in ORDER_STATUSES]
    rows.append(("r-again", "o-paid", "twice", "A", ts("2024-01-02 00:00:00")))
    rows.append(("r-nobody", "o-paid", None, "B1", ts(T0)))
    rows.append(("r-ghost", "o-missing", None, "A", ts(T0)))
    cmds = spark.createDataFrame(rows, "cmd_id string, order_id string, reason string, "
                                       "actor_id string, requested_at timestamp_ntz")
    r = cm.refund_orders(t, cmds)
    out = {x["cmd_id"]: x for x in r["outcomes"].collect()}
    ok = {k for k, v in out.items() if v["ok"]}
    assert ok == {"r-paid", "r-processing", "r-delivered", "r-disputed"}
    assert out["r-completed"]["error"] == "Status pesanan tidak bisa direfund (completed)."
    assert out["r-again"]["error"] == "Status pesanan tidak bisa direfund (refunded)."
    assert out["r-nobody"]["error"] == "Tidak punya akses admin."
    assert out["r-ghost"]["error"] == "Pesanan tidak ditemukan."
    w = {x["user_id"]: x for x in r["wallets"].collect()}
    assert w["B1"]["balance"] == 400 and w["B1"]["wallet_id"] == "W-B1"
    assert w["S1"]["escrow_hold"] == 0  # 150 - 4 x 100, floored at zero
    led = sorted(x["balance_after"] for x in r["ledger"].collect())
    assert led == [100, 200, 300, 400]


def test_confirm_states(spark):
    orders = table(spark, "orders", [
        {"id": "a", "buyer_id": "B1", "seller_id": "S1", "status": "delivered",
         "total_amount": 100, "seller_receives": 95, "product_title": "t"},
        {"id": "b", "buyer_id": "B1", "seller_id": "S1", "status": "processing",
         "total_amount": 100, "seller_receives": 95, "product_title": "t"},
        {"id": "c", "buyer_id": "B1", "seller_id": "S1", "status": "delivered",
         "total_amount": 100, "seller_receives": 95, "product_title": "t"}])
    t = {"orders": orders,
         "wallets": table(spark, "wallets", [{"id": "W1", "user_id": "S1", "balance": 10,
                                              "escrow_hold": 150, "total_in": 3}])}
    cmds = spark.createDataFrame(
        [("1", "a", "B1", ts(T0)), ("2", "b", "B1", ts(T0)), ("3", "c", "B2", ts(T0)),
         ("4", "a", "B1", ts("2024-01-02 00:00:00"))],
        "cmd_id string, order_id string, caller_id string, requested_at timestamp_ntz")
    r = cm.confirm_orders(t, cmds)
    out = {x["cmd_id"]: x["ok"] for x in r["outcomes"].collect()}
    assert out == {"1": True, "2": False, "3": False, "4": False}
    w = r["wallets"].collect()[0]
    assert (w["balance"], w["escrow_hold"], w["total_in"]) == (105, 50, 98)
    notes = {x["title"] for x in r["notifications"].collect()}
    assert notes == {"✅ Dana rekber cair!", "🎉 Pesanan selesai!"}


def test_conversation_pairs(spark):
    conv = table(spark, "conversations", [{"id": "C0", "user_a_id": "B5", "user_b_id": "S5",
                                           "product_id": 70}])
    req = spark.createDataFrame(
        [("1", "x", "y", None, ts(T0)), ("2", "y", "x", 11, ts("2024-01-01 11:00:00")),
         ("3", "x", "x", 12, ts(T0)), ("4", "S5", "B5", None, ts(T0)),
         ("5", None, "y", None, ts(T0))],
        "req_id string, me_id string, other_id string, product_id bigint, "
        "requested_at timestamp_ntz")
    r = cm.conversation_pairs({"conversations": conv}, req)
    pairs = {(x["user_a_id"], x["user_b_id"]): x for x in r["conversations"].collect()}
    assert set(pairs) == {("x", "y"), ("B5", "S5")}
    assert pairs[("x", "y")]["product_id"] == 11 and pairs[("x", "y")]["created"]
    assert pairs[("B5", "S5")]["product_id"] == 70 and not pairs[("B5", "S5")]["created"]
    out = {x["req_id"]: x for x in r["outcomes"].collect()}
    assert out["3"]["error"] == cm.ERR_SELF_CHAT
    assert out["5"]["error"] == cm.ERR_UNAUTHENTICATED
    assert out["1"]["conversation_id"] == out["2"]["conversation_id"]


def _catalog_tables(spark):
    prods = table(spark, "products", [
        {"id": 1, "seller_id": "S1", "title": "Diskon 50% Skin", "category": "game",
         "price": 100, "is_active": True, "created_at": ts("2024-01-01 00:00:00")},
        {"id": 2, "seller_id": "S2", "title": "a_b voucher", "category": "digital",
         "price": 300, "is_active": True, "created_at": ts("2024-01-02 00:00:00")},
        {"id": 3, "seller_id": "S2", "title": "MiXeD Case", "category": "jasa",
         "price": 200, "is_active": True, "created_at": ts("2024-01-03 00:00:00")},
        {"id": 4, "seller_id": "S1", "title": "hidden", "category": "jasa",
         "price": 200, "is_active": False, "created_at": ts("2024-01-04 00:00:00")},
        {"id": 5, "seller_id": "S1", "title": "rated", "category": "jasa",
         "price": 50, "is_active": True, "created_at": ts("2023-12-01 00:00:00")}])
    prof = table(spark, "profiles", [{"id": "S1", "full_name": "Toko Satu", "username": ""},
                                     {"id": "S2", "full_name": "Dua", "username": "dua"}])
    reviews = table(spark, "reviews", [{"id": "r", "product_id": 5, "rating": 5}])
    orders = table(spark, "orders", [])
    return {"products": prods, "profiles": prof, "reviews": reviews, "orders": orders}


def test_search_is_literal_and_case_insensitive(spark):
    t = _catalog_tables(spark)
    ids = lambda q: sorted(r["id"] for r in cat.catalog(t, search=q).collect())
    assert ids("%") == [1]
    assert ids("_") == [2]
    assert ids("mixed") == [3]
    assert ids("toko") == [1, 5]          # empty username falls back to the name
    sellers = {r["id"]: r["seller"] for r in cat.catalog_rows(t).collect()}
    assert sellers[1] == "Toko Satu" and sellers[2] == "@dua"


def test_rating_default_and_newest_first_ties(spark):
    t = _catalog_tables(spark)
    top = [r["id"] for r in cat.catalog(t, sort="rating").collect()]
    # All rate 5.0 (four unrated, one rated 5): newest first among equals.
    assert top == [3, 2, 1, 5]
    assert [r["id"] for r in cat.catalog(t, sub="valorant").collect()] == []


def test_ledger_bad_row_is_reported(spark):
    rows = [("t1", "W", "topup", 100, 100, ts("2024-01-01 00:00:00")),
            ("t2", "W", "escrow_release", 50, 200, ts("2024-01-01 01:00:00")),
            ("t3", "W", "withdrawal", 30, 120, ts("2024-01-02 00:00:00"))]
    led = spark.createDataFrame(rows, "id string, wallet_id string, type string, amount bigint, "
                                      "balance_after bigint, created_at timestamp_ntz")
    bad = {r["id"]: r for r in lg.ledger_mismatches({"wallet_transactions": led}).collect()}
    assert set(bad) == {"t2", "t3"}
    assert bad["t2"]["difference"] == 50 and bad["t2"]["expected_balance"] == 150
    assert bad["t3"]["difference"] == 0 and bad["t3"]["step_mismatch"]


def test_page_of_201_returns_oldest_200(spark):
    import datetime as dt
    start = dt.datetime(2024, 1, 1, 22, 0)
    rows = [(f"m{i:03d}", "C1", "u", "hi", False, start + dt.timedelta(minutes=i))
            for i in range(201)]
    m = spark.createDataFrame(rows, "id string, conversation_id string, sender_id string, "
                                    "body string, is_read boolean, created_at timestamp_ntz")
    page = ch.conversation_page({"messages": m}).collect()
    assert len(page) == 200
    assert max(r["id"] for r in page) == "m199"
    assert sorted(r["position"] for r in page) == list(range(1, 201))


def test_settle_uses_every_digit_and_the_oldest_admin_wallet(spark):
    t = {"orders": table(spark, "orders", [{"id": "O1", "product_id": 1, "total_amount": 1_000_000_000},
                                           {"id": "O2", "product_id": 1, "total_amount": 2**62}]),
         "products": table(spark, "products", [{"id": 1, "seller_id": "S9"}]),
         "wallets": table(spark, "wallets", []), "platform_commission": table(spark, "platform_commission", []),
         "app_settings": _settings(spark, "0.00125"),
         "admin_wallet": spark.createDataFrame(
             [("AW-2", 5, ts("2024-02-01 00:00:00"), None), ("AW-1", 7, ts(T0), None), ("AW-0", 9, None, None)],
             "id string, balance long, created_at timestamp_ntz, updated_at timestamp_ntz")}
    cmds = spark.createDataFrame([("c1", "O1", ts(T0)), ("c2", "O2", ts("2024-01-02 00:00:00"))],
                                 "cmd_id string, order_id string, requested_at timestamp_ntz")
    r = cm.settle_commission(t, cmds)
    fees = {x["order_id"]: x["fee"] for x in r["outcomes"].collect()}
    assert fees == {"O1": 1_250_000, "O2": 2**62 * 125 // 100_000}
    aw = {x["id"]: x for x in r["admin_wallet"].collect()}
    assert {k: x["balance"] for k, x in aw.items()} == {"AW-1": 7 + sum(fees.values()), "AW-2": 5, "AW-0": 9}
    assert aw["AW-1"]["updated_at"] == ts("2024-01-02 00:00:00") and aw["AW-2"]["updated_at"] is None
    assert str(r["commission"].filter("order_id = 'O1'").collect()[0]["rate"]) == "0.0013"


def test_status_change_settles_and_checks_the_domain(spark):
    t = {"orders": table(spark, "orders", [{"id": f"O{k}", "product_id": 1 if k < 3 else None, "total_amount": 1000,
                                            "status": "delivered"} for k in (1, 2, 3)]),
         "products": table(spark, "products", [{"id": 1, "seller_id": "S"}]),
         "profiles": table(spark, "profiles", [{"id": "A", "role": "admin"}]),
         "wallets": table(spark, "wallets", []), "platform_commission": table(spark, "platform_commission", []),
         "admin_wallet": _admin_wallet(spark), "app_settings": _settings(spark, None)}
    rows = [("c1", "O1", "completed", "A"), ("c2", "O2", "not_a_status", "A"), ("c3", "O3", "completed", "A"),
            ("c4", "O2", "completed", "X"), ("c5", "O2", None, "A"), ("c6", "O2", "paid", "A")]
    cmds = spark.createDataFrame([(*r, None, ts(T0)) for r in rows], "cmd_id string, order_id string, "
                                 "new_status string, actor_id string, note string, requested_at timestamp_ntz")
    r = cm.apply_status(t, cmds)
    out = {x["cmd_id"]: x["error"] for x in r["outcomes"].collect()}
    assert out == {"c1": None, "c2": 'invalid input value for enum order_status: "not_a_status"',
                   "c3": cm.ERR_SETTLE_PREFIX + cm.ERR_ORDER_NOT_FOUND_SETTLE, "c4": cm.ERR_NOT_ADMIN,
                   "c5": 'invalid input value for enum order_status: ""', "c6": None}
    assert {x["order_id"]: x["status"] for x in r["orders"].collect()} == {"O1": "completed", "O2": "paid"}
    assert [(x["wallet_id"], x["amount"], x["balance_after"]) for x in r["ledger"].collect()] == [("W-S", 950, 950)]
    assert r["commission"].collect()[0]["fee_amount"] == 50 and r["admin_wallet"].collect()[0]["balance"] == 50
    assert r["order_fees"].collect()[0]["seller_payout"] == 950 and r["wallets"].collect()[0]["balance_after"] == 950
    bad = cm.apply_status(dict(t, app_settings=_settings(spark, "abc")), cmds)
    errors = {x["cmd_id"]: x["error"] for x in bad["outcomes"].collect()}
    assert errors["c6"] == errors["c1"] == 'invalid input syntax for type numeric: "abc"'
    assert errors["c4"] == cm.ERR_NOT_ADMIN and bad["orders"].count() == 0


def test_adjust_keeps_every_unit_and_refuses_null_amounts(spark):
    big = 2**53 + 1
    prof = table(spark, "profiles", [{"id": "A", "role": "admin"}])
    wal = table(spark, "wallets", [{"id": "W-U", "user_id": "U", "balance": big, "total_in": big, "total_out": 0}])
    rows = [(1, "U", 2, "x"), (2, "N", 5, "no wallet yet"), (3, "U", None, "null"), (4, "U", -(big + 10), "too much"),
            (5, "U", -1, "fits"), (6, "U", 2**63 - 1, "too large"), (7, None, 5, "nobody")]
    cmds = spark.createDataFrame([(s, "A", u, a, r, ts(T0)) for s, u, a, r in rows],
                                 "seq long, actor_id string, user_id string, amount long, reason string, "
                                 "created_at timestamp_ntz")
    r = cm.adjust_wallets({"profiles": prof, "wallets": wal}, cmds)
    out = {x["seq"]: (x["new_balance"], x["error"]) for x in r["outcomes"].collect()}
    assert out == {1: (big + 2, None), 2: (5, None), 3: (None, cm.ERR_NULL_AMOUNT), 4: (None, cm.ERR_NEGATIVE),
                   5: (big + 1, None), 6: (None, "bigint out of range"), 7: (5, None)}
    fin = {x["user_id"]: x for x in r["wallets"].collect()}
    assert (fin["U"]["balance"], fin["U"]["total_in"], fin["U"]["total_out"]) == (big + 1, big + 2, 1)
    assert (fin["N"]["total_in"], fin["N"]["total_out"]) == (5, 0)


def test_adjust_guards(spark):
    prof = table(spark, "profiles", [{"id": "A", "role": "admin"}, {"id": "U", "role": "pembeli"}])
    wal = table(spark, "wallets", [{"id": "W-U", "user_id": "U", "balance": 100,
                                    "total_in": 0, "total_out": 0}])
    rows = [(1, "A", "U", -150, "too much"), (2, "A", "U", -60, "fits"),
            (3, "A", "U", 0, "zero"), (4, "A", "U", 10, "  "), (5, "U", "U", 10, "self"),
            (6, "A", "N", 5, "new wallet")]
    cmds = spark.createDataFrame(rows, "seq long, actor_id string, user_id string, "
                                       "amount long, reason string") \
        .withColumn("created_at", F.lit(T0).cast("timestamp_ntz"))
    r = cm.adjust_wallets({"profiles": prof, "wallets": wal}, cmds)
    out = {x["seq"]: x for x in r["outcomes"].collect()}
    assert not out[1]["ok"] and "wallets_balance_check" in out[1]["error"]
    assert out[2]["ok"] and out[2]["new_balance"] == 40
    assert out[3]["error"] == "Jumlah tidak boleh nol."
    assert out[4]["error"] == "Alasan wajib diisi untuk audit."
    assert out[5]["error"] == "Tidak punya akses admin."
    fin = {x["user_id"]: x for x in r["wallets"].collect()}
    assert fin["U"]["balance"] == 40 and fin["U"]["total_out"] == 60
    assert fin["N"]["wallet_id"] == "W-N" and fin["N"]["balance"] == 5


def test_quality_rules_find_each_bad_row(spark):
    from escrowlens.operators import quality as qa
    t = {
        "profiles": table(spark, "profiles", [
            {"id": "B1", "role": "pembeli", "username": "same"},
            {"id": "B2", "role": "boss", "username": "same"}]),
        "accounts": spark.createDataFrame([("B1", "ok@mail.test"), ("B2", "not an email")],
                                          "id string, email string"),
        "wallets": table(spark, "wallets", [
            {"id": "W1", "user_id": "B1", "balance": 5},
            {"id": "W2", "user_id": "B9", "balance": -1}]),
        "products": table(spark, "products", [{"id": 1, "price": 0}]),
        "orders": table(spark, "orders", [
            {"id": "o1", "buyer_id": "B1", "seller_id": "S7", "status": "paid",
             "product_price": 10, "quantity": 3, "total_amount": 31, "platform_fee": 1,
             "seller_receives": 30}]),
        "reviews": table(spark, "reviews", [{"id": "r1", "order_id": "o1", "rating": 6},
                                            {"id": "r2", "order_id": "o1", "rating": 5}]),
        "conversations": table(spark, "conversations", [
            {"id": "c1", "user_a_id": "S1", "user_b_id": "B1"}]),
        "messages": table(spark, "messages", [{"id": "m1", "body": "   "}]),
        "wallet_transactions": table(spark, "wallet_transactions", [
            {"id": "t1", "wallet_id": "W404", "type": "bonus", "amount": 5}]),
    }
    got = {(r["rule"], r["row_key"]) for r in qa.quality_violations(t).collect()}
    assert got == {
        ("profiles_role_check", "B2"), ("profiles_username_key", "same"),
        ("accounts_email_format", "B2"),
        ("wallets_balance_check", "W2"), ("wallets_user_id_fkey", "W2"),
        ("products_price_check", "1"),
        ("orders_total_is_price_x_qty", "o1"), ("orders_seller_id_fkey", "o1"),
        ("reviews_rating_check", "r1"), ("reviews_order_id_key", "o1"),
        ("ordered_pair", "c1"), ("messages_body_check", "m1"),
        ("wallet_tx_wallet_id_fkey", "t1"), ("wallet_tx_type_enum", "t1"),
    }


def test_integrity_rules_find_each_bad_row(spark):
    from escrowlens.operators import quality as qa
    from escrowlens.sources.schemas import SCHEMAS
    good = {"profiles": {"id": "P", "role": "penjual", "is_suspended": False}}
    t = {name: table(spark, name, [good[name]] if name in good else []) for name in SCHEMAS}
    assert qa.integrity_violations(t).count() == 0
    t["wallets"] = table(spark, "wallets", [{"id": "W", "user_id": "P", "balance": None, "escrow_hold": 0,
                                             "total_in": 0, "total_out": 0}])
    t["products"] = table(spark, "products", [{"id": 1, "seller_id": "gone", "title": "x", "category": "game",
                                               "price": 1, "is_active": True, "created_at": ts(T0)}])
    t["messages"] = table(spark, "messages", [{"id": "m", "conversation_id": "c?", "sender_id": "P", "body": "x",
                                               "is_read": None, "created_at": ts(T0)}])
    t["forum_messages"] = table(spark, "forum_messages", [
        {"id": "f", "room_id": "r", "sender_id": "P", "sender_role": "admin", "body": "x", "created_at": ts(T0)}])
    row = {"order_id": "o?", "gross_amount": 1, "fee_amount": 1, "seller_net": 0, "status": "odd", "created_at": ts(T0)}
    t["platform_commission"] = table(spark, "platform_commission", [{"id": "c1", **row}, {"id": "c2", **row}])
    got = sorted((r["rule"], r["row_key"]) for r in qa.integrity_violations(t).collect())
    each = lambda rule: [(f"platform_commission_{rule}", k) for k in ("c1", "c2")]
    assert got == sorted([
        ("wallets_balance_not_null", "W"), ("products_seller_id_fkey", "1"),
        ("messages_conversation_id_fkey", "m"), ("messages_is_read_not_null", "m"),
        ("forum_messages_sender_role_check", "f"), ("platform_commission_order_id_key", "o?"),
        *each("rate_not_null"), *each("order_id_fkey"), *each("status_check")])


def test_inbox_order_and_unread_sides(spark):
    from escrowlens.operators import chat as ch
    t = {"conversations": table(spark, "conversations", [
            {"id": "c1", "user_a_id": "A", "user_b_id": "B"}, {"id": "c2", "user_a_id": "A", "user_b_id": "C"},
            {"id": "c3", "user_a_id": "A", "user_b_id": "B", "last_message": "stored", "last_message_at": ts(T0)}]),
         "messages": table(spark, "messages", [
            {"id": str(k), "conversation_id": c, "sender_id": s, "body": f"b{k}", "is_read": r,
             "created_at": ts(f"2024-03-0{k} 00:00:00")}
            for k, (c, s, r) in enumerate([("c1", "A", False), ("c1", "A", False), ("c1", "B", False),
                                           ("c2", "C", True), ("c2", "C", False), ("c1", None, False)], 1)]),
         "profiles": table(spark, "profiles", [{"id": x, "full_name": x} for x in "ABC"]),
         "products": table(spark, "products", [])}
    rows = ch.inbox(t).collect()
    assert [r["conversation_id"] for r in rows] == ["c2", "c2", "c1", "c1", "c3", "c3"]
    got = {(r["conversation_id"], r["viewer_id"]): (r["last_message"], r["unread_count"]) for r in rows}
    assert got == {("c1", "A"): ("b3", 1), ("c1", "B"): ("b3", 2), ("c2", "A"): ("b5", 1), ("c2", "C"): ("b5", 0),
                   ("c3", "A"): ("stored", 0), ("c3", "B"): ("stored", 0)}


def test_close_ratings_are_no_ties(spark):
    t = _catalog_tables(spark)
    rows = [(1, 5)] * 99_999 + [(1, 4)] + [(2, 5)] * 66_666 + [(2, 4)]
    t["reviews"] = spark.createDataFrame([(f"r{k}", p, r) for k, (p, r) in enumerate(rows)],
                                         "id string, product_id long, rating long")
    got = cat.catalog(t, sort="rating", limit=4).collect()
    order = [r["id"] for r in got if r["id"] in (1, 2)]
    assert order == [1, 2] and {r["rating"] for r in got if r["id"] in (1, 2)} == {5.0}


def test_refund_v1_needs_the_buyers_wallet(spark):
    t = {"orders": table(spark, "orders", [
            {"id": f"O{k}", "buyer_id": b, "seller_id": "S", "status": "paid", "total_amount": 100, "product_title": "x"}
            for k, b in ((1, "B"), (2, "N"))]),
         "profiles": table(spark, "profiles", [{"id": "A", "role": "admin"}]),
         "wallets": table(spark, "wallets", [{"id": "W-B", "user_id": "B", "balance": 5, "escrow_hold": 0,
                                              "total_in": 0, "total_out": 0}])}
    cmds = spark.createDataFrame([(f"c{k}", f"O{k}", "why", "A", ts(T0)) for k in (1, 2)],
                                 "cmd_id string, order_id string, reason string, actor_id string, "
                                 "requested_at timestamp_ntz")
    r = cm.refund_orders(t, cmds, first_version=True)
    assert {x["cmd_id"]: x["error"] for x in r["outcomes"].collect()} == {"c1": None, "c2": cm.ERR_NO_LEDGER_WALLET}
    assert [x["description"] for x in r["ledger"].collect()] == ["Refund admin — x (why)"]
    assert {x["user_id"] for x in r["wallets"].collect()} == {"B"}
    assert {x["title"] for x in r["notifications"].collect()} == {cm.TITLE_REFUND_BUYER_V1, cm.TITLE_REFUND_SELLER_V1}
    later = cm.refund_orders(t, cmds)
    assert later["outcomes"].filter("ok").count() == 2 and later["wallets"].count() == 3


def test_inserted_rows_get_the_declared_defaults(spark):
    from escrowlens.sources.schemas import conform, schema
    rows = spark.createDataFrame([("m", "c", "A", "hi")], "id string, conversation_id string, sender_id string, body string")
    out = conform(rows, "messages", T0)
    assert out.schema.simpleString() == schema("messages").simpleString()
    row = out.collect()[0]
    assert row["is_read"] is False and row["created_at"] == ts(T0)
    assert conform(rows.select("id"), "wallets", T0).collect()[0]["balance"] == 0


def test_work_folder_must_be_shared_on_a_cluster():
    from escrowlens import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.work_dir(Session())
