"""Flagship query end to end, against the values in SURVEY §7.3 (sf0.001)."""

import __spark_entry__ as se
from conftest import SF_SMALL
from escrowlens import registry


def test_entry_flagship(spark):
    row = se.entry(spark).collect()
    assert len(row) == 1
    r = row[0].asDict()
    assert r["total_orders"] == 6000
    assert r["completed_orders"] == 1009
    assert r["pending_orders"] == 696
    assert r["disputed_orders"] == 312
    assert r["gmv_completed"] == 5434034444
    assert r["platform_revenue"] == 271701243
    assert r["total_escrow_held"] == 10404904840
    assert r["total_buyers"] == 150


def test_every_query_has_a_callable_and_most_an_oracle():
    qs, sql = registry.queries(), registry.oracle_sql()
    assert len(qs) >= 100
    assert set(qs) <= set(se.queries()) and set(sql) <= set(se.oracle_sql())
    assert set(sql) <= set(qs)
    missing = set(qs) - set(sql)
    assert not missing, f"queries without oracle SQL: {sorted(missing)}"


def test_status_counts_match_fixture_table(spark):
    from escrowlens.sources.marketplace import load_marketplace
    t = load_marketplace(spark, SF_SMALL)
    got = {r["status"]: r["count"] for r in t["orders"].groupBy("status").count().collect()}
    assert got == {"cancelled": 341, "completed": 1009, "delivered": 1318, "disputed": 312,
                   "paid": 625, "pending_payment": 696, "processing": 1362, "refunded": 337}


def test_sized_conf_scales_partitions():
    from escrowlens.session import sized_conf
    assert sized_conf(10 * 1024 ** 2)["spark.sql.shuffle.partitions"] == "8"
    assert sized_conf(100 * 1024 ** 4)["spark.sql.shuffle.partitions"] == "409600"
    assert sized_conf(1024 ** 4)["spark.sql.shuffle.partitions"] == "4096"
