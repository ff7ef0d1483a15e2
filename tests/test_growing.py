"""Tables that grow with the business: what of them reaches the driver, and how often rows travel."""

from __future__ import annotations

from conftest import SF_SMALL
from escrowlens.operators import commands as cm
from escrowlens.operators import views
from escrowlens.sources import commands as src
from escrowlens.sources.marketplace import load_marketplace
from pyspark.sql import functions as F


def _planned(spark, build, **conf) -> str:
    """The plan, made without statistics of a run."""
    conf = {"spark.sql.adaptive.enabled": "false"} | conf
    keep = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        return build()._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_products_are_not_broadcast_to_the_settlement(spark):
    """Their compressed files look small at any count of products."""
    t = load_marketplace(spark, SF_SMALL)
    settled, changed = cm.settle_commission(t, src.settle_commands(t)), cm.apply_status(t, src.status_commands(t))
    for df in (settled["outcomes"], settled["commission"], settled["ledger"], changed["commission"]):
        plan = _planned(spark, lambda: df.select("*"))  # noqa: B023
        joins = [x for x in plan.splitlines() if "Join [_product" in x]
        assert joins and all("SortMergeJoin" in x for x in joins), joins


def test_changed_commission_rows_are_those_of_settled_orders(spark):
    """They come by themselves, as in the whole table, and the whole table isn't shuffled for them."""
    t = load_marketplace(spark, SF_SMALL)
    done = cm.settle_commission(t, src.settle_commands(t))
    changes = done["commission_changes"]
    exp = done["commission"].join(done["orders"].select("order_id").distinct(), "order_id", "left_semi").select(*changes.columns)
    assert changes.columns == done["commission"].columns
    assert 0 < changes.count() < done["commission"].count()
    assert changes.exceptAll(exp).count() == 0 and exp.exceptAll(changes).count() == 0


def test_published_commission_settles_its_batch_once(spark, monkeypatch):
    """The batch that is repeated is the one that was written, not another settlement."""
    from escrowlens.registry import q_commands
    from escrowlens.sources.versions import VersionedTable
    t, plans = load_marketplace(spark, SF_SMALL), []
    upsert = VersionedTable.upsert

    def seen(self, changes, batch_id, gone=None):
        plans.append(changes._jdf.queryExecution().executedPlan().toString())
        upsert(self, changes, batch_id, gone)

    monkeypatch.setattr(VersionedTable, "upsert", seen)
    got = q_commands.commission_published(t, spark, SF_SMALL)
    exp = cm.settle_commission(t, src.settle_commands(t))["commission"]
    assert len(plans) == 2 and not [p for p in plans if "Join" in p or "Exchange" in p]
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def _view_tables(spark):
    """Orders with missing, unknown and repeated products and people."""
    orders = [(f"o{k}", [k % 7, None, 99][k % 3], [f"B{k % 5}", None, "B9"][k % 4 % 3]) for k in range(300)]
    names = "created_at status quantity total_amount platform_fee seller_payout commission_rate".split()
    return {"orders": spark.createDataFrame(orders, "id string, product_id long, buyer_id string")
            .withColumns({n: F.lit(n) for n in names}),
            "products": spark.createDataFrame(
                [(k, f"t{k}", "c", f"S{k % 2}") for k in range(7)] + [(3, "again", "c", None), (None, "none", "c", "S1")],
                "id long, title string, category string, seller_id string"),
            "profiles": spark.createDataFrame(
                [(x, f"n{x}", f"u{x}") for x in ("B0", "B1", "B1", "B2", "S0")] + [(None, "nobody", None)],
                "id string, full_name string, username string"),
            "wallets": spark.createDataFrame([("B0", 1), ("B1", 2), ("B3", 3), ("S1", 4), (None, 5)], "user_id string, balance long"),
            "platform_commission": spark.createDataFrame([("o1", 1, "settled"), ("o3", 2, "settled"), ("o3", 3, "due")],
                                                         "order_id string, fee_amount long, status string")}


def test_view_on_a_grid_gives_the_same_rows_and_deals_the_orders_once(spark):
    t = _view_tables(spark)
    plain = views.admin_orders_v2(t, grid=False)
    for shape in ((1, 1), (3, 3), (2, 5)):
        grid = views.admin_orders_v2(t, grid=shape)
        assert grid.schema == plain.schema
        assert grid.exceptAll(plain).count() == 0 and plain.exceptAll(grid).count() == 0
    plan = _planned(spark, lambda: views.admin_orders_v2(load_marketplace(spark, SF_SMALL), grid=(3, 3)),
                    **{"spark.sql.autoBroadcastJoinThreshold": "-1"})
    dealt = [x for x in plan.splitlines() if "Exchange" in x and "_cell" in x]
    assert len([x for x in dealt if "shufflepartitionidpassthrough(direct_shuffle_partition_id(_cell#" in x]) == 1
    assert not [x for x in dealt if "hashpartitioning" in x]


def test_a_grid_is_for_many_rows_and_smaller_tables(spark, monkeypatch):
    from escrowlens.plans import joins
    monkeypatch.setattr(joins, "ROWS_PER_CELL", 10)
    few, many = spark.range(30), spark.range(400)
    assert joins.grid_shape(few, few, few) is None  # too few cells
    assert joins.grid_shape(many, few, few) == (6, 7)
    assert joins.grid_shape(many, spark.range(120), spark.range(3)) == (40, 1)
    assert joins.grid_shape(many, few, spark.range(60)) is None  # repeated, they are more than 400
