"""Catalogue: scan, card rows, filters, search, sorts, top-k and buyer prices.

The source fetched every active product to the browser and filtered, sorted
and counted there.  Here the whole pipeline is one lazy plan; filters on
product columns reach the Parquet scan, and the top-8 lists compile to
TakeOrderedAndProject (a per-partition top-k, then one small merge).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escrowlens.functions import labels as L
from escrowlens.functions.money import COMMISSION_RATE_KEY, buyer_fee, parse_rate, rupiah

Tables = dict[str, DataFrame]

SCAN_COLUMNS = ["id", "title", "price", "category", "subcategory", "icon", "grad_start",
                "grad_end", "badge", "sold_count", "rating_sum", "rating_count",
                "seller_id", "is_active", "description", "stock", "photos", "cover_image",
                "created_at"]
SORTS = ("latest", "popular", "rating", "price-asc", "price-desc")
HOME_SIZE = 8


def catalog_scan(t: Tables) -> DataFrame:
    """Active products with the catalogue's column list (pruned scan)."""
    return t["products"].select(*SCAN_COLUMNS).filter(F.col("is_active"))


def _ratings(t: Tables) -> DataFrame:
    """Per rated product: rating_sum, rating_count and the exact average."""
    return t["reviews"].filter(F.col("product_id").isNotNull()).groupBy(
        F.col("product_id").alias("id")).agg(
        F.sum("rating").alias("rating_sum"), F.count(F.lit(1)).alias("rating_count")) \
        .withColumn("_exact", F.col("rating_sum") / F.col("rating_count"))


def _exact_rating() -> Column:
    return F.coalesce("_exact", F.lit(float(L.DEFAULT_RATING)))


def product_rating(t: Tables) -> DataFrame:
    """rating_sum, rating_count and rating per product (5 when unrated)."""
    zero = F.lit(0).cast("bigint")
    return t["products"].select("id").join(_ratings(t), "id", "left").select(
        "id", F.coalesce("rating_sum", zero).alias("rating_sum"),
        F.coalesce("rating_count", zero).alias("rating_count"),
        F.round(_exact_rating(), 4).alias("rating"))


def product_sold(t: Tables, since: str | None = None, until: str | None = None) -> DataFrame:
    """Units sold per product: quantity summed over completed orders
    (optionally those completed in [since, until])."""
    o = t["orders"].filter((F.col("status") == "completed") & F.col("product_id").isNotNull())
    if since is not None:
        o = o.filter(F.col("completed_at") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        o = o.filter(F.col("completed_at") <= F.lit(until).cast("timestamp_ntz"))
    return o.groupBy(F.col("product_id").alias("id")).agg(F.sum("quantity").alias("sold"))


def catalog_rows(t: Tables, sold_since: str | None = None, sold_until: str | None = None
                 ) -> DataFrame:
    """Card rows: active products with seller label, rating and units sold."""
    return _cards(t, catalog_scan(t), sold_since, sold_until).drop("_exact")


def _cards(t: Tables, p: DataFrame, since: str | None = None, until: str | None = None
           ) -> DataFrame:
    """Card rows of the products ``p``, which may carry ``_exact`` (rating) or
    ``sold`` already; ``_exact`` stays, for sorting on the unrounded rating."""
    seller = t["profiles"].select(F.col("id").alias("seller_id"), "full_name", "username")
    j = p.join(seller, "seller_id", "left")
    if "_exact" not in p.columns:
        j = j.join(_ratings(t).select("id", "_exact"), "id", "left")
    if "sold" not in p.columns:
        j = j.join(product_sold(t, since, until), "id", "left")
    grad = F.when(F.col("grad_start").isNotNull() & F.col("grad_end").isNotNull()
                  & (F.col("grad_start") != "") & (F.col("grad_end") != ""),
                  F.array("grad_start", "grad_end")).otherwise(
        F.array(*[F.lit(g) for g in L.DEFAULT_GRAD]))
    return j.select(
        "id", "title", "price", F.col("category").alias("cat"),
        F.col("subcategory").alias("sub"), "seller_id",
        L.seller_label("username", "full_name").alias("seller"),
        F.round(_exact_rating(), 4).alias("rating"), _exact_rating().alias("_exact"),
        F.coalesce("sold", F.lit(0).cast("bigint")).alias("sold"),
        F.coalesce(L.blank_to_null("icon"), F.lit(L.DEFAULT_ICON)).alias("icon"),
        grad.alias("grad"),
        F.coalesce(L.blank_to_null("badge"), F.lit(L.DEFAULT_BADGE)).alias("badge"),
        F.coalesce("description", F.lit("")).alias("description"),
        "stock",
        L.photos_or_cover("photos", "cover_image").alias("photos"),
        "created_at",
    )


def _sort_keys(sort: str) -> list[Column]:
    newest = [F.col("created_at").desc_nulls_last(), F.col("id").asc()]
    main = {
        "latest": [],
        "popular": [F.col("sold").desc()],
        "rating": [F.col("_exact").desc()],
        "price-asc": [F.col("price").asc()],
        "price-desc": [F.col("price").desc()],
    }
    if sort not in main:
        raise ValueError(f"unknown sort {sort!r}; one of {SORTS}")
    # Ties keep the newest-first order of the unsorted list (stable sort).
    return main[sort] + newest


def catalog(t: Tables, category: str | None = None, sub: str | None = None,
            search: str | None = None, sort: str = "latest", limit: int | None = None,
            trim_search: bool = False, sold_since: str | None = None,
            sold_until: str | None = None) -> DataFrame:
    """Filters -> sort (-> limit).  Choosing a subcategory forces category 'game'.

    Search is a case-insensitive literal substring of the title or the seller
    label (``%`` and ``_`` are ordinary characters; no ``like``).  The page's
    own search box uses the text as typed; the header search box trims it
    first (``trim_search``), and an empty result of trimming means no search.

    A limited list without a search is cut before the joins: only the table
    that its sort needs is read for all products.
    """
    if trim_search and search is not None:
        search = search.strip()
    if sub:
        category = "game"
    keys = _sort_keys(sort)
    p = catalog_scan(t)
    if category:
        p = p.filter(F.col("category") == category)
    if sub:
        p = p.filter(F.col("subcategory") == sub)
    if limit is not None and not search:
        if sort == "popular":
            p = p.join(product_sold(t, sold_since, sold_until), "id", "left").withColumn(
                "sold", F.coalesce("sold", F.lit(0).cast("bigint")))
        elif sort == "rating":
            p = p.join(_ratings(t).select("id", "_exact"), "id", "left").withColumn(
                "_exact", _exact_rating())
        p = p.orderBy(*keys).limit(limit)
    df = _cards(t, p, sold_since, sold_until)
    if search:
        q = search.lower()
        df = df.filter(F.lower("title").contains(q) | F.lower("seller").contains(q))
    df = df.orderBy(*keys)
    return (df.limit(limit) if limit is not None else df).drop("_exact")


def cards_of(t: Tables, p: DataFrame, sort: str = "latest", limit: int | None = None,
             few: int = 2_000) -> DataFrame:
    """Sorted card rows of ``p``, products (distinct ids) that a search has found.

    Up to ``few`` of them (counted first) go into the scans of products, orders and
    reviews as values; more are left to semi joins, which Catalyst sizes."""
    found = p.select("id").limit(few + 1).collect()
    if len(found) <= few:
        ids = [r["id"] for r in found]
        p = catalog_scan(t).filter(F.col("id").isin(ids))
        near = lambda name: t[name].filter(F.col("product_id").isin(ids))
    else:
        ids = p.select(F.col("id").alias("product_id"))
        near = lambda name: t[name].join(ids, "product_id", "left_semi")
    only = {"profiles": t["profiles"], "orders": near("orders"), "reviews": near("reviews")}
    df = _cards(only, p).orderBy(*_sort_keys(sort))
    return (df.limit(limit) if limit is not None else df).drop("_exact")


def catalog_count(t: Tables, **filters) -> DataFrame:
    """Result count of the catalogue query (no sort needed)."""
    df = catalog(t, **filters)
    return df.agg(F.count(F.lit(1)).alias("result_count"))


def home_popular_24h(t: Tables, asof: str) -> DataFrame:
    """Top 8 by units sold in the 24 hours up to ``asof`` (completion time)."""
    import datetime as _dt
    until = _dt.datetime.fromisoformat(asof)
    since = (until - _dt.timedelta(days=1)).isoformat(sep=" ")
    return catalog(t, sort="popular", limit=HOME_SIZE, sold_since=since,
                   sold_until=until.isoformat(sep=" "))


def popular_by_hour(t: Tables, k: int = HOME_SIZE, changes_only: bool = False) -> DataFrame:
    """The ``home_popular_24h`` list (as_of, rank, id, sold) of every full hour at which the
    last 24 hours hold a sale, or only of the hours at which the sums of any product change.

    Each sale enters the window at the first full hour not before it and leaves it 24
    hours later (25 where it lies on the hour: the window is closed on both sides).
    Sales are first summed into hourly panes per product; the sum of a window is the
    running sum of what entered and left, so no window adds its sales up again.  What
    grows with products times hours is only the sums above zero, cut to the first ``k``
    of an hour before its shuffle (rank pushed below it).  The ``k`` newest products
    fill lists that are short of sales, as in the list of one hour.
    """
    hour = 3600
    p = catalog_scan(t).select("id", "created_at")
    sales = t["orders"].filter((F.col("status") == "completed") & F.col("product_id").isNotNull()
                               & F.col("completed_at").isNotNull())
    micros = F.unix_micros(F.col("completed_at").cast("timestamp"))
    enters = F.ceil(micros / F.lit(hour * 1_000_000)).cast("bigint")
    leaves = enters + F.when(micros % F.lit(hour * 1_000_000) == 0, 25).otherwise(24)
    q = F.col("quantity")
    steps = sales.select(F.col("product_id").alias("id"), F.explode(F.array(
        F.struct(enters.alias("at"), q.alias("d"), F.lit(1).alias("n")),
        F.struct(leaves.alias("at"), (-q).alias("d"), F.lit(-1).alias("n")))).alias("s")) \
        .groupBy("id", F.col("s.at").alias("at")).agg(F.sum("s.d").alias("d"), F.sum("s.n").alias("n"))
    steps = steps.join(p.select("id"), "id", "left_semi")
    mine = Window.partitionBy("id").orderBy("at")
    sums = steps.select("id", "at", F.sum("d").over(mine).alias("sold"), F.sum("n").over(mine).alias("held"),
                        F.lead("at").over(mine).alias("until")).filter("held > 0")
    sums = sums.select("id", "sold", F.explode(F.expr("sequence(at, until - 1)")).alias("at"))
    if changes_only:   # hours of the calendar, whatever the number of sales
        sums = sums.join(steps.select("at").distinct(), "at", "left_semi")
    hours = sums.select("at").distinct()
    newest = [r["id"] for r in p.orderBy(F.col("created_at").desc_nulls_last(), "id").limit(k).collect()]  # k numbers
    # A product with a sum of its own keeps that below.
    fill = hours.select("at", F.explode(F.array(*map(F.lit, newest)).cast("array<bigint>")).alias("id"),
                        F.lit(0).cast("bigint").alias("sold"))
    order = [F.col("sold").desc(), F.col("created_at").desc_nulls_last(), F.col("id")]
    rank = F.row_number().over(Window.partitionBy("at").orderBy(*order))
    top = sums.join(p, "id").withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")
    short = fill.join(p, "id").select("at", "id", "sold", "created_at").unionByName(
        top.select("at", "id", "sold", "created_at"))
    one = short.groupBy("at", "id").agg(F.max("sold").alias("sold"), F.max("created_at").alias("created_at"))
    as_of = F.timestamp_seconds(F.col("at") * hour).cast("timestamp_ntz")
    return one.withColumn("rank", rank).filter(F.col("rank") <= k).select(as_of.alias("as_of"), "rank", "id", "sold")


def checkout_eligible(t: Tables) -> DataFrame:
    """Active products that can be bought: stock unlimited (null) or positive."""
    p = catalog_scan(t)
    return p.filter(F.col("stock").isNull() | (F.col("stock") > 0)).select("id", "title",
                                                                           "stock")


def rate_setting(t: Tables) -> DataFrame:
    """One row: the text of the commission rate setting (null when missing)."""
    s = t["app_settings"].filter(F.col("key") == COMMISSION_RATE_KEY)
    # LIMIT 1 without an order in the source; pinned to the latest update.
    return s.agg(F.max_by("value", "updated_at").alias("value"))


def effective_rate(t: Tables) -> DataFrame:
    """One row: the buyer-side rate, default 0.05 when missing or unparsable."""
    return rate_setting(t).select(parse_rate("value").alias("rate"))


def catalog_priced(t: Tables, fee_cap: int = 0) -> DataFrame:
    """Buyer price per active product: fee = round(price * rate), capped when
    ``fee_cap`` > 0; total = price + fee."""
    rate = F.broadcast(effective_rate(t))   # one row by construction
    p = catalog_scan(t).select("id", "price").crossJoin(rate)
    fee = buyer_fee(F.col("price"), F.col("rate"), F.lit(fee_cap))
    return p.select("id", "price", "rate",
                    fee.alias("fee"), (F.col("price") + fee).alias("buyer_total"))


def catalog_labels(t: Tables, asof: str) -> DataFrame:
    """Display labels of catalogue cards."""
    r = catalog_rows(t)
    return r.select(
        "id", rupiah("price").alias("price_label"),
        L.category_label("cat").alias("category_label"),
        L.stock_label("stock").alias("stock_label"),
        L.rating_label("rating").alias("rating_label"),
        "seller",
        L.chat_time_label("created_at", F.lit(asof).cast("timestamp_ntz")).alias("time_label"),
    )
