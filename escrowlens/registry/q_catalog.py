"""Registered catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from escrowlens.operators import catalog as c
from escrowlens.operators.search import CatalogIndex
from escrowlens.registry.core import register

ASOF = "2001-08-01 00:00:00"

ROWS = """
, rt AS (SELECT product_id AS id, sum(rating) AS rs, count(*) AS rc FROM m_reviews
         WHERE product_id IS NOT NULL GROUP BY product_id),
sd AS (SELECT product_id AS id, sum(quantity) AS sold FROM m_orders
       WHERE status = 'completed' AND product_id IS NOT NULL {sold_filter}
       GROUP BY product_id),
rows AS (
  SELECT p.id, p.title, p.price, p.category AS cat, p.subcategory AS sub, p.seller_id,
         CASE WHEN s.username IS NOT NULL AND s.username <> '' THEN '@' || s.username
              ELSE coalesce(nullif(s.full_name, ''), 'Penjual') END AS seller,
         CASE WHEN coalesce(rt.rc, 0) > 0 THEN rt.rs / rt.rc ELSE 5.0 END AS exact,
         round(exact, 4) AS rating,
         CAST(coalesce(sd.sold, 0) AS BIGINT) AS sold,
         coalesce(nullif(p.icon, ''), '📦') AS icon,
         CAST(to_json(CASE WHEN p.grad_start IS NOT NULL AND p.grad_end IS NOT NULL
                           AND p.grad_start <> '' AND p.grad_end <> ''
                      THEN [p.grad_start, p.grad_end]
                      ELSE ['#16A37A', '#0E7C5B'] END) AS VARCHAR) AS grad,
         coalesce(nullif(p.badge, ''), 'Instan') AS badge,
         coalesce(p.description, '') AS description, p.stock,
         CAST(to_json(CASE WHEN p.photos IS NOT NULL THEN p.photos
                           WHEN p.cover_image IS NOT NULL THEN [p.cover_image]
                           ELSE CAST([] AS VARCHAR[]) END) AS VARCHAR) AS photos,
         p.created_at
  FROM m_products p
  LEFT JOIN m_profiles s ON s.id = p.seller_id
  LEFT JOIN rt ON rt.id = p.id
  LEFT JOIN sd ON sd.id = p.id
  WHERE p.is_active)
"""
ALL_ROWS = ROWS.format(sold_filter="")
NEWEST = "created_at DESC NULLS LAST, id"


def _rows_query(where: str = "", order: str = "", limit: str = "") -> str:
    q = ALL_ROWS + "SELECT * EXCLUDE (exact) FROM rows"
    if where:
        q += f" WHERE {where}"
    if order:
        q += f" ORDER BY {order}"
    if limit:
        q += f" LIMIT {limit}"
    return q


register("catalog_scan", """
SELECT id, title, price, category, subcategory, icon, grad_start, grad_end, badge,
       sold_count, rating_sum, rating_count, seller_id, is_active, description, stock,
       CAST(to_json(photos) AS VARCHAR) AS photos, cover_image, created_at
FROM m_products WHERE is_active
""")(c.catalog_scan)

register("catalog_rows", _rows_query())(c.catalog_rows)


@register("product_rating", """
SELECT p.id, CAST(coalesce(r.rs, 0) AS BIGINT) AS rating_sum,
       coalesce(r.rc, 0) AS rating_count,
       CASE WHEN coalesce(r.rc, 0) > 0 THEN round(r.rs / r.rc, 4) ELSE 5.0 END AS rating
FROM m_products p
LEFT JOIN (SELECT product_id, sum(rating) AS rs, count(*) AS rc FROM m_reviews
           WHERE product_id IS NOT NULL GROUP BY product_id) r ON r.product_id = p.id
""")
def product_rating(t):
    """Average review rating per product; 5 when unrated."""
    return c.product_rating(t)


@register("product_sold", """
SELECT product_id AS id, CAST(sum(quantity) AS BIGINT) AS sold FROM m_orders
WHERE status = 'completed' AND product_id IS NOT NULL GROUP BY product_id
""")
def product_sold(t):
    """Units sold per product over completed orders."""
    return c.product_sold(t)


@register("catalog_by_category", _rows_query("cat = 'game'", NEWEST))
def catalog_by_category(t):
    """Catalogue filtered to one category."""
    return c.catalog(t, category="game")


@register("catalog_by_subcategory", _rows_query("cat = 'game' AND sub = 'valorant'", NEWEST))
def catalog_by_subcategory(t):
    """Catalogue filtered to one game subcategory (forces category game)."""
    return c.catalog(t, category="digital", sub="valorant")


@register("catalog_search", _rows_query(
    "contains(lower(title), 'ring') OR contains(lower(seller), 'ring')", NEWEST))
def catalog_search(t):
    """Case-insensitive substring search of title or seller label."""
    return c.catalog(t, search="Ring")


@register("catalog_search_header", _rows_query(
    "contains(lower(title), 'ring') OR contains(lower(seller), 'ring')", NEWEST))
def catalog_search_header(t):
    """Header search: the text is trimmed before the same substring search."""
    return c.catalog(t, search="  Ring ", trim_search=True)


@register("catalog_search_literal", _rows_query(
    "contains(lower(title), 'r_d') OR contains(lower(seller), 'r_d')", NEWEST))
def catalog_search_literal(t):
    """Search text with '_' matches literally (no pattern semantics)."""
    return c.catalog(t, search="R_D")


@register("catalog_search_punctuation", _rows_query(
    "contains(lower(title), 'supplier#') OR contains(lower(seller), 'supplier#')", NEWEST))
def catalog_search_punctuation(t):
    """Search text with punctuation matches literally, and hits."""
    return c.catalog(t, search="Supplier#")


FULL_WHERE = ("cat = 'digital' AND (contains(lower(title), 'ed') "
              "OR contains(lower(seller), 'ed'))")


@register("catalog_full", _rows_query(FULL_WHERE, "price, " + NEWEST))
def catalog_full(t):
    """Composite catalogue query: category + search + price ascending."""
    return c.catalog(t, category="digital", search="ed", sort="price-asc")


@register("catalog_full_count",
          ALL_ROWS + f"SELECT count(*) AS result_count FROM rows WHERE {FULL_WHERE}")
def catalog_full_count(t):
    """Result count of the composite catalogue query."""
    return c.catalog_count(t, category="digital", search="ed", sort="price-asc")


@register("catalog_latest", _rows_query(order=NEWEST))
def catalog_latest(t):
    """Whole catalogue, newest first."""
    return c.catalog(t, sort="latest")


@register("catalog_popular", _rows_query(order="sold DESC, " + NEWEST))
def catalog_popular(t):
    """Whole catalogue, best selling first."""
    return c.catalog(t, sort="popular")


@register("catalog_top_rated", _rows_query(order="exact DESC, " + NEWEST))
def catalog_top_rated(t):
    """Whole catalogue, highest rated first (unrated count as 5)."""
    return c.catalog(t, sort="rating")


@register("catalog_price_asc", _rows_query(order="price, " + NEWEST))
def catalog_price_asc(t):
    """Whole catalogue, cheapest first."""
    return c.catalog(t, sort="price-asc")


@register("catalog_price_desc", _rows_query(order="price DESC, " + NEWEST))
def catalog_price_desc(t):
    """Whole catalogue, dearest first."""
    return c.catalog(t, sort="price-desc")


@register("home_latest", _rows_query(order=NEWEST, limit="8"))
def home_latest(t):
    """Home page: 8 newest products."""
    return c.catalog(t, sort="latest", limit=c.HOME_SIZE)


@register("home_recommended", _rows_query(order="exact DESC, " + NEWEST, limit="8"))
def home_recommended(t):
    """Home page: 8 highest rated products."""
    return c.catalog(t, sort="rating", limit=c.HOME_SIZE)


@register("home_popular", _rows_query(order="sold DESC, " + NEWEST, limit="8"))
def home_popular(t):
    """Home page: 8 best-selling products (all time, as the source sorts)."""
    return c.catalog(t, sort="popular", limit=c.HOME_SIZE)


@register("home_popular_24h", ROWS.format(
    sold_filter=f"AND completed_at >= TIMESTAMP '{ASOF}' - INTERVAL 1 DAY "
                f"AND completed_at <= TIMESTAMP '{ASOF}'")
    + "SELECT * EXCLUDE (exact) FROM rows ORDER BY sold DESC, " + NEWEST + " LIMIT 8")
def home_popular_24h(t):
    """Home page: 8 best-selling products over the last 24 hours."""
    return c.home_popular_24h(t, ASOF)


@register("home_popular_hourly", """
, sale AS (SELECT product_id AS id, quantity, completed_at AS c FROM m_orders
           WHERE status = 'completed' AND product_id IN (SELECT id FROM m_products WHERE is_active)),
edge AS (SELECT DISTINCT id, unnest([
           CASE WHEN date_trunc('hour', c) = c THEN c ELSE date_trunc('hour', c) + INTERVAL 1 HOUR END,
           date_trunc('hour', c) + INTERVAL 25 HOUR]) AS as_of FROM sale),
asofs AS (SELECT DISTINCT as_of FROM edge),
held AS (SELECT as_of, id, sum(quantity) AS sold FROM asofs
         JOIN sale ON c >= as_of - INTERVAL 24 HOUR AND c <= as_of GROUP BY as_of, id),
newest AS (SELECT id FROM m_products WHERE is_active ORDER BY created_at DESC NULLS LAST, id LIMIT 8),
listed AS (SELECT * FROM held UNION ALL
           SELECT a.as_of, n.id, 0 FROM (SELECT DISTINCT as_of FROM held) a, newest n
           WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.as_of = a.as_of AND h.id = n.id))
SELECT as_of, row_number() OVER (PARTITION BY as_of ORDER BY sold DESC, created_at DESC NULLS LAST, l.id) AS rank,
       l.id, CAST(sold AS BIGINT) AS sold
FROM listed l JOIN m_products p ON p.id = l.id
QUALIFY rank <= 8
""")
def home_popular_hourly(t):
    """The 24-hour best sellers at every full hour at which a product's sum changes."""
    return c.popular_by_hour(t, changes_only=True)


register("checkout_eligible", """
SELECT id, title, stock FROM m_products
WHERE is_active AND (stock IS NULL OR stock > 0)
""")(c.checkout_eligible)


register("catalog_priced", """
, r AS (SELECT coalesce(try_cast((SELECT value FROM m_settings WHERE key = 'commission_rate'
                                  ORDER BY updated_at DESC LIMIT 1) AS DECIMAL(18,17)),
                        CAST(0.05 AS DECIMAL(18,17))) AS rate)
SELECT p.id, p.price, CAST(r.rate AS DOUBLE) AS rate,
       CAST(round(p.price * r.rate) AS BIGINT) AS fee,
       p.price + CAST(round(p.price * r.rate) AS BIGINT) AS buyer_total
FROM m_products p, r WHERE p.is_active
""")(c.catalog_priced)


@register("catalog_labels", ALL_ROWS + f"""
SELECT id, 'Rp ' || replace(format('{{:,}}', price), ',', '.') AS price_label,
       CASE cat WHEN 'digital' THEN 'Produk Digital' WHEN 'game' THEN 'Produk Game'
                WHEN 'jasa' THEN 'Jasa' ELSE coalesce(cat, '-') END AS category_label,
       CASE WHEN stock IS NULL THEN '' WHEN stock > 0
            THEN 'Stok tersedia (' || stock || ')' ELSE 'Habis' END AS stock_label,
       CAST(CAST(round(CAST(rating AS DECIMAL(10,4)), 1) AS DECIMAL(10,1)) AS VARCHAR)
         AS rating_label,
       seller,
       CASE WHEN CAST(created_at AS DATE) = CAST(TIMESTAMP '{ASOF}' AS DATE)
            THEN strftime(created_at, '%H.%M')
            ELSE day(created_at) || ' ' ||
                 (['Jan','Feb','Mar','Apr','Mei','Jun','Jul','Agu','Sep','Okt','Nov',
                   'Des'])[month(created_at)] || ' ' || strftime(created_at, '%H.%M')
       END AS time_label
FROM rows
""")
def catalog_labels(t):
    """Price, category, stock, rating and time labels of catalogue cards."""
    return c.catalog_labels(t, ASOF)


# The search index of a session's tables, built once (as the tables themselves are).
_indexes: dict[tuple, CatalogIndex] = {}


def _index(t, spark, sf_dir) -> CatalogIndex:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _indexes:
        _indexes[key] = CatalogIndex.build(t)
    return _indexes[key]


def _found(text: str, *more: str) -> str:
    return " AND ".join([f"(contains(lower(title), '{text}') OR contains(lower(seller), '{text}'))", *more])


@register("catalog_search_indexed", _rows_query(_found("ring"), NEWEST), needs_session=True)
def catalog_search_indexed(t, spark, sf_dir):
    """Header search through the trigram index: only the postings of its pieces are read."""
    return _index(t, spark, sf_dir).search(t, "  Ring ", trim_search=True)


@register("catalog_search_indexed_literal", _rows_query(_found("r_d"), NEWEST), needs_session=True)
def catalog_search_indexed_literal(t, spark, sf_dir):
    """Text with '_' through the index: an ordinary character."""
    return _index(t, spark, sf_dir).search(t, "R_D")


@register("catalog_search_indexed_punctuation", _rows_query(_found("supplier#"), NEWEST), needs_session=True)
def catalog_search_indexed_punctuation(t, spark, sf_dir):
    """A text that nearly every seller label holds, through the index."""
    return _index(t, spark, sf_dir).search(t, "Supplier#")


@register("catalog_full_indexed", _rows_query(_found("ring", "cat = 'digital'"), "price, " + NEWEST),
          needs_session=True)
def catalog_full_indexed(t, spark, sf_dir):
    """Category, indexed search and price ascending."""
    return _index(t, spark, sf_dir).search(t, "Ring", category="digital", sort="price-asc")


RENAMED = "Toko Ringan"
RENAMED_SQL = ALL_ROWS.replace("FROM m_products p", f"""
  FROM (SELECT * REPLACE (CASE WHEN id % 11 = 3 THEN 'Kartu Stringer ' || id ELSE title END AS title)
        FROM m_products) p""").replace("LEFT JOIN m_profiles s", f"""
  LEFT JOIN (SELECT * REPLACE (CASE WHEN role = 'penjual' AND id LIKE '%7' THEN NULL ELSE username END AS username,
                               CASE WHEN role = 'penjual' AND id LIKE '%7' THEN '{RENAMED}' ELSE full_name END
                                 AS full_name) FROM m_profiles) s""")


@register("catalog_search_renamed", RENAMED_SQL + f"""
SELECT * EXCLUDE (exact) FROM rows WHERE {_found("ring")} ORDER BY {NEWEST}""", needs_session=True)
def catalog_search_renamed(t, spark, sf_dir):
    """Indexed search after a batch of renamed sellers and retitled products: only the
    changed texts are indexed anew, and former texts no longer match."""
    new_title = t["products"].filter("id % 11 = 3").withColumn(
        "title", F.concat(F.lit("Kartu Stringer "), F.col("id").cast("string")))
    change = (F.col("role") == "penjual") & F.col("id").endswith("7")
    new_name = t["profiles"].filter(change).withColumns(
        {"username": F.lit(None).cast("string"), "full_name": F.lit(RENAMED)})
    index = CatalogIndex.build(t)
    index.add(1, new_title, new_name)
    now = {"products": t["products"].filter("not coalesce(id % 11 = 3, false)").unionByName(new_title),
           "profiles": t["profiles"].filter(~F.coalesce(change, F.lit(False))).unionByName(new_name),
           "orders": t["orders"], "reviews": t["reviews"]}
    return index.search(now, "ring")
