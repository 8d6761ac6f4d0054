"""Catalog and stock queries."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, functions as F

from tillspark import schemas
from tillspark.functions.positions import assign_ids, largest_id
from tillspark.functions.text import price_label
from tillspark.operators import catalog, inventory, lookups, updates, validate
from tillspark.plans.registry import query
from tillspark.sources import tables
from tillspark.sources.standins import Tables, stored

_COLUMNS = "id, name, brand, category, price, description, image_url, width, active"
FILTERS = {
    "brand": "BRAND#2",
    "category": "DECK",
    "min_price": Decimal("900.00"),
    "max_price": Decimal("990.00"),
    "name": "R",
}
_MATCH = """active AND lower(brand) = 'brand#2' AND category = 'DECK'
  AND price >= 900 AND price <= 990 AND lower(name) LIKE '%r%'"""
_STOCK = "coalesce(i.quantity - i.reserved, 0)"
_PAGE = f"""SELECT p.*, {_STOCK} AS stock,
  CASE WHEN {_STOCK} > 0 THEN concat(CAST({_STOCK} AS VARCHAR), ' in stock')
    ELSE 'Out of stock' END AS stock_label,
  CASE WHEN {_STOCK} > 0 THEN 'Add to cart' ELSE 'Out of stock' END AS button_label,
  {_STOCK} <> 0 AS can_add, format('€{{:,.2f}}', CAST(p.price AS DOUBLE)) AS price_label
FROM products p LEFT JOIN inventory i ON i.product_id = p.id"""


@query("scan_products", "SELECT * FROM products")
def scan_products(t: Tables) -> DataFrame:
    return tables.scan_products(t.spark, stored(t.products, schemas.PRODUCTS))


@query("scan_inventory", "SELECT * FROM inventory")
def scan_inventory(t: Tables) -> DataFrame:
    return tables.scan_inventory(t.spark, stored(t.inventory, schemas.INVENTORY))


@query("catalog_search", f"SELECT {_COLUMNS} FROM products WHERE {_MATCH}")
def catalog_search(t: Tables) -> DataFrame:
    return catalog.catalog_search(t.products, **FILTERS)


@query("catalog_search_brand", "SELECT * FROM products WHERE active AND lower(brand) = 'brand#17'")
def catalog_search_brand(t: Tables) -> DataFrame:
    return catalog.catalog_search(t.products, brand="bRAND#17", name="  ")


@query("catalog_search_category", "SELECT * FROM products WHERE active AND category = 'TRUCKS'")
def catalog_search_category(t: Tables) -> DataFrame:
    return catalog.catalog_search(t.products, category="TRUCKS", brand=" ")


@query("catalog_search_min_price", "SELECT * FROM products WHERE active AND price >= 950")
def catalog_search_min_price(t: Tables) -> DataFrame:
    return catalog.catalog_search(t.products, min_price=Decimal("950.00"))


@query("catalog_search_max_price", "SELECT * FROM products WHERE active AND price <= 950")
def catalog_search_max_price(t: Tables) -> DataFrame:
    return catalog.catalog_search(
        t.products, min_price=Decimal(0), max_price=Decimal("950.00"), zero_means_unset=True
    )


@query(
    "catalog_search_name_wildcard",
    "SELECT * FROM products WHERE active AND lower(name) LIKE '%b%t_%'",
)
def catalog_search_name_wildcard(t: Tables) -> DataFrame:
    return catalog.catalog_search(t.products, name="B%t_")


@query(
    "catalog_search_name_literal",
    "SELECT * FROM products WHERE active AND contains(lower(name), 'bolt')",
)
def catalog_search_name_literal(t: Tables) -> DataFrame:
    return catalog.catalog_search(t.products, name="Bolt", literal=True)


@query("catalog_search_active", "SELECT * FROM products WHERE active")
def catalog_search_active(t: Tables) -> DataFrame:
    return catalog.catalog_search(t.products)


@query("product_view", f"SELECT {_COLUMNS} FROM products")
def product_view(t: Tables) -> DataFrame:
    return catalog.product_view(t.products)


@query("catalog_with_stock", f"{_PAGE} WHERE p.active AND p.category = 'DECK'")
def catalog_with_stock(t: Tables) -> DataFrame:
    return catalog.catalog_with_stock(t.products, t.inventory, category="DECK")


@query("catalog_with_stock_filtered", f"{_PAGE} WHERE {_MATCH}")
def catalog_with_stock_filtered(t: Tables) -> DataFrame:
    return catalog.catalog_with_stock(t.products, t.inventory, **FILTERS)


@query("catalog_count", f"SELECT count(*) AS products FROM products WHERE {_MATCH}")
def catalog_count(t: Tables) -> DataFrame:
    return catalog.catalog_count(t.products, **FILTERS)


@query("distinct_brands", "SELECT DISTINCT brand FROM products WHERE active ORDER BY brand")
def distinct_brands(t: Tables) -> DataFrame:
    return catalog.distinct_brands(t.products)


@query(
    "price_label",
    """SELECT id, format('€{:,.2f}', CAST(total_amount AS DOUBLE)) AS label FROM orders_t""",
)
def order_price_label(t: Tables) -> DataFrame:
    return t.orders_t.select("id", price_label("total_amount").alias("label"))


@query("inventory_view", "SELECT *, quantity - reserved AS available FROM inventory")
def inventory_view(t: Tables) -> DataFrame:
    return inventory.inventory_view(t.inventory)


@query(
    "inventory_for_products",
    """SELECT *, quantity - reserved AS available FROM inventory
    WHERE product_id IN (SELECT id FROM products WHERE active)""",
)
def inventory_for_products(t: Tables) -> DataFrame:
    keys = catalog.catalog_search(t.products).select(F.col("id").alias("product_id"))
    return inventory.inventory_for_products(t.inventory, keys)


@query(
    "inventory_exists",
    """SELECT id AS product_id, id IN (SELECT product_id FROM inventory) AS "exists" FROM products""",
)
def inventory_exists(t: Tables) -> DataFrame:
    return inventory.inventory_exists(
        t.products.select(F.col("id").alias("product_id")), t.inventory
    )


@query(
    "product_exists",
    """SELECT r.request_id, r.name, r.brand, EXISTS (SELECT 1 FROM products p
      WHERE p.name = r.name AND p.brand = r.brand) AS "exists" FROM product_requests r""",
)
def product_exists(t: Tables) -> DataFrame:
    return catalog.product_exists(
        t.product_requests.select("request_id", "name", "brand"), t.products
    )


@query(
    "lookup_keys_products",
    """SELECT e.event_id AS id, p.name, p.active, p.id IS NOT NULL AS found,
      CASE WHEN p.id IS NULL THEN 404 END AS error_code,
      CASE WHEN p.id IS NULL THEN concat('Product not found with id: ', CAST(e.event_id AS VARCHAR)) END AS message
    FROM events e LEFT JOIN products p ON p.id = e.event_id""",
)
def lookup_products(t: Tables) -> DataFrame:
    keys = t.raw("events").select(F.col("event_id").alias("id"))
    return lookups.lookup_keys(
        keys, t.products.select("id", "name", "active"), "id", lookups.NOT_FOUND_TEXT["product"]
    )


@query(
    "lookup_keys_inventory",
    """SELECT p.id AS product_id, i.quantity, i.reserved, i.id IS NOT NULL AS found,
      CASE WHEN i.id IS NULL THEN 404 END AS error_code,
      CASE WHEN i.id IS NULL THEN concat('Inventory not found for product: ', CAST(p.id AS VARCHAR)) END AS message
    FROM products p LEFT JOIN inventory i ON i.product_id = p.id""",
)
def lookup_inventory(t: Tables) -> DataFrame:
    return lookups.lookup_keys(
        t.products.select(F.col("id").alias("product_id")),
        t.inventory.select("product_id", "quantity", "reserved"),
        "product_id",
        lookups.NOT_FOUND_TEXT["inventory"],
    )


@query(
    "assign_ids",
    """SELECT request_id, name, (SELECT max(id) FROM products) + row_number() OVER (ORDER BY name, request_id) AS id
    FROM product_requests""",
)
def assigned_ids(t: Tables) -> DataFrame:
    rows = t.product_requests.select("request_id", "name")
    return assign_ids(rows, ["name", "request_id"], "id", largest_id(t.products, "id"))


@query(
    "new_product_rows",
    """SELECT (SELECT max(id) FROM products) + row_number() OVER (ORDER BY request_id) AS id,
      name, brand, category, price, description, image_url, width, true AS active
    FROM product_requests""",
)
def new_product_rows(t: Tables) -> DataFrame:
    return catalog.new_product_rows(t.product_requests, largest_id(t.products, "id"))


_SEEDS = """SELECT p_partkey * 2 AS seq, p_name AS name FROM {part}
  UNION ALL SELECT s_suppkey * 2 + 1 AS seq, concat('kit ', CAST(s_nationkey AS STRING)) AS name
  FROM {supplier}"""


@query(
    "seed_products",
    f"""WITH seeds AS ({_SEEDS.format(part="part", supplier="supplier")}),
    first AS (SELECT name, min(seq) AS seq FROM seeds GROUP BY name)
    SELECT * FROM products UNION ALL
    SELECT (SELECT max(id) FROM products) + row_number() OVER (ORDER BY seq, name), name, 'House', 'DECK', CAST(seq AS DECIMAL(18,2)), NULL, NULL, NULL, true
    FROM first WHERE name NOT IN (SELECT name FROM products)""",
)
def seed_products(t: Tables) -> DataFrame:
    rows = t.spark.sql(_SEEDS, part=t.raw("part"), supplier=t.raw("supplier")).select(
        "seq",
        "name",
        F.lit("House").alias("brand"),
        F.lit("DECK").alias("category"),
        F.col("seq").cast("decimal(18,2)").alias("price"),
        F.lit(True).alias("active"),
    )
    return catalog.seed_products(t.products, rows)


@query(
    "seed_inventory",
    """SELECT * FROM inventory UNION ALL
    SELECT (SELECT max(id) FROM inventory) + row_number() OVER (ORDER BY min(order_id), product_id), product_id, 10, 0
    FROM order_items WHERE product_id NOT IN (SELECT product_id FROM inventory) GROUP BY product_id""",
)
def seed_inventory(t: Tables) -> DataFrame:
    rows = t.lines_t.select(
        "product_id",
        F.col("order_id").alias("seq"),
        F.lit(10).alias("quantity"),
        F.lit(0).alias("reserved"),
    )
    return inventory.seed_inventory(t.inventory, rows)


@query(
    "upsert_by_key",
    """SELECT * FROM inventory
      WHERE product_id NOT IN (SELECT id FROM products WHERE category = 'TRUCKS')
    UNION ALL SELECT id, id, 10, 0 FROM products WHERE category = 'TRUCKS'""",
)
def upsert_by_key(t: Tables) -> DataFrame:
    rows = t.products.filter("category = 'TRUCKS'").select(
        "id",
        F.col("id").alias("product_id"),
        F.lit(10).alias("quantity"),
        F.lit(0).alias("reserved"),
    )
    return updates.upsert_by_key(t.inventory, rows, "product_id")


_CHANGED = "SELECT request_id + 500 AS id, * EXCLUDE (request_id) FROM product_requests"


def _product_changes(t: Tables) -> DataFrame:
    return t.product_requests.withColumn("id", F.col("request_id") + 500)


@query(
    "update_products",
    f"""WITH changed AS ({_CHANGED})
    SELECT p.id, {", ".join(f"CASE WHEN c.id IS NULL THEN p.{f} ELSE c.{f} END AS {f}" for f in catalog.EDITABLE)}, p.active
    FROM products p LEFT JOIN changed c ON c.id = p.id""",
)
def update_products(t: Tables) -> DataFrame:
    return catalog.update_products(t.products, _product_changes(t), "request_id").table


@query(
    "update_products_rejects",
    f"""WITH changed AS ({_CHANGED})
    SELECT id, 404 AS error_code, concat('Product not found with id: ', CAST(id AS VARCHAR)) AS message
    FROM changed WHERE id NOT IN (SELECT id FROM products)""",
)
def update_products_rejects(t: Tables) -> DataFrame:
    rejects = catalog.update_products(t.products, _product_changes(t), "request_id").rejects
    return rejects.select("id", "error_code", "message")


@query(
    "deactivate_products",
    """SELECT * EXCLUDE (active), active AND id NOT IN (SELECT product_id FROM order_items WHERE quantity = 50)
      AS active FROM products""",
)
def deactivate_products(t: Tables) -> DataFrame:
    ids = t.lines_t.filter("quantity = 50").select(F.col("product_id").alias("id"))
    return catalog.deactivate_products(t.products, ids).table


@query(
    "new_inventory_rows",
    """SELECT (SELECT max(id) FROM inventory) + row_number() OVER (ORDER BY product_id, quantity) AS id,
      product_id, quantity, 0 AS reserved FROM stock_requests
    WHERE product_id IS NOT NULL AND quantity >= 0""",
)
def new_inventory_rows(t: Tables) -> DataFrame:
    valid = validate.validate_inventory(t.stock_requests).valid
    return inventory.new_inventory_rows(valid, largest_id(t.inventory, "id"))


# Two creation requests per product number, in event order.
_CREATIONS = "SELECT seq, seq >> 1 AS product_id, quantity FROM cart_events"


def _creations(t: Tables) -> DataFrame:
    return t.cart_events.select("seq", F.shiftright("seq", 1).alias("product_id"), "quantity")


@query(
    "create_inventory",
    f"""WITH requests AS ({_CREATIONS}),
    first AS (SELECT product_id, min(seq) AS seq FROM requests
      WHERE product_id NOT IN (SELECT product_id FROM inventory) GROUP BY product_id)
    SELECT * FROM inventory UNION ALL
    SELECT (SELECT max(id) FROM inventory) + row_number() OVER (ORDER BY r.seq), r.product_id, r.quantity, 0
    FROM requests r JOIN first f USING (product_id, seq)""",
)
def create_inventory(t: Tables) -> DataFrame:
    return inventory.create_inventory(t.inventory, _creations(t), "seq").table


@query(
    "create_inventory_rejects",
    f"""WITH requests AS ({_CREATIONS}),
    first AS (SELECT product_id, min(seq) AS seq FROM requests
      WHERE product_id NOT IN (SELECT product_id FROM inventory) GROUP BY product_id)
    SELECT r.seq, r.product_id, r.quantity, 409 AS error_code,
      concat('Inventory already exists for product: ', CAST(r.product_id AS VARCHAR)) AS message
    FROM requests r LEFT JOIN first f USING (product_id, seq) WHERE f.seq IS NULL""",
)
def create_inventory_rejects(t: Tables) -> DataFrame:
    return inventory.create_inventory(t.inventory, _creations(t), "seq").rejects


_SETTINGS = "SELECT seq, seq >> 3 AS product_id, quantity FROM cart_events"


@query(
    "set_stock",
    f"""WITH changes AS ({_SETTINGS}),
    last AS (SELECT product_id, max_by(quantity, seq) AS quantity FROM changes GROUP BY product_id)
    SELECT i.id, i.product_id, coalesce(l.quantity, i.quantity) AS quantity, i.reserved
    FROM inventory i LEFT JOIN last l USING (product_id)""",
)
def set_stock(t: Tables) -> DataFrame:
    changes = t.cart_events.select("seq", F.shiftright("seq", 3).alias("product_id"), "quantity")
    return inventory.set_stock(t.inventory, changes, "seq").table


@query(
    "increase_stock",
    """WITH added AS (SELECT product_id, sum(quantity) AS added FROM order_items GROUP BY product_id)
    SELECT i.id, i.product_id, CAST(i.quantity + coalesce(a.added, 0) AS INT) AS quantity, i.reserved
    FROM inventory i LEFT JOIN added a USING (product_id)""",
)
def increase_stock(t: Tables) -> DataFrame:
    return inventory.increase_stock(
        t.inventory, t.lines_t.select("product_id", "quantity")
    ).table


@query(
    "increase_stock_rejects",
    """SELECT o.order_id, o.product_id, 404 AS error_code,
      concat('Inventory not found for product: ', CAST(o.product_id AS VARCHAR)) AS message
    FROM order_items o WHERE product_id NOT IN (SELECT product_id FROM inventory)""",
)
def increase_stock_rejects(t: Tables) -> DataFrame:
    changes = t.lines_t.select("order_id", "product_id", "quantity")
    return inventory.increase_stock(t.inventory, changes).rejects.drop("quantity")


@query(
    "event_items_inventory",
    """SELECT o.order_id AS event_seq, o.item_pos, o.product_id, o.quantity, i.quantity AS stock,
      i.reserved, i.id IS NOT NULL AS found
    FROM order_items o LEFT JOIN inventory i USING (product_id)""",
)
def event_items_inventory(t: Tables) -> DataFrame:
    return inventory.event_items_inventory(t.ledger_lines, t.inventory)
