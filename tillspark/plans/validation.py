"""Validation queries: valid rows, and rejects with their messages as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillspark import schemas
from tillspark.functions.codec import encode
from tillspark.functions.pages import PAGE_ITEMS
from tillspark.operators import binding, orders, rejects, validate
from tillspark.plans.registry import query
from tillspark.sources.standins import Tables


def _error_text(checked: validate.Checked | binding.Bound) -> DataFrame:
    """The error map as sorted `field: message` text."""
    entries = F.transform(
        F.array_sort(F.map_entries("errors")),
        lambda e: F.concat(e["key"], F.lit(": "), e["value"]),
    )
    return checked.rejects.withColumn("errors", F.array_join(entries, "; "))


_BLANK = "({0} IS NULL OR regexp_full_match({0}, '\\s*'))"
_PRODUCT_ERRORS = f"""concat_ws('; ',
  CASE WHEN {_BLANK.format("brand")} THEN 'brand: Brand is required' END,
  CASE WHEN category IS NULL THEN 'category: Category is required' END,
  CASE WHEN {_BLANK.format("name")} THEN 'name: Name is required' END,
  CASE WHEN price IS NULL THEN 'price: Price is required'
    WHEN price < 0 THEN 'price: Price must be positive' END)"""


@query("validate_products", f"SELECT * FROM product_requests WHERE {_PRODUCT_ERRORS} = ''")
def validate_products(t: Tables) -> DataFrame:
    return validate.validate_products(t.product_requests).valid


@query(
    "validate_products_rejects",
    f"""SELECT request_id, {_PRODUCT_ERRORS} AS errors, 400 AS error_code
    FROM product_requests WHERE {_PRODUCT_ERRORS} <> ''""",
)
def validate_products_rejects(t: Tables) -> DataFrame:
    checked = validate.validate_products(t.product_requests)
    return _error_text(checked).select("request_id", "errors", "error_code")


def _request_lines(t: Tables) -> DataFrame:
    """Request lines where some lack their price or have no quantity."""
    return t.request_lines.select(
        "request_id",
        "item_pos",
        F.when(F.col("product_id") % 29 != 0, F.col("product_id")).alias("product_id"),
        F.when(F.col("quantity") == 49, F.lit(0))
        .when(F.col("quantity") != 48, F.col("quantity"))
        .alias("quantity"),
        F.when(F.col("quantity") != 50, F.col("unit_price")).alias("unit_price"),
    )


_ORDER_REQUESTS = """requests AS (SELECT id AS request_id,
    CASE WHEN id % 11 <> 0 THEN customer_id END AS customer_id FROM orders_t),
  entries AS (SELECT order_id AS request_id, item_pos,
    CASE WHEN product_id % 29 <> 0 THEN product_id END AS product_id,
    CASE WHEN quantity = 49 THEN 0 WHEN quantity <> 48 THEN quantity END AS quantity,
    CASE WHEN quantity <> 50 THEN unit_price END AS unit_price FROM order_items),
  messages AS (
    SELECT request_id, item_pos, concat('items[', CAST(item_pos - 1 AS VARCHAR), '].', field) AS field, message FROM (
      SELECT *, 'productId' AS field, 'Product ID is required' AS message FROM entries WHERE product_id IS NULL
      UNION ALL SELECT *, 'quantity', 'Quantity is required' FROM entries WHERE quantity IS NULL
      UNION ALL SELECT *, 'quantity', 'Quantity must be at least 1' FROM entries WHERE quantity < 1
      UNION ALL SELECT *, 'unitPrice', 'Unit price is required' FROM entries WHERE unit_price IS NULL)),
  per_request AS (SELECT request_id, count(*) AS n,
    bool_or(unit_price IS NULL OR quantity IS NULL) AS broken,
    count(CASE WHEN product_id IS NULL OR quantity IS NULL OR quantity < 1 OR unit_price IS NULL THEN 1 END) AS wrong
    FROM entries GROUP BY request_id),
  marked AS (SELECT r.*, coalesce(e.n, 0) AS n, coalesce(e.broken, false) AS broken, coalesce(e.wrong, 0) AS wrong
    FROM requests r LEFT JOIN per_request e USING (request_id))"""


@query(
    "validate_orders",
    f"""WITH {_ORDER_REQUESTS} SELECT request_id, customer_id, CAST(n AS INT) AS items
    FROM marked WHERE customer_id IS NOT NULL AND n > 0 AND NOT broken""",
)
def validate_orders(t: Tables) -> DataFrame:
    return validate.validate_orders(t.request_heads, _request_lines(t), count="items").valid


@query(
    "validate_orders_rejects",
    f"""WITH {_ORDER_REQUESTS} SELECT request_id,
      CASE WHEN customer_id IS NULL OR n = 0 THEN concat_ws('; ',
        CASE WHEN customer_id IS NULL THEN 'customerId: Customer ID is required' END,
        CASE WHEN n = 0 THEN 'items: Order must have at least one item' END) END AS errors,
      CASE WHEN customer_id IS NULL OR n = 0 THEN 400 ELSE 500 END AS error_code
    FROM marked WHERE customer_id IS NULL OR n = 0 OR broken""",
)
def validate_orders_rejects(t: Tables) -> DataFrame:
    checked = validate.validate_orders(t.request_heads, _request_lines(t))
    return _error_text(checked).select("request_id", "errors", "error_code")


@query(
    "validate_orders_strict",
    f"""WITH {_ORDER_REQUESTS} SELECT request_id, concat_ws('; ',
        CASE WHEN customer_id IS NULL THEN 'customerId: Customer ID is required' END,
        CASE WHEN n = 0 THEN 'items: Order must have at least one item'
          WHEN wrong > 0 THEN concat('items: ', CAST(wrong AS VARCHAR), ' lines are not valid') END) AS errors,
      400 AS error_code
    FROM marked WHERE customer_id IS NULL OR n = 0 OR wrong > 0""",
)
def validate_orders_strict(t: Tables) -> DataFrame:
    """What the declared line rules would reject as well, if they were in force."""
    checked = validate.validate_orders(t.request_heads, _request_lines(t), strict_items=True)
    return _error_text(checked).select("request_id", "errors", "error_code")


@query(
    "validate_order_items",
    f"""WITH {_ORDER_REQUESTS}, found AS (
      SELECT request_id, (item_pos - 1) // {PAGE_ITEMS} AS page, concat(field, ': ', message) AS error FROM messages
      UNION ALL SELECT request_id, 0, 'customerId: Customer ID is required' FROM marked WHERE customer_id IS NULL
      UNION ALL SELECT request_id, 0, 'items: Order must have at least one item' FROM marked WHERE n = 0)
    SELECT request_id, page, string_agg(error, '; ' ORDER BY error) AS errors, 400 AS error_code
    FROM found GROUP BY request_id, page""",
)
def validate_order_items(t: Tables) -> DataFrame:
    """All errors of a request, its own and those of its lines."""
    return validate.request_errors(t.request_heads, _request_lines(t))


_PAYMENT_ERRORS = """concat_ws('; ',
  CASE WHEN amount IS NULL THEN 'amount: Amount is required'
    WHEN amount <= 0 THEN 'amount: Amount must be positive' END,
  CASE WHEN customer_id IS NULL THEN 'customerId: Customer ID is required' END,
  CASE WHEN order_id IS NULL THEN 'orderId: Order ID is required' END)"""


@query("validate_payments", f"SELECT * FROM payment_requests WHERE {_PAYMENT_ERRORS} = ''")
def validate_payments(t: Tables) -> DataFrame:
    return validate.validate_payments(t.payment_requests).valid


@query(
    "validate_payments_rejects",
    f"""SELECT *, {_PAYMENT_ERRORS} AS errors, 400 AS error_code
    FROM payment_requests WHERE {_PAYMENT_ERRORS} <> ''""",
)
def validate_payments_rejects(t: Tables) -> DataFrame:
    return _error_text(validate.validate_payments(t.payment_requests))


_STOCK_ERRORS = """concat_ws('; ',
  CASE WHEN product_id IS NULL THEN 'productId: Product ID is required' END,
  CASE WHEN quantity IS NULL THEN 'quantity: Quantity is required'
    WHEN quantity < 0 THEN 'quantity: Quantity cannot be negative' END)"""


@query("validate_inventory", f"SELECT * FROM stock_requests WHERE {_STOCK_ERRORS} = ''")
def validate_inventory(t: Tables) -> DataFrame:
    return validate.validate_inventory(t.stock_requests).valid


@query(
    "validate_inventory_rejects",
    f"""SELECT *, {_STOCK_ERRORS} AS errors, 400 AS error_code
    FROM stock_requests WHERE {_STOCK_ERRORS} <> ''""",
)
def validate_inventory_rejects(t: Tables) -> DataFrame:
    return _error_text(validate.validate_inventory(t.stock_requests))


@query(
    "unique_key_check",
    """WITH counted AS (SELECT product_id, count(*) AS new_rows FROM stock_requests
      WHERE product_id IS NOT NULL GROUP BY product_id)
    SELECT product_id, new_rows, 409 AS error_code, 'duplicate key' AS message FROM counted
    WHERE new_rows > 1 OR product_id IN (SELECT product_id FROM inventory)""",
)
def unique_key_check(t: Tables) -> DataFrame:
    rows = t.stock_requests.filter("product_id IS NOT NULL")
    return validate.unique_key_check(rows, "product_id", t.inventory)


@query(
    "not_null_check",
    """SELECT product_id, quantity, reserved, concat_ws(',', CASE WHEN product_id IS NULL THEN 'product_id' END,
      CASE WHEN quantity IS NULL THEN 'quantity' END) AS missing
    FROM (SELECT product_id, quantity, 0 AS reserved FROM stock_requests)
    WHERE product_id IS NULL OR quantity IS NULL""",
)
def not_null_check(t: Tables) -> DataFrame:
    rows = t.stock_requests.select("product_id", "quantity", F.lit(0).alias("reserved"))
    return validate.not_null_check(rows, "inventory")


_REASON = """CASE event_type WHEN 'view' THEN 'NOT_FOUND' WHEN 'click' THEN 'CONFLICT'
  WHEN 'signup' THEN 'INVALID' WHEN 'purchase' THEN 'PROVIDER' ELSE 'BROKEN' END"""


@query(
    "error_code",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 404 WHEN 'click' THEN 409 WHEN 'signup' THEN 400
        WHEN 'purchase' THEN 502 ELSE 500 END AS error_code,
      CASE event_type WHEN 'purchase' THEN concat('Stripe error: ', props)
        WHEN 'error' THEN 'An unexpected error occurred' ELSE props END AS message
    FROM events""",
)
def error_code(t: Tables) -> DataFrame:
    reasons = t.raw("events").withColumn("reason", F.expr(_REASON))
    return reasons.select(
        "event_id",
        rejects.error_code("reason").alias("error_code"),
        rejects.error_message("reason", "props").alias("message"),
    )


# Product requests as they come in: every sixth category and every 23rd price does not fit, every 31st body is broken.
_FITS = "p_partkey % 31 <> 0 AND p_partkey % 6 <> 0 AND p_partkey % 23 <> 0"


def _bodies(t: Tables) -> binding.Bound:
    key, price = F.col("p_partkey"), F.col("p_retailprice").cast(schemas.MONEY).cast("string")
    body = encode(
        F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.when(key % 6 == 0, F.lower("p_type")).otherwise(F.lit("DECK")).alias("category"),
        F.when(key % 23 == 0, F.lit("cheap")).otherwise(price).alias("price"), F.col("p_size").alias("width"),
    )
    bodies = t.raw("part").select(
        key.alias("request_id"), F.when(key % 31 == 0, F.lit('{"name":')).otherwise(body).alias("body")
    )
    return binding.bind_requests(bodies, binding.PRODUCT_REQUEST)


@query(
    "bind_product_requests",
    f"""SELECT p_partkey AS request_id, p_name AS name, p_brand AS brand, 'DECK' AS category,
      CAST(p_retailprice AS DECIMAL(18,2)) AS price, CAST(NULL AS VARCHAR) AS description,
      CAST(NULL AS VARCHAR) AS image_url, CAST(p_size AS DOUBLE) AS width FROM part WHERE {_FITS}""",
)
def bind_product_requests(t: Tables) -> DataFrame:
    return _bodies(t).valid


@query(
    "bind_product_requests_rejects",
    """SELECT p_partkey AS request_id, CASE WHEN p_partkey % 31 = 0 THEN 'body: Malformed request body'
      ELSE concat_ws('; ', CASE WHEN p_partkey % 6 = 0 THEN concat('category: Not valid: ', lower(p_type)) END,
        CASE WHEN p_partkey % 23 = 0 THEN 'price: Not valid: cheap' END) END AS errors, 400 AS error_code
    FROM part WHERE p_partkey % 31 = 0 OR p_partkey % 6 = 0 OR p_partkey % 23 = 0""",
)
def bind_product_requests_rejects(t: Tables) -> DataFrame:
    return _error_text(_bodies(t))


def _status_bodies(t: Tables) -> binding.Bound:
    """Every tenth status is written in small letters, which is no status."""
    name = F.when(F.col("seq") % 10 == 0, F.lower("status")).otherwise(F.col("status"))
    body = encode(F.col("order_id").alias("orderId"), name.alias("status"))
    return binding.bind_requests(t.status_changes.select("seq", body.alias("body")), binding.STATUS_REQUEST)


@query(
    "bind_status_requests",
    """WITH last AS (SELECT order_id, max_by(status, seq) AS status FROM status_changes WHERE seq % 10 <> 0 GROUP BY order_id)
    SELECT o.id, o.customer_id, coalesce(l.status, o.status) AS status, o.total_amount, o.created_at
    FROM orders_t o LEFT JOIN last l ON l.order_id = o.id""",
)
def bind_status_requests(t: Tables) -> DataFrame:
    """Status changes out of request bodies; a name that is no status changes nothing."""
    return orders.set_order_status(t.orders_t, _status_bodies(t).valid).table


@query(
    "bind_status_requests_rejects",
    "SELECT seq, concat('status: Not valid: ', lower(status)) AS errors, 400 AS error_code FROM status_changes WHERE seq % 10 = 0",
)
def bind_status_requests_rejects(t: Tables) -> DataFrame:
    return _error_text(_status_bodies(t))
