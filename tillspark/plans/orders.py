"""Order queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillspark import schemas
from tillspark.functions.pages import PAGE_ITEMS
from tillspark.functions.positions import largest_id
from tillspark.operators import lookups, orders
from tillspark.operators.validate import validate_orders
from tillspark.plans.registry import query
from tillspark.session import scratch_path
from tillspark.sources import tables
from tillspark.sources.standins import Tables, stored
from tillspark.sources.topics import read_topic, topic_rows, write_topic

AS_OF = "2024-06-01 00:00:00"
# Nested lines as the text that both engines can print alike.
_EVENT_ITEM = """concat('{"productId":', CAST(product_id AS VARCHAR), ',"quantity":', CAST(quantity AS VARCHAR),
  ',"unitPrice":', CAST(unit_price AS VARCHAR), '}')"""
PLACED_SQL = f"""WITH lists AS (SELECT order_id, concat('[', string_agg({_EVENT_ITEM}, ',' ORDER BY item_pos), ']') AS items
    FROM order_items GROUP BY order_id)
  SELECT o.id, CAST(o.id AS VARCHAR) AS key, concat('{{"orderId":', CAST(o.id AS VARCHAR),
    ',"customerId":', CAST(o.customer_id AS VARCHAR), ',"totalAmount":', CAST(o.total_amount AS VARCHAR),
    ',"items":', coalesce(l.items, '[]'), '}}') AS value
  FROM orders_t o LEFT JOIN lists l ON l.order_id = o.id"""


@query("scan_orders", "SELECT * FROM orders_t")
def scan_orders(t: Tables) -> DataFrame:
    return tables.scan_orders(t.spark, stored(t.orders_t, schemas.ORDERS))


@query(
    "scan_order_items",
    "SELECT order_id * 1000 + item_pos AS id, order_id, product_id, quantity, unit_price FROM order_items",
)
def scan_order_items(t: Tables) -> DataFrame:
    items = t.order_items.withColumn("id", F.col("order_id") * 1000 + F.col("item_pos"))
    return tables.scan_order_items(t.spark, stored(items, schemas.ORDER_ITEMS))


@query(
    "order_item_view",
    "SELECT *, CAST(unit_price * quantity AS DECIMAL(18,2)) AS subtotal FROM order_items",
)
def order_item_view(t: Tables) -> DataFrame:
    return orders.order_item_view(t.order_items)


@query(
    "order_totals",
    """SELECT o.id AS order_id, CAST(coalesce(sum(i.unit_price * i.quantity), 0) AS DECIMAL(18,2)) AS total_amount
    FROM orders_t o LEFT JOIN order_items i ON i.order_id = o.id GROUP BY o.id""",
)
def order_totals(t: Tables) -> DataFrame:
    return orders.order_totals(t.orders_t, t.lines_t)


# As a reader who asks for three lines at a time.
READER_ROWS = 3
_ITEM_TEXT = """concat('{"item_pos":', CAST(item_pos AS VARCHAR), ',"product_id":', CAST(product_id AS VARCHAR),
  ',"quantity":', CAST(quantity AS VARCHAR), ',"unit_price":', CAST(unit_price AS VARCHAR),
  ',"subtotal":', CAST(CAST(unit_price * quantity AS DECIMAL(18,2)) AS VARCHAR), '}')"""


def _lists(rows: int) -> str:
    return f"""WITH n AS (SELECT order_id, count(*) AS n FROM order_items GROUP BY order_id),
      paged AS (SELECT *, (item_pos - 1) // {rows} AS page FROM order_items)
    SELECT order_id, CAST(page AS BIGINT) AS page, CAST((any_value(n.n) + {rows} - 1) // {rows} AS BIGINT) AS pages,
      CAST(page * {rows} AS BIGINT) AS item_offset, concat('[', string_agg({_ITEM_TEXT}, ',' ORDER BY item_pos), ']') AS items
    FROM paged JOIN n USING (order_id) GROUP BY order_id, page"""


@query("order_item_lists", _lists(READER_ROWS))
def order_item_lists(t: Tables) -> DataFrame:
    return orders.order_item_lists(t.order_items, READER_ROWS).withColumn("items", F.to_json("items"))


_WITH_ITEMS = f"""SELECT o.id, o.customer_id, o.status, o.total_amount, o.created_at,
    coalesce(l.page, 0) AS page, coalesce(l.pages, 1) AS pages, coalesce(l.item_offset, 0) AS item_offset,
    coalesce(l.items, '[]') AS items
  FROM orders_t o LEFT JOIN ({_lists(PAGE_ITEMS)}) l ON l.order_id = o.id"""


@query("orders_with_items", _WITH_ITEMS)
def orders_with_items(t: Tables) -> DataFrame:
    return orders.orders_with_items(t.orders_t, t.order_items, nested=True).withColumn("items", F.to_json("items"))


@query(
    "orders_by_customer",
    f"{_WITH_ITEMS} WHERE o.customer_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def orders_by_customer(t: Tables) -> DataFrame:
    wanted = t.raw("customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("customer_id"))
    mine = orders.orders_by_customer(t.orders_t, t.order_items, wanted, nested=True)
    return mine.withColumn("items", F.to_json("items"))


@query("orders_by_status", "SELECT * FROM orders_t WHERE status = 'PENDING'")
def orders_by_status(t: Tables) -> DataFrame:
    return orders.orders_by_status(t.orders_t, "PENDING")


@query(
    "lookup_keys_orders",
    """SELECT e.event_id * 2 AS id, o.customer_id, o.status, o.id IS NOT NULL AS found,
      CASE WHEN o.id IS NULL THEN 404 END AS error_code,
      CASE WHEN o.id IS NULL THEN concat('Order not found with id: ', CAST(e.event_id * 2 AS VARCHAR)) END AS message
    FROM events e LEFT JOIN orders_t o ON o.id = e.event_id * 2""",
)
def lookup_orders(t: Tables) -> DataFrame:
    keys = t.raw("events").select((F.col("event_id") * 2).alias("id"))
    return lookups.lookup_keys(
        keys, t.orders_t.select("id", "customer_id", "status"), "id", lookups.NOT_FOUND_TEXT["order"]
    )


def created_orders(t: Tables) -> orders.NewOrders:
    valid = validate_orders(t.request_heads, t.request_lines).valid
    return orders.new_order_rows(valid, t.request_lines, F.lit(AS_OF), largest_id(t.orders_t, "id"))


CREATED = """placeable AS (SELECT o.id AS request_id, o.customer_id, i.*
    FROM orders_t o JOIN order_items i ON i.order_id = o.id WHERE o.id % 11 <> 0),
  created AS (SELECT request_id, customer_id,
      (SELECT max(id) FROM orders_t) + row_number() OVER (ORDER BY request_id) AS id,
      CAST(sum(unit_price * quantity) AS DECIMAL(18,2)) AS total_amount
    FROM placeable GROUP BY request_id, customer_id)"""


@query(
    "new_order_rows",
    f"""WITH {CREATED} SELECT id, request_id, customer_id, 'PENDING' AS status, total_amount,
      TIMESTAMP '{AS_OF}' AS created_at FROM created""",
)
def new_order_rows(t: Tables) -> DataFrame:
    return created_orders(t).orders


@query(
    "new_order_items",
    f"""WITH {CREATED} SELECT c.id AS order_id, p.item_pos, p.product_id, p.quantity, p.unit_price
    FROM created c JOIN placeable p USING (request_id)""",
)
def new_order_items(t: Tables) -> DataFrame:
    return created_orders(t).items


@query(
    "place_orders",
    f"""WITH {CREATED}, lists AS (SELECT c.id, c.customer_id, c.total_amount,
        concat('[', string_agg({_EVENT_ITEM}, ',' ORDER BY item_pos), ']') AS items
      FROM created c JOIN placeable p USING (request_id) GROUP BY c.id, c.customer_id, c.total_amount)
    SELECT CAST(id AS VARCHAR) AS key, concat('{{"orderId":', CAST(id AS VARCHAR), ',"customerId":',
      CAST(customer_id AS VARCHAR), ',"totalAmount":', CAST(total_amount AS VARCHAR), ',"items":', items, '}}') AS value
    FROM lists""",
)
def place_orders(t: Tables) -> DataFrame:
    """The events published for every valid request."""
    placed = orders.place_orders(
        t.request_heads, t.request_lines, F.lit(AS_OF), largest_id(t.orders_t, "id")
    )
    return placed.events.select("key", "value")


@query("order_placed_events", f"SELECT key, value FROM ({PLACED_SQL})")
def order_placed_events(t: Tables) -> DataFrame:
    return orders.order_placed_events(t.orders_t, t.order_items).select("key", "value")


@query(
    "order_cancelled_events",
    """SELECT CAST(id AS VARCHAR) AS key, concat('{"orderId":', CAST(id AS VARCHAR), ',"customerId":',
      CAST(customer_id AS VARCHAR), '}') AS value FROM orders_t WHERE status = 'CANCELLED'""",
)
def order_cancelled_events(t: Tables) -> DataFrame:
    return orders.order_cancelled_events(t.orders_t.filter("status = 'CANCELLED'"))


def placed_topic(t: Tables) -> DataFrame:
    events = orders.order_placed_events(t.orders_t, t.order_items)
    return topic_rows(events, F.col("event_seq"))


@query("write_topic", f"SELECT id AS seq, key, value FROM ({PLACED_SQL})")
def written_topic(t: Tables) -> DataFrame:
    """Published rows, read back from the topic's folder."""
    folder = scratch_path(t.spark, "topic")
    write_topic(placed_topic(t), folder)
    return read_topic(t.spark, folder, streaming=False).drop("at")


@query("read_topic", f"SELECT id AS seq, key, value FROM ({PLACED_SQL})")
def streamed_topic(t: Tables) -> DataFrame:
    """A topic copied to another one by a stream, raw text unchanged."""
    source, target = scratch_path(t.spark, "topic"), scratch_path(t.spark, "topic")
    write_topic(placed_topic(t), source)
    copy = write_topic(read_topic(t.spark, source), target, scratch_path(t.spark, "offsets"))
    copy.awaitTermination()
    return read_topic(t.spark, target, streaming=False).drop("at")


@query(
    "set_order_status",
    """WITH last AS (SELECT order_id, max_by(status, seq) AS status FROM status_changes GROUP BY order_id)
    SELECT o.id, o.customer_id, coalesce(l.status, o.status) AS status, o.total_amount, o.created_at
    FROM orders_t o LEFT JOIN last l ON l.order_id = o.id""",
)
def set_order_status(t: Tables) -> DataFrame:
    return orders.set_order_status(t.orders_t, t.status_changes).table


@query(
    "set_order_status_rejects",
    """SELECT seq, order_id, 404 AS error_code,
      concat('Order not found with id: ', CAST(order_id AS VARCHAR)) AS message
    FROM (SELECT seq, seq * 2 AS order_id FROM status_changes)
    WHERE order_id NOT IN (SELECT id FROM orders_t)""",
)
def set_order_status_rejects(t: Tables) -> DataFrame:
    changes = t.status_changes.withColumn("order_id", F.col("seq") * 2)
    return orders.set_order_status(t.orders_t, changes).rejects.drop("status")


def _cancels(t: Tables) -> DataFrame:
    return t.status_changes.filter("status = 'CANCELLED'").select("order_id")


@query(
    "cancel_orders",
    """SELECT id, customer_id, CASE WHEN id IN (SELECT order_id FROM status_changes WHERE status = 'CANCELLED')
      THEN 'CANCELLED' ELSE status END AS status, total_amount, created_at FROM orders_t""",
)
def cancel_orders(t: Tables) -> DataFrame:
    return orders.cancel_orders(t.orders_t, _cancels(t)).orders


@query(
    "cancel_orders_events",
    """SELECT CAST(o.id AS VARCHAR) AS key, concat('{"orderId":', CAST(o.id AS VARCHAR), ',"customerId":',
      CAST(o.customer_id AS VARCHAR), '}') AS value
    FROM status_changes c JOIN orders_t o ON o.id = c.order_id WHERE c.status = 'CANCELLED'""",
)
def cancel_orders_events(t: Tables) -> DataFrame:
    return orders.cancel_orders(t.orders_t, _cancels(t)).events


# Payment events over twice the range of order ids, so that some orders are unknown.
PAID_SQL = """SELECT seq, seq * 2 AS order_id, CASE status WHEN 'PAID' THEN 'COMPLETED'
  WHEN 'CANCELLED' THEN 'FAILED' ELSE 'OTHER' END AS status FROM status_changes"""


def paid_events(t: Tables) -> DataFrame:
    return t.status_changes.select(
        "seq",
        (F.col("seq") * 2).alias("order_id"),
        F.when(F.col("status") == "PAID", "COMPLETED")
        .when(F.col("status") == "CANCELLED", "FAILED")
        .otherwise("OTHER")
        .alias("status"),
    )


_ROUTED = "CASE status WHEN 'COMPLETED' THEN 'PAID' WHEN 'FAILED' THEN 'CANCELLED' END"


@query(
    "route_payment_status",
    f"SELECT seq, order_id, status, {_ROUTED} AS new_status FROM ({PAID_SQL})",
)
def route_payment_status(t: Tables) -> DataFrame:
    return paid_events(t).withColumn("new_status", orders.route_payment_status("status"))


@query(
    "payment_event_orders",
    f"""SELECT e.seq, e.order_id, e.status, e.new_status, o.status AS old_status
    FROM (SELECT *, {_ROUTED} AS new_status FROM ({PAID_SQL})) e JOIN orders_t o ON o.id = e.order_id
    WHERE e.new_status IS NOT NULL""",
)
def payment_event_orders(t: Tables) -> DataFrame:
    return orders.payment_event_orders(paid_events(t), t.orders_t).table


@query(
    "payment_event_orders_rejects",
    f"""SELECT seq, order_id, 404 AS error_code, concat('Order not found: ', CAST(order_id AS VARCHAR)) AS message
    FROM ({PAID_SQL}) WHERE status <> 'OTHER' AND order_id NOT IN (SELECT id FROM orders_t)""",
)
def payment_event_orders_rejects(t: Tables) -> DataFrame:
    rejects = orders.payment_event_orders(paid_events(t), t.orders_t).rejects
    return rejects.drop("status", "new_status")


@query(
    "apply_payment_status",
    f"""WITH last AS (SELECT order_id, max_by({_ROUTED}, seq) AS status FROM ({PAID_SQL})
      WHERE status <> 'OTHER' GROUP BY order_id)
    SELECT o.id, o.customer_id, coalesce(l.status, o.status) AS status, o.total_amount, o.created_at
    FROM orders_t o LEFT JOIN last l ON l.order_id = o.id""",
)
def apply_payment_status(t: Tables) -> DataFrame:
    return orders.apply_payment_status(t.orders_t, paid_events(t)).table
