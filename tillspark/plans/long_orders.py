"""Queries over orders of any length: one order holds a third of all lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillspark import schemas
from tillspark.functions.codec import decode_events
from tillspark.functions.pages import event_lines, first_pages, split_arrived, with_places
from tillspark.operators import notifications, orders, payments
from tillspark.operators.ledger import stock_ledger
from tillspark.operators.validate import validate_orders
from tillspark.plans.orders import AS_OF
from tillspark.plans.registry import query
from tillspark.plans.stock import LINES_SQL, ledger_sql
from tillspark.session import materialize
from tillspark.sources.standins import Tables, payment_topic
from tillspark.sources.topics import topic_rows


def _made(t: Tables) -> orders.NewOrders:
    heads = t.long_orders.withColumnRenamed("id", "request_id")
    lines = t.long_items.withColumnRenamed("order_id", "request_id")
    return orders.new_order_rows(validate_orders(heads, lines).valid, lines, F.lit(AS_OF))


_MADE = """made AS (SELECT row_number() OVER (ORDER BY o.id) AS id, o.id AS request_id, any_value(o.customer_id) AS customer_id,
    CAST(sum(i.unit_price * i.quantity) AS DECIMAL(18,2)) AS total_amount
  FROM long_orders o JOIN long_items i ON i.order_id = o.id GROUP BY o.id)"""


@query(
    "long_order_rows",
    f"""WITH {_MADE} SELECT id, request_id, customer_id, 'PENDING' AS status, total_amount,
      TIMESTAMP '{AS_OF}' AS created_at FROM made""",
)
def long_order_rows(t: Tables) -> DataFrame:
    """One order, id and total per request."""
    return _made(t).orders


@query(
    "long_order_items",
    f"""WITH {_MADE} SELECT m.id AS order_id, i.item_pos, i.product_id, i.quantity, i.unit_price
    FROM made m JOIN long_items i ON i.order_id = m.request_id""",
)
def long_order_items(t: Tables) -> DataFrame:
    return _made(t).items


def _placed(t: Tables) -> DataFrame:
    """The placed events of the long orders, as decoded topic rows."""
    made = _made(t)
    items = materialize(made.items, "long-made")  # pages, counts and orders without lines each read them
    topic = topic_rows(orders.order_placed_events(made.orders.drop("request_id"), items), F.col("event_seq"))
    return decode_events(topic, schemas.ORDER_PLACED).valid


@query(
    "long_placed_events",
    f"WITH {_MADE} SELECT id AS event_seq, id AS order_id, customer_id, total_amount FROM made",
)
def long_placed_events(t: Tables) -> DataFrame:
    """The events, put together from their pages."""
    arrived = split_arrived(with_places(_placed(t)))
    return first_pages(arrived.whole).select(
        "event_seq", F.col("event.orderId").alias("order_id"), F.col("event.customerId").alias("customer_id"),
        F.col("event.totalAmount").alias("total_amount"),
    )


@query(
    "long_placed_lines",
    f"""WITH {_MADE} SELECT m.id AS event_seq, i.item_pos, i.product_id, i.quantity, i.unit_price
    FROM made m JOIN long_items i ON i.order_id = m.request_id""",
)
def long_placed_lines(t: Tables) -> DataFrame:
    """The lines of the events, numbered over all pages."""
    item = F.col("_item")
    return event_lines(
        with_places(_placed(t)), item["productId"].alias("product_id"), item["quantity"].alias("quantity"), item["unitPrice"].alias("unit_price")
    )


@query(
    "long_order_confirmations",
    f"""WITH {_MADE} SELECT 'ORDER_CONFIRMATION' AS kind, id AS order_id, customer_id,
      concat('Sending order confirmation - orderId: ', CAST(id AS VARCHAR), ', customerId: ', CAST(customer_id AS VARCHAR)) AS text
    FROM made""",
)
def long_order_confirmations(t: Tables) -> DataFrame:
    """One notice per order, however many pages."""
    return notifications.order_confirmations(_placed(t))


def _payments(t: Tables) -> tuple[DataFrame, DataFrame]:
    """One payment per long order that has lines, and its items as stored texts."""
    counted = t.long_items.groupBy("order_id").agg(
        F.count("*").alias("item_count"), F.sum(orders.line_amount()).alias("amount")
    )
    requests = t.long_orders.withColumnRenamed("id", "order_id").join(counted, "order_id")
    made = payments.new_payment_rows(requests, F.lit(AS_OF))
    session = F.concat(F.lit("sess_"), F.col("order_id").cast("string"))
    return made.withColumn("stripe_session_id", session), payments.item_texts(t.long_items)


_PAID = """paid_long AS (SELECT row_number() OVER (ORDER BY o.id) AS id, o.id AS order_id, any_value(o.customer_id) AS customer_id,
    CAST(sum(i.unit_price * i.quantity) AS DECIMAL(18,2)) AS amount, count(*) AS item_count
  FROM long_orders o JOIN long_items i ON i.order_id = o.id GROUP BY o.id)"""


@query(
    "long_payment_rows",
    f"WITH {_PAID} SELECT id, order_id, customer_id, amount, 'PENDING' AS status, item_count FROM paid_long",
)
def long_payment_rows(t: Tables) -> DataFrame:
    """One payment of the full amount per order."""
    return _payments(t)[0].select("id", "order_id", "customer_id", "amount", "status", "item_count")


@query(
    "long_payment_lines",
    f"""WITH {_PAID} SELECT p.id AS event_seq, i.item_pos, i.product_id, i.quantity
    FROM paid_long p JOIN long_items i ON i.order_id = p.order_id""",
)
def long_payment_lines(t: Tables) -> DataFrame:
    """Every payment completed once: the lines that its published event brings."""
    stored, texts = _payments(t)
    matched = stored.select(
        F.col("id").alias("event_seq"), F.lit("COMPLETED").alias("status"), F.col("stripe_session_id").alias("session_id"),
        "order_id", "customer_id", "item_count",
    )
    topic = topic_rows(payments.payment_events(matched, texts), F.col("event_seq"))
    decoded = decode_events(topic, schemas.PAYMENT_EVENT).valid
    return event_lines(with_places(decoded), F.col("_item.productId").alias("product_id"), F.col("_item.quantity"))


_LONG_LEDGER = ledger_sql(True, LINES_SQL, "long_items")


@query("long_stock_ledger", _LONG_LEDGER)
def long_stock_ledger(t: Tables) -> DataFrame:
    """The ledger over events out of a paged topic; the long one fails as a whole from its first failure on."""
    totals = t.long_items.groupBy(F.col("order_id").alias("id")).agg(F.sum(orders.line_amount()).alias("total_amount"))
    topic = payment_topic(t.long_orders.join(totals, "id"), t.long_items)
    decoded = split_arrived(with_places(decode_events(topic, schemas.PAYMENT_EVENT).valid)).whole
    lines = event_lines(decoded, F.col("_item.productId").alias("product_id"), F.col("_item.quantity"))
    return stock_ledger(t.inventory, materialize(lines, "long-lines")).lines  # read several times
