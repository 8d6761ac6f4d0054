"""Payment and webhook queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillspark import schemas
from tillspark.functions import codec
from tillspark.functions.positions import largest_id
from tillspark.operators import lookups, payments
from tillspark.operators.validate import validate_payments
from tillspark.plans.orders import AS_OF
from tillspark.plans.registry import query
from tillspark.sources import tables
from tillspark.sources.standins import Tables, stored

_VIEW = """SELECT id, order_id, customer_id, amount, status, stripe_session_id,
  CAST(NULL AS VARCHAR) AS checkout_url, created_at FROM payments"""


@query(
    "scan_payments",
    """SELECT id, order_id, customer_id, amount, status, stripe_session_id, CAST(NULL AS VARCHAR) AS stripe_payment_intent_id,
      item_count, created_at, updated_at FROM paid""",
)
def scan_payments(t: Tables) -> DataFrame:
    return tables.scan_payments(t.spark, stored(t.paid, schemas.PAYMENTS))


@query("payment_view", _VIEW)
def payment_view(t: Tables) -> DataFrame:
    return payments.payment_view(t.payments)


@query(
    "payments_by_customer",
    f"{_VIEW} WHERE customer_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def payments_by_customer(t: Tables) -> DataFrame:
    wanted = t.raw("customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("customer_id"))
    return payments.payments_by_customer(t.payments, wanted)


@query("payments_by_status", "SELECT * FROM payments WHERE status = 'PENDING'")
def payments_by_status(t: Tables) -> DataFrame:
    return payments.payments_by_status(t.payments, "PENDING")


@query(
    "lookup_keys_payment_by_order",
    """SELECT o.id AS order_id, p.amount, p.status, p.id IS NOT NULL AS found,
      CASE WHEN p.id IS NULL THEN 404 END AS error_code,
      CASE WHEN p.id IS NULL THEN concat('Payment not found for order: ', CAST(o.id AS VARCHAR)) END AS message
    FROM orders_t o LEFT JOIN payments p ON p.order_id = o.id""",
)
def lookup_payment_by_order(t: Tables) -> DataFrame:
    return lookups.lookup_keys(
        t.orders_t.select(F.col("id").alias("order_id")),
        t.payments.select("order_id", "amount", "status"),
        "order_id",
        lookups.NOT_FOUND_TEXT["payment_by_order"],
    )


@query(
    "lookup_keys_payment_by_session",
    """SELECT w.session_id AS stripe_session_id, p.order_id, p.id IS NOT NULL AS found,
      CASE WHEN p.id IS NULL THEN 404 END AS error_code,
      CASE WHEN p.id IS NULL THEN concat('Payment not found for session: ', w.session_id) END AS message
    FROM webhook_events w LEFT JOIN payments p ON p.stripe_session_id = w.session_id
    WHERE w.session_id IS NOT NULL""",
)
def lookup_payment_by_session(t: Tables) -> DataFrame:
    keys = t.webhook_events.filter("session_id IS NOT NULL").select(
        F.col("session_id").alias("stripe_session_id")
    )
    return lookups.lookup_keys(
        keys,
        t.payments.select("stripe_session_id", "order_id"),
        "stripe_session_id",
        lookups.NOT_FOUND_TEXT["payment_by_session"],
    )


# The page of a payment's items text; a payment without items has an empty one.
_TEXT_PAGE = """coalesce(t.page, 0) AS page, coalesce(t.pages, 1) AS pages,
  coalesce(t.item_offset, 0) AS item_offset, t.items_json"""


@query(
    "new_payment_rows",
    f"""WITH payable AS (SELECT r.order_id, r.customer_id, r.amount, n.item_count FROM payment_requests r
      LEFT JOIN (SELECT order_id, count(*) AS item_count FROM lines_t GROUP BY order_id) n ON n.order_id = r.order_id
      WHERE r.order_id IS NOT NULL AND r.customer_id IS NOT NULL AND r.amount > 0)
    SELECT p.*, {_TEXT_PAGE} FROM (SELECT (SELECT max(id) FROM payments) + row_number() OVER (ORDER BY order_id) AS id,
      order_id, customer_id, amount, 'PENDING' AS status, CAST(NULL AS VARCHAR) AS stripe_session_id,
      CAST(NULL AS VARCHAR) AS stripe_payment_intent_id, item_count,
      TIMESTAMP '{AS_OF}' AS created_at, CAST(NULL AS TIMESTAMP) AS updated_at FROM payable) p
    LEFT JOIN payment_pages t ON t.order_id = p.order_id""",
)
def new_payment_rows(t: Tables) -> DataFrame:
    valid = validate_payments(t.payment_requests).valid
    counted = t.lines_t.groupBy("order_id").agg(F.count("*").alias("item_count"))
    made = payments.new_payment_rows(
        valid.join(counted, "order_id", "left"), F.lit(AS_OF), largest_id(t.payments, "id")
    )
    return payments.with_item_texts(made, t.payment_texts)


@query("payment_item_texts", "SELECT order_id, items_json FROM payment_items")
def payment_item_texts(t: Tables) -> DataFrame:
    return t.payment_texts.select("order_id", "items_json")


@query(
    "checkout_lines",
    """SELECT order_id, CAST(trunc(amount * 100) AS BIGINT) AS unit_amount, 'eur' AS currency,
      concat('Order #', CAST(order_id AS VARCHAR)) AS name, CAST(1 AS BIGINT) AS quantity,
      concat('{"orderId":"', CAST(order_id AS VARCHAR), '","paymentId":"', CAST(id AS VARCHAR), '"}') AS metadata
    FROM payments""",
)
def checkout_lines(t: Tables) -> DataFrame:
    return payments.checkout_lines(t.payments).withColumn("metadata", F.to_json("metadata"))


# The provider's answer for every urgent or high-priority order.
_SESSIONS = """SELECT o_orderkey AS order_id, concat('cs_', CAST(o_orderkey AS STRING)) AS session_id,
  concat('https://pay.example/', CAST(o_orderkey AS STRING)) AS url
  FROM {orders} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"""


def _sessions(t: Tables) -> DataFrame:
    return t.spark.sql(_SESSIONS, orders=t.raw("orders"))


@query(
    "checkout_results",
    f"""SELECT s.order_id, s.session_id, s.url AS checkout_url
    FROM payments p JOIN ({_SESSIONS.format(orders="orders")}) s ON s.order_id = p.order_id""",
)
def checkout_results(t: Tables) -> DataFrame:
    return payments.checkout_results(t.payments, _sessions(t))


@query(
    "attach_session",
    f"""SELECT p.* REPLACE (coalesce(s.session_id, p.stripe_session_id) AS stripe_session_id)
    FROM payments p LEFT JOIN ({_SESSIONS.format(orders="orders")}) s ON s.order_id = p.order_id""",
)
def attach_session(t: Tables) -> DataFrame:
    return payments.attach_session(t.payments, _sessions(t))


@query(
    "route_webhook_type",
    """SELECT CASE type WHEN 'checkout.session.completed' THEN 'completed'
      WHEN 'checkout.session.expired' THEN 'expired' ELSE 'other' END AS route, count(*) AS events
    FROM webhook_events GROUP BY 1""",
)
def route_webhook_type(t: Tables) -> DataFrame:
    route = payments.route_webhook_type("type").alias("route")
    return t.webhook_events.groupBy(route).agg(F.count("*").alias("events"))


_SESSION_ID = """coalesce(session_id, CASE WHEN type = 'checkout.session.completed'
  AND json_valid(raw) THEN json_extract_string(raw, '$.id') END)"""


@query(
    "session_id_from_event",
    f"SELECT event_seq, type, {_SESSION_ID} AS session_id FROM webhook_events",
)
def session_id_from_event(t: Tables) -> DataFrame:
    found = codec.session_id(F.col("type"), F.col("session_id"), F.col("raw"))
    return t.webhook_events.select("event_seq", "type", found.alias("session_id"))


@query(
    "parse_items_json",
    """SELECT p.id, i.item_pos, i.product_id, i.quantity
    FROM payments p JOIN order_items i ON i.order_id = p.order_id""",
)
def parse_items_json(t: Tables) -> DataFrame:
    """Items text back to lines."""
    lines = payments.items_of_texts(t.payment_texts)
    return t.payments.select("id", "order_id").join(lines, "order_id").drop("order_id")


_HANDLED = f"""handled AS (SELECT event_seq, ts, type, {_SESSION_ID} AS session_id,
    CASE type WHEN 'checkout.session.completed' THEN 'COMPLETED' ELSE 'FAILED' END AS status
  FROM webhook_events WHERE type IN ('checkout.session.completed', 'checkout.session.expired'))"""


@query(
    "webhook_payments",
    f"""WITH {_HANDLED} SELECT h.event_seq, h.ts, h.type, h.status, h.session_id, p.id AS payment_id,
      p.order_id, p.customer_id, p.item_count FROM handled h JOIN paid p ON p.stripe_session_id = h.session_id""",
)
def webhook_payments(t: Tables) -> DataFrame:
    return payments.webhook_payments(t.webhook_events, t.paid).events


UNPAID_SQL = f"""WITH {_HANDLED} SELECT event_seq, ts, type, status, session_id,
    CASE WHEN session_id IS NULL THEN 500 ELSE 404 END AS error_code,
    CASE WHEN session_id IS NULL THEN 'An unexpected error occurred'
      ELSE concat('Payment not found for session: ', session_id) END AS message
  FROM handled WHERE session_id IS NULL OR session_id NOT IN (SELECT stripe_session_id FROM payments)"""


@query("webhook_payments_rejects", UNPAID_SQL)
def webhook_payments_rejects(t: Tables) -> DataFrame:
    return payments.webhook_payments(t.webhook_events, t.paid).rejects


_SETTLED = f"""WITH {_HANDLED},
  last AS (SELECT session_id, max_by(status, event_seq) AS status, max_by(ts, event_seq) AS ts
    FROM handled WHERE session_id IS NOT NULL GROUP BY session_id)
  SELECT p.* REPLACE (coalesce(l.status, p.status) AS status, coalesce(l.ts, p.updated_at) AS updated_at)
  FROM {{table}} p LEFT JOIN last l ON l.session_id = p.stripe_session_id"""


@query("settle_payments", _SETTLED.format(table="payments"))
def settle_payments(t: Tables) -> DataFrame:
    return payments.settle_payments(t.payments, t.webhook_events)


def published_sql(condition: str) -> str:
    return f"""WITH {_HANDLED} SELECT h.event_seq, CAST(p.order_id AS VARCHAR) AS key, h.status,
      concat('{{"orderId":', CAST(p.order_id AS VARCHAR), ',"customerId":', CAST(p.customer_id AS VARCHAR),
        ',"sessionId":"', h.session_id, '","status":"', h.status, '","items":', coalesce(i.items_json, '[]'),
        '}}') AS value
    FROM handled h JOIN payments p ON p.stripe_session_id = h.session_id
      LEFT JOIN payment_items i ON i.order_id = p.order_id WHERE {condition}"""


def _settle(t: Tables) -> payments.Settled:
    return payments.settle_webhooks(t.paid, t.payment_texts, t.webhook_events)


@query("payment_events", published_sql("true"))
def payment_events(t: Tables) -> DataFrame:
    return _settle(t).published.drop("page")


@query("settle_webhooks_completed", published_sql("h.status = 'COMPLETED'"))
def settle_webhooks_completed(t: Tables) -> DataFrame:
    return _settle(t).completed.drop("page")


@query("settle_webhooks_failed", published_sql("h.status = 'FAILED'"))
def settle_webhooks_failed(t: Tables) -> DataFrame:
    return _settle(t).failed.drop("page")


SETTLED_SQL = _SETTLED.format(table="paid")


@query(
    "settle_webhooks",
    f"SELECT p.*, {_TEXT_PAGE} FROM ({SETTLED_SQL}) p LEFT JOIN payment_pages t ON t.order_id = p.order_id",
)
def settle_webhooks(t: Tables) -> DataFrame:
    """The settled payments as they are stored, with their items."""
    return payments.with_item_texts(_settle(t).payments, t.payment_texts)
