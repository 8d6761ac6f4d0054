"""Event decoding, notifications, and the streaming jobs run over whole topics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T

from tillspark import schemas
from tillspark.functions.codec import decode_events
from tillspark.operators import notifications, orders
from tillspark.plans.carts import FOLD_SQL
from tillspark.plans.orders import placed_topic
from tillspark.plans.payments import SETTLED_SQL, UNPAID_SQL, published_sql
from tillspark.plans.registry import query
from tillspark.plans.stock import INVENTORY_SQL, ledger_sql
from tillspark.session import materialize, scratch_path
from tillspark.sources.standins import Tables
from tillspark.sources.topics import read_topic, subscribe, topic_rows, write_topic
from tillspark.streaming import jobs
from tillspark.streaming.outcomes import REJECTED, Outcomes


def _notice(kind: str, text: str, rows: str) -> str:
    return f"""SELECT '{kind}' AS kind, order_id, customer_id, concat('{text} - orderId: ',
      CAST(order_id AS VARCHAR), ', customerId: ', CAST(customer_id AS VARCHAR)) AS text FROM ({rows})"""


_ORDERS = "SELECT id AS order_id, customer_id FROM orders_t"
_CANCELLED = f"{_ORDERS} WHERE status = 'CANCELLED'"
_CONFIRMED_SQL = _notice("ORDER_CONFIRMATION", "Sending order confirmation", _ORDERS)
_CANCELLED_SQL = _notice("ORDER_CANCELLATION", "Sending order cancellation", _CANCELLED)


def cancelled_topic(t: Tables) -> DataFrame:
    events = orders.order_cancelled_events(t.orders_t.filter("status = 'CANCELLED'"))
    return topic_rows(events, F.col("key"))


def _stream(t: Tables, rows: DataFrame) -> DataFrame:
    """The rows as a topic folder, read back as a stream."""
    folder = scratch_path(t.spark, "topic")
    write_topic(rows, folder)
    return read_topic(t.spark, folder)


def _paths(t: Tables) -> tuple[str, str]:
    return scratch_path(t.spark, "out"), scratch_path(t.spark, "offsets")


@query("order_confirmations", _CONFIRMED_SQL)
def order_confirmations(t: Tables) -> DataFrame:
    placed = decode_events(placed_topic(t), schemas.ORDER_PLACED, on_error="fail").valid
    return notifications.order_confirmations(placed)


@query("order_cancellations", _CANCELLED_SQL)
def order_cancellations(t: Tables) -> DataFrame:
    cancelled = decode_events(cancelled_topic(t), schemas.ORDER_CANCELLED, on_error="fail").valid
    return notifications.order_cancellations(cancelled)


@query(
    "payment_notices",
    _notice("PAYMENT_CONFIRMATION", "Sending payment confirmation", f"{_ORDERS} WHERE total_amount > 300000")
    + " UNION ALL "
    + _notice("PAYMENT_FAILED", "Sending payment failed notification", f"{_ORDERS} WHERE total_amount < 100000"),
)
def payment_notices(t: Tables) -> DataFrame:
    return notifications.payment_notices(decode_events(t.payment_topic, schemas.PAYMENT_EVENT).valid)


@query("notification_feed", f"{_CONFIRMED_SQL} UNION ALL {_CANCELLED_SQL}")
def notification_feed(t: Tables) -> DataFrame:
    """The notification job over both order topics."""
    out, checkpoint = _paths(t)
    jobs.notification_job(
        _stream(t, placed_topic(t)), _stream(t, cancelled_topic(t)), out, checkpoint
    )
    return t.spark.read.parquet(out)


_SESSION = T.StructType([T.StructField("id", T.StringType())])


@query(
    "decode_events",
    "SELECT event_seq, json_extract_string(raw, '$.id') AS id FROM webhook_events WHERE json_valid(raw)",
)
def decoded(t: Tables) -> DataFrame:
    valid = decode_events(t.webhook_events, _SESSION, "raw").valid
    return valid.select("event_seq", "event.id")


@query(
    "decode_events_quarantine",
    "SELECT event_seq, raw FROM webhook_events WHERE NOT json_valid(raw)",
)
def quarantined(t: Tables) -> DataFrame:
    return decode_events(t.webhook_events, _SESSION, "raw").quarantine.select("event_seq", "raw")


def _in_three(t: Tables, rows: DataFrame, job: Callable[[DataFrame], None]) -> None:
    """The rows published in three parts, in order; the job reads each as one micro-batch.

    A part has as many files as it needs and the job goes on from its
    checkpoint, so no task writes or reads a whole part.
    """
    folder = scratch_path(t.spark, "topic")
    kept = materialize(rows, "topic-rows")
    third = kept.agg(F.max("seq").alias("n")).first()["n"] / 3
    for part in range(3):
        low, high = F.col("seq") > part * third, F.col("seq") <= (part + 1) * third
        write_topic(kept.filter((low | F.lit(part == 0)) & high), folder)
        job(read_topic(t.spark, folder))


# Every 97th payload is broken, every 89th names an order nobody knows.
_BROKEN, _UNKNOWN = "{0} % 97 = 0", "{0} % 97 <> 0 AND {0} % 89 = 0"


def _faulty(topic: DataFrame) -> DataFrame:
    value = F.when(F.col("seq") % 97 == 0, F.lit("not-valid-json")).when(
        F.col("seq") % 89 == 0, F.regexp_replace("value", '"orderId":([0-9]+)', '"orderId":9000000000$1')
    )
    return topic.withColumn("value", value.otherwise(F.col("value")))


def _malformed_sql(rows: str) -> str:
    return f"""SELECT id AS seq, CAST(id AS VARCHAR) AS key, 'not-valid-json' AS value
      FROM ({rows}) WHERE {_BROKEN.format("id")}"""


def _outcomes(t: Tables) -> tuple[Outcomes, str]:
    return Outcomes(t.spark, scratch_path(t.spark, "outcomes")), scratch_path(t.spark, "offsets")


@query("cancel_audit", _CANCELLED + " AND id % 97 <> 0")
def cancel_audit(t: Tables) -> DataFrame:
    """What the stock group records of cancellations, as a streaming job."""
    return _audited(t).read("audit", jobs.AUDIT).drop("batch")


@query("cancel_audit_malformed", _malformed_sql("SELECT id FROM orders_t WHERE status = 'CANCELLED'"))
def cancel_audit_malformed(t: Tables) -> DataFrame:
    return _audited(t).malformed()


def _audited(t: Tables) -> Outcomes:
    out, checkpoint = _outcomes(t)
    broken = F.when(F.col("seq") % 97 == 0, F.lit("not-valid-json")).otherwise(F.col("value"))
    topic = cancelled_topic(t).withColumn("value", broken)
    _in_three(t, topic, lambda part: jobs.cancel_audit_job(part, out, checkpoint))
    return out


_WELL = "id % 97 <> 0"
_NOTICED = (
    _notice("PAYMENT_CONFIRMATION", "Sending payment confirmation", f"{_ORDERS} WHERE total_amount > 300000 AND {_WELL}")
    + " UNION ALL "
    + _notice("PAYMENT_FAILED", "Sending payment failed notification", f"{_ORDERS} WHERE total_amount < 100000 AND {_WELL}")
)


def _noticed(t: Tables) -> Outcomes:
    out, checkpoint = _outcomes(t)
    broken = F.when(F.col("seq") % 97 == 0, F.lit("not-valid-json")).otherwise(F.col("value"))
    topic = t.payment_topic.withColumn("value", broken)
    _in_three(t, topic, lambda part: jobs.payment_notice_job(part, out, checkpoint))
    return out


@query("payment_notices_stream", _NOTICED)
def payment_notices_stream(t: Tables) -> DataFrame:
    return _noticed(t).read("notice", jobs.NOTICE).drop("batch")


@query("payment_notices_malformed", _malformed_sql("SELECT id FROM orders_t"))
def payment_notices_malformed(t: Tables) -> DataFrame:
    return _noticed(t).malformed()


_ROUTED_BY_AMOUNT = "CASE WHEN total_amount > 300000 THEN 'PAID' WHEN total_amount < 100000 THEN 'CANCELLED' {0} END"


@query(
    "apply_payment_status_stream",
    f"""SELECT id, customer_id, {_ROUTED_BY_AMOUNT.format("ELSE status")} AS status, total_amount, created_at FROM orders_t""",
)
def apply_payment_status_stream(t: Tables) -> DataFrame:
    out, checkpoint = _outcomes(t)
    jobs.order_status_job(_stream(t, t.payment_topic), t.orders_t, out, checkpoint)
    return jobs.current_orders(t.orders_t, out)


def _faulty_statuses(t: Tables) -> Outcomes:
    out, checkpoint = _outcomes(t)
    _in_three(t, _faulty(t.payment_topic), lambda part: jobs.order_status_job(part, t.orders_t, out, checkpoint))
    return out


@query(
    "apply_payment_status_batches",
    f"""SELECT id, customer_id, CASE WHEN id % 97 = 0 OR id % 89 = 0 THEN status
      ELSE {_ROUTED_BY_AMOUNT.format("ELSE status")} END AS status, total_amount, created_at FROM orders_t""",
)
def apply_payment_status_batches(t: Tables) -> DataFrame:
    return jobs.current_orders(t.orders_t, _faulty_statuses(t))


@query(
    "apply_payment_status_batches_rejects",
    f"""SELECT id AS seq, CAST(concat('9000000000', CAST(id AS VARCHAR)) AS BIGINT) AS order_id, 404 AS error_code,
      concat('Order not found with id: 9000000000', CAST(id AS VARCHAR)) AS message
    FROM orders_t WHERE {_UNKNOWN.format("id")} AND {_ROUTED_BY_AMOUNT.format("")} IS NOT NULL""",
)
def apply_payment_status_batches_rejects(t: Tables) -> DataFrame:
    return _faulty_statuses(t).read(REJECTED, jobs.REJECT).drop("batch")


@query("apply_payment_status_batches_malformed", _malformed_sql("SELECT id FROM orders_t"))
def apply_payment_status_batches_malformed(t: Tables) -> DataFrame:
    return _faulty_statuses(t).malformed()


@query(
    "apply_payment_status_latest",
    f"""SELECT id, customer_id, CASE WHEN id > (SELECT max(id) FROM orders_t) / 2
      THEN {_ROUTED_BY_AMOUNT.format("ELSE status")} ELSE status END AS status, total_amount, created_at FROM orders_t""",
)
def apply_payment_status_latest(t: Tables) -> DataFrame:
    """The order group declares no start, so what was published before its first start passes it by."""
    out, checkpoint = _outcomes(t)
    folder = scratch_path(t.spark, "topic")
    topic = materialize(t.payment_topic, "topic-rows")
    half = topic.agg(F.max("seq").alias("n")).first()["n"] / 2
    for late in (False, True):
        write_topic(topic.filter((F.col("seq") > half) == late), folder)
        jobs.order_status_job(subscribe(t.spark, folder, "order-service", checkpoint), t.orders_t, out, checkpoint)
    return jobs.current_orders(t.orders_t, out)


@query("apply_stock_events", INVENTORY_SQL)
def apply_stock_events(t: Tables) -> DataFrame:
    """The stock job over the payment topic; any payment status takes stock."""
    out, checkpoint = _outcomes(t)
    jobs.stock_job(_stream(t, t.payment_topic), t.inventory, out, checkpoint)
    return jobs.current_stock(t.inventory, out)


_TAKEN = "(SELECT * FROM order_items WHERE order_id % 97 <> 0)"


def _stocked(t: Tables, mode: str = "exact") -> Outcomes:
    out, checkpoint = _outcomes(t)
    broken = F.when(F.col("seq") % 97 == 0, F.lit("not-valid-json")).otherwise(F.col("value"))
    topic = t.payment_topic.withColumn("value", broken)
    _in_three(t, topic, lambda part: jobs.stock_job(part, t.inventory, out, checkpoint, mode))
    return out


@query(
    "apply_stock_events_rejects",
    ledger_sql(True, """SELECT o.event_seq, o.item_pos, o.product_id, o.quantity,
      CASE WHEN c.code = -2 THEN 404 ELSE 409 END AS error_code,
      concat(CASE WHEN c.code = -2 THEN 'Inventory not found for product: ' ELSE 'Insufficient stock for product: ' END,
        CAST(o.product_id AS VARCHAR)) AS message
    FROM ordered o JOIN outcomes c USING (n) WHERE c.code = -2 OR (c.code >= 0 AND c.code % 4 = 3)""", _TAKEN),
)
def apply_stock_events_rejects(t: Tables) -> DataFrame:
    return _stocked(t).read(REJECTED, jobs.FAILED_LINE).drop("batch")


@query("apply_stock_events_malformed", _malformed_sql("SELECT id FROM orders_t"))
def apply_stock_events_malformed(t: Tables) -> DataFrame:
    return _stocked(t, "independent").malformed()


def _settled(t: Tables) -> Outcomes:
    folder = scratch_path(t.spark, "webhooks")
    events = t.webhook_events
    events.write.parquet(folder)
    out, checkpoint = _outcomes(t)
    webhooks = t.spark.readStream.schema(events.schema).parquet(folder)
    jobs.settle_job(webhooks, t.paid, t.payment_texts, out, checkpoint)
    return out


@query("settle_webhooks_stream", SETTLED_SQL)
def settle_webhooks_stream(t: Tables) -> DataFrame:
    return jobs.current_payments(t.paid, _settled(t))


_COMPLETED_SQL = published_sql("h.status = 'COMPLETED'")


@query("settle_webhooks_stream_topic", f"SELECT event_seq AS seq, key, value FROM ({_COMPLETED_SQL})")
def settle_webhooks_stream_topic(t: Tables) -> DataFrame:
    """What the settle job published to the payment-completed topic."""
    return jobs.published_topic(_settled(t), schemas.PAYMENT_COMPLETED_TOPIC).drop("page")


@query("settle_webhooks_stream_rejects", f"SELECT event_seq, type, session_id, error_code, message FROM ({UNPAID_SQL})")
def settle_webhooks_stream_rejects(t: Tables) -> DataFrame:
    return _settled(t).read(REJECTED, jobs.UNPAID).drop("batch")


@query("cart_fold_stream", FOLD_SQL)
def cart_fold_stream(t: Tables) -> DataFrame:
    """The cart job over all cart events, and its state afterwards."""
    folder = scratch_path(t.spark, "cart-events")
    events = t.cart_events
    events.write.parquet(folder)
    out, checkpoint = _outcomes(t)
    jobs.cart_job(t.spark.readStream.schema(events.schema).parquet(folder), out, checkpoint)
    return jobs.current_carts(t.spark, checkpoint)
