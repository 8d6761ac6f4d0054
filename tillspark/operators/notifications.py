"""Notification rows out of order and payment events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillspark.functions.pages import first_pages, with_places

# Kind of notice to its text, before the ids.
NOTICE_TEXT = {
    "ORDER_CONFIRMATION": "Sending order confirmation",
    "ORDER_CANCELLATION": "Sending order cancellation",
    "PAYMENT_CONFIRMATION": "Sending payment confirmation",
    "PAYMENT_FAILED": "Sending payment failed notification",
}


def _notices(events: DataFrame, kind: str) -> DataFrame:
    order, customer = F.col("event.orderId"), F.col("event.customerId")

    def shown(col):
        return F.coalesce(col.cast("string"), F.lit("null"))

    return events.select(
        F.lit(kind).alias("kind"),
        order.alias("order_id"),
        customer.alias("customer_id"),
        F.concat(
            F.lit(f"{NOTICE_TEXT[kind]} - orderId: "), shown(order),
            F.lit(", customerId: "), shown(customer),
        ).alias("text"),
    )


def order_confirmations(placed: DataFrame) -> DataFrame:
    """One notice per order placed, however many items."""
    return _notices(first_pages(with_places(placed)), "ORDER_CONFIRMATION")


def order_cancellations(cancelled: DataFrame) -> DataFrame:
    return _notices(cancelled, "ORDER_CANCELLATION")


def payment_notices(events: DataFrame) -> DataFrame:
    """Notices for completed and failed payments; other statuses give none."""
    first = first_pages(with_places(events))
    done = first.filter(F.col("event.status") == "COMPLETED")
    failed = first.filter(F.col("event.status") == "FAILED")
    return _notices(done, "PAYMENT_CONFIRMATION").unionByName(_notices(failed, "PAYMENT_FAILED"))


def notification_feed(placed: DataFrame, cancelled: DataFrame) -> DataFrame:
    """One feed out of the two order topics."""
    return order_confirmations(placed).unionByName(order_cancellations(cancelled))


def cancel_audit(cancelled: DataFrame) -> DataFrame:
    """What the stock side records of a cancellation; stock itself never moves."""
    return cancelled.select(
        F.col("event.orderId").alias("order_id"), F.col("event.customerId").alias("customer_id")
    )
