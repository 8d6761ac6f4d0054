"""Payments: creation, checkout lines, settlement from webhook events."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tillspark import schemas
from tillspark.functions import codec, text
from tillspark.functions.pages import PAGE_ITEMS, encode_page, item_pages, with_item_pages
from tillspark.functions.positions import assign_ids
from tillspark.operators import lookups, updates
from tillspark.operators.rejects import error_code, error_message

# Webhook event types and the status each one sets.
WEBHOOK_STATUS = {
    "checkout.session.completed": "COMPLETED",
    "checkout.session.expired": "FAILED",
}
CURRENCY = "eur"  # fixed value


def payment_view(payments: DataFrame) -> DataFrame:
    """Public columns; the checkout address is never stored, so always null."""
    return payments.select(
        "id",
        "order_id",
        "customer_id",
        "amount",
        "status",
        "stripe_session_id",
        F.lit(None).cast("string").alias("checkout_url"),
        "created_at",
    )


def payments_by_customer(payments: DataFrame, customers: DataFrame) -> DataFrame:
    return payment_view(lookups.rows_for_keys(payments, customers, "customer_id"))


def payments_by_status(payments: DataFrame, status: str) -> DataFrame:
    if status not in schemas.PAYMENT_STATUSES:
        raise ValueError(f"unknown payment status: {status}")
    return lookups.rows_with_value(payments, "status", status)


def new_payment_rows(
    requests: DataFrame,
    created_at: Column,
    start: int | DataFrame = 0,
    key: Sequence[str] = ("order_id",),
) -> DataFrame:
    """Valid requests (order_id, customer_id, amount, item_count) to pending payments.

    One payment per request. Its items are rows of `item_texts`; a request
    that had no item list at all keeps a null count.
    """
    nothing = F.lit(None).cast("string")
    return assign_ids(requests, list(key), "id", start).select(
        "id",
        "order_id",
        "customer_id",
        F.col("amount").cast(schemas.MONEY).alias("amount"),
        F.lit("PENDING").alias("status"),
        nothing.alias("stripe_session_id"),
        nothing.alias("stripe_payment_intent_id"),
        F.col("item_count").cast("long").alias("item_count"),
        created_at.cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


def item_texts(items: DataFrame, page_items: int = PAGE_ITEMS) -> DataFrame:
    """Lines (order_id, item_pos, product_id, quantity) as JSON text, in pages of the order."""
    entry = F.struct(F.col("product_id").alias("productId"), "quantity")
    text = F.to_json("items", {"ignoreNullFields": "false"})
    return item_pages(items, "order_id", entry, page_items).select(
        "order_id", "page", "pages", "item_offset", text.alias("items_json")
    )


def with_item_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Payments (order_id, item_count, ...) with their `item_texts`.

    The text is null where the request had no item list. A payment whose
    items need several pages has a row for each of them.
    """
    empty = rows.filter(F.coalesce("item_count", F.lit(0)) == 0)
    paged = with_item_pages(rows.filter("item_count > 0"), texts, "order_id", empty, "items_json")
    no_items = F.when(F.col("item_count") == 0, F.lit("[]"))
    return paged.withColumn("items_json", F.coalesce("items_json", no_items))


def items_of_texts(texts: DataFrame) -> DataFrame:
    """The lines back out of the texts; null, empty or bad text has none."""
    parsed = codec.parsed_once(texts, codec.parse_items("items_json"), "_items")
    return parsed.select("order_id", "item_offset", F.posexplode("_items").alias("_pos", "_item")).select(
        "order_id",
        (F.col("item_offset") + F.col("_pos") + 1).alias("item_pos"),
        F.col("_item.productId").alias("product_id"),
        "_item.quantity",
    )


def checkout_lines(payments: DataFrame, label: str = "Order #") -> DataFrame:
    """What the payment provider is asked to charge, one line per payment."""
    order, payment = F.col("order_id").cast("string"), F.col("id").cast("string")
    return payments.select(
        "order_id",
        text.minor_units("amount").alias("unit_amount"),
        F.lit(CURRENCY).alias("currency"),
        F.concat(F.lit(label), order).alias("name"),
        F.lit(1).cast("long").alias("quantity"),
        F.create_map(F.lit("orderId"), order, F.lit("paymentId"), payment).alias("metadata"),
    )


def attach_session(payments: DataFrame, sessions: DataFrame, seq: str = "session_id") -> DataFrame:
    """Write the provider's session id back on the payment of its order.

    Of several sessions of an order the last by `seq` counts.
    """
    ids = sessions.groupBy("order_id").agg(F.max_by("session_id", seq).alias("stripe_session_id"))
    return updates.overwrite_fields(payments, ids, "order_id", ["stripe_session_id"])


def checkout_results(payments: DataFrame, sessions: DataFrame) -> DataFrame:
    """What the buyer gets back, given the provider's sessions."""
    return payments.select("order_id").join(sessions, "order_id").select(
        "order_id", "session_id", F.col("url").alias("checkout_url")
    )


def route_webhook_type(kind: Column | str) -> Column:
    """completed, expired or other."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    return (
        F.when(kind == "checkout.session.completed", F.lit("completed"))
        .when(kind == "checkout.session.expired", F.lit("expired"))
        .otherwise(F.lit("other"))
    )


def _targeted(events: DataFrame) -> DataFrame:
    """Handled webhook events with the session they name and the status they set."""
    status = F
    for kind, name in WEBHOOK_STATUS.items():
        status = status.when(F.col("type") == kind, F.lit(name))
    return events.withColumn("status", status).filter(F.col("status").isNotNull()).select(
        "event_seq",
        "ts",
        "type",
        "status",
        codec.session_id(F.col("type"), F.col("session_id"), F.col("raw")).alias("session_id"),
    )


def webhook_sessions(events: DataFrame) -> DataFrame:
    """The sessions that handled webhook events name."""
    named = _targeted(events).filter(F.col("session_id").isNotNull())
    return named.select(F.col("session_id").alias("stripe_session_id")).distinct()


class Matched(NamedTuple):
    events: DataFrame
    rejects: DataFrame


def webhook_payments(events: DataFrame, payments: DataFrame) -> Matched:
    """Handled events joined to their payment.

    No session id is an internal error, an unknown session a 404. Every
    event meets the payments once; hits and misses are told by a flag.
    """
    targeted = _targeted(events)
    wanted = payments.select(
        F.col("stripe_session_id").alias("session_id"),
        F.col("id").alias("payment_id"),
        "order_id",
        "customer_id",
        "item_count",
    )
    joined = targeted.join(wanted, "session_id", "left")
    missed = joined.filter(F.col("payment_id").isNull()).select(*targeted.columns)
    named = F.col("session_id").isNotNull()
    reason = F.when(named, F.lit("NOT_FOUND")).otherwise(F.lit("INTERNAL"))
    text = F.concat(F.lit(lookups.NOT_FOUND_TEXT["payment_by_session"]), "session_id")
    return Matched(
        joined.filter(F.col("payment_id").isNotNull()),
        missed.select("*", error_code(reason).alias("error_code"), error_message(reason, text).alias("message")),
    )


def settle_payments(payments: DataFrame, events: DataFrame) -> DataFrame:
    """Status and update time from the last event of each session.

    Events reduce to one row per session before they meet the payments,
    so a session with very many events costs no skewed join.
    """
    named = _targeted(events).filter(F.col("session_id").isNotNull())
    paid = (F.col("status") == "COMPLETED").alias("paid")
    picked = updates.pick_by_seq(
        named.select("event_seq", "session_id", paid, "ts"), "session_id", "event_seq"
    )
    last = picked.select(
        F.col("session_id").alias("stripe_session_id"),
        F.when(F.col("paid"), F.lit("COMPLETED")).otherwise(F.lit("FAILED")).alias("status"),
        F.col("ts").alias("updated_at"),
    )
    return updates.overwrite_fields(payments, last, "stripe_session_id", ["status", "updated_at"])


def payment_events(matched: DataFrame, texts: DataFrame) -> DataFrame:
    """One event per handled webhook event, items read from the payment's texts.

    Columns event_seq, page, key, status, value. Events of a payment without
    items need no texts, so the join is an inner one.
    """
    parsed = codec.parsed_once(texts.select("order_id", "page", "pages", "item_offset", "items_json"), codec.parse_items("items_json"), "items").drop("items_json")
    empty = matched.filter(F.coalesce("item_count", F.lit(0)) == 0)
    listed = matched.filter("item_count > 0")
    return with_item_pages(listed, parsed, "order_id", empty).select(
        "event_seq",
        "page",
        F.col("order_id").cast("string").alias("key"),
        "status",
        encode_page(
            F.col("event_seq"),
            F.col("order_id").alias("orderId"),
            F.col("customer_id").alias("customerId"),
            F.col("session_id").alias("sessionId"),
            F.col("status").alias("status"),
            F.col("items"),
        ).alias("value"),
    )


class Settled(NamedTuple):
    payments: DataFrame
    published: DataFrame
    rejects: DataFrame

    @property
    def completed(self) -> DataFrame:
        return self.published.filter(F.col("status") == "COMPLETED")

    @property
    def failed(self) -> DataFrame:
        return self.published.filter(F.col("status") == "FAILED")


def settle_webhooks(payments: DataFrame, texts: DataFrame, events: DataFrame) -> Settled:
    """Webhook events settle payments and give events for two topics, by status."""
    matched = webhook_payments(events, payments)
    return Settled(
        settle_payments(payments, events), payment_events(matched.events, texts), matched.rejects
    )
