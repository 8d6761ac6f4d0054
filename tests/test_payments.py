from __future__ import annotations

import json
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tillspark import schemas
from tillspark.functions import codec
from tillspark.functions.pages import event_lines, with_places
from tillspark.operators import payments, rejects, validate
from tillspark.sources.topics import topic_rows

EVENT = "event_seq long, ts timestamp_ntz, type string, session_id string, raw string"
DONE, EXPIRED = "checkout.session.completed", "checkout.session.expired"


@pytest.fixture
def stored(spark):
    return spark.sql(
        """SELECT id, order_id, 100L customer_id, CAST(85.00 AS DECIMAL(18,2)) amount, 'PENDING' status,
        session stripe_session_id, item_count, TIMESTAMP_NTZ'2024-01-01' created_at,
        CAST(NULL AS TIMESTAMP_NTZ) updated_at FROM VALUES
        (1L, 10L, 'sess_1', 1L), (2L, 11L, 'sess_2', 2L), (3L, 12L, NULL, NULL) t(id, order_id, session, item_count)"""
    )


@pytest.fixture
def texts(table):
    return table(
        "order_id long, page long, pages long, item_offset long, items_json string",
        (10, 0, 1, 0, '[{"productId":5,"quantity":2}]'), (11, 0, 1, 0, "oops"),
    )


@pytest.fixture
def events(table):
    import datetime

    def at(minute):
        return datetime.datetime(2024, 2, 1, 0, minute)

    return table(
        EVENT,
        (1, at(1), DONE, "sess_1", "{}"),
        (2, at(2), EXPIRED, "sess_1", "{}"),
        (3, at(3), DONE, None, '{"id":"sess_2"}'),
        (4, at(4), EXPIRED, None, '{"id":"sess_2"}'),
        (5, at(5), DONE, None, "not-valid-json"),
        (6, at(6), DONE, "sess_9", "{}"),
        (7, at(7), "invoice.paid", "sess_2", "{}"),
    )


def test_settlement_takes_the_last_event(stored, texts, events):
    settled = payments.settle_webhooks(stored, texts, events)
    got = rows(settled.payments.withColumn("m", F.minute("updated_at")), "id", "status", "m")
    assert got == [(1, "FAILED", 2), (2, "COMPLETED", 3), (3, "PENDING", None)]
    assert rows(settled.completed, "event_seq", "key") == [(1, "10"), (3, "11")]
    assert rows(settled.failed, "event_seq", "key") == [(2, "10")]
    assert rows(settled.rejects, "event_seq", "error_code", "message") == [
        (4, 500, "An unexpected error occurred"),
        (5, 500, "An unexpected error occurred"),
        (6, 404, "Payment not found for session: sess_9"),
    ]


def test_published_items(stored, texts, events):
    published = payments.payment_events(payments.webhook_payments(events, stored).events, texts)
    bodies = {r["event_seq"]: json.loads(r["value"]) for r in published.collect()}
    assert bodies[1] == {
        "orderId": 10, "customerId": 100, "sessionId": "sess_1", "status": "COMPLETED",
        "items": [{"productId": 5, "quantity": 2}],
    }
    assert bodies[3]["items"] == []


def test_items_text(table):
    texts = table("t string", ('[{"productId":1,"quantity":2}]',), ("",), (None,), ("{bad",), ("[]",))
    assert [len(r[0]) for r in texts.select(codec.parse_items("t")).collect()] == [1, 0, 0, 0, 0]


def test_new_payments(table):
    requests = table(
        "order_id long, customer_id long, amount decimal(18,2), item_count long",
        (10, 100, Decimal("85.00"), 2), (11, 100, Decimal("1.00"), None), (12, 100, Decimal("1.00"), 0),
    )
    made = payments.new_payment_rows(requests, F.lit("2024-01-01 00:00:00"), start=5)
    assert rows(made, "id", "order_id", "status", "item_count") == [
        (6, 10, "PENDING", 2), (7, 11, "PENDING", None), (8, 12, "PENDING", 0),
    ]
    assert rows(payments.payment_view(made), "id", "checkout_url") == [(6, None), (7, None), (8, None)]


@pytest.mark.parametrize("page_items", [1, 2, 3, 50])
def test_items_of_any_length_are_stored_as_text(stored, table, page_items):
    lines = [(10, p, p * 7, None if p == 2 else p) for p in range(1, 6)] + [(12, 1, 3, 4)]
    texts = payments.item_texts(table("order_id long, item_pos long, product_id long, quantity int", *lines), page_items)
    assert rows(payments.items_of_texts(texts)) == lines
    if page_items == 50:
        assert rows(texts.filter("order_id = 12"), "items_json") == [('[{"productId":3,"quantity":4}]',)]
    matched = stored.filter("id = 1").select(
        F.lit(77).cast("long").alias("event_seq"), F.lit("COMPLETED").alias("status"), F.col("stripe_session_id").alias("session_id"),
        "order_id", "customer_id", "item_count",
    )
    topic = topic_rows(payments.payment_events(matched, texts), F.col("event_seq"))
    decoded = with_places(codec.decode_events(topic, schemas.PAYMENT_EVENT).valid)
    assert decoded.count() == -(-5 // page_items)
    got = event_lines(decoded, F.col("_item.productId"), F.col("_item.quantity"))
    assert rows(got) == [(77, *line[1:]) for line in lines[:5]]


def test_checkout(stored, table):
    lines = payments.checkout_lines(stored, label="Shop order ")
    assert rows(lines, "order_id", "unit_amount", "currency", "name")[0] == (10, 8500, "eur", "Shop order 10")
    assert lines.first()["metadata"].keys() == {"orderId", "paymentId"}
    sessions = table("order_id long, session_id string, url string", (12, "cs_12", "u"), (99, "cs_99", "v"))
    assert rows(payments.attach_session(stored, sessions), "id", "stripe_session_id") == [
        (1, "sess_1"), (2, "sess_2"), (3, "cs_12"),
    ]
    assert rows(payments.checkout_results(stored, sessions)) == [(12, "cs_12", "u")]


def test_customer_without_payments(stored, table):
    assert payments.payments_by_customer(stored, table("customer_id long", (7,))).count() == 0
    assert payments.payments_by_customer(stored, table("customer_id long", (100,))).count() == 3


def test_request_validation(table):
    requests = table(
        "order_id long, customer_id long, amount decimal(18,2)",
        (1, 1, Decimal("0.01")), (None, 1, Decimal(1)), (2, None, None), (3, 1, Decimal("-5.00")), (4, 1, Decimal(0)),
    )
    checked = validate.validate_payments(requests)
    assert rows(checked.valid, "order_id") == [(1,)]
    messages = sorted(v for r in checked.rejects.collect() for v in r["errors"].values())
    assert messages == [
        "Amount is required", "Amount must be positive", "Amount must be positive",
        "Customer ID is required", "Order ID is required",
    ]


def test_error_codes(table):
    reasons = table("r string, d string", ("NOT_FOUND", "a"), ("CONFLICT", "b"), ("INVALID", "c"), ("PROVIDER", "d"), ("X", "e"))
    got = reasons.select(rejects.error_code("r"), rejects.error_message("r", "d"))
    assert [tuple(r) for r in got.collect()] == [
        (404, "a"), (409, "b"), (400, "c"), (502, "Stripe error: d"), (500, "An unexpected error occurred"),
    ]


def test_minor_units_cut_toward_zero(table):
    from tillspark.functions.text import minor_units

    amounts = table("x decimal(18,4)", (Decimal("1.2399"),), (Decimal("-1.2399"),))
    assert [r[0] for r in amounts.select(minor_units("x")).collect()] == [123, -123]


def test_not_null_check(table):
    stock = table("product_id long, quantity int, reserved int", (1, 1, 0), (None, None, 0))
    assert rows(validate.not_null_check(stock, "inventory"), "missing") == [("product_id,quantity",)]
