from __future__ import annotations

import json
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tillspark import schemas
from tillspark.functions.codec import decode_events
from tillspark.functions.pages import event_lines, first_pages, split_arrived, with_places
from tillspark.operators import notifications, orders, validate
from tillspark.sources.topics import topic_rows

ORDER = "id long, customer_id long, status string, total_amount decimal(18,2), created_at timestamp_ntz"
ITEM = "order_id long, item_pos long, product_id long, quantity int, unit_price decimal(18,2)"
REQUEST = "request_id long, customer_id long"
LINE = ITEM.replace("order_id", "request_id")


@pytest.fixture
def stored(spark):
    return spark.sql(
        """SELECT id, customer_id, status, CAST(total AS DECIMAL(18,2)) total_amount,
        TIMESTAMP_NTZ'2024-01-01' created_at FROM VALUES (1L, 100L, 'PENDING', 170.00),
        (2L, 200L, 'PAID', 10.00), (3L, 100L, 'CANCELLED', 0) t(id, customer_id, status, total)"""
    )


@pytest.fixture
def items(table):
    return table(
        ITEM, (1, 1, 10, 2, Decimal("85.00")), (2, 2, 12, 1, Decimal("3.00")), (2, 1, 11, 1, Decimal("7.00"))
    )


def test_totals_are_exact_and_default_to_zero(stored, items):
    assert rows(orders.order_totals(stored, items)) == [
        (1, Decimal("170.00")), (2, Decimal("10.00")), (3, Decimal("0.00")),
    ]


def test_orders_come_with_their_lines(stored, items):
    got = rows(orders.orders_with_items(stored, items), "id", "item_pos", "product_id", "subtotal")
    assert got == [(1, 1, 10, Decimal("170.00")), (2, 1, 11, Decimal("7.00")), (2, 2, 12, Decimal("3.00")), (3, None, None, None)]


def test_lists_page_through_an_order(table):
    many = table(ITEM, *[(1, p, p, 1, Decimal("1.00")) for p in range(7, 0, -1)], (2, 1, 5, 1, Decimal("2.00")))
    nested = orders.order_item_lists(many, page_rows=3)
    pages = {(r["order_id"], r["page"], r["pages"], r["item_offset"]): [i["item_pos"] for i in r["items"]] for r in nested.collect()}
    assert pages == {(1, 0, 3, 0): [1, 2, 3], (1, 1, 3, 3): [4, 5, 6], (1, 2, 3, 6): [7], (2, 0, 1, 0): [1]}


@pytest.mark.parametrize("page_items", [1, 3, 7, 100])
def test_events_of_any_length_are_put_together_again(stored, table, page_items):
    lines = [(1, p, p * 3, p, Decimal("1.50")) for p in range(1, 8)] + [(2, 1, 9, 1, Decimal("2.00"))]
    events = orders.order_placed_events(stored, table(ITEM, *lines), page_items)
    texts = [json.loads(r["value"]) for r in events.filter("key = '1'").orderBy("page").collect()]
    pages = -(-7 // page_items)
    if pages > 1:
        assert [(t["eventSeq"], t["page"], t["pages"], t["itemOffset"]) for t in texts] == [
            (1, p, pages, p * page_items) for p in range(pages)
        ]
    else:
        assert set(texts[0]) == {"orderId", "customerId", "totalAmount", "items"}
    decoded = decode_events(topic_rows(events, F.col("event_seq")), schemas.ORDER_PLACED).valid
    placed = with_places(decoded)
    assert rows(first_pages(placed), "event_seq", "event.totalAmount") == [
        (1, Decimal("170.00")), (2, Decimal("10.00")), (3, Decimal("0.00")),
    ]
    got = event_lines(placed, F.col("_item.productId"), F.col("_item.quantity"), F.col("_item.unitPrice"))
    assert rows(got) == lines
    assert rows(notifications.order_confirmations(decoded), "order_id") == [(1,), (2,), (3,)]


def test_waiting_events_are_told_from_whole_ones(stored, table):
    lines = [(1, p, p, 1, Decimal("1.00")) for p in range(1, 8)] + [(2, p, p, 1, Decimal("1.00")) for p in range(1, 5)]
    events = orders.order_placed_events(stored, table(ITEM, *lines), 2)
    came = events.filter("not (key = '1' and page = 2)")
    topic = topic_rows(came.unionByName(came.filter("key = '2' and page = 1")), F.col("event_seq"))
    arrived = split_arrived(with_places(decode_events(topic, schemas.ORDER_PLACED).valid))
    assert rows(arrived.whole, "event_seq", "page") == [(2, 0), (2, 1), (3, 0)]
    assert rows(arrived.waiting, "event_seq", "page") == [(1, 0), (1, 1), (1, 3)]


def test_created_orders(table):
    requests = table(REQUEST, (7, 100), (5, 200))
    lines = table(
        LINE, (7, 1, 10, 2, Decimal("85.00")), (5, 1, 11, 1, Decimal("7.00")), (5, 2, 12, 3, Decimal("0.05"))
    )
    made = orders.new_order_rows(requests, lines, F.lit("2024-05-01 10:00:00"), start=40)
    assert rows(made.orders, "id", "request_id", "status", "total_amount") == [
        (41, 5, "PENDING", Decimal("7.15")), (42, 7, "PENDING", Decimal("170.00")),
    ]
    assert rows(made.items, "order_id", "item_pos", "product_id", "quantity") == [
        (41, 1, 11, 1), (41, 2, 12, 3), (42, 1, 10, 2),
    ]


def test_an_order_of_thousands_of_lines_is_one_order(spark, table):
    lines = spark.range(1, 5001).select(
        F.lit(7).cast("long").alias("request_id"), F.col("id").alias("item_pos"), (F.col("id") % 90).alias("product_id"),
        F.lit(2).alias("quantity"), F.lit("0.50").cast("decimal(18,2)").alias("unit_price"),
    )
    placed = orders.place_orders(table(REQUEST, (7, 100), (8, 100)), lines, F.lit("2024-05-01 10:00:00"))
    assert rows(placed.orders, "id", "request_id", "total_amount") == [(1, 7, Decimal("5000.00"))]
    assert placed.items.count() == 5000 and placed.events.count() == 5
    decoded = with_places(decode_events(topic_rows(placed.events, F.col("event_seq")), schemas.ORDER_PLACED).valid)
    assert first_pages(decoded).count() == 1
    got = event_lines(decoded, F.col("_item.productId").alias("product_id"))
    assert got.filter("item_pos % 90 = product_id").select("item_pos").distinct().count() == 5000
    assert rows(placed.rejects, "request_id") == [(8,)]


def test_placed_event_keeps_item_order(stored, items):
    events = {r["key"]: json.loads(r["value"]) for r in orders.order_placed_events(stored, items).collect()}
    assert events["2"] == {
        "orderId": 2, "customerId": 200, "totalAmount": 10.0,
        "items": [
            {"productId": 11, "quantity": 1, "unitPrice": 7.0},
            {"productId": 12, "quantity": 1, "unitPrice": 3.0},
        ],
    }
    assert events["3"]["items"] == []


def test_orders_by_customer_and_status(stored, items, table):
    mine = orders.orders_by_customer(stored, items, table("customer_id long", (100,), (100,)))
    assert rows(mine, "id", "item_pos") == [(1, 1), (3, None)]
    assert rows(orders.orders_by_status(stored, "PAID"), "id") == [(2,)]
    with pytest.raises(ValueError):
        orders.orders_by_status(stored, "LOST")


def test_last_status_wins_and_unknown_orders_are_rejected(stored, table):
    changes = table(
        "seq long, order_id long, status string",
        (2, 1, "SHIPPED"), (1, 1, "PAID"), (3, 3, "PENDING"), (4, 9, "PAID"), (5, 2, "LOST"),
    )
    update = orders.set_order_status(stored, changes)
    assert rows(update.table, "id", "status") == [(1, "SHIPPED"), (2, "PAID"), (3, "PENDING")]
    assert rows(update.rejects, "order_id", "error_code") == [(2, 400), (9, 404)]


def test_cancel_emits_one_event_per_request(stored, table):
    done = orders.cancel_orders(stored, table("order_id long", (1,), (3,), (3,), (9,)))
    assert rows(done.orders, "id", "status") == [(1, "CANCELLED"), (2, "PAID"), (3, "CANCELLED")]
    assert rows(done.events, "key") == [("1",), ("3",), ("3",)]
    assert rows(done.rejects, "order_id") == [(9,)]


def test_payment_status_routing(stored, table):
    events = table(
        "seq long, order_id long, status string",
        (1, 1, "COMPLETED"), (2, 2, "FAILED"), (3, 3, "UNKNOWN"), (4, 3, None),
    )
    update = orders.apply_payment_status(stored, events)
    assert rows(update.table, "id", "status") == [(1, "PAID"), (2, "CANCELLED"), (3, "CANCELLED")]


def test_request_validation(table):
    requests = table(REQUEST, (1, 100), (2, None), (3, 100), (5, 100), (6, 100))
    price = Decimal("1.00")
    lines = table(
        LINE, (1, 1, 10, 1, price), (2, 1, 10, 1, price), (5, 1, 10, 1, price), (5, 2, 10, 1, None), (6, 1, None, 0, price),
    )
    loose = validate.validate_orders(requests, lines)
    assert rows(loose.valid) == [(1, 100), (6, 100)]
    errors = {r["request_id"]: (r["errors"], r["error_code"]) for r in loose.rejects.collect()}
    assert errors == {
        2: ({"customerId": "Customer ID is required"}, 400),
        3: ({"items": "Order must have at least one item"}, 400), 5: (None, 500),
    }
    strict = validate.validate_orders(requests, lines, strict_items=True)
    assert rows(strict.valid, "request_id") == [(1,)]
    found = {r["request_id"]: r["errors"] for r in strict.rejects.collect()}
    assert found[5] == found[6] == {"items": "1 lines are not valid"}
    assert rows(validate.validate_order_items(lines)) == [
        (5, 2, "items[1].unitPrice", "Unit price is required"),
        (6, 1, "items[0].productId", "Product ID is required"),
        (6, 1, "items[0].quantity", "Quantity must be at least 1"),
    ]
