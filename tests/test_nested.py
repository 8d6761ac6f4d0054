"""Results with their item lists or texts, in pages where they are long."""

from __future__ import annotations

import json
from decimal import Decimal

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tillspark.operators import cart, orders, payments, validate

ORDER = "id long, customer_id long"
ITEM = "order_id long, item_pos long, product_id long, quantity int, unit_price decimal(18,2)"
PRICE = Decimal("1.50")


@pytest.fixture
def items(table):
    """Order 1 has seven lines, order 2 one, order 3 none."""
    return table(ITEM, *[(1, p, p * 3, p, PRICE) for p in range(7, 0, -1)], (2, 1, 9, 1, PRICE))


def paged(df, key, items):
    """(key, page, pages, item_offset) to what `items` makes of the list."""
    return {tuple(r[c] for c in (key, "page", "pages", "item_offset")): items(r) for r in df.collect()}


@pytest.mark.parametrize("page_items", [3, 100])
def test_orders_with_nested_lines(table, items, page_items):
    stored = table(ORDER, (1, 10), (2, 20), (3, 10))
    lists = lambda r: [(i["item_pos"], i["product_id"], i["subtotal"]) for i in r["items"]]
    one = [(p, p * 3, p * PRICE) for p in range(1, 8)]
    pages = -(-7 // page_items)
    mine = {(1, p, pages, p * page_items): one[p * page_items : (p + 1) * page_items] for p in range(pages)}
    mine[(3, 0, 1, 0)] = []
    wanted = orders.orders_by_customer(stored, items, table("customer_id long", (10,)), True, page_items)
    assert paged(wanted, "id", lists) == mine
    every = orders.orders_with_items(stored, items, True, page_items)
    assert paged(every, "id", lists) == mine | {(2, 0, 1, 0): [(1, 9, PRICE)]}


def test_request_lists_of_carts(table):
    lines = table(ITEM.replace("order_id", "cart_id"), *[(c, p, p, 1, PRICE) for c in (None, 4) for p in (3, 1, 2)])
    got = paged(cart.order_request_lists(lines, 2), "cart_id", lambda r: [tuple(i) for i in r["items"]])
    first, last = [(1, 1, PRICE), (2, 1, PRICE)], [(3, 1, PRICE)]
    assert got == {(c, p, 2, p * 2): part for c in (None, 4) for p, part in enumerate((first, last))}


def test_payment_requests_with_their_items(table, items):
    heads = table("id long, customer_id long, total_amount decimal(18,2)", (1, 10, PRICE), (3, 10, PRICE))
    asked = cart.payment_request(heads, items.filter("order_id = 1")).nested(4)
    got = paged(asked, "order_id", lambda r: (r["customer_id"], r["amount"], [tuple(i) for i in r["items"]]))
    assert got == {
        (1, 0, 2, 0): (10, PRICE, [(p * 3, p) for p in range(1, 5)]),
        (1, 1, 2, 4): (10, PRICE, [(p * 3, p) for p in range(5, 8)]), (3, 0, 1, 0): (10, PRICE, []),
    }


def test_payments_with_their_item_texts(table, items):
    requests = table(
        "order_id long, customer_id long, amount decimal(18,2), item_count long",
        (1, 10, PRICE, 7), (2, 20, PRICE, 1), (3, 10, PRICE, None), (4, 10, PRICE, 0),
    )
    made = payments.new_payment_rows(requests, F.lit("2024-01-01 00:00:00"), start=5)
    stored = payments.with_item_texts(made, payments.item_texts(items, 5))
    assert rows(stored, "id", "order_id", "page", "pages", "item_offset") == [
        (6, 1, 0, 2, 0), (6, 1, 1, 2, 5), (7, 2, 0, 1, 0), (8, 3, 0, 1, 0), (9, 4, 0, 1, 0),
    ]
    texts = {(r["order_id"], r["page"]): r["items_json"] and json.loads(r["items_json"]) for r in stored.collect()}
    assert texts[1, 1] == [{"productId": p * 3, "quantity": p} for p in (6, 7)]
    assert texts[2, 0] == [{"productId": 9, "quantity": 1}]
    assert texts[3, 0] is None and texts[4, 0] == []


def test_valid_requests_count_their_items(table, items):
    checked = validate.validate_orders(
        table(ORDER, (1, 10), (2, None), (3, 10)), items.withColumnRenamed("order_id", "id"), key="id", count="items"
    )
    assert rows(checked.valid) == [(1, 10, 7)]
    assert rows(checked.rejects, "id", "items") == [(2, 1), (3, 0)]


def test_all_errors_of_a_request(table):
    requests = table(ORDER, (1, None), (2, 20), (3, 20))
    lines = table(
        ITEM.replace("order_id", "id"),
        (1, 1, None, 0, PRICE), (1, 2, 5, 1, PRICE), (1, 3, 5, None, None), (3, 1, 5, 1, PRICE),
    )
    assert rows(validate.request_errors(requests, lines, "id", 2)) == [
        (1, 0, "customerId: Customer ID is required; items[0].productId: Product ID is required; "
               "items[0].quantity: Quantity must be at least 1", 400),
        (1, 1, "items[2].quantity: Quantity is required; items[2].unitPrice: Unit price is required", 400),
        (2, 0, "items: Order must have at least one item", 400),
    ]


@pytest.mark.parametrize(
    ("name", "column"),
    [
        ("orders_with_items", "items"), ("orders_by_customer", "items"), ("order_request_items", "items"),
        ("payment_request", "items"), ("new_payment_rows", "items_json"), ("settle_webhooks", "items_json"),
        ("validate_orders", "items"), ("validate_order_items", "errors"),
    ],
)
def test_queries_return_lists(spark, name, column):
    assert column in contract.queries()[name](spark, SMALL).columns
