from __future__ import annotations

import random
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tillspark.operators import cart, orders

EVENT = "seq long, cart_id long, action string, product_id long, quantity int, available_stock int"


def replay(events):
    """Strict replay, event by event."""
    carts = {}
    for seq, cart_id, action, product, quantity, stock in sorted(events):
        lines = carts.setdefault(cart_id, {})
        if action == "clear":
            lines.clear()
        elif action == "remove" or (action == "set" and quantity <= 0):
            lines.pop(product, None)
        elif action == "set":
            line = lines.get(product)
            if line and not (quantity > line[1] and quantity > line[0]):
                line[0] = quantity
        elif product in lines:
            lines[product][0] += 1 if quantity is None else quantity
        else:
            lines[product] = [
                1 if quantity is None else quantity, 99 if stock is None else stock, seq
            ]
    return sorted((c, p, *line) for c, lines in carts.items() for p, line in lines.items())


def random_events(rnd, size):
    actions = ["add"] * 6 + ["set"] * 5 + ["remove", "clear"]
    events = []
    for seq in range(size):
        action = rnd.choice(actions) if rnd.random() < 0.97 or size < 50 else "clear"
        hot = rnd.random() < 0.4
        events.append((
            seq * rnd.choice([1, 1, 1]) + (seq // 7) * 5,
            0 if hot else rnd.randint(0, 3),
            action,
            1 if hot else rnd.randint(1, 3),
            None if action == "add" and rnd.random() < 0.1 else rnd.randint(-1, 9),
            None if rnd.random() < 0.1 else rnd.randint(0, 8),
        ))
    return events


@pytest.mark.parametrize("seed", range(8))
def test_fold_equals_strict_replay(table, seed):
    rnd = random.Random(seed)
    events = random_events(rnd, rnd.choice([8, 60, 400]))
    for bits in (1, 3, 20):
        got = rows(cart.cart_fold(table(EVENT, *events), chunk_bits=bits))
        assert got == replay(events)


def test_cart_rules(table):
    events = table(
        EVENT,
        (1, 1, "add", 5, None, 3), (2, 1, "add", 5, 4, 9),  # one line, first stock kept
        (3, 1, "set", 6, 2, None),  # unknown product
        (4, 1, "add", 7, 1, 2), (5, 1, "set", 7, 3, None),  # raise above stock ignored
        (6, 1, "add", 8, 9, 2), (7, 1, "set", 8, 5, None),  # lowering is always allowed
        (8, 1, "add", 9, 1, 9), (9, 1, "set", 9, 0, None),  # zero removes
        (10, 2, "add", 5, 1, 1), (11, 2, "clear", None, None, None),
    )
    assert rows(cart.cart_fold(events), "cart_id", "product_id", "quantity", "available_stock") == [
        (1, 5, 5, 3), (1, 7, 1, 2), (1, 8, 5, 2),
    ]


@pytest.fixture
def priced(table):
    lines = table(
        "cart_id long, product_id long, quantity long, available_stock int, added_seq long",
        (1, 5, 2, 3, 10), (1, 6, 9, 4, 8), (1, 7, 9, 1, 9), (2, 5, 1, 1, 11),
    )
    products = table(
        "id long, name string, price decimal(18,2)",
        (5, "Deck", Decimal("85.00")), (6, "Trucks", Decimal("0.10")), (7, "Wheels", Decimal("1.00")),
    )
    return cart.priced_lines(lines, products)


def test_totals_and_counts(priced):
    assert rows(cart.cart_totals(priced)) == [(1, Decimal("179.90")), (2, Decimal("85.00"))]
    assert rows(cart.cart_item_counts(priced)) == [(1, 20), (2, 1)]


def test_gate_names_first_offending_line(priced):
    assert rows(cart.stock_gate(priced)) == [
        (1, False, 6, 'Not enough stock for "Trucks". Only 4 available.'), (2, True, None, None),
    ]


def test_lines_view(priced):
    view = cart.cart_lines_view(priced)
    assert rows(view, "cart_id", "product_id", "subtotal", "over_stock", "stock_warning") == [
        (1, 5, Decimal("170.00"), False, None), (1, 6, Decimal("0.90"), True, "Only 4 available"),
        (1, 7, Decimal("9.00"), True, "Only 1 available"), (2, 5, Decimal("85.00"), False, None),
    ]


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_requests_keep_cart_order(priced, hot_rows):
    lines = cart.order_request_items(priced, hot_rows=hot_rows)
    assert rows(lines, "cart_id", "item_pos", "product_id") == [(1, 1, 6), (1, 2, 7), (1, 3, 5), (2, 1, 5)]


def test_only_passing_carts_check_out(priced):
    made = cart.checkout_requests(priced)
    assert rows(made.requests) == [(2, 2)]
    assert rows(made.lines, "cart_id", "product_id") == [(2, 5)]


def test_created_orders_ask_for_their_payment(priced):
    made = cart.checkout_requests(priced)
    placed = orders.new_order_rows(made.requests, made.lines, F.lit("2024-05-01 10:00:00"), 6, "cart_id")
    asked = cart.payment_request(placed.orders, placed.items)
    assert rows(asked.requests) == [(7, 2, Decimal("85.00"))]
    assert rows(asked.items) == [(7, 1, 5, 1)]
