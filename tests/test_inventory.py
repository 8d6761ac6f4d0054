from __future__ import annotations

import pytest
from conftest import rows

from tillspark.operators import inventory, updates, validate

STOCK = "id long, product_id long, quantity int, reserved int"


@pytest.fixture
def stock(table):
    return table(STOCK, (1, 10, 20, 0), (2, 11, 5, 2))


def test_view_subtracts_reserved(stock):
    assert rows(inventory.inventory_view(stock), "product_id", "available") == [(10, 20), (11, 3)]


def test_unknown_products_are_missing_silently(stock, table):
    keys = table("product_id long", (10,), (99,))
    assert rows(inventory.inventory_for_products(stock, keys), "product_id") == [(10,)]
    empty = table("product_id long")
    assert inventory.inventory_for_products(stock, empty).count() == 0


def test_exists(stock, table):
    keys = table("product_id long", (10,), (99,))
    assert rows(inventory.inventory_exists(keys, stock)) == [(10, True), (99, False)]


def test_create_rejects_duplicates_and_first_wins(stock, table):
    requests = table(
        "seq long, product_id long, quantity int", (1, 10, 7), (2, 12, 8), (3, 12, 9)
    )
    made = inventory.create_inventory(stock, requests, "seq")
    assert rows(made.table, "product_id", "quantity", "reserved")[-1] == (12, 8, 0)
    assert made.table.count() == stock.count() + 1
    assert made.table.filter("id is null").isEmpty()
    assert made.table.select("id").distinct().count() == made.table.count()
    assert rows(made.rejects, "seq", "error_code", "message") == [
        (1, 409, "Inventory already exists for product: 10"),
        (3, 409, "Inventory already exists for product: 12"),
    ]


def test_set_and_increase(stock, table):
    changes = table(
        "seq long, product_id long, quantity int", (1, 10, 70), (2, 10, 50), (3, 99, 1)
    )
    assert rows(inventory.set_stock(stock, changes, "seq").table, "product_id", "quantity") == [
        (10, 50), (11, 5),
    ]
    more = inventory.increase_stock(stock, table("product_id long, quantity int", (10, 4), (10, 6), (98, 1)))
    assert rows(more.table, "product_id", "quantity") == [(10, 30), (11, 5)]
    assert rows(more.rejects, "product_id", "message") == [
        (98, "Inventory not found for product: 98")
    ]


def test_seed_is_a_no_op_the_second_time(stock, table):
    seeds = table("seq long, product_id long, quantity int, reserved int", *[(p, p, 10, 0) for p in range(8, 13)])
    once = inventory.seed_inventory(stock, seeds)
    assert rows(once, "product_id", "quantity") == [(8, 10), (9, 10), (10, 20), (11, 5), (12, 10)]
    assert inventory.seed_inventory(once, seeds).count() == 5


def test_upsert_replaces_and_inserts(stock, table):
    changed = table(STOCK + ", seq int", (1, 10, 1, 0, 1), (1, 10, 2, 0, 2), (9, 12, 3, 0, 1))
    after = updates.upsert_by_key(stock, changed, "product_id", "seq")
    assert rows(after, "product_id", "quantity") == [(10, 2), (11, 5), (12, 3)]


def test_validation(table):
    requests = table("product_id long, quantity int", (1, 0), (None, 3), (2, -1), (3, None))
    checked = validate.validate_inventory(requests)
    assert rows(checked.valid) == [(1, 0)]
    assert sorted(v for r in checked.rejects.collect() for v in r["errors"].values()) == [
        "Product ID is required", "Quantity cannot be negative", "Quantity is required",
    ]


def test_unique_keys(stock, table):
    new = table("product_id long", (10,), (12,), (13,), (13,))
    assert rows(validate.unique_key_check(new, "product_id", stock), "product_id", "new_rows") == [
        (10, 1), (13, 2),
    ]
    assert rows(validate.unique_key_check(new, "product_id"), "product_id") == [(13,)]
