from __future__ import annotations

from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tillspark import schemas
from tillspark.functions.text import enum_or_null, is_blank, price_label
from tillspark.operators import catalog, lookups, updates, validate
from tillspark.sources import tables

PRODUCT = "id long, name string, brand string, category string, price decimal(18,2), " \
    "description string, image_url string, width double, active boolean"
REQUEST = "id long, name string, brand string, category string, price decimal(18,2), " \
    "description string, image_url string, width double"


def product(i, name, brand, category="DECK", price="85.00", active=True):
    return (i, name, brand, category, Decimal(price), None, None, None, active)


@pytest.fixture
def products(table):
    return table(
        PRODUCT,
        product(1, "Alder Deck", "Alder"),
        product(2, "Birch Trucks", "Birch", "TRUCKS", "49.99"),
        product(3, "Alder Wheels_52", "Alder", "WHEELS", "39.99"),
        product(4, "Old Deck 100%", "Cedar", "DECK", "59.99", active=False),
    )


def ids(df):
    return [r[0] for r in rows(df, "id")]


def test_brands_leave_out_inactive(products):
    assert [r["brand"] for r in catalog.distinct_brands(products).collect()] == ["Alder", "Birch"]


def test_unset_and_blank_filters_are_dropped(products):
    assert ids(catalog.catalog_search(products)) == [1, 2, 3]
    assert ids(catalog.catalog_search(products, brand=" \t", name="", category="")) == [1, 2, 3]


def test_filters_ignore_case_and_bounds_include(products):
    assert ids(catalog.catalog_search(products, brand="aLDER")) == [1, 3]
    found = catalog.catalog_search(
        products, min_price=Decimal("39.99"), max_price=Decimal("49.99")
    )
    assert ids(found) == [2, 3]


def test_zero_bound(products):
    assert ids(catalog.catalog_search(products, max_price=Decimal(0))) == []
    unset = catalog.catalog_search(products, max_price=Decimal(0), zero_means_unset=True)
    assert ids(unset) == [1, 2, 3]


def test_name_wildcards_stay_live_unless_literal(products):
    assert ids(catalog.catalog_search(products, name="DECK")) == [1]
    assert ids(catalog.catalog_search(products, name="a%r d")) == [1]
    assert ids(catalog.catalog_search(products, name="wheels_", literal=True)) == [3]
    assert ids(catalog.catalog_search(products, name="a%r d", literal=True)) == []


def test_unknown_category_fails(products):
    with pytest.raises(ValueError):
        catalog.catalog_search(products, category="HELMET")


def test_search_is_pushed_to_the_scan(spark, products, tmp_path):
    path = str(tmp_path / "products")
    products.write.parquet(path)
    stored = tables.scan_products(spark, path)
    assert stored.schema.names == schemas.PRODUCTS.names
    found = stored.filter(catalog.catalog_predicate(category="DECK")).select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(category,DECK)" in plan and "image_url" not in plan
    assert ids(found) == [1]


@pytest.mark.parametrize("name", ["products", "inventory", "orders", "order_items", "payments"])
def test_scans_read_declared_schemas(spark, tmp_path, name):
    schema = getattr(schemas, name.upper())
    path = str(tmp_path / name)
    spark.createDataFrame([tuple(None for _ in schema)], schema).write.parquet(path)
    assert getattr(tables, f"scan_{name}")(spark, path).schema == schema


def test_stock_defaults_to_zero(products, table):
    stock = table("id long, product_id long, quantity int, reserved int", (1, 1, 5, 2), (2, 3, 2, 3))
    page = catalog.catalog_with_stock(products, stock)
    assert rows(page, "id", "stock", "stock_label", "can_add") == [
        (1, 3, "3 in stock", True), (2, 0, "Out of stock", False), (3, -1, "Out of stock", True),
    ]


def test_lookup_reports_missing_ids(products, table):
    found = lookups.lookup_keys(
        table("id long", (4,), (99,)), products, "id", lookups.NOT_FOUND_TEXT["product"]
    )
    hits, misses = lookups.split_found(found)
    assert ids(hits) == [4]
    assert rows(misses, "id", "error_code", "message") == [
        (99, 404, "Product not found with id: 99")
    ]


def test_update_overwrites_with_nulls_and_rejects_unknown(products, table):
    changes = table(
        REQUEST,
        (1, "New Deck", "Dune", "DECK", Decimal("89.99"), None, None, 8.0),
        (99, "x", "y", "DECK", Decimal("1.00"), None, None, None),
    )
    with_text = products.replace({"Old Deck 100%": "Old"}).na.fill({"description": "text"})
    update = catalog.update_products(with_text, changes.withColumn("seq", F.col("id")), "seq")
    assert rows(update.table.filter("id = 1"), "name", "brand", "price", "description", "active") == [
        ("New Deck", "Dune", Decimal("89.99"), None, True)
    ]
    assert rows(update.rejects, "id", "error_code") == [(99, 404)]


def test_last_update_of_a_product_wins(products, table):
    changes = table(
        REQUEST + ", seq int",
        *[(1, f"Deck {n}", "Dune", "DECK", Decimal(n), None, None, None, n) for n in (2, 3, 1)],
    )
    update = catalog.update_products(products, changes, "seq")
    assert update.table.count() == 4
    assert rows(update.table.filter("id = 1"), "name") == [("Deck 3",)]


def test_soft_delete_is_idempotent(products, table):
    ids_ = table("id long", (1,), (1,), (4,), (99,))
    once = catalog.deactivate_products(products, ids_)
    twice = catalog.deactivate_products(once.table, ids_)
    expected = [(1, False), (2, True), (3, True), (4, False)]
    assert rows(once.table, "id", "active") == rows(twice.table, "id", "active") == expected
    assert ids(once.rejects) == [99]


def test_seed_adds_absent_names_once(products, table):
    seeds = table(
        "seq long, name string, brand string, category string, price decimal(18,2), active boolean",
        *[(i, f"Seed {i % 7}", "House", "DECK", Decimal(i), True) for i in range(14)],
        (99, "Alder Deck", "House", "DECK", Decimal(1), True),
    )
    once = catalog.seed_products(products, seeds)
    assert once.count() == 4 + 7
    assert rows(once.filter("name = 'Seed 3'"), "price") == [(Decimal("3.00"),)]
    assert catalog.seed_products(once, seeds).count() == 11


def test_product_exists_is_exact(products, table):
    keys = table("name string, brand string", ("Alder Deck", "Alder"), ("alder deck", "Alder"), ("x", None))
    assert rows(catalog.product_exists(keys, products), "name", "exists") == [
        ("Alder Deck", True), ("alder deck", False), ("x", False),
    ]


def test_validation_messages(table):
    requests = table(
        REQUEST,
        (1, "Deck", "Alder", "DECK", Decimal(0), None, None, None),
        (2, " \t", "Alder", "DECK", Decimal("5.00"), None, None, None),
        (3, "Deck", None, None, Decimal("-0.01"), None, None, None),
        (4, "Deck", "Alder", "DECK", None, None, None, None),
    )
    checked = validate.validate_products(requests)
    assert ids(checked.valid) == [1]
    errors = {r["id"]: r["errors"] for r in checked.rejects.collect()}
    assert errors == {
        2: {"name": "Name is required"},
        3: {
            "brand": "Brand is required",
            "category": "Category is required",
            "price": "Price must be positive",
        },
        4: {"price": "Price is required"},
    }
    assert {r["error_code"] for r in checked.rejects.collect()} == {400}


def test_text_helpers(table):
    df = table("s string, x decimal(18,2)", ("\t\n ", Decimal("1234567.5")), (None, Decimal("-0.05")))
    assert [r[0] for r in df.select(is_blank("s")).collect()] == [True, True]
    assert [r[0] for r in df.select(price_label("x")).collect()] == ["€1,234,567.50", "-€0.05"]
    parsed = table("s string", ("DECK",), ("deck",)).select(enum_or_null("s", schemas.CATEGORIES))
    assert [r[0] for r in parsed.collect()] == ["DECK", None]


def test_last_row_of_text_is_picked_by_key_and_sequence(table):
    rows_ = table(
        "k long, name string, seq long, v int", (1, "a", 1, 5), (1, "b", 3, None), (1, "c", 2, 7), (None, "x", 4, 1), (None, "y", 9, 2),
    )
    assert rows(updates.pick_by_seq(rows_, "k", "seq")) == [(None, "y", 9, 2), (1, "b", 3, None)]
    assert rows(updates.pick_by_seq(rows_, "k", "seq", first=True)) == [(None, "x", 4, 1), (1, "a", 1, 5)]
    plan = updates.pick_by_seq(rows_, "k", "seq")._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and "LeftSemi" in plan
