"""Products: search, brands, stock on the catalog page, writes."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from tillspark import schemas
from tillspark.functions import text
from tillspark.functions.positions import assign_ids
from tillspark.operators import lookups, updates
from tillspark.operators.inventory import inventory_view

PRODUCT_COLUMNS = schemas.PRODUCTS.names
# Every field an update replaces; id and active stay.
EDITABLE = ["name", "brand", "category", "price", "description", "image_url", "width"]


def catalog_predicate(
    brand: str | None = None,
    category: str | None = None,
    min_price: Decimal | None = None,
    max_price: Decimal | None = None,
    name: str | None = None,
    literal: bool = False,
    zero_means_unset: bool = False,
) -> Column:
    """Conjunction of the filters that are set, always on active products.

    A blank text argument counts as unset. The shop's client also drops a
    price bound of 0; `zero_means_unset` does the same.
    """
    terms = [F.col("active")]
    if brand and brand.strip():
        terms.append(F.lower("brand") == brand.lower())
    if category is not None and category != "":
        if category not in schemas.CATEGORIES:
            raise ValueError(f"unknown category: {category}")
        terms.append(F.col("category") == category)
    if min_price is not None and not (zero_means_unset and min_price == 0):
        terms.append(F.col("price") >= F.lit(min_price))
    if max_price is not None and not (zero_means_unset and max_price == 0):
        terms.append(F.col("price") <= F.lit(max_price))
    if name and name.strip():
        terms.append(text.contains_ignoring_case("name", name, literal))
    predicate = F.lit(True)
    for term in terms:
        predicate = predicate & term
    return predicate


def catalog_search(products: DataFrame, **filters: object) -> DataFrame:
    """Products that pass every set filter, unsorted and unpaged."""
    return product_view(products.filter(catalog_predicate(**filters)))


def product_view(products: DataFrame) -> DataFrame:
    return products.select(*PRODUCT_COLUMNS)


def catalog_count(products: DataFrame, **filters: object) -> DataFrame:
    """Number of matching products."""
    return products.filter(catalog_predicate(**filters)).agg(F.count("*").alias("products"))


def catalog_with_stock(products: DataFrame, inventory: DataFrame, **filters: object) -> DataFrame:
    """The catalog page: matching products with their stock and labels."""
    stock = F.coalesce("available", F.lit(0))
    available = inventory_view(inventory).select(F.col("product_id").alias("id"), "available")
    return (
        catalog_search(products, **filters)
        .join(available, "id", "left")
        .select(
            *PRODUCT_COLUMNS,
            stock.alias("stock"),
            F.when(stock > 0, F.concat(stock.cast("string"), F.lit(" in stock")))
            .otherwise(F.lit("Out of stock"))
            .alias("stock_label"),
            F.when(stock > 0, F.lit("Add to cart"))
            .otherwise(F.lit("Out of stock"))
            .alias("button_label"),
            (stock != 0).alias("can_add"),
            text.price_label("price").alias("price_label"),
        )
    )


def distinct_brands(products: DataFrame) -> DataFrame:
    """Brands of active products, ascending and case-sensitive."""
    return products.filter("active").select("brand").distinct().orderBy("brand")


def product_exists(keys: DataFrame, products: DataFrame) -> DataFrame:
    """Whether a product with this exact name and brand exists."""
    return lookups.key_exists(keys, products, ["name", "brand"])


def new_product_rows(requests: DataFrame, start: int | DataFrame = 0, order_by: Sequence[str] = ("request_id",)) -> DataFrame:
    """Requests as active product rows, numbered on from `start` along a unique key."""
    made = assign_ids(requests.select(*dict.fromkeys([*order_by, *EDITABLE])), list(order_by), "id", start)
    return made.select("id", *EDITABLE, F.lit(True).alias("active"))


def seed_products(products: DataFrame, rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Insert rows whose name is not yet present."""
    return updates.insert_absent(products, rows, "name", seq)


def update_products(products: DataFrame, requests: DataFrame, seq: str) -> updates.Update:
    """Replace the editable fields by id, the last request of a product winning.

    Unknown ids are rejected.
    """
    last = updates.pick_by_seq(requests.select("id", *EDITABLE, F.col(seq).alias("_seq")), "id", "_seq")
    return updates.Update(
        updates.overwrite_fields(products, last, "id", EDITABLE),
        lookups.reject_unknown(requests, products, "id", lookups.NOT_FOUND_TEXT["product"]),
    )


def deactivate_products(products: DataFrame, ids: DataFrame) -> updates.Update:
    """Soft delete; deleting twice changes nothing more."""
    off = ids.select("id").distinct().withColumn("active", F.lit(False))
    return updates.Update(
        updates.overwrite_fields(products, off, "id", ["active"]),
        lookups.reject_unknown(ids, products, "id", lookups.NOT_FOUND_TEXT["product"]),
    )
