"""Orders: creation from requests, totals, nested views, status changes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tillspark import schemas
from tillspark.functions.codec import encode
from tillspark.functions.pages import PAGE_ITEMS, encode_page, item_pages, with_item_pages
from tillspark.functions.positions import assign_ids
from tillspark.operators import lookups, updates
from tillspark.operators.rejects import with_error
from tillspark.operators.validate import validate_orders


class NewOrders(NamedTuple):
    orders: DataFrame
    items: DataFrame


def line_amount() -> Column:
    return F.col("unit_price") * F.col("quantity")


def new_order_rows(
    requests: DataFrame,
    lines: DataFrame,
    created_at: Column,
    start: int | DataFrame = 0,
    key: str = "request_id",
) -> NewOrders:
    """Valid requests (key, customer_id) and their lines to pending orders and items.

    Lines (key, item_pos, product_id, quantity, unit_price) stay flat, so an
    order has one id and one total whatever its length; ids follow `key`.
    `created_at` is given, so a re-run gives the same rows.
    """
    sums = lines.groupBy(key).agg(F.sum(line_amount()).alias("_sum"))
    numbered = assign_ids(requests.select(key, "customer_id").join(sums, key, "left"), [key], "id", start)
    orders = numbered.select(
        "id",
        key,
        "customer_id",
        F.lit("PENDING").alias("status"),
        F.coalesce("_sum", F.lit(0)).cast(schemas.MONEY).alias("total_amount"),
        created_at.cast("timestamp_ntz").alias("created_at"),
    )
    items = lines.join(numbered.select(key, F.col("id").alias("order_id")), key).select(
        "order_id", "item_pos", "product_id", "quantity", "unit_price"
    )
    return NewOrders(orders, items)


def order_item_view(items: DataFrame) -> DataFrame:
    return items.withColumn("subtotal", line_amount().cast(schemas.MONEY))


def order_totals(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Exact total per order, 0 for an order without lines."""
    sums = items.groupBy("order_id").agg(F.sum(line_amount()).alias("_sum"))
    return orders.join(sums, orders["id"] == sums["order_id"], "left").select(
        orders["id"].alias("order_id"),
        F.coalesce("_sum", F.lit(0)).cast(schemas.MONEY).alias("total_amount"),
    )


def order_item_lists(items: DataFrame, page_rows: int = PAGE_ITEMS) -> DataFrame:
    """Lines nested per order, in position order, as a reader pages through them."""
    entry = F.struct("item_pos", "product_id", "quantity", "unit_price", "subtotal")
    return item_pages(order_item_view(items), "order_id", entry, page_rows)


def _without_lines(orders: DataFrame, items: DataFrame) -> DataFrame:
    having = items.select(F.col("order_id").alias("id")).distinct()
    return orders.join(having, "id", "left_anti")


def orders_with_items(
    orders: DataFrame, items: DataFrame, nested: bool = False, page_items: int = PAGE_ITEMS
) -> DataFrame:
    """One row per order and line; an order without lines has one row without item.

    `nested` gives each order with the list of its lines (`order_item_lists`)
    instead, an empty one where it has none. An order longer than `page_items`
    has a row per page of its list, with `page`, `pages` and `item_offset`.

    An inner join plus the orders without lines, in place of an outer
    join: adaptive execution can then split an order with very many lines.
    """
    if nested:
        pages = order_item_lists(items, page_items).withColumnRenamed("order_id", "id")
        return with_item_pages(orders, pages, "id", _without_lines(orders, items))
    lines = order_item_view(items).withColumnRenamed("order_id", "id")
    return orders.join(lines, "id").unionByName(_without_lines(orders, items), allowMissingColumns=True)


def orders_by_customer(
    orders: DataFrame, items: DataFrame, customers: DataFrame, nested: bool = False, page_items: int = PAGE_ITEMS
) -> DataFrame:
    """Orders of the wanted customers with their lines, see `orders_with_items`."""
    wanted = lookups.rows_for_keys(orders, customers, "customer_id")
    mine = items.join(wanted.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    return orders_with_items(wanted, mine, nested, page_items)


def orders_by_status(orders: DataFrame, status: str) -> DataFrame:
    if status not in schemas.ORDER_STATUSES:
        raise ValueError(f"unknown order status: {status}")
    return lookups.rows_with_value(orders, "status", status)


def order_placed_events(orders: DataFrame, items: DataFrame, page_items: int = PAGE_ITEMS) -> DataFrame:
    """One event per order, keyed by order id: event_seq, page, key, value."""
    entry = F.struct(
        F.col("product_id").alias("productId"), "quantity", F.col("unit_price").alias("unitPrice")
    )
    pages = item_pages(items, "order_id", entry, page_items).withColumnRenamed("order_id", "id")
    return with_item_pages(orders, pages, "id", _without_lines(orders, items)).select(
        F.col("id").alias("event_seq"),
        "page",
        F.col("id").cast("string").alias("key"),
        encode_page(
            F.col("id"),
            F.col("id").alias("orderId"),
            F.col("customer_id").alias("customerId"),
            F.col("total_amount").alias("totalAmount"),
            F.col("items"),
        ).alias("value"),
    )


class Placed(NamedTuple):
    orders: DataFrame
    items: DataFrame
    events: DataFrame
    rejects: DataFrame


def place_orders(
    requests: DataFrame,
    lines: DataFrame,
    created_at: Column,
    start: int | DataFrame = 0,
    key: str = "request_id",
    strict_items: bool = False,
) -> Placed:
    """Requests and their lines to stored rows, published events and rejects."""
    checked = validate_orders(requests, lines, strict_items, key)
    made = new_order_rows(checked.valid, lines, created_at, start, key)
    events = order_placed_events(made.orders.drop(key), made.items)
    return Placed(made.orders, made.items, events, checked.rejects)


def order_cancelled_events(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("id").cast("string").alias("key"),
        encode(F.col("id").alias("orderId"), F.col("customer_id").alias("customerId")).alias("value"),
    )


def set_order_status(orders: DataFrame, changes: DataFrame, seq: str = "seq") -> updates.Update:
    """Any status to any allowed status; the last change per order wins.

    Unknown statuses and unknown orders are rejected.
    """
    statuses = F.array(*[F.lit(s) for s in schemas.ORDER_STATUSES])
    coded = changes.select(
        seq, "order_id", F.array_position(statuses, F.col("status")).cast("int").alias("code")
    )
    last = updates.pick_by_seq(coded.filter("code > 0"), "order_id", seq).select(
        F.col("order_id").alias("id"), F.element_at(statuses, F.col("code")).alias("status")
    )
    ids = orders.select(F.col("id").alias("order_id"))
    allowed = F.coalesce(F.col("status").isin(*schemas.ORDER_STATUSES), F.lit(False))
    unbound = with_error(
        changes.filter(~allowed),
        "INVALID",
        F.concat(F.lit("Unknown order status: "), F.coalesce("status", F.lit("null"))),
    )
    unknown = lookups.reject_unknown(
        changes.filter(allowed), ids, "order_id", lookups.NOT_FOUND_TEXT["order"]
    )
    return updates.Update(
        updates.overwrite_fields(orders, last, "id", ["status"]), unbound.unionByName(unknown)
    )


class Cancelled(NamedTuple):
    orders: DataFrame
    events: DataFrame
    rejects: DataFrame


def cancel_orders(orders: DataFrame, requests: DataFrame) -> Cancelled:
    """Cancel by id and emit one event per request, repeats included."""
    ids = requests.select(F.col("order_id").alias("id"))
    cancelled = ids.distinct().withColumn("status", F.lit("CANCELLED"))
    known = orders.select(F.col("id").alias("order_id"))
    return Cancelled(
        updates.overwrite_fields(orders, cancelled, "id", ["status"]),
        order_cancelled_events(ids.join(orders.select("id", "customer_id"), "id")),
        lookups.reject_unknown(requests, known, "order_id", lookups.NOT_FOUND_TEXT["order"]),
    )


def route_payment_status(status: Column | str) -> Column:
    """Order status that a payment status asks for; null leaves the order alone."""
    status = F.col(status) if isinstance(status, str) else status
    return F.when(status == "COMPLETED", F.lit("PAID")).when(
        status == "FAILED", F.lit("CANCELLED")
    )


def payment_event_orders(events: DataFrame, orders: DataFrame) -> updates.Update:
    """Routed payment events joined to their order; unknown orders are rejected."""
    routed = events.withColumn("new_status", route_payment_status("status")).filter(
        F.col("new_status").isNotNull()
    )
    current = orders.select(F.col("id").alias("order_id"), F.col("status").alias("old_status"))
    return updates.Update(
        routed.join(current, "order_id"),
        lookups.reject_unknown(routed, current, "order_id", "Order not found: "),
    )


def apply_payment_status(orders: DataFrame, events: DataFrame, seq: str = "seq") -> updates.Update:
    """Payment events set order status; statuses without a route change nothing."""
    routed = events.select(
        seq, "order_id", route_payment_status("status").alias("status")
    ).filter(F.col("status").isNotNull())
    return set_order_status(orders, routed, seq)
