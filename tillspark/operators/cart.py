"""Shopping carts: replay of cart events, merging, totals, checkout gate."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillspark import schemas
from tillspark.functions.pages import PAGE_ITEMS, item_pages, with_item_pages
from tillspark.functions.positions import row_positions
from tillspark.session import materialize

# An add without quantity or known stock.
DEFAULT_QUANTITY = 1
DEFAULT_STOCK = 99
# Rows of one line that a task orders together: 2 ** 20.
CHUNK_BITS = 20


def _after_last_clear(events: DataFrame) -> DataFrame:
    """Events that no later clear of their cart wipes out."""
    cleared = (
        events.filter("action = 'clear'").groupBy("cart_id").agg(F.max("seq").alias("_cleared"))
    )
    return (
        events.filter("action <> 'clear'")
        .join(cleared, "cart_id", "left")
        .filter(F.col("_cleared").isNull() | (F.col("seq") > F.col("_cleared")))
        .drop("_cleared")
    )


def _chained(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Apply quantity steps in order; one step per key comes out.

    The line's stock and beginning are the same on all its rows.

    A step either sets the quantity (`fixed`) or adds `plus` and then caps
    at `cap`. Chaining steps gives a step again, so the rows of a line can
    be chained in chunks first and the chunks afterwards.
    """
    whole = Window.partitionBy(*keys)
    running = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last_fixed = F.max(F.when(F.col("fixed").isNotNull(), F.col(order))).over(whole)
    marked = rows.withColumn("_last", last_fixed)
    counts = F.col("_last").isNull() | (F.col(order) > F.col("_last"))
    summed = marked.withColumn("_plus", F.when(counts, F.col("plus")).otherwise(0)).withColumn(
        "_sum", F.sum("_plus").over(running)
    )
    total, room = F.sum("_plus"), F.min(F.when(counts, F.col("cap") - F.col("_sum")))
    start = F.max_by("fixed", F.when(F.col("fixed").isNotNull(), F.col(order)))
    return summed.groupBy(*keys).agg(
        F.when(start.isNotNull(), F.least(start, room) + total).alias("fixed"),
        total.alias("plus"),
        (room + total).alias("cap"),
        F.min("available_stock").alias("available_stock"),
        F.min("added_seq").alias("added_seq"),
    )


def cart_fold(events: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Replay add / remove / set / clear events in `seq` order into cart lines.

    `seq` must be unique. Products of a cart only meet at a clear, so after
    the last clear the replay runs per (cart, product). There it is cut
    into chunks of the sequence, each at most 2 ** chunk_bits rows: a line
    with very many events spreads over tasks, and only one row per chunk
    is ordered per line.
    """
    line, part = ["cart_id", "product_id"], ["cart_id", "product_id", "chunk"]
    adds, sets = F.col("action") == "add", F.col("action") == "set"
    live = (
        _after_last_clear(events)
        .withColumn("chunk", F.shiftright("seq", chunk_bits))
        .withColumn(
            "quantity",
            F.when(adds, F.coalesce("quantity", F.lit(DEFAULT_QUANTITY)))
            .otherwise(F.col("quantity"))
            .cast("long"),
        )
        .withColumn("available_stock", F.coalesce("available_stock", F.lit(DEFAULT_STOCK)))
        .withColumn("removes", (F.col("action") == "remove") | (sets & (F.col("quantity") <= 0)))
        .select(*part, "seq", "action", "quantity", "available_stock", "removes")
    )

    # Where each line begins: the first add after the line's last removal.
    within = Window.partitionBy(*part)
    removed_in_chunk = F.max(F.when(F.col("removes"), F.col("seq"))).over(within)
    begins = adds & (F.col("_removed").isNull() | (F.col("seq") > F.col("_removed")))
    begin = F.struct("seq", "quantity", "available_stock")
    per_chunk = (
        live.withColumn("_removed", removed_in_chunk)
        .groupBy(*part)
        .agg(
            F.max("_removed").alias("_removed"),
            F.min(F.when(begins, begin)).alias("_begin"),
        )
    )
    over_line = Window.partitionBy(*line)
    removal_chunk = F.max(F.when(F.col("_removed").isNotNull(), F.col("chunk"))).over(over_line)
    origins = (
        per_chunk.withColumn("_from", F.coalesce(removal_chunk, F.col("chunk")))
        .filter(F.col("chunk") >= F.col("_from"))
        .withColumn("begin", F.min("_begin").over(over_line))
        .filter(F.col("begin").isNotNull())
        .select(*part, "begin")
    )

    # Every later event becomes a quantity step.
    stock = F.col("begin.available_stock")
    is_begin = F.col("seq") == F.col("begin.seq")
    raises = sets & (F.col("quantity") > stock)
    steps = (
        live.join(origins, part)
        .filter((F.col("seq") >= F.col("begin.seq")) & ~F.coalesce("removes", F.lit(False)))
        .filter(adds | F.col("quantity").isNotNull())
        .select(
            *part,
            "seq",
            F.when(is_begin | (sets & ~raises), F.col("quantity")).alias("fixed"),
            F.when(adds & ~is_begin, F.col("quantity")).otherwise(0).alias("plus"),
            F.when(raises, F.col("quantity")).alias("cap"),
            stock.alias("available_stock"),
            F.col("begin.seq").alias("added_seq"),
        )
    )
    lines = _chained(_chained(steps, part, "seq"), line, "chunk")
    return lines.select(
        *line, F.col("fixed").alias("quantity"), "available_stock", "added_seq"
    )


def cart_line_merge(adds: DataFrame) -> DataFrame:
    """One line per cart and product: quantities summed, first stock kept."""
    return adds.groupBy("cart_id", "product_id").agg(
        F.sum("quantity").alias("quantity"),
        F.min_by("available_stock", "seq").alias("available_stock"),
        F.min("seq").alias("added_seq"),
    )


def priced_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Cart lines with the product's current name and price."""
    current = products.select(F.col("id").alias("product_id"), "name", "price")
    return lines.join(current, "product_id")


def cart_lines_view(priced: DataFrame) -> DataFrame:
    over = F.col("quantity") > F.col("available_stock")
    return priced.select(
        "*",
        (F.col("price") * F.col("quantity")).cast(schemas.MONEY).alias("subtotal"),
        over.alias("over_stock"),
        F.when(
            over,
            F.concat(F.lit("Only "), F.col("available_stock").cast("string"), F.lit(" available")),
        ).alias("stock_warning"),
    )


def cart_totals(priced: DataFrame) -> DataFrame:
    """Exact total per cart (the shop's client adds binary floats)."""
    amount = F.sum(F.col("price") * F.col("quantity"))
    return priced.groupBy("cart_id").agg(amount.cast(schemas.MONEY).alias("total"))


def cart_item_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("cart_id").agg(F.sum("quantity").alias("item_count"))


def stock_gate(priced: DataFrame) -> DataFrame:
    """Whether a cart may check out, and its first line that may not."""
    over = F.col("quantity") > F.col("available_stock")
    offender = F.min_by(
        F.struct("product_id", "name", "available_stock"), F.when(over, F.col("added_seq"))
    )
    gated = priced.groupBy("cart_id").agg(F.max(over).alias("_blocked"), offender.alias("_line"))
    message = F.concat(
        F.lit('Not enough stock for "'), F.col("_line.name"), F.lit('". Only '),
        F.col("_line.available_stock").cast("string"), F.lit(" available."),
    )
    return gated.select(
        "cart_id",
        (~F.col("_blocked")).alias("passes"),
        F.when(F.col("_blocked"), F.col("_line.product_id")).alias("first_product_id"),
        F.when(F.col("_blocked"), message).alias("message"),
    )


def order_request_items(priced: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Cart lines as lines of an order request, in cart order at the current price.

    The lines are written once, since numbering looks at them several times.
    """
    priced = materialize(priced.select("cart_id", "product_id", "quantity", "price", "added_seq"), "cart-lines")
    placed = row_positions(priced, "cart_id", ["added_seq"], "item_pos", hot_rows)
    return placed.select(
        "cart_id",
        "item_pos",
        "product_id",
        F.col("quantity").cast("int").alias("quantity"),
        F.col("price").alias("unit_price"),
    )


def order_request_lists(lines: DataFrame, page_items: int = PAGE_ITEMS) -> DataFrame:
    """Cart lines (`order_request_items`) nested as the request's item list, see `item_pages`."""
    return item_pages(lines, "cart_id", F.struct("product_id", "quantity", "unit_price"), page_items)


class PaymentRequests(NamedTuple):
    requests: DataFrame
    items: DataFrame

    def nested(self, page_items: int = PAGE_ITEMS) -> DataFrame:
        """Requests with the list of their items, a row per page of it."""
        pages = item_pages(self.items, "order_id", F.struct("product_id", "quantity"), page_items)
        bare = self.requests.join(self.items.select("order_id").distinct(), "order_id", "left_anti")
        return with_item_pages(self.requests, pages, "order_id", bare)


def payment_request(orders: DataFrame, items: DataFrame) -> PaymentRequests:
    """Created orders to payment requests: the order's total, and its items."""
    return PaymentRequests(
        orders.select(F.col("id").alias("order_id"), "customer_id", F.col("total_amount").alias("amount")),
        items.select("order_id", "item_pos", "product_id", "quantity"),
    )


class CheckoutRequests(NamedTuple):
    requests: DataFrame
    lines: DataFrame


def checkout_requests(
    priced: DataFrame, customer: Column | None = None, hot_rows: int | None = None
) -> CheckoutRequests:
    """Order requests of the carts that pass the stock gate, with their lines."""
    passing = stock_gate(priced).filter("passes").select("cart_id")
    lines = order_request_items(priced.join(passing, "cart_id", "left_semi"), hot_rows)
    return CheckoutRequests(
        passing.withColumn("customer_id", F.col("cart_id") if customer is None else customer), lines
    )
