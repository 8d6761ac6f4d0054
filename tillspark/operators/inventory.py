"""Stock rows: view, creation, absolute and relative changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tillspark.functions.positions import assign_ids, largest_id

from tillspark.operators import lookups, updates
from tillspark.operators.rejects import with_error

CONFLICT_TEXT = "Inventory already exists for product: "  # fixed value


def inventory_view(inventory: DataFrame) -> DataFrame:
    return inventory.withColumn("available", F.col("quantity") - F.col("reserved"))


def inventory_for_products(inventory: DataFrame, keys: DataFrame) -> DataFrame:
    """Stock of the wanted products; products without a row are missing."""
    return inventory_view(lookups.rows_for_keys(inventory, keys, "product_id"))


def inventory_exists(keys: DataFrame, inventory: DataFrame) -> DataFrame:
    return lookups.key_exists(keys, inventory, "product_id")


def new_inventory_rows(requests: DataFrame, start: int | DataFrame = 0, order_by: Sequence[str] = ("product_id", "quantity")) -> DataFrame:
    """Requests as stock rows, numbered on from `start`."""
    rows = requests.select(*dict.fromkeys([*order_by, "product_id", "quantity"]))
    made = assign_ids(rows, list(order_by), "id", start)
    return made.select("id", "product_id", "quantity", F.lit(0).alias("reserved"))


def seed_inventory(inventory: DataFrame, rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Insert rows whose product has none yet."""
    return updates.insert_absent(inventory, rows, "product_id", seq)


def create_inventory(inventory: DataFrame, requests: DataFrame, seq: str) -> updates.Update:
    """The table with the new rows, and requests rejected because the product has a row.

    Within one batch the first request of a product wins; the others are
    rejected as if they had come after it.
    """
    fresh = requests.join(inventory.select("product_id"), "product_id", "left_anti")
    winners = updates.pick_by_seq(fresh, "product_id", seq, first=True)
    taken = requests.join(inventory.select("product_id"), "product_id", "left_semi")
    first = winners.select("product_id", F.col(seq).alias("_first"))
    late = fresh.join(first, "product_id").filter(F.col(seq) != F.col("_first")).drop("_first")
    rejects = with_error(
        taken.unionByName(late),
        "CONFLICT",
        F.concat(F.lit(CONFLICT_TEXT), F.col("product_id").cast("string")),
    )
    made = new_inventory_rows(winners, largest_id(inventory, "id"), [seq])
    return updates.Update(inventory.unionByName(made), rejects)


def set_stock(inventory: DataFrame, changes: DataFrame, seq: str) -> updates.Update:
    """Absolute quantity, no lower bound; the last change per product wins."""
    last = updates.pick_by_seq(changes, "product_id", seq)
    return updates.Update(
        updates.overwrite_fields(inventory, last, "product_id", ["quantity"]),
        lookups.reject_unknown(
            changes, inventory, "product_id", lookups.NOT_FOUND_TEXT["inventory"]
        ),
    )


def increase_stock(inventory: DataFrame, changes: DataFrame) -> updates.Update:
    """Add quantities; the order of additions does not matter."""
    added = changes.groupBy("product_id").agg(F.sum("quantity").alias("_added"))
    table = inventory.join(added, "product_id", "left").select(
        *[
            (F.col("quantity") + F.coalesce("_added", F.lit(0))).cast("int").alias(c)
            if c == "quantity"
            else F.col(c)
            for c in inventory.columns
        ]
    )
    return updates.Update(
        table,
        lookups.reject_unknown(
            changes, inventory, "product_id", lookups.NOT_FOUND_TEXT["inventory"]
        ),
    )


def event_items_inventory(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """Event lines with their product's stock row; `found` is false without one."""
    stock = inventory.select("product_id", F.col("quantity").alias("stock"), "reserved").withColumn(
        "found", F.lit(True)
    )
    return lines.join(stock, "product_id", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )
