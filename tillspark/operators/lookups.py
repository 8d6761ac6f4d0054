"""Keyed lookups, existence tests and key-set filters.

All of them take the wanted keys as a DataFrame, so one call serves any
number of keys. The looked-up table has one row per key; adaptive
execution broadcasts the small side or splits a hot key of the large one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tillspark.operators.rejects import with_error

# Not-found texts, followed by the key.
NOT_FOUND_TEXT = {
    "product": "Product not found with id: ",
    "order": "Order not found with id: ",
    "inventory": "Inventory not found for product: ",
    "payment_by_order": "Payment not found for order: ",
    "payment_by_session": "Payment not found for session: ",
}


def lookup_keys(keys: DataFrame, table: DataFrame, key: str, text: str) -> DataFrame:
    """Every wanted key with its row; missing ones carry 404 and a message."""
    found = table.withColumn("found", F.lit(True))
    joined = keys.select(key).join(found, key, "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )
    missing = F.concat(F.lit(text), F.col(key).cast("string"))
    return joined.select(
        "*",
        F.when(~F.col("found"), F.lit(404)).alias("error_code"),
        F.when(~F.col("found"), missing).alias("message"),
    )


def split_found(looked_up: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits, and misses as rejects."""
    hits = looked_up.filter("found").drop("found", "error_code", "message")
    misses = looked_up.filter(~F.col("found"))
    return hits, misses


def rows_for_keys(table: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is wanted; unknown keys are silently missing."""
    return table.join(keys, on, "left_semi")


def rows_with_value(table: DataFrame, column: str, value: object) -> DataFrame:
    """Rows with one literal value, pushed to the scan."""
    return table.filter(F.col(column) == F.lit(value))


def key_exists(keys: DataFrame, table: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Each wanted key with an `exists` flag."""
    on = [on] if isinstance(on, str) else list(on)
    present = table.select(*on).distinct().withColumn("exists", F.lit(True))
    return keys.join(present, on, "left").withColumn(
        "exists", F.coalesce("exists", F.lit(False))
    )


def reject_unknown(requests: DataFrame, table: DataFrame, key: str, text: str) -> DataFrame:
    """Requests naming a key that the table lacks."""
    return not_found(requests.join(table.select(key), key, "left_anti"), key, text)


def not_found(requests: DataFrame, key: str, text: str) -> DataFrame:
    """Requests whose key is known to be missing, as rejects."""
    return with_error(requests, "NOT_FOUND", F.concat(F.lit(text), F.col(key).cast("string")))
