"""Numbering rows without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillspark.session import materialize

HOT_ROWS = 1_000_000
_ROW = "_row"


def largest_id(df: DataFrame, column: str) -> DataFrame:
    """Largest value of an id column, 0 for an empty table, as a one-row table."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).alias("_start"))


def assign_ids(
    df: DataFrame,
    order_by: Sequence[str],
    id_col: str = "id",
    start: int | DataFrame = 0,
    parts: int | None = None,
) -> DataFrame:
    """Number rows start+1, start+2, ... along a unique sort key.

    `start` may be a one-row table, see `largest_id`.

    The sort is a range shuffle over the whole key, so partitions stay
    even; without `parts`, adaptive execution joins small ones. Only one row per partition goes into the offset sum. The sorted
    rows are written out once: the range bounds come from a sample, and
    counting and numbering must see the same bounds.
    """
    width = () if parts is None else (parts,)
    sorted_rows = materialize(
        df.repartitionByRange(*width, *order_by)
        .sortWithinPartitions(*order_by)
        .withColumn(_ROW, F.monotonically_increasing_id()),
        "ids",
    )
    block = F.shiftright(_ROW, 33)
    within = F.col(_ROW).bitwiseAND(F.lit((1 << 33) - 1))
    # One row per partition from here on, so the one-task window is bounded.
    sizes = sorted_rows.groupBy(block.alias("_block")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")
    )
    if isinstance(start, DataFrame):
        offsets = offsets.crossJoin(F.broadcast(start))  # one row
    else:
        offsets = offsets.withColumn("_start", F.lit(start))
    numbered = sorted_rows.withColumn("_block", block).join(F.broadcast(offsets), "_block")
    return numbered.withColumn(
        id_col, F.col("_start") + F.col("_before") + within + 1
    ).drop("_block", "_before", "_start", _ROW)


def row_positions(
    df: DataFrame,
    key: str,
    order_by: Sequence[Column | str],
    out: str,
    hot_rows: int | None = None,
) -> DataFrame:
    """Position 1, 2, ... of each row within its key.

    Keys of up to `hot_rows` rows (HOT_ROWS unless given) use a window. Larger keys are numbered
    by `assign_ids` over (key, order), then shifted by the key's first
    number, so that no task holds such a key. There are at most
    rows / hot_rows large keys, which bounds the broadcast.
    """
    hot_rows = hot_rows or HOT_ROWS
    plain = Window.partitionBy(key).orderBy(*order_by)
    position = F.row_number().over(plain).cast("long")
    if df.count() <= hot_rows:
        return df.withColumn(out, position)
    hot = df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
    hot = materialize(hot.select(key), "hot")
    if hot.isEmpty():
        return df.withColumn(out, position)
    cold_rows = df.join(F.broadcast(hot), key, "left_anti").withColumn(out, position)
    numbered = assign_ids(
        df.join(F.broadcast(hot), key, "left_semi"), [key, *order_by], "_index"
    )
    first = numbered.groupBy(key).agg(F.min("_index").alias("_first"))
    hot_positions = numbered.join(F.broadcast(first), key).withColumn(
        out, F.col("_index") - F.col("_first") + 1
    )
    return cold_rows.unionByName(hot_positions.select(cold_rows.columns))
