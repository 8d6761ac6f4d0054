"""Table updates as transforms that return the new table."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F, types as T

from tillspark.functions.positions import assign_ids, largest_id


class Update(NamedTuple):
    """The new table and the requests that could not be applied."""

    table: DataFrame
    rejects: DataFrame


def pick_by_seq(df: DataFrame, key: str | Sequence[str], seq: str, first: bool = False) -> DataFrame:
    """One row per key: the last by sequence, or the first.

    An aggregate and not a window: partial results combine before the
    shuffle, so a hot key costs one row per map task. `seq` must be unique
    within a key. Numeric rows go through the aggregate whole. Text would
    make it sort all rows, so there only key and sequence do, and the rows
    are then picked by both; that pair is one row, so no key is hot.
    """
    key = [key] if isinstance(key, str) else list(key)
    rest = [f for f in df.schema if f.name not in key]
    if all(isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType, T.TimestampNTZType)) for f in rest):
        pick = F.min_by if first else F.max_by
        return df.groupBy(*key).agg(*[pick(f.name, seq).alias(f.name) for f in rest])
    end = F.min(seq) if first else F.max(seq)
    picked = df.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(end.alias("_end"))
    same = F.col(seq).eqNullSafe(F.col("_end"))
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(picked, same, "left_semi").select(*key, *[f.name for f in rest])


def upsert_by_key(table: DataFrame, rows: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """Insert or replace whole rows by key.

    Without `seq` the new rows must have one row per key; with it the last
    row per key counts, and the sequence itself is not stored.
    """
    if seq is not None:
        rows = pick_by_seq(rows, key, seq).drop(seq)
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def insert_absent(table: DataFrame, rows: DataFrame, key: str, seq: str, id_col: str = "id") -> DataFrame:
    """Keep the table and add only rows whose key it lacks; re-running adds nothing.

    Of several new rows with one key the first by sequence is added, as
    if they had been inserted one after the other. Added rows are numbered
    on from the table's largest id, by sequence and then key.
    """
    first = pick_by_seq(rows.drop(id_col), key, seq, first=True)
    added = assign_ids(first.join(table.select(key), key, "left_anti"), [seq, key], id_col, largest_id(table, id_col))
    return table.unionByName(added.drop(seq), allowMissingColumns=True)


def overwrite_fields(
    table: DataFrame, changes: DataFrame, key: str, fields: Sequence[str]
) -> DataFrame:
    """Replace fields of matched rows; null overwrites too, so no coalesce."""
    new = changes.select(
        key, *[F.col(f).alias(f"_new_{f}") for f in fields], F.lit(True).alias("_hit")
    )
    joined = table.join(new, key, "left")
    columns = [
        F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        if c in fields
        else F.col(c)
        for c in table.columns
    ]
    return joined.select(*columns)
