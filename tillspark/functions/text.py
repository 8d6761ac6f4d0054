"""Text tests and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_blank(col: Column | str) -> Column:
    """Null, empty, or nothing but characters up to the space (trim() would leave tabs in place)."""
    col = F.col(col) if isinstance(col, str) else col
    return col.isNull() | col.rlike(r"^[\x00-\x20]*$")


def contains_ignoring_case(col: Column | str, needle: str, literal: bool = False) -> Column:
    """`%` and `_` in the needle stay wildcards unless `literal` is set."""
    lowered = F.lower(col)
    if literal:
        return lowered.contains(needle.lower())
    return lowered.like(f"%{needle.lower()}%")


def price_label(amount: Column | str) -> Column:
    """Euro text with thousands separators and two decimals."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    sign = F.when(amount < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.lit("€"), F.format_number(F.abs(amount), 2))


def minor_units(amount: Column | str) -> Column:
    """Cents, cut toward zero."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    return (amount * 100).cast("long")


def enum_or_null(col: Column | str, allowed: tuple[str, ...]) -> Column:
    """The value when it is an allowed name, otherwise null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col.isin(*allowed), col)
