"""JSON in and out of columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tillspark import schemas

_CORRUPT = "_corrupt"


def encode(*fields: Column) -> Column:
    """One JSON object, null fields written out."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def parse_items(col: Column | str) -> Column:
    """Items text to an array; null, empty or bad text gives an empty array."""
    kind = T.ArrayType(schemas.ITEM_QUANTITY)
    return F.coalesce(F.from_json(col, kind), F.array().cast(kind))


def session_id(kind: Column, decoded: Column, raw: Column) -> Column:
    """Session id of a webhook event.

    The decoded object's id wins; only completed events may fall back on
    the id field of the raw text.
    """
    fallback = F.when(
        kind == "checkout.session.completed", F.get_json_object(raw, "$.id")
    )
    return F.coalesce(decoded, fallback)


def parsed_once(df: DataFrame, parsed: Column, name: str) -> DataFrame:
    """`df` with a column that is worked out once, whatever reads it.

    As a generated column it is out of reach of the optimiser, which would
    put the parser into every later filter and projection.
    """
    return df.select("*", F.explode(F.array(parsed)).alias(name))


def bind_events(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Every row with its payload as `event` and whether it is `malformed`."""
    wide = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    bound = parsed_once(df, F.from_json(value, wide, options), "event")
    bad = F.col("event").isNull() | F.col(f"event.{_CORRUPT}").isNotNull()
    return bound.withColumn("malformed", bad).withColumn("event", F.col("event").dropFields(_CORRUPT))


class Decoded(NamedTuple):
    valid: DataFrame
    quarantine: DataFrame


def decode_events(
    df: DataFrame,
    schema: T.StructType,
    value: str = "value",
    on_error: str = "quarantine",
) -> Decoded:
    """Bind the payload to `event`, splitting off payloads that do not bind.

    `on_error="fail"` stops the job at the first bad payload, which is
    how the notification listeners behave.
    """
    if on_error == "fail":
        bound = F.from_json(value, schema, {"mode": "FAILFAST"})
        checked = F.when(
            F.length(F.trim(F.coalesce(value, F.lit("")))) == 0,
            F.raise_error(F.lit("empty payload")).cast(schema),
        ).otherwise(bound)
        return Decoded(df.withColumn("event", checked), df.filter(F.lit(False)))
    if on_error != "quarantine":
        raise ValueError(f"unknown on_error: {on_error}")
    bound = bind_events(df, schema, value)
    return Decoded(
        bound.filter(~F.col("malformed")).drop("malformed"),
        bound.filter("malformed").drop("event", "malformed"),
    )
