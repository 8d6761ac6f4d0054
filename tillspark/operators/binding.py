"""Request bodies bound to a declared schema, with the fields that do not fit."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tillspark import schemas
from tillspark.functions.codec import parsed_once
from tillspark.functions.text import enum_or_null
from tillspark.operators.rejects import error_code


class Field(NamedTuple):
    """A field of a body: its name there, its column, its type, and the names it may have."""

    name: str
    column: str
    kind: T.DataType
    allowed: tuple[str, ...] | None = None


class Bound(NamedTuple):
    valid: DataFrame
    rejects: DataFrame


_TEXT, _LONG, _DOUBLE = T.StringType(), T.LongType(), T.DoubleType()

PRODUCT_REQUEST = (
    Field("name", "name", _TEXT),
    Field("brand", "brand", _TEXT),
    Field("category", "category", _TEXT, schemas.CATEGORIES),
    Field("price", "price", schemas.MONEY),
    Field("description", "description", _TEXT),
    Field("imageUrl", "image_url", _TEXT),
    Field("width", "width", _DOUBLE),
)
STATUS_REQUEST = (
    Field("orderId", "order_id", _LONG),
    Field("status", "status", _TEXT, schemas.ORDER_STATUSES),
)


def _fitted(field: Field, text: Column) -> Column:
    return enum_or_null(text, field.allowed) if field.allowed else text.try_cast(field.kind)


def bind_requests(requests: DataFrame, fields: tuple[Field, ...], body: str = "body") -> Bound:
    """JSON bodies as typed columns, and requests that do not bind.

    The body is parsed once, all fields as text, and each is then fitted to
    its type or its allowed names. A missing or null field is null and left
    to validation; a field that is there and does not fit is an error of the
    request, told in `errors` by the field's name. A body that is no JSON
    object has one error, under `body`. Other fields are ignored.
    """
    shape = T.StructType([T.StructField(f.name, _TEXT) for f in fields])
    parsed = parsed_once(requests, F.from_json(body, shape), "_fields")
    # Bad JSON gives a row of nulls, so that it takes a look at the text itself.
    broken = F.get_json_object(body, "$").isNull() | ~F.ltrim(body).startswith("{")
    wrong = [
        F.when(
            F.col(f"_fields.{f.name}").isNotNull() & _fitted(f, F.col(f"_fields.{f.name}")).isNull(),
            F.struct(
                F.lit(f.name).alias("key"),
                F.concat(F.lit("Not valid: "), F.col(f"_fields.{f.name}")).alias("value"),
            ),
        )
        for f in fields
    ]
    unread = F.array(F.struct(F.lit("body").alias("key"), F.lit("Malformed request body").alias("value")))
    errors = F.when(F.coalesce(broken, F.lit(True)), unread).otherwise(
        F.filter(F.array(*wrong), lambda e: e.isNotNull())
    )
    marked = parsed_once(parsed, errors, "_errors")
    others = [F.col(c) for c in requests.columns if c != body]
    return Bound(
        marked.filter(F.size("_errors") == 0).select(
            *others, *[_fitted(f, F.col(f"_fields.{f.name}")).alias(f.column) for f in fields]
        ),
        marked.filter(F.size("_errors") > 0).select(
            *others, F.map_from_entries("_errors").alias("errors"), error_code(F.lit("INVALID")).alias("error_code")
        ),
    )
