"""Request validation: valid rows and rejects with a field-to-message map."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tillspark import schemas
from tillspark.functions.pages import PAGE_ITEMS
from tillspark.functions.text import is_blank
from tillspark.operators.rejects import error_code, with_error


class Checked(NamedTuple):
    valid: DataFrame
    rejects: DataFrame


class Rule(NamedTuple):
    """A field, the message when it is broken, and the test for broken."""

    field: str
    message: str
    broken: Column


def _errors(rules: list[Rule]) -> Column:
    entries = F.array(
        *[
            F.when(
                F.coalesce(r.broken, F.lit(False)),
                F.struct(F.lit(r.field).alias("key"), F.lit(r.message).alias("value")),
            )
            for r in rules
        ]
    )
    return F.filter(entries, lambda e: e.isNotNull())


def check(df: DataFrame, rules: list[Rule], more: Column | None = None) -> Checked:
    """Split by the rules; `more` is a further array of (key, value) errors."""
    found = _errors(rules)
    if more is not None:
        found = F.concat(found, more)
    marked = df.withColumn("_found", found)
    rejects = (
        marked.filter(F.size("_found") > 0)
        .withColumn("errors", F.map_from_entries("_found"))
        .withColumn("error_code", error_code(F.lit("INVALID")))
    )
    return Checked(marked.filter(F.size("_found") == 0).drop("_found"), rejects.drop("_found"))


def validate_products(requests: DataFrame) -> Checked:
    price = F.col("price")
    # The messages.
    return check(
        requests,
        [
            Rule("name", "Name is required", is_blank("name")),
            Rule("brand", "Brand is required", is_blank("brand")),
            Rule("category", "Category is required", F.col("category").isNull()),
            Rule("price", "Price is required", price.isNull()),
            Rule("price", "Price must be positive", price < 0),
        ],
    )


def _line_rules() -> list[Rule]:
    quantity = F.col("quantity")
    return [
        Rule("productId", "Product ID is required", F.col("product_id").isNull()),
        Rule("quantity", "Quantity is required", quantity.isNull()),
        Rule("quantity", "Quantity must be at least 1", quantity < 1),
        Rule("unitPrice", "Unit price is required", F.col("unit_price").isNull()),
    ]


def validate_order_items(lines: DataFrame, key: str = "request_id") -> DataFrame:
    """Errors of single lines, a row each: key, item_pos, field, message.

    The field names the line by its index, as in `items[0].quantity`.
    """
    found = lines.select(key, "item_pos", F.explode(_errors(_line_rules())).alias("_error"))
    index = (F.col("item_pos") - 1).cast("string")
    return found.select(
        key,
        "item_pos",
        F.concat(F.lit("items["), index, F.lit("]."), F.col("_error.key")).alias("field"),
        F.col("_error.value").alias("message"),
    )


def request_errors(
    requests: DataFrame, lines: DataFrame, key: str = "request_id", page_items: int = PAGE_ITEMS
) -> DataFrame:
    """Every error of whole requests and of their lines as one text per request: key, page, errors, error_code.

    Errors of a line stand on the page of the line, those of the request on
    page 0, so that a request with very many broken lines is no single text.
    """
    page = F.call_function("div", F.col("item_pos") - 1, F.lit(page_items))
    of_lines = validate_order_items(lines, key).select(
        key, page.alias("page"), F.concat_ws(": ", "field", "message").alias("_error")
    )
    # Without the line rules, so that only rules of the request itself are left.
    refused = validate_orders(requests, lines, key=key).rejects.filter("errors IS NOT NULL")
    of_requests = refused.select(
        key, F.lit(0).cast("long").alias("page"), F.explode("errors").alias("_field", "_message")
    ).select(key, "page", F.concat_ws(": ", "_field", "_message").alias("_error"))
    return (
        of_lines.unionByName(of_requests)
        .groupBy(key, "page")
        .agg(F.array_join(F.array_sort(F.collect_list("_error")), "; ").alias("errors"))
        .withColumn("error_code", error_code(F.lit("INVALID")))
    )


def validate_orders(
    requests: DataFrame,
    lines: DataFrame,
    strict_items: bool = False,
    key: str = "request_id",
    count: str | None = None,
) -> Checked:
    """Customer and item list of whole requests, however many lines they have.

    With `strict_items` a request with a broken line is rejected; its error
    says how many, `validate_order_items` says which. Otherwise a line
    lacking price or quantity is not a validation error, but its total
    cannot be computed, so the request still goes to the rejects, with the
    code of an internal error. Lines are counted per request before they
    meet the requests; `count` names a column that keeps their number.
    """
    broken = F.size(_errors(_line_rules())) > 0
    unpriced = F.col("unit_price").isNull() | F.col("quantity").isNull()
    counted = lines.groupBy(key).agg(
        F.count("*").alias("_lines"),
        F.count_if(broken).alias("_broken"),
        F.count_if(unpriced).alias("_unpriced"),
    )
    marked = requests.join(counted, key, "left")
    if count:
        marked = marked.withColumn(count, F.coalesce("_lines", F.lit(0)).cast("int"))
    rules = [
        Rule("customerId", "Customer ID is required", F.col("customer_id").isNull()),
        Rule("items", "Order must have at least one item", F.col("_lines").isNull()),
    ]
    if strict_items:
        many = F.when(
            F.col("_broken") > 0,
            F.struct(F.lit("items").alias("key"), F.concat(F.col("_broken").cast("string"), F.lit(" lines are not valid")).alias("value")),
        )
        checked = check(marked, rules, F.filter(F.array(many), lambda e: e.isNotNull()))
        return Checked(*(df.drop("_lines", "_broken", "_unpriced") for df in checked))
    checked = check(marked, rules)
    internal = (
        checked.valid.filter("_unpriced > 0")
        .withColumn("errors", F.lit(None).cast("map<string,string>"))
        .withColumn("error_code", error_code(F.lit("INTERNAL")))
    )
    parts = checked.valid.filter("_unpriced = 0"), checked.rejects.unionByName(internal)
    return Checked(*(df.drop("_lines", "_broken", "_unpriced") for df in parts))


def validate_payments(requests: DataFrame) -> Checked:
    amount = F.col("amount")
    return check(
        requests,
        [
            Rule("orderId", "Order ID is required", F.col("order_id").isNull()),
            Rule("customerId", "Customer ID is required", F.col("customer_id").isNull()),
            Rule("amount", "Amount is required", amount.isNull()),
            Rule("amount", "Amount must be positive", amount <= 0),
        ],
    )


def validate_inventory(requests: DataFrame) -> Checked:
    quantity = F.col("quantity")
    return check(
        requests,
        [
            Rule("productId", "Product ID is required", F.col("product_id").isNull()),
            Rule("quantity", "Quantity is required", quantity.isNull()),
            Rule("quantity", "Quantity cannot be negative", quantity < 0),
        ],
    )


def unique_key_check(rows: DataFrame, key: str, existing: DataFrame | None = None) -> DataFrame:
    """Keys that would break uniqueness, with their number of new rows."""
    counts = rows.groupBy(key).agg(F.count("*").alias("new_rows"))
    if existing is None:
        return with_error(counts.filter("new_rows > 1"), "CONFLICT", F.lit("duplicate key"))
    stored = existing.select(key).distinct().withColumn("_stored", F.lit(True))
    marked = counts.join(stored, key, "left")
    clash = marked.filter((F.col("new_rows") > 1) | F.col("_stored")).drop("_stored")
    return with_error(clash, "CONFLICT", F.lit("duplicate key"))


def not_null_check(rows: DataFrame, table: str) -> DataFrame:
    """Rows with a null in a required column, and the first such column."""
    missing = F.array_compact(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in schemas.REQUIRED[table]])
    )
    return rows.withColumn("missing", F.concat_ws(",", missing)).filter(F.col("missing") != "")
