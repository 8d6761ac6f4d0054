"""Error codes and messages carried on rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Reason to error code.
CODES = {"NOT_FOUND": 404, "CONFLICT": 409, "INVALID": 400, "PROVIDER": 502}
OTHER_CODE = 500
# Texts of internal and payment-provider errors.
OTHER_TEXT = "An unexpected error occurred"
PROVIDER_TEXT = "Stripe error: "


def error_code(reason: Column | str) -> Column:
    """Code of a reject reason; any other reason counts as internal."""
    reason = F.col(reason) if isinstance(reason, str) else reason
    chain = F
    for name, code in CODES.items():
        chain = chain.when(reason == name, F.lit(code))
    return chain.otherwise(F.lit(OTHER_CODE))


def error_message(reason: Column | str, detail: Column | str) -> Column:
    """Text shown for a reject; internal errors hide their detail."""
    reason = F.col(reason) if isinstance(reason, str) else reason
    detail = F.col(detail) if isinstance(detail, str) else detail
    return (
        F.when(reason == "PROVIDER", F.concat(F.lit(PROVIDER_TEXT), detail))
        .when(reason.isin("NOT_FOUND", "CONFLICT", "INVALID"), detail)
        .otherwise(F.lit(OTHER_TEXT))
    )


def with_error(df: DataFrame, reason: str, detail: Column) -> DataFrame:
    """Add `error_code` and `message` for one reason."""
    return df.withColumn("error_code", error_code(F.lit(reason))).withColumn(
        "message", error_message(F.lit(reason), detail)
    )
