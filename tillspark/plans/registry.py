"""Queries by name, each with the SQL it is checked against, if any."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillspark.session import SETTINGS
from tillspark.sources.standins import DERIVED_SQL, VIEWS, Tables

Plan = Callable[[Tables], DataFrame]

PLANS: dict[str, Plan] = {}
CHECKS: dict[str, str] = {}

_RAW = {name: name for name in ("part", "orders", "lineitem", "events")}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under a name."""

    def add(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query registered twice: {name}")
        PLANS[name] = plan
        if sql is not None:
            CHECKS[name] = with_views(sql)
        return plan

    return add


def _views() -> dict[str, str]:
    plain = {name: text.format(**_RAW, ntz="") for name, text in VIEWS.items()}
    return plain | DERIVED_SQL


def with_views(sql: str) -> str:
    """Put the stand-in views that the text uses in front of it."""
    views = _views()
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in views.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    prelude = ",\n".join(f"{name} AS ({views[name]})" for name in needed)
    body = sql.strip()
    recursive = ""
    if body.upper().startswith("WITH RECURSIVE"):
        recursive, body = "RECURSIVE ", ", " + body[len("WITH RECURSIVE"):]
    elif body.upper().startswith("WITH"):
        body = ", " + body[len("WITH"):]
    return f"WITH {recursive}{prelude}\n{body}"


def runner(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    """The plan as a function of session and test folder."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        for key, value in SETTINGS.items():
            if spark.conf.isModifiable(key):
                spark.conf.set(key, value)
        return plan(Tables(spark, folder))

    return run
