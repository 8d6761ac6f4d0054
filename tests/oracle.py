"""Compare a Spark result with DuckDB's on the same test folder."""

from __future__ import annotations

import collections
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _kind(arrow_type) -> str:
    return str(arrow_type).replace("large_", "").replace("[ns]", "[us]")


def _rows(table) -> collections.Counter:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]

    def plain(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else value
        return repr(value) if isinstance(value, (list, dict)) else value

    return collections.Counter(tuple(plain(v) for v in row) for row in zip(*columns))


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when names, types and rows agree, else what differs."""
    mine = spark_df.toArrow()
    theirs = con.sql(sql).to_arrow_table()
    kinds = [{f.name: _kind(f.type) for f in t.schema} for t in (mine, theirs)]
    if kinds[0] != kinds[1]:
        odd = {k: (kinds[0].get(k), kinds[1].get(k)) for k in kinds[0].keys() | kinds[1].keys()}
        return f"schema {({k: v for k, v in odd.items() if v[0] != v[1]})}"
    a, b = _rows(mine), _rows(theirs)
    if a != b:
        return (
            f"rows {sum(a.values())} vs {sum(b.values())}; "
            f"only spark {list((a - b).items())[:2]}; only sql {list((b - a).items())[:2]}"
        )
    return None
