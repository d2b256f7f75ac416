"""Side-by-side comparison of a registered query with its SQL on DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

from tallyfold.plans.tables import COLUMNS


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in COLUMNS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_plain(row[i]) for i in order) for row in rows)


_KINDS = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "DOUBLE": "double",
    "FLOAT": "float",
    "TIMESTAMP": "timestamp_ntz",
}


def compare(spark_df, con, sql: str) -> str:
    """Empty when columns, types and rows agree, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: _KINDS.get(str(d[1]), str(d[1]).lower()) for d in cursor.description}
    expected_columns, expected = _bag(names, cursor.fetchall())
    columns, actual = _bag(spark_df.columns, spark_df.collect())
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    types = {f.name: f.dataType.simpleString() for f in spark_df.schema}
    if types != kinds:
        return f"types {types} != {kinds}"
    if actual != expected:
        surplus, lacking = actual - expected, expected - actual
        return (
            f"rows {sum(actual.values())} vs {sum(expected.values())}; only spark {sum(surplus.values())}: "
            f"{list(surplus)[:4]}; only sql {sum(lacking.values())}: {list(lacking)[:4]}"
        )
    return "" if actual else "no rows on either side"
