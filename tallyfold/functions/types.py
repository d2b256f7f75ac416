"""Spellings of column types for comparison, DDL text and diagrams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sized(name: str, *sizes: Column) -> Column:
    return F.concat(F.lit(f"{name}("), F.concat_ws(",", *[s.cast("string") for s in sizes]), F.lit(")"))


def _set(size: Column) -> Column:
    """Given, and not zero."""
    return F.coalesce(size, F.lit(0)) != 0


def compare_type(data_type: Column, precision: Column, scale: Column) -> Column:
    """Upper case; NUMERIC carries its sizes when both are set."""
    name = F.upper(data_type)
    return F.when((name == "NUMERIC") & _set(precision) & _set(scale), _sized("NUMERIC", precision, scale)).otherwise(
        name
    )


def is_serial(data_type: Column, default: Column) -> Column:
    """An integer filled from a sequence."""
    return (F.upper(data_type) == "INTEGER") & F.coalesce(F.lower(default).contains("nextval"), F.lit(False))


def ddl_type(data_type: Column, default: Column, length: Column, precision: Column, scale: Column) -> Column:
    """The type as written in CREATE TABLE."""
    name = F.upper(data_type)
    return (
        F.when(is_serial(data_type, default), "SERIAL")
        .when(name.isin("CHARACTER VARYING", "VARCHAR") & _set(length), _sized("VARCHAR", length))
        .when(name.isin("CHARACTER VARYING", "VARCHAR", "CHARACTER", "CHAR"), "TEXT")
        .when((name == "NUMERIC") & _set(precision) & _set(scale), _sized("NUMERIC", precision, scale))
        .when((name == "NUMERIC") & _set(precision), _sized("NUMERIC", precision))
        .otherwise(name)
    )


def diagram_type(type_name: Column) -> Column:
    """Types without sizes; TEXT when none is given."""
    return (
        F.when(type_name.startswith("NUMERIC"), "DECIMAL")
        .when(type_name.startswith("TIMESTAMP"), "TIMESTAMP")
        .otherwise(F.coalesce(type_name, F.lit("TEXT")))
    )


def same_type(left: Column, right: Column) -> Column:
    """Equal, or INTEGER against SERIAL: both are stored alike."""
    integers = ("INTEGER", "SERIAL")
    a, b = F.upper(left), F.upper(right)
    return (a == b) | (a.isin(*integers) & b.isin(*integers))
