"""Catalog files: raw text tokens to typed rows, and the table definitions they document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.ddl import reference_parts
from tallyfold.functions.identifiers import schema_part, table_part
from tallyfold.functions.text import strip
from tallyfold.functions.tokens import bool_token, empty_to_null, is_table_row, null_token, order_number
from tallyfold.schemas import CATALOG_HEADER
from tallyfold.sources.csv_files import read_by_header


def read_catalog(spark: SparkSession, paths: str | list[str], multi_line: bool = True, file: str | None = None) -> DataFrame:
    """Raw tokens of catalog files, columns bound by the header of each file."""
    return read_by_header(spark, paths, CATALOG_HEADER, multi_line=multi_line, file=file)


def typed_catalog(raw: DataFrame, *kept: str) -> DataFrame:
    """CATALOG rows from raw tokens, with the columns ``kept``; rows about the table itself have order 0 and no column."""
    c = {name: F.col(f"`{name}`") for name in CATALOG_HEADER}
    return raw.select(
        c["Table"].alias("table"),
        null_token(c["Column"]).alias("column"),
        F.when(is_table_row(c["Order"]), F.lit(0).cast("long")).otherwise(order_number(c["Order"])).alias("order"),
        c["Type"].alias("type"),
        bool_token(c["Nullable?"]).alias("nullable"),
        bool_token(c["Primary Key?"]).alias("primary_key"),
        empty_to_null(strip(c["Foreign Key"])).alias("foreign_key"),
        empty_to_null(c["Description"]).alias("description"),
        empty_to_null(c["Sample Values"]).alias("sample_values"),
        *kept,
    )


def documented_columns(catalog: DataFrame) -> DataFrame:
    """Catalog rows about columns, tokens stripped."""
    return catalog.where(F.col("order") != 0).withColumns(
        {"table": strip(F.col("table")), "column": F.coalesce("column", F.lit("")), "type": strip(F.col("type"))}
    )


def table_definitions(catalog: DataFrame, schemas: list[str], folder_schema: str | None = None) -> DataFrame:
    """``(schema, name, column, order, type, primary_key, ref)`` of the tables of the given schemas.

    Rows of order 0 stand for the table itself. ``ref`` is the struct of a well-formed foreign key. A table whose schema differs from that of the
    folder it was found in (column ``folder_schema``) is left out, as is a name without a schema.
    """
    rows = catalog.where(F.col("table").contains(".")).withColumns(
        {"schema": schema_part(F.col("table")), "name": table_part(F.col("table"))}
    )
    rows = rows.where(F.col("schema").isin(*schemas))
    if folder_schema is not None:
        rows = rows.where(F.col("schema") == F.col(folder_schema))
    return rows.select(
        "schema",
        "name",
        F.coalesce("column", F.lit("")).alias("column"),
        "order",
        "type",
        F.coalesce("primary_key", F.lit(False)).alias("primary_key"),
        reference_parts(strip(F.col("foreign_key"))).alias("ref"),
    )
