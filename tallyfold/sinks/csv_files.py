"""CSV snapshots and catalog files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from tallyfold.functions.tokens import bool_text
from tallyfold.schemas import CATALOG_HEADER

# As quoted fields may span lines a file is read by one task, so files are kept short.
ROWS_PER_FILE = 200_000


def _nested_as_json(df: DataFrame) -> DataFrame:
    nested = (ArrayType, MapType, StructType, VariantType)
    return df.select(
        *[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else f"`{f.name}`" for f in df.schema]
    )


def write_csv(
    df: DataFrame,
    path: str,
    order_by: list[str] | None = None,
    keep_empty: bool = True,
    rows_per_file: int = ROWS_PER_FILE,
) -> None:
    """Header and rows, quoted only where needed; without ``order_by`` nothing is sorted or moved.

    NULL is written as nothing. Empty text is written as ``""``, or like NULL without ``keep_empty``.
    """
    (
        _nested_as_json(df.orderBy(*order_by) if order_by else df)
        .write.options(
            header=True,
            escape='"',
            nullValue="",
            emptyValue='""' if keep_empty else "",
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
            maxRecordsPerFile=rows_per_file,
        )
        .csv(path)
    )


def catalog_rows(catalog: DataFrame) -> DataFrame:
    """CATALOG rows as the text tokens of a catalog file."""
    blank = F.lit("")
    columns = [
        F.col("table"),
        F.coalesce("column", F.lit("NULL")),
        F.col("order").cast("string"),
        F.col("type"),
        bool_text(F.col("nullable")),
        bool_text(F.col("primary_key")),
        F.coalesce("foreign_key", blank),
        F.coalesce("description", blank),
        F.coalesce("sample_values", blank),
    ]
    return catalog.select(*[c.alias(name) for c, name in zip(columns, CATALOG_HEADER)])


def write_catalogs(catalog: DataFrame, path: str, table_names: DataFrame | None = None) -> None:
    """One folder of catalog files per table, rows in column order.

    Ranges of (table, order) are the unit of work, so a table of any length is written by several tasks.
    With ``table_names`` (table) only tables with a definition are written.
    """
    kept = catalog if table_names is None else catalog.join(table_names, "table", "left_semi")
    ordered = kept.repartitionByRange("table", "order").sortWithinPartitions("table", "order")
    rows = catalog_rows(ordered).withColumn("table_name", F.col("Table"))
    rows.write.options(header=True, escape='"', emptyValue="").partitionBy("table_name").csv(path)
