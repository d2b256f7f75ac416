"""The actual schema: column metadata of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.types import compare_type
from tallyfold.operators.reconcile import last_per_key
from tallyfold.schemas import METADATA

# Schemas that belong to the system.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")


def user_tables(columns: DataFrame) -> DataFrame:
    """Distinct ``schema.table`` names outside the system schemas."""
    return (
        columns.where(~F.col("schema").isin(*SYSTEM_SCHEMAS))
        .select(F.concat_ws(".", "schema", "table").alias("table"))
        .distinct()
    )


def described_columns(columns: DataFrame, primary_keys: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """METADATA rows from raw column rows and the key columns.

    ``columns``: schema, table, column, order, data_type, precision, scale, nullable;
    ``primary_keys``: schema, table, column; ``foreign_keys``: schema, table, column, constraint,
    position, foreign_key. Where several foreign keys share a column, the last constraint counts.
    """
    place = ["schema", "table", "column"]
    pk = primary_keys.select(*place).distinct().withColumn("primary_key", F.lit(True))
    fk = last_per_key(foreign_keys, place, ["constraint", "position", "foreign_key"]).select(*place, "foreign_key")
    return (
        columns.join(pk, place, "left")
        .join(fk, place, "left")
        .select(
            *place,
            "order",
            compare_type(F.col("data_type"), F.col("precision"), F.col("scale")).alias("type"),
            "nullable",
            F.coalesce("primary_key", F.lit(False)).alias("primary_key"),
            "foreign_key",
        )
    )


def columns_of(spark: SparkSession, schema: str, tables: dict[str, DataFrame]) -> DataFrame:
    """METADATA rows of DataFrames, read from their schemas alone."""
    rows = [
        (schema, table, field.name, position, field.dataType.simpleString().upper(), field.nullable, False, None)
        for table, df in sorted(tables.items())
        for position, field in enumerate(df.schema.fields, start=1)
    ]
    return spark.createDataFrame(rows, METADATA)
