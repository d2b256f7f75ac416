"""Which table files a snapshot creates, updates and deletes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.identifiers import schema_part, table_path
from tallyfold.operators.reconcile import presence


def owned(tables: DataFrame, owners: Iterable[str] | None) -> DataFrame:
    """Tables whose schema is one of the owners; all for None or no owners."""
    return tables.where(schema_part(F.col("table")).isin(*owners)) if owners else tables


def snapshot_diff(db_tables: DataFrame, local_tables: DataFrame, owners: Iterable[str] | None = None) -> DataFrame:
    """``(table, action, path)``: create what only the database has, delete what it lacks, update the rest."""
    both = presence(owned(db_tables, owners), owned(local_tables, owners), ["table"])
    action = F.when(~F.col("in_left"), "delete").when(~F.col("in_right"), "create").otherwise("update")
    return both.select("table", action.alias("action"), table_path(F.col("table")).alias("path"))


def snapshot_counts(diff: DataFrame) -> DataFrame:
    """``(action, tables)``."""
    return diff.groupBy("action").agg(F.count(F.lit(1)).alias("tables"))


def files_to_delete(diff: DataFrame, files: DataFrame) -> DataFrame:
    """Existing definition and data files (path) of the tables to delete."""
    gone = diff.where(F.col("action") == "delete").select("path")
    data = gone.select(F.regexp_replace("path", r"[^/]+\z", "seed.csv").alias("path"))
    return files.join(gone.unionByName(data), "path", "left_semi")
