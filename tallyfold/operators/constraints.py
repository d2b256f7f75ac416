"""Key, reference, null and uniqueness checks, which file tables do not enforce themselves."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyfold.operators.reconcile import union_all

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Reference:
    table: str
    columns: tuple[str, ...]
    ref_table: str
    ref_columns: tuple[str, ...]


def _any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def key_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key values that occur more than once or hold a NULL: ``(*columns, n)``."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | _any_null(columns))


def orphans(child: DataFrame, columns: Sequence[str], parent: DataFrame, ref_columns: Sequence[str]) -> DataFrame:
    """Child key values without a parent and how often they occur: ``(*columns, n)``.

    A key with a NULL part refers to nothing and passes. Both sides shrink to distinct keys before they
    meet, so a key that holds much of a table travels as a few rows.
    """
    used = child.where(~_any_null(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(*[F.col(r).alias(c) for c, r in zip(columns, ref_columns)]).distinct()
    return used.join(known, list(columns), "left_anti")


def null_counts(name: str, df: DataFrame) -> DataFrame:
    """``(table, column, nulls, n_rows)`` for every column, in one pass over the columns of the files."""
    counts = df.selectExpr("count(1) AS n", *[f"count(`{c}`) AS `c_{c}`" for c in df.columns])
    rows = ", ".join(
        f"named_struct('table', '{name}', 'column', '{c}', 'nulls', n - `c_{c}`, 'n_rows', n)" for c in df.columns
    )
    return counts.selectExpr(f"inline(array({rows}))")


def duplicated_values(df: DataFrame, column: str) -> DataFrame:
    """``(value, n)`` for values that occur more than once; NULLs do not collide.

    Text is first counted by its hash; the texts whose hash repeats are then compared themselves, which keeps the result exact. Where
    the repeated hashes outgrow a broadcast, all texts are shuffled by their hash.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value"))
    if isinstance(df.schema[column].dataType, StringType):
        hashed = values.withColumn("h", F.xxhash64("value"))
        repeated = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1).select("h")
        values = hashed.join(repeated, "h", "left_semi").select("value")
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def unique_summary(name: str, df: DataFrame, column: str) -> DataFrame:
    """``(table, column, duplicated, surplus)``: repeated values and the rows beyond their first.

    Texts are told apart by their SHA-256, so that digests are shuffled in their place.
    """
    if isinstance(df.schema[column].dataType, StringType):
        df = df.select(F.unhex(F.sha2(F.col(column), 256)).alias(column))
    return duplicated_values(df, column).agg(
        F.lit(name).alias("table"),
        F.lit(column).alias("column"),
        F.count(F.lit(1)).alias("duplicated"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"),
    )


def _check(check: str, table: str, columns: Sequence[str], df: DataFrame, broken: Column, ref_table: str = "") -> DataFrame:
    return df.agg(
        F.lit(check).alias("check"),
        F.lit(table).alias("table"),
        F.lit(",".join(columns)).alias("columns"),
        F.lit(ref_table).alias("ref_table"),
        F.coalesce(broken, F.lit(0)).cast("long").alias("broken"),
    )


def constraint_report(
    tables: Tables,
    primary_keys: dict[str, tuple[str, ...]],
    references: Sequence[Reference],
    unique: Sequence[tuple[str, str]] = (),
    not_null: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """One row per declared constraint with the number of rows (of values for UNIQUE) that break it.

    NOT NULL holds for the columns that ``not_null`` declares and for key columns; all others may hold NULL.
    """
    parts = []
    for table, columns in primary_keys.items():
        parts.append(_check("PRIMARY KEY", table, columns, key_violations(tables[table], columns), F.sum("n")))
    for ref in references:
        lost = orphans(tables[ref.table], ref.columns, tables[ref.ref_table], ref.ref_columns)
        parts.append(_check("FOREIGN KEY", ref.table, ref.columns, lost, F.sum("n"), ref.ref_table))
    for table, df in tables.items():
        declared = {*(not_null or {}).get(table, ()), *primary_keys.get(table, ())}
        columns = [c for c in df.columns if c in declared]
        if not columns:
            continue
        nulls = null_counts(table, df.select(*columns))
        parts.append(
            nulls.select(
                F.lit("NOT NULL").alias("check"),
                "table",
                F.col("column").alias("columns"),
                F.lit("").alias("ref_table"),
                F.col("nulls").alias("broken"),
            )
        )
    for table, column in unique:
        parts.append(
            _check("UNIQUE", table, [column], duplicated_values(tables[table], column), F.count(F.lit(1)))
        )
    return union_all(parts)


def load_status(report: DataFrame) -> DataFrame:
    """Per table whether it may be loaded: ``(table, checks, failed, status)``."""
    return (
        report.groupBy("table")
        .agg(F.count(F.lit(1)).alias("checks"), F.count_if(F.col("broken") > 0).alias("failed"))
        .withColumn("status", F.when(F.col("failed") > 0, "failed").otherwise("success"))
    )


def next_ids(tables: Tables, id_columns: dict[str, str]) -> DataFrame:
    """``(table, id_column, next_id)``: the id after the greatest one, and 2 for an empty table.

    Tables without the id column are skipped.
    """
    parts = [
        tables[table].agg(
            F.lit(table).alias("table"),
            F.lit(column).alias("id_column"),
            (F.greatest(F.lit(1), F.coalesce(F.max(column), F.lit(0))) + 1).cast("long").alias("next_id"),
        )
        for table, column in id_columns.items()
        if column in tables[table].columns
    ]
    return union_all(parts)
