"""Key columns of declared constraints.

Inputs follow the standard metadata views: ``constraints`` (schema, table, name, kind), ``key_columns``
(schema, table, name, column, position) and ``references`` (schema, name, ref_schema, ref_name). Joins
use the table as well as the constraint name, so constraints of the same name do not mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CONSTRAINT = ["schema", "table", "name"]


def _key_columns(constraints: DataFrame, key_columns: DataFrame, kind: str) -> DataFrame:
    of_kind = constraints.where(F.col("kind") == kind).select(*_CONSTRAINT)
    return key_columns.join(of_kind, _CONSTRAINT)


def primary_key_columns(constraints: DataFrame, key_columns: DataFrame) -> DataFrame:
    """``(schema, table, name, column, position)`` of primary keys."""
    return _key_columns(constraints, key_columns, "PRIMARY KEY").select(*_CONSTRAINT, "column", "position")


def single_unique_columns(constraints: DataFrame, key_columns: DataFrame) -> DataFrame:
    """``(schema, table, column)`` with a UNIQUE constraint of their own."""
    unique = _key_columns(constraints, key_columns, "UNIQUE")
    return (
        unique.groupBy(*_CONSTRAINT)
        .agg(F.count(F.lit(1)).alias("n"), F.min("column").alias("column"))
        .where(F.col("n") == 1)
        .select("schema", "table", "column")
    )


def foreign_key_columns(constraints: DataFrame, key_columns: DataFrame, references: DataFrame) -> DataFrame:
    """Foreign key columns paired with the referenced columns by position."""
    own = _key_columns(constraints, key_columns, "FOREIGN KEY").join(references, ["schema", "name"])
    target = key_columns.select(
        F.col("schema").alias("ref_schema"),
        F.col("name").alias("ref_name"),
        "position",
        F.col("table").alias("ref_table"),
        F.col("column").alias("ref_column"),
    )
    return own.join(target, ["ref_schema", "ref_name", "position"]).select(
        *_CONSTRAINT, "column", "position", "ref_schema", "ref_table", "ref_column"
    )


def paired_key_columns(constraints: DataFrame) -> DataFrame:
    """The same from constraints that hold both column lists: ``columns`` and ``ref_columns`` arrays."""
    pairs = F.posexplode(F.arrays_zip("columns", "ref_columns")).alias("at", "pair")
    return constraints.select(*_CONSTRAINT, "ref_schema", "ref_table", pairs).select(
        *_CONSTRAINT,
        F.col("pair.columns").alias("column"),
        (F.col("at") + 1).alias("position"),
        "ref_schema",
        "ref_table",
        F.col("pair.ref_columns").alias("ref_column"),
    )


def catalogued_foreign_keys(constraints: DataFrame, relations: DataFrame, namespaces: DataFrame, attributes: DataFrame) -> DataFrame:
    """Foreign key columns with the columns they refer to, from the system catalog's own form.

    ``constraints`` (name, kind, relation, ref_relation, numbers, ref_numbers) hold the column numbers of both sides as arrays, which a lateral join
    unnests side by side with their position. ``relations`` (id, name, namespace), ``namespaces`` (id, name) and ``attributes``
    (relation, number, name) give the names; each is used for either side, which makes seven relations in all.
    """
    keys = constraints.where(F.col("kind") == "f").select("name", "relation", "ref_relation", "numbers", "ref_numbers").alias("k")
    zipped = F.arrays_zip(F.col("k.numbers").outer().alias("number"), F.col("k.ref_numbers").outer().alias("ref_number"))
    pairs = constraints.sparkSession.tvf.posexplode(zipped).toDF("at", "pair")
    unnested = keys.lateralJoin(pairs).select("name", "relation", "ref_relation", (F.col("at") + 1).alias("position"), "pair.number", "pair.ref_number")

    def names(prefix: str) -> DataFrame:
        spaces = namespaces.select(F.col("id").alias("namespace"), F.col("name").alias(f"{prefix}schema"))
        return relations.join(spaces, "namespace").select(F.col("id").alias(f"{prefix}relation"), f"{prefix}schema", F.col("name").alias(f"{prefix}table"))

    def columns(prefix: str) -> DataFrame:
        return attributes.select(F.col("relation").alias(f"{prefix}relation"), F.col("number").alias(f"{prefix}number"), F.col("name").alias(f"{prefix}column"))

    named = unnested.join(names(""), "relation").join(names("ref_"), "ref_relation")
    named = named.join(columns(""), ["relation", "number"]).join(columns("ref_"), ["ref_relation", "ref_number"])
    return named.select(*_CONSTRAINT, "column", "position", "ref_schema", "ref_table", "ref_column")
