"""Entity-relationship diagram text (Mermaid syntax), one line per row.

Input are the rows of :func:`tallyfold.sources.catalogs.table_definitions`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.identifiers import diagram_name
from tallyfold.functions.types import diagram_type

LINE_ORDER = ["section", "schema_rank", "name", "part", "position"]


def _entity(schema: str, name: str) -> Column:
    return F.concat_ws("_", schema, name)


def relationships(definitions: DataFrame) -> DataFrame:
    """``(schema, name, entity, position, label, ref_entity, cardinality)``: each relationship once.

    A reference to a table outside the input is no relationship. The label is the referring column.
    """
    entity = _entity("schema", "name")
    refs = (
        definitions.where(F.col("ref").isNotNull())
        .select(
            "schema",
            "name",
            F.col("column").alias("label"),
            _entity("ref.schema", "ref.table").alias("ref_entity"),
            F.col("ref.column").alias("ref_column"),
            F.col("order").alias("position"),
        )
        .groupBy("schema", "name", "ref_entity", "label")
        .agg(F.min(F.struct("position", "ref_column")).alias("first"))
        .select("schema", "name", "ref_entity", "label", "first.*")
    )
    known = definitions.select(entity.alias("ref_entity")).distinct()
    keys = definitions.where("primary_key").select(
        entity.alias("ref_entity"), F.col("column").alias("ref_column"), F.lit(True).alias("is_key")
    )
    return (
        refs.join(known, "ref_entity", "left_semi")
        .join(keys.distinct(), ["ref_entity", "ref_column"], "left")
        .select(
            "schema",
            "name",
            entity.alias("entity"),
            "position",
            "label",
            "ref_entity",
            F.when(F.col("is_key"), "||--o{").otherwise("}o--||").alias("cardinality"),
        )
    )


def diagram_lines(definitions: DataFrame, schemas: Sequence[str]) -> DataFrame:
    """``(section, schema_rank, name, part, position, text)``, to be sorted by :data:`LINE_ORDER`."""
    rank = F.array_position(F.array(*[F.lit(s) for s in schemas]), F.col("schema")).cast("int")

    def lines(df: DataFrame, section: int, part: int, position: Column, text: Column) -> DataFrame:
        return df.select(
            F.lit(section).alias("section"),
            rank.alias("schema_rank"),
            "name",
            F.lit(part).alias("part"),
            position.cast("long").alias("position"),
            text.alias("text"),
        )

    entity = _entity("schema", "name")
    tables = definitions.select("schema", "name").distinct()
    column = F.concat_ws(" ", F.concat(F.lit("        "), diagram_type(F.col("type"))), diagram_name(F.col("column")))
    related = F.format_string('    %s %s %s : "%s"', "entity", "cardinality", "ref_entity", "label")
    zero = F.lit(0)

    # The fixed lines: title, one comment per requested schema, title of the relationships.
    fixed = [(0, 0, 0, "erDiagram"), (0, 0, 1, ""), (2, 0, 0, "    %% Relationships"), (2, 0, 1, "")]
    for i, schema in enumerate(schemas, start=1):
        fixed += [(1, i, 0, f"    %% {schema.capitalize()} Schema"), (1, i, 1, "")]
    spark = definitions.sparkSession
    titles = spark.createDataFrame(fixed, "section int, schema_rank int, position long, text string").select(
        "section", "schema_rank", F.lit("").alias("name"), F.lit(-1).alias("part"), "position", "text"
    )
    return (
        titles.unionByName(lines(tables, 1, 0, zero, F.concat(F.lit("    "), entity, F.lit(" {"))))
        .unionByName(lines(definitions.where(F.col("order") != 0), 1, 1, F.col("order"), column))
        .unionByName(lines(tables, 1, 2, zero, F.lit("    }")))
        .unionByName(lines(tables, 1, 3, zero, F.lit("")))
        .unionByName(lines(relationships(definitions), 2, 0, F.col("position"), related))
    )
