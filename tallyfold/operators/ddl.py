"""CREATE TABLE text from column metadata, one line per row.

Sorting by :data:`LINE_ORDER` puts the lines of each table in order. Tables are never gathered: the only
text built from several rows is the list of primary key columns, which databases limit to a few dozen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.identifiers import quote_identifier
from tallyfold.functions.types import ddl_type, is_serial

TABLE = ["schema", "table"]
LINE_ORDER = [*TABLE, "section", "constraint", "position"]

_HEAD, _COLUMNS, _PRIMARY, _FOREIGN_HEAD, _FOREIGN, _END = range(6)


def _line(section: int, position: int, text: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"),
        F.lit("").alias("constraint"),
        F.lit(position).cast("long").alias("position"),
        text.alias("text"),
    )


def _foreign_lines(foreign_keys: DataFrame) -> DataFrame:
    """One line per column pair, each text once at its first place."""
    text = F.format_string(
        "    FOREIGN KEY (%s) REFERENCES %s.%s (%s)",
        *[quote_identifier(F.col(c)) for c in ("column", "ref_schema", "ref_table", "ref_column")],
    )
    return (
        foreign_keys.select(*TABLE, text.alias("text"), F.struct("constraint", F.col("position").cast("long").alias("position")).alias("at"))
        .groupBy(*TABLE, "text")
        .agg(F.min("at").alias("at"))
    )


def ddl_lines(columns: DataFrame, primary_keys: DataFrame, unique: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """``(schema, table, section, constraint, position, text)``.

    ``columns``: schema, table, column, order, data_type, nullable, default, length, precision, scale;
    ``primary_keys``: schema, table, column, position; ``unique``: schema, table, column;
    ``foreign_keys``: schema, table, constraint, position, column, ref_schema, ref_table, ref_column.
    """
    foreign = _foreign_lines(foreign_keys)
    keys = (
        primary_keys.groupBy(*TABLE)
        .agg(F.array_sort(F.collect_set(F.struct("position", "column"))).alias("cols"))
        .select(*TABLE, F.array_join(F.transform("cols", lambda c: quote_identifier(c["column"])), ", ").alias("pk"))
    )
    tables = (
        columns.groupBy(*TABLE)
        .agg(F.max("order").alias("last_order"))
        .join(keys, TABLE, "left")
        .join(foreign.groupBy(*TABLE).agg(F.max("at").alias("last_fk")), TABLE, "left")
    )

    # The lines that each table has once; a line of NULL is left out.
    schema, table = quote_identifier(F.col("schema")), quote_identifier(F.col("table"))
    has_fk = F.col("last_fk").isNotNull()
    single = [
        (_HEAD, F.lit("-- Schema Creation")),
        (_HEAD, F.format_string("CREATE SCHEMA IF NOT EXISTS %s;", schema)),
        (_HEAD, F.lit("")),
        (_HEAD, F.lit("-- Table Creation")),
        (_HEAD, F.format_string("CREATE TABLE %s.%s (", schema, table)),
        (_HEAD, F.lit("")),
        (_HEAD, F.lit("    -- Columns")),
        (_PRIMARY, F.lit("")),
        (_PRIMARY, F.lit("    -- Primary Key")),
        (_PRIMARY, F.concat(F.lit("    PRIMARY KEY ("), F.col("pk"), F.when(has_fk, "),").otherwise(")"))),
        (_FOREIGN_HEAD, F.when(has_fk, "")),
        (_FOREIGN_HEAD, F.when(has_fk, "    -- Foreign Keys")),
        (_END, F.lit("")),
        (_END, F.lit(");")),
    ]
    first = {section: i for i, (section, _) in reversed(list(enumerate(single)))}
    lines = F.array(*[_line(section, i - first[section], text) for i, (section, text) in enumerate(single)])
    frame = tables.select(*TABLE, F.inline(F.filter(lines, lambda line: line["text"].isNotNull())))

    default = F.nullif(F.col("default"), F.lit(""))
    serial = is_serial(F.col("data_type"), default)
    line = F.concat(
        F.lit("    "),
        quote_identifier(F.col("column")),
        F.lit(" "),
        ddl_type(*[F.col(c) for c in ("data_type", "default", "length", "precision", "scale")]),
        F.when(~F.col("nullable"), " NOT NULL").otherwise(""),
        F.when(F.col("is_unique"), " UNIQUE").otherwise(""),
        F.when(default.isNotNull() & ~serial, F.concat(F.lit(" DEFAULT "), default)).otherwise(""),
        # The last column is the last entry of a table without keys.
        F.when((F.col("order") == F.col("last_order")) & F.col("pk").isNull() & F.col("last_fk").isNull(), "").otherwise(","),
    )
    flagged = columns.join(unique.select(*TABLE, "column", F.lit(True).alias("is_unique")).distinct(), [*TABLE, "column"], "left")
    body = flagged.join(tables, TABLE).select(
        *TABLE,
        F.lit(_COLUMNS).alias("section"),
        F.lit("").alias("constraint"),
        F.col("order").cast("long").alias("position"),
        line.alias("text"),
    )

    foreign_body = foreign.join(tables.select(*TABLE, "last_fk"), TABLE).select(
        *TABLE,
        F.lit(_FOREIGN).alias("section"),
        F.col("at.constraint").alias("constraint"),
        F.col("at.position").alias("position"),
        F.concat(F.col("text"), F.when(F.col("at") == F.col("last_fk"), "").otherwise(",")).alias("text"),
    )
    return frame.unionByName(body).unionByName(foreign_body)
