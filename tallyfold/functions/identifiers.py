"""Spellings of identifiers: quoted, qualified, diagram-safe, as a path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfold.functions.text import WORD, has_upper

_LEADING_DIGIT = r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]"
_PLAIN = rf"^{WORD}*[\p{{L}}\p{{N}}]{WORD}*\z"


def quote_identifier(name: Column) -> Column:
    """Quote what is not plain lower case; keep what is already quoted."""
    plain = name.rlike(_PLAIN) & ~name.rlike(_LEADING_DIGIT) & ~has_upper(name)
    quoted = name.startswith('"') & name.endswith('"')
    return F.when(quoted | plain, name).otherwise(F.concat(F.lit('"'), name, F.lit('"')))


def schema_part(name: Column) -> Column:
    """Text before the first dot."""
    return F.substring_index(name, ".", 1)


def table_part(name: Column) -> Column:
    """Text after the first dot; NULL without a dot."""
    return F.get(F.split(name, r"\.", 2), F.lit(1))


def quote_qualified(name: Column) -> Column:
    """Quote schema and table apart."""
    return F.when(
        name.contains("."),
        F.concat_ws(".", quote_identifier(schema_part(name)), quote_identifier(table_part(name))),
    ).otherwise(quote_identifier(name))


def diagram_name(name: Column) -> Column:
    """Letters, digits and underscores only; blanks become underscores."""
    return F.regexp_replace(F.replace(name, F.lit(" "), F.lit("_")), rf"[^\p{{L}}\p{{N}}_]", "")


def table_path(name: Column, file_name: str = "create.sql") -> Column:
    """``schema.a__b`` as ``schema/a/b/<file_name>``; a name without schema stops the query."""
    folders = F.filter(F.split(table_part(name), "__"), lambda part: part != "")
    path = F.concat_ws("/", schema_part(name), F.array_join(folders, "/"), F.lit(file_name))
    return F.when(name.contains("."), path).otherwise(
        F.raise_error(F.concat(F.lit("table name without schema: "), name))
    )
