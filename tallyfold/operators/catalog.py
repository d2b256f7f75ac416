"""Documented catalog against actual schema."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.identifiers import schema_part
from tallyfold.functions.types import same_type
from tallyfold.operators.reconcile import Rule, broken_rules, issue, presence, tagged
from tallyfold.operators.summary import observed, summary_row
from tallyfold.session import written

# The schemas that are checked, and the spelling of generated owner schemas.
VALIDATED_SCHEMAS = ("meta", "test00000000000000000000")
GENERATED_OWNER = r"^[0-9a-f]{24}\z"


def without_generated_owners(catalog: DataFrame, validated: Iterable[str] = VALIDATED_SCHEMAS) -> DataFrame:
    """Drop documentation of generated owner schemas that are not validated."""
    schema = schema_part(F.col("table"))
    return catalog.where(schema.isin(*validated) | ~schema.rlike(GENERATED_OWNER))


def _text(value: Column) -> Column:
    return value.cast("string")


def _flag(value: Column) -> Column:
    return F.when(value, "True").when(~value, "False")


def _place() -> Column:
    return F.concat_ws(".", "table", "column")


def _value_rule(aspect: str, get, show, equal=lambda a, b: a == b) -> Rule:
    """Values on both sides that differ; a NULL on the documented side says nothing."""

    def as_issue(db: Column, doc: Column) -> Column:
        a, b = show(get(db)), show(get(doc))
        said = F.concat(F.lit(f"{aspect.replace('_', ' ')} of "), _place(), F.lit(" is "), a, F.lit(" in the database and "), b, F.lit(" in the catalog"))
        return issue(f"{aspect}_mismatch", table=F.col("table"), column=F.col("column"), db_value=a, catalog_value=b, message=said)

    return lambda db, doc: db["present"] & doc["present"] & ~equal(get(db), get(doc)), as_issue


def _one_side_rule(type_: str, before: str, after: str, there: str, absent: str) -> Rule:
    def as_issue(db: Column, doc: Column) -> Column:
        return issue(type_, table=F.col("table"), column=F.col("column"), message=F.concat(F.lit(before), _place(), F.lit(after)))

    return lambda db, doc: {"db": db, "doc": doc}[there].isNotNull() & {"db": db, "doc": doc}[absent].isNull(), as_issue


def _undocumented_key() -> Rule:
    def as_issue(db: Column, doc: Column) -> Column:
        fk = db["foreign_key"]
        said = F.concat(F.lit("Column "), _place(), F.lit(" refers to "), fk, F.lit(", the catalog names no target"))
        return issue("foreign_key_missing_in_catalog", table=F.col("table"), column=F.col("column"), db_value=fk, message=said)

    return (
        lambda db, doc: db["present"] & doc["present"] & db["foreign_key"].isNotNull() & doc["foreign_key"].isNull(),
        as_issue,
    )


# A foreign key that is only documented is no issue, so neither rule on foreign keys covers it.
COLUMN_RULES: list[Rule] = [
    _one_side_rule("missing_column", "The catalog says nothing about column ", "", "db", "doc"),
    _one_side_rule("extra_column", "The catalog describes column ", ", which is not in the database", "doc", "db"),
    _value_rule("order", lambda s: s["order"], _text),
    _value_rule("type", lambda s: F.upper(s["type"]), _text, same_type),
    _value_rule("nullability", lambda s: s["nullable"], _flag),
    _value_rule("primary_key", lambda s: s["primary_key"], _flag),
    _value_rule("foreign_key", lambda s: s["foreign_key"], _text),
    _undocumented_key(),
]


def table_presence(metadata: DataFrame, documented: DataFrame) -> DataFrame:
    """``(table, in_left, in_right)``: tables of the actual schema and of the documentation."""
    return presence(metadata, documented, ["table"])


def catalog_sides(metadata: DataFrame, documented: DataFrame, tie_order: list[str] | None = None) -> DataFrame:
    """``(table, column, l, r)``: each column as it is and as it is documented, by one aggregate over both inputs.

    ``metadata``: table (``schema.table``), column, order, type, nullable, primary_key, foreign_key;
    ``documented``: the same columns. A column documented twice counts as last documented by
    ``tie_order`` (by default its position). The side that lacks the column is NULL.
    """
    fields = ["table", "column", "order", "type", "nullable", "primary_key", "foreign_key"]
    return tagged(metadata.select(*fields), documented.select(*dict.fromkeys(fields + (tie_order or []))), ["table", "column"], tie_order or ["order"])


def catalog_issues(metadata: DataFrame, documented: DataFrame, tie_order: list[str] | None = None) -> DataFrame:
    """All differences between the actual columns and the documented ones, as ISSUE rows.

    Both inputs, as for :func:`catalog_sides`, are read once: tables and columns are then judged by what that wrote.
    """
    return _issues_of(written(catalog_sides(metadata, documented, tie_order), "sides")[0])


def catalog_report(metadata: DataFrame, documented: DataFrame, tie_order: list[str] | None = None) -> DataFrame:
    """One row on the whole comparison: status, valid, message, total_issues, tables_checked, columns_checked (those that both sides have)."""
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    sides, seen = observed(catalog_sides(metadata, documented, tie_order), "sides", columns=F.count_if(both))
    tables, known = observed(_tables_of(sides), "tables", common=F.count_if(F.col("in_left") & F.col("in_right")))
    _, found = observed(_issues_of(sides, tables).select("type"), "issues", total=F.count(F.lit(1)))
    return summary_row(metadata.sparkSession, "catalog", found["total"], {"tables_checked": known["common"], "columns_checked": seen["columns"]})


def _tables_of(sides: DataFrame) -> DataFrame:
    return sides.groupBy("table").agg(F.bool_or(F.col("l").isNotNull()).alias("in_left"), F.bool_or(F.col("r").isNotNull()).alias("in_right"))


def _issues_of(sides: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    tables = _tables_of(sides) if tables is None else tables
    name = F.col("table")
    lacking = F.when(
        ~F.col("in_right"), issue("missing_table", table=name, message=F.concat(F.lit("The catalog says nothing about table "), name))
    ).when(
        ~F.col("in_left"), issue("extra_table", table=name, message=F.concat(F.lit("The catalog describes table "), name, F.lit(", which is not in the database")))
    )
    common = tables.where("in_left and in_right").select("table")
    columns = broken_rules(sides.join(common, "table", "left_semi"), COLUMN_RULES)
    return tables.where("not (in_left and in_right)").select(lacking.alias("i")).select("i.*").unionByName(columns)
