"""One injected fault per kind of difference, constraint metadata, DDL and diagram text."""

from __future__ import annotations

import pytest

from tallyfold.operators.catalog import catalog_issues, without_generated_owners
from tallyfold.operators.ddl import LINE_ORDER as DDL_ORDER
from tallyfold.operators.ddl import ddl_lines
from tallyfold.operators.diagram import LINE_ORDER, diagram_lines
from tallyfold.operators.keys import paired_key_columns, single_unique_columns
from tallyfold.schemas import CATALOG, CATALOG_HEADER
from tallyfold.sinks.csv_files import write_catalogs
from tallyfold.sinks.tables import read_rows, replace_catalog
from tallyfold.sources.catalogs import documented_columns, read_catalog, table_definitions, typed_catalog
from tallyfold.sources.csv_files import read_by_header
from tallyfold.sources.metadata import columns_of, described_columns, user_tables

COLUMNS = "table string, column string, order long, type string, nullable boolean, primary_key boolean, foreign_key string"
ACTUAL = [
    ("meta.languages", "ID", 1, "INTEGER", False, True, None),
    ("meta.languages", "Name", 2, "TEXT", False, False, None),
    ("meta.languages", "Flag", 3, "TEXT", True, False, None),
    ("meta.widgets", "ID", 1, "INTEGER", False, True, None),
    ("meta.widgets", "Avatar ID", 2, "INTEGER", True, False, "meta.lucide_icon.ID"),
]


def replaced(table, column, **changes):
    names = ["table", "column", "order", "type", "nullable", "primary_key", "foreign_key"]
    return [
        tuple(changes.get(n, v) for n, v in zip(names, row)) if row[:2] == (table, column) else row for row in ACTUAL
    ]


FAULTS = {
    "extra_table": ACTUAL + [("test.fake", "ID", 1, "SERIAL", None, None, None)],
    "missing_table": [r for r in ACTUAL if r[0] != "meta.languages"],
    "extra_column": ACTUAL + [("meta.languages", "Fake", 99, "TEXT", None, None, None)],
    "missing_column": [r for r in ACTUAL if r[1] != "Flag"],
    "type_mismatch": replaced("meta.languages", "ID", type="TEXT"),
    "nullability_mismatch": replaced("meta.languages", "Name", nullable=True),
    "order_mismatch": replaced("meta.languages", "ID", order=99),
    "primary_key_mismatch": replaced("meta.languages", "ID", primary_key=False),
    "foreign_key_mismatch": replaced("meta.widgets", "Avatar ID", foreign_key="meta.languages.ID"),
    "foreign_key_missing_in_catalog": replaced("meta.widgets", "Avatar ID", foreign_key=None),
}


@pytest.mark.parametrize("fault", sorted(FAULTS))
def test_each_fault_is_found_alone(spark, rows, fault):
    found = catalog_issues(spark.createDataFrame(ACTUAL, COLUMNS), spark.createDataFrame(FAULTS[fault], COLUMNS))
    assert [r[0] for r in rows(found, "type")] == [fault]


def test_what_is_no_difference(spark, rows):
    actual = spark.createDataFrame(ACTUAL, COLUMNS)
    assert rows(catalog_issues(actual, actual)) == []
    silent = replaced("meta.languages", "ID", type="serial", nullable=None, primary_key=None, foreign_key="meta.x.ID")
    assert rows(catalog_issues(actual, spark.createDataFrame(silent, COLUMNS))) == []


def test_messages(spark, rows):
    found = catalog_issues(spark.createDataFrame(ACTUAL, COLUMNS), spark.createDataFrame(FAULTS["nullability_mismatch"], COLUMNS))
    assert rows(found, "db_value", "catalog_value", "message") == [
        ("False", "True", "nullability of meta.languages.Name is False in the database and True in the catalog")
    ]


def test_generated_owners_are_dropped(spark, rows):
    names = ["meta.a", "0123456789abcdef01234567.a", "test00000000000000000000.a", "0123456789ABCDEF01234567.a"]
    df = spark.createDataFrame([(n,) for n in names], "table string")
    assert [r[0] for r in rows(without_generated_owners(df))] == sorted(names[0:1] + names[2:])


def test_catalog_files_round_trip(spark, rows, tmp_path):
    catalog = [
        ("meta.a", None, 0, None, None, None, None, "All, of it", None),
        ("meta.a", "ID", 1, "SERIAL", False, True, None, 'say "x"\nend', "1|2"),
        ("meta.b", "A", 1, "TEXT", None, None, "meta.a.ID", None, None),
    ]
    df = spark.createDataFrame(catalog, CATALOG)
    write_catalogs(df, str(tmp_path / "c"), spark.createDataFrame([("meta.a",)], "table string"))
    back = typed_catalog(read_catalog(spark, str(tmp_path / "c" / "table_name=meta.a")))
    expected = [tuple("" if i == 3 and v is None else v for i, v in enumerate(r)) for r in catalog[:2]]
    assert rows(back) == sorted(expected, key=lambda t: tuple((x is not None, x) for x in t))


def test_catalog_is_replaced_by_all_files(spark, rows, tmp_path):
    target, head = str(tmp_path / "t"), "Table,Column,Order,Type,Nullable?,Primary Key?,Foreign Key,Description,Sample Values\n"
    for schema in ("meta", ".hidden"):
        (tmp_path / "docs" / schema).mkdir(parents=True)
    assert replace_catalog(spark, [str(tmp_path / "docs"), str(tmp_path / "none")], target) is None
    (tmp_path / "docs" / "meta" / "catalog.csv").write_text(head + "meta.a,x,1,TEXT,TRUE,,,,\n")
    (tmp_path / "docs" / ".hidden" / "catalog.csv").write_text("Order,Table,Type\n2,meta.b,INTEGER\n3,meta.b,TEXT\n")
    assert replace_catalog(spark, [str(tmp_path / "docs")], target) == 3
    assert rows(read_rows(spark, target), "table", "order", "nullable") == [("meta.a", 1, True), ("meta.b", 2, None), ("meta.b", 3, None)]
    for file in ("meta", ".hidden"):
        (tmp_path / "docs" / file / "catalog.csv").write_text(head)
    assert replace_catalog(spark, [str(tmp_path / "docs")], target) == 0
    assert rows(read_rows(spark, target)) == []


def test_headers_that_differ(spark, rows, tmp_path):
    folder = tmp_path / "a b"
    folder.mkdir()
    (folder / "x.csv").write_text('A,B\n1,2\n"3\n4",5\n6\n')
    (folder / "y.csv").write_text("B,C,A,A\n1,2,3,9,8\n")
    (folder / "z.csv").write_text('"C\nD",B\nq,\n')
    (folder / "empty.csv").write_text("")
    got = read_by_header(spark, str(folder), ["A", "B", "C"], "-", file="f")
    assert rows(got, "A", "B", "C") == [("-", "", "-"), ("1", "2", "-"), ("3\n4", "5", "-"), ("6", "", "-"), ("9", "1", "2")]
    assert {r[0].rsplit("/", 1)[-1] for r in rows(got, "f")} == {"x.csv", "y.csv", "z.csv"}


def test_missing_header_columns_are_empty(spark, rows, tmp_path):
    (tmp_path / "catalog.csv").write_text("Table,Order,Column\nmeta.a,1,x\n")
    raw = read_catalog(spark, str(tmp_path / "catalog.csv"))
    assert raw.columns == CATALOG_HEADER and rows(raw)[0][:4] == ("meta.a", "x", "1", "")


def test_metadata_of_tables(spark, rows):
    df = spark.createDataFrame([(1, "x")], "id int, name string")
    got = columns_of(spark, "meta", {"t": df})
    assert rows(got, "table", "column", "order", "type") == [("t", "id", 1, "INT"), ("t", "name", 2, "STRING")]
    system = columns_of(spark, "pg_catalog", {"t": df})
    assert rows(user_tables(got.unionByName(system))) == [("meta.t",)]


def test_last_foreign_key_counts(spark, rows):
    raw = spark.createDataFrame(
        [("m", "t", "a", 1, "numeric", 8, 2, True)],
        "schema string, table string, column string, order int, data_type string, precision int, scale int, nullable boolean",
    )
    pk = spark.createDataFrame([], "schema string, table string, column string")
    fk = spark.createDataFrame(
        [("m", "t", "a", "fk_a", 1, "m.x.y"), ("m", "t", "a", "fk_b", 1, "m.z.y")],
        "schema string, table string, column string, constraint string, position int, foreign_key string",
    )
    assert rows(described_columns(raw, pk, fk), "type", "primary_key", "foreign_key") == [("NUMERIC(8,2)", False, "m.z.y")]


def test_constraint_metadata(spark, rows):
    constraints = spark.createDataFrame(
        [("m", "t", "u1", "UNIQUE"), ("m", "t", "u2", "UNIQUE"), ("m", "s", "u1", "UNIQUE")],
        "schema string, table string, name string, kind string",
    )
    keys = spark.createDataFrame(
        [("m", "t", "u1", "a", 1), ("m", "t", "u2", "a", 1), ("m", "t", "u2", "b", 2), ("m", "s", "u1", "z", 1)],
        "schema string, table string, name string, column string, position int",
    )
    assert rows(single_unique_columns(constraints, keys)) == [("m", "s", "z"), ("m", "t", "a")]
    pairs = spark.createDataFrame(
        [("m", "t", "fk", "m", "p", ["a", "b"], ["x", "y"])],
        "schema string, table string, name string, ref_schema string, ref_table string, columns array<string>, ref_columns array<string>",
    )
    assert rows(paired_key_columns(pairs), "column", "position", "ref_column") == [("a", 1, "x"), ("b", 2, "y")]


def lines(df, order):
    return [r[0] for r in df.orderBy(*order).select("text").collect()]


def test_ddl_text(spark):
    columns = spark.createDataFrame(
        [
            ("etl", "sync", "id", 1, "integer", False, "nextval('s')", None, 32, 0),
            ("etl", "sync", "Name", 2, "text", False, None, None, None, None),
            ("etl", "sync", "value", 3, "integer", True, "0", None, 32, 0),
            ("etl", "sync", "label", 4, "character varying", True, None, 100, None, None),
            ("etl", "sync", "score", 5, "numeric", True, None, None, 10, 2),
            ("etl", "bare", "a", 1, "text", True, None, None, None, None),
        ],
        "schema string, table string, column string, order int, data_type string, nullable boolean, default string, length int, precision int, scale int",
    )
    pk = spark.createDataFrame([("etl", "sync", "id", 1), ("etl", "sync", "Name", 2)], "schema string, table string, column string, position int")
    unique = spark.createDataFrame([("etl", "sync", "Name")], "schema string, table string, column string")
    fk = spark.createDataFrame(
        [("etl", "sync", c, 1, col, "etl", ref, "id") for c, col, ref in (("f1", "value", "parent"), ("f2", "score", "parent"), ("f3", "value", "parent"))],
        "schema string, table string, constraint string, position int, column string, ref_schema string, ref_table string, ref_column string",
    )
    got = ddl_lines(columns, pk, unique, fk)
    assert lines(got.where("table = 'sync'"), DDL_ORDER) == [
        "-- Schema Creation",
        "CREATE SCHEMA IF NOT EXISTS etl;",
        "",
        "-- Table Creation",
        "CREATE TABLE etl.sync (",
        "",
        "    -- Columns",
        "    id SERIAL NOT NULL,",
        '    "Name" TEXT NOT NULL UNIQUE,',
        "    value INTEGER DEFAULT 0,",
        "    label VARCHAR(100),",
        "    score NUMERIC(10,2),",
        "",
        "    -- Primary Key",
        '    PRIMARY KEY (id, "Name"),',
        "",
        "    -- Foreign Keys",
        "    FOREIGN KEY (value) REFERENCES etl.parent (id),",
        "    FOREIGN KEY (score) REFERENCES etl.parent (id)",
        "",
        ");",
    ]
    assert lines(got.where("table = 'bare'"), DDL_ORDER)[7:] == ["    a TEXT", "", "    -- Primary Key", "", ");"]


def test_diagram(spark):
    catalog = [
        ("meta.icon", None, 0, "", None, None, None, None, None),
        ("meta.icon", "ID", 1, "SERIAL", None, True, None, None, None),
        ("meta.icon", "Made At", 2, "TIMESTAMP WITH TIME ZONE", None, None, None, None, None),
        ("meta.widget", "Icon ID", 1, "INTEGER", None, None, "meta.icon.ID", None, None),
        ("meta.widget", "Other", 2, "NUMERIC(3,1)", None, None, "meta.icon.Made At", None, None),
        ("meta.widget", "Gone", 3, "TEXT", None, None, "meta.nowhere.ID", None, None),
        ("meta.widget", "Odd", 4, "TEXT", None, None, "meta.icon", None, None),
        ("nodot", "A", 1, "TEXT", None, None, None, None, None),
    ]
    definitions = table_definitions(spark.createDataFrame(catalog, CATALOG), ["meta"])
    assert lines(diagram_lines(definitions, ["meta"]), LINE_ORDER) == [
        "erDiagram",
        "",
        "    %% Meta Schema",
        "",
        "    meta_icon {",
        "        SERIAL ID",
        "        TIMESTAMP Made_At",
        "    }",
        "",
        "    meta_widget {",
        "        INTEGER Icon_ID",
        "        DECIMAL Other",
        "        TEXT Gone",
        "        TEXT Odd",
        "    }",
        "",
        "    %% Relationships",
        "",
        '    meta_widget ||--o{ meta_icon : "Icon ID"',
        '    meta_widget }o--|| meta_icon : "Other"',
    ]


def test_documented_columns_skip_table_rows(spark, rows):
    raw = [("m.a", "NULL", "0"), ("m.a", "x", "1"), ("m.a", "y", ""), ("m.a", "z", "NULL")]
    df = spark.createDataFrame([r + ("",) * 6 for r in raw], CATALOG_HEADER)
    assert rows(documented_columns(typed_catalog(df)), "column", "order") == [("x", 1)]


def test_metadata_keys_keep_an_orders_numbers_together(spark, rows, tmp_path):
    """Equal and null line numbers count once; line items are dealt by their order alone, so those of one stay side by side."""
    from tallyfold.plans.schema_catalog import metadata_keys

    spark.createDataFrame([(1, 7), (2, 7)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    items = [(1, 1), (1, 1), (1, 2), (2, 2), (2, None), (2, None), (None, 1)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    keys = metadata_keys(spark, str(tmp_path))
    assert rows(keys, "kind", "table", "column", "position", "ref_table", "ref_column") == [
        ("FOREIGN KEY", "order_1", "c1", 1, "order_1", "c1"),
        ("FOREIGN KEY", "order_1", "c2", 2, "order_1", "c2"),
        ("FOREIGN KEY", "order_2", "c2", 2, "order_1", "c2"),
        ("PRIMARY KEY", "order_1", "c1", 1, None, None),
        ("PRIMARY KEY", "order_1", "c2", 2, None, None),
        ("PRIMARY KEY", "order_2", None, None, None, None),
        ("PRIMARY KEY", "order_2", "c2", 2, None, None),
    ]
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "hashpartitioning" in line and "l_linenumber" in line]
