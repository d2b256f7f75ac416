"""CSV rules, strict loads, constraint checks, parameterised SQL."""

from __future__ import annotations

import pytest
from py4j.protocol import Py4JJavaError

from tallyfold.operators.constraints import (
    Reference,
    constraint_report,
    duplicated_values,
    key_violations,
    load_status,
    next_ids,
    null_counts,
    orphans,
)
from tallyfold.sinks.csv_files import write_csv
from tallyfold.sinks.tables import read_rows, remove_old_versions, replace_rows
from tallyfold.sources.csv_files import load_strict
from tallyfold.sources.sql import run_sql


def test_null_and_empty(spark, rows, tmp_path):
    (tmp_path / "seed.csv").write_text('any,header\n1,\n2,""\n3,"a ""b"",\nc"\n4, NULL \n')
    assert rows(load_strict(spark, str(tmp_path / "seed.csv"), "id int, v string")) == [
        (1, None),
        (2, ""),
        (3, 'a "b",\nc'),
        (4, " NULL "),
    ]


@pytest.mark.parametrize("text", ["Name\nx\n", "Name,Required\nx\n", "Name,Required\nx,y,z\n", "Name,Required\nx,y\nz\n"])
def test_wrong_width_fails_the_load(spark, tmp_path, text):
    (tmp_path / "seed.csv").write_text(text)
    with pytest.raises(Py4JJavaError, match="MALFORMED"):
        load_strict(spark, str(tmp_path / "seed.csv"), "Name string, Required string").count()


def test_failed_load_keeps_old_rows(spark, rows, tmp_path):
    old = spark.createDataFrame([("a", "b")], "Name string, Required string")
    assert replace_rows(old, str(tmp_path / "t")) == 1
    (tmp_path / "seed.csv").write_text("Name\nx\n")
    with pytest.raises(Py4JJavaError, match="MALFORMED"):
        replace_rows(load_strict(spark, str(tmp_path / "seed.csv"), "Name string, Required string"), str(tmp_path / "t"))
    assert rows(read_rows(spark, str(tmp_path / "t"))) == [("a", "b")]
    # A table may be replaced by its own rows; what failed or is old can go.
    assert replace_rows(read_rows(spark, str(tmp_path / "t")).unionAll(old), str(tmp_path / "t")) == 2
    assert remove_old_versions(spark, str(tmp_path / "t")) == 2
    assert rows(read_rows(spark, str(tmp_path / "t"))) == [("a", "b"), ("a", "b")]
    with pytest.raises(FileNotFoundError):
        read_rows(spark, str(tmp_path / "u"))


@pytest.mark.parametrize("keep_empty", [True, False])
def test_csv_round_trip(spark, rows, tmp_path, keep_empty):
    data = [(1, ""), (2, None), (3, ' a,"b"\n\nc '), (4, "\\"), (5, "x")]
    write_csv(spark.createDataFrame(data, "id int, v string"), str(tmp_path / "c"), ["id"], keep_empty, rows_per_file=2)
    back = rows(load_strict(spark, str(tmp_path / "c"), "id int, v string"))
    assert back == [(i, v if keep_empty else v or None) for i, v in data]


def test_nested_values_are_json(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, map('a', array(1, 2)) AS v")
    write_csv(df, str(tmp_path / "c"), ["id"])
    (part,) = (tmp_path / "c").glob("*.csv")
    assert part.read_text() == 'id,v\n1,"{""a"":[1,2]}"\n'


def test_constraints(spark, rows):
    parent = spark.createDataFrame([(1, "A"), (2, "B"), (2, "B"), (None, None)], "id int, code string")
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None), (4, 9)], "id int, parent_id int")
    assert rows(key_violations(parent, ["id"])) == [(None, 1), (2, 2)]
    assert rows(orphans(child, ["parent_id"], parent, ["id"])) == [(9, 2)]
    assert rows(null_counts("parent", parent)) == [("parent", "code", 1, 4), ("parent", "id", 1, 4)]
    assert rows(duplicated_values(parent, "code")) == [("B", 2)]
    report = constraint_report(
        {"parent": parent, "child": child},
        {"parent": ("id",), "child": ("id",)},
        [Reference("child", ("parent_id",), "parent", ("id",))],
        [("parent", "code")],
        {"child": ("parent_id",)},
    )
    broken = rows(report.where("broken > 0"), "check", "table", "columns", "broken")
    assert broken == [
        ("FOREIGN KEY", "child", "parent_id", 2),
        ("NOT NULL", "child", "parent_id", 1),
        ("NOT NULL", "parent", "id", 1),
        ("PRIMARY KEY", "parent", "id", 3),
        ("UNIQUE", "parent", "code", 1),
    ]
    assert rows(load_status(report), "table", "status") == [("child", "failed"), ("parent", "failed")]


def test_next_ids(spark, rows):
    full = spark.createDataFrame([(100, "x")], "ID int, Name string")
    other = spark.createDataFrame([(1,)], "user_id int")
    got = next_ids({"full": full, "empty": full.limit(0), "other": other}, {"full": "ID", "empty": "ID", "other": "ID"})
    assert rows(got) == [("empty", "ID", 2), ("full", "ID", 101)]


@pytest.mark.parametrize("query", ["", None])
def test_empty_query(spark, query):
    with pytest.raises(ValueError, match="SQL query cannot be empty"):
        run_sql(spark, query)


def test_parameters(spark, rows):
    assert rows(run_sql(spark, "SELECT ? AS a, ? AS b", (1, "x'y"))) == [(1, "x'y")]
    assert rows(run_sql(spark, "SELECT :n AS a", {"n": 2})) == [(2,)]
    assert rows(run_sql(spark, "SELECT '{kept}' AS a")) == [("{kept}",)]
