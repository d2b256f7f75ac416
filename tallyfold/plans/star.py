"""Constraint checks over the declared keys of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators.constraints import (
    Reference,
    constraint_report,
    key_violations,
    load_status,
    next_ids,
    null_counts,
    orphans,
    unique_summary,
)
from tallyfold.operators.reconcile import union_all
from tallyfold.plans.tables import COLUMNS, table, tables
from tallyfold.sources.sql import run_sql

PRIMARY_KEYS = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"),
    "events": ("event_id",),
    "documents": ("doc_id",),
    "embeddings": ("vec_id",),
    "pages": ("page_id",),
    "benchmark": ("item_id",),
    "labels": ("doc_id",),
    "conversations": ("conv_id", "turn"),
}
FOREIGN_KEYS = [
    Reference("nation", ("n_regionkey",), "region", ("r_regionkey",)),
    Reference("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    Reference("supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    Reference("orders", ("o_custkey",), "customer", ("c_custkey",)),
    Reference("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    Reference("lineitem", ("l_partkey",), "part", ("p_partkey",)),
    Reference("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
    Reference("labels", ("doc_id",), "documents", ("doc_id",)),
]
NULLABLE = {"customer": "c_mktsegment"}
# Keys that should be referred to, read against the direction of the declared references.
UNREFERENCED = [
    Reference("orders", ("o_orderkey",), "lineitem", ("l_orderkey",)),
    Reference("documents", ("doc_id",), "labels", ("doc_id",)),
    Reference("customer", ("c_custkey",), "orders", ("o_custkey",)),
]
UNIQUE = [
    ("region", "r_name"),
    ("nation", "n_name"),
    ("customer", "c_name"),
    ("supplier", "s_name"),
    ("part", "p_name"),
    ("pages", "url"),
    ("documents", "text"),
    ("benchmark", "text"),
    ("conversations", "text"),
]


# Columns declared NOT NULL beside the keys; the rest may hold NULL.
NOT_NULL = {name: tuple(c for c in columns.split() if c != NULLABLE.get(name)) for name, columns in COLUMNS.items()}


def checked_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All tables; customers in debt have no market segment, which may be NULL."""
    found = tables(spark, sf_dir)
    found["customer"] = found["customer"].withColumn("c_mktsegment", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))
    return found


def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        orphans(table(spark, sf_dir, r.table), r.columns, table(spark, sf_dir, r.ref_table), r.ref_columns).select(
            F.lit(r.table).alias("child_table"),
            F.lit(r.ref_table).alias("parent_table"),
            F.col(r.columns[0]).cast("long").alias("key"),
            "n",
        )
        for r in UNREFERENCED
    ]
    return union_all(parts)


def pk_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_violations(table(spark, sf_dir, "lineitem"), PRIMARY_KEYS["lineitem"])


def null_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_all([null_counts(n, df) for n, df in tables(spark, sf_dir).items()])


def unique_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_all([unique_summary(t, table(spark, sf_dir, t), c) for t, c in UNIQUE])


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraint_report(checked_tables(spark, sf_dir), PRIMARY_KEYS, FOREIGN_KEYS, UNIQUE, NOT_NULL)


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_status(report(spark, sf_dir))


def next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = {name: keys[0] for name, keys in PRIMARY_KEYS.items() if len(keys) == 1}
    return next_ids(tables(spark, sf_dir), ids | {"lineitem": "ID"})


def sql_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = """
        SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS quantity
        FROM {lineitem}
        WHERE l_quantity > :least AND l_shipdate >= :since
        GROUP BY l_returnflag, l_linestatus
    """
    bound = {"least": 10, "since": "1997-01-01"}
    return run_sql(spark, query, bound, lineitem=table(spark, sf_dir, "lineitem"))


def _unreferenced_sql(r: Reference) -> str:
    c, p = r.columns[0], r.ref_columns[0]
    return (
        f"SELECT '{r.table}' AS child_table, '{r.ref_table}' AS parent_table, CAST({c} AS BIGINT) AS key, "
        f"count(*) AS n FROM {r.table} AS a WHERE NOT EXISTS "
        f"(SELECT 1 FROM {r.ref_table} AS b WHERE b.{p} = a.{c}) GROUP BY {c}"
    )


def _null_sql(name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
        f"count(*) AS n_rows FROM {name}"
        for c in COLUMNS[name].split()
    )


def _repeated_sql(name: str, column: str) -> str:
    return f"SELECT count(*) AS n FROM {name} WHERE {column} IS NOT NULL GROUP BY {column} HAVING count(*) > 1"


def _unique_sql(name: str, column: str) -> str:
    return (
        f"SELECT '{name}' AS \"table\", '{column}' AS \"column\", count(*) AS duplicated, "
        f"CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus FROM ({_repeated_sql(name, column)})"
    )


def _report_sql() -> str:
    def row(check, name, columns, count, source, ref=""):
        return (
            f"SELECT '{check}' AS \"check\", '{name}' AS \"table\", '{columns}' AS columns, '{ref}' AS ref_table, "
            f"CAST(coalesce({count}, 0) AS BIGINT) AS broken FROM {source}"
        )

    rows = []
    for name, keys in PRIMARY_KEYS.items():
        cols = ", ".join(keys)
        grouped = f"(SELECT count(*) AS n FROM {name} GROUP BY {cols} HAVING count(*) > 1)"
        rows.append(row("PRIMARY KEY", name, ",".join(keys), "sum(n)", grouped))
    for r in FOREIGN_KEYS:
        lost = f"(SELECT 1 FROM {r.table} WHERE {r.columns[0]} NOT IN (SELECT {r.ref_columns[0]} FROM {r.ref_table}))"
        rows.append(row("FOREIGN KEY", r.table, r.columns[0], "count(*)", lost, r.ref_table))
    for name, columns in COLUMNS.items():
        for c in columns.split():
            if name == "customer" and c == "c_mktsegment":
                continue
            rows.append(row("NOT NULL", name, c, f"count(*) FILTER (WHERE {c} IS NULL)", name))
    for name, c in UNIQUE:
        rows.append(row("UNIQUE", name, c, "count(*)", f"({_repeated_sql(name, c)})"))
    return " UNION ALL ".join(rows)


QUERIES = {
    "fk_orphans": fk_orphans,
    "pk_duplicates": pk_duplicates,
    "null_check": null_check,
    "unique_check": unique_check,
    "constraint_report": report,
    "load_status": status,
    "next_id": next_id,
    "sql_param": sql_param,
}

ORACLE = {
    "fk_orphans": " UNION ALL ".join(_unreferenced_sql(r) for r in UNREFERENCED),
    "pk_duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem "
    "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL",
    "null_check": " UNION ALL ".join(_null_sql(n) for n in COLUMNS),
    "unique_check": " UNION ALL ".join(_unique_sql(t, c) for t, c in UNIQUE),
    "constraint_report": _report_sql(),
    "load_status": 'SELECT "table", count(*) AS checks, count(*) FILTER (WHERE broken > 0) AS failed, '
    "CASE WHEN count(*) FILTER (WHERE broken > 0) > 0 THEN 'failed' ELSE 'success' END AS status "
    f'FROM ({_report_sql()}) GROUP BY "table"',
    "next_id": " UNION ALL ".join(
        f"SELECT '{n}' AS \"table\", '{k[0]}' AS id_column, "
        f"CAST(greatest(1, coalesce(max({k[0]}), 0)) + 1 AS BIGINT) AS next_id FROM {n}"
        for n, k in PRIMARY_KEYS.items()
        if len(k) == 1
    ),
    "sql_param": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) "
    "AS quantity FROM lineitem WHERE l_quantity > 10 AND l_shipdate >= TIMESTAMP '1997-01-01' "
    "GROUP BY l_returnflag, l_linestatus",
}
