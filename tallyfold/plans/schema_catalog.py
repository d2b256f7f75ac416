"""Schema metadata and its documentation, derived from orders and line items.

An order is read as a column of the table of its customer: status and date give the schema, priority
the type, price the flags. The documentation is a second reading of the same rows with other rules, so
that every kind of difference occurs. Line items give the foreign keys of a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.identifiers import diagram_name, quote_identifier, quote_qualified, table_path
from tallyfold.operators.catalog import catalog_issues, catalog_report, table_presence, without_generated_owners
from tallyfold.operators.ddl import ddl_lines
from tallyfold.operators.diagram import diagram_lines
from tallyfold.operators.keys import catalogued_foreign_keys, foreign_key_columns, primary_key_columns, single_unique_columns
from tallyfold.operators.reconcile import last_per_key
from tallyfold.operators.snapshot import snapshot_diff
from tallyfold.plans.tables import COLUMNS, table
from tallyfold.schemas import CATALOG_HEADER
from tallyfold.session import scratch_path, written
from tallyfold.sinks.csv_files import catalog_rows, write_catalogs, write_csv
from tallyfold.sinks.tables import read_rows, remove_old_versions, replace_catalog, replace_rows
from tallyfold.sources.catalogs import documented_columns, read_catalog, table_definitions, typed_catalog
from tallyfold.sources.storage import list_tree, parquet_columns
from tallyfold.sources.metadata import SYSTEM_SCHEMAS, described_columns, user_tables

TEST_SCHEMA = "test00000000000000000000"
GENERATED_SCHEMA = "0123456789abcdef01234567"
TABLE = ["schema", "table"]


def _month() -> Column:
    return F.month("o_orderdate")


def raw_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw metadata rows; ``o_*`` columns stay for the readers below."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    years = F.year("o_orderdate") - 1995
    return table(spark, sf_dir, "orders").select(
        "*",
        F.when(status == "F", "meta")
        .when(status == "O", TEST_SCHEMA)
        .when(years < 3, GENERATED_SCHEMA)
        .otherwise("pg_catalog")
        .alias("schema"),
        F.concat(F.lit("cust__"), F.col("o_custkey")).alias("table"),
        F.concat(F.when(priority == "1-URGENT", "Order ID ").otherwise("o_"), F.col("o_orderkey")).alias("column"),
        (F.col("o_orderkey") + 1).alias("order"),
        F.when(priority == "1-URGENT", "integer")
        .when(priority == "2-HIGH", "numeric")
        .when(priority == "3-MEDIUM", "character varying")
        .when(priority == "4-NOT SPECIFIED", "timestamp without time zone")
        .otherwise("character")
        .alias("data_type"),
        F.when(priority == "1-URGENT", "nextval('seq')").when(priority == "5-LOW", "'none'").alias("default"),
        F.when(_month() > 1, F.day("o_orderdate")).alias("length"),
        (_month() + 8).alias("precision"),
        years.alias("scale"),
        (F.col("o_totalprice") > 250000).alias("nullable"),
    )


def primary_keys(columns: DataFrame) -> DataFrame:
    """The first and the last column of each table: ``(schema, table, column, position)``."""
    ends = columns.groupBy(*TABLE).agg(F.min_by("column", "order").alias("a"), F.max_by("column", "order").alias("z"))
    return ends.select(*TABLE, F.posexplode(F.array_distinct(F.array("a", "z"))).alias("p", "column")).select(
        *TABLE, "column", (F.col("p") + 1).alias("position")
    )


def foreign_keys(columns: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One constraint per line item of the column; returned items refer to the customer's own table."""
    own = F.col("l_returnflag") == "R"
    return lineitem.join(columns, F.col("l_orderkey") == F.col("o_orderkey")).select(
        *TABLE,
        "column",
        F.concat(F.lit("fk_"), F.col("l_linenumber")).alias("constraint"),
        F.lit(1).alias("position"),
        F.lit("meta").alias("ref_schema"),
        F.concat(F.lit("cust__"), F.when(own, F.col("o_custkey")).otherwise(F.col("l_suppkey"))).alias("ref_table"),
        F.when(own, F.concat(F.lit("o_"), F.col("o_orderkey")))
        .otherwise(F.concat(F.lit("o_"), F.col("l_partkey")))
        .alias("ref_column"),
    )


def _reference_text() -> Column:
    return F.concat_ws(".", "ref_schema", "ref_table", "ref_column")


def actual_metadata(spark: SparkSession, sf_dir: str, columns: DataFrame | None = None) -> DataFrame:
    """METADATA rows of the actual schema, or of some of its raw ``columns``."""
    columns = raw_columns(spark, sf_dir) if columns is None else columns
    foreign = foreign_keys(columns, table(spark, sf_dir, "lineitem")).withColumn("foreign_key", _reference_text())
    raw = columns.select(*TABLE, "column", "order", "data_type", "precision", "scale", "nullable")
    return described_columns(raw, primary_keys(columns), foreign)


def catalog_tokens(spark: SparkSession, sf_dir: str, columns: DataFrame | None = None) -> DataFrame:
    """Raw catalog tokens: a row per order, or of some of the raw ``columns``, and a row per table."""
    columns = raw_columns(spark, sf_dir) if columns is None else columns
    price, kind = F.col("o_totalprice"), F.upper("data_type")
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("part"))
    name = F.concat_ws(".", "schema", "table")
    # The most expensive orders are documented as keys and refer to themselves.
    target = F.when(F.col("part").isNotNull(), F.when(price > 480000, F.col("o_orderkey")).otherwise(F.col("part")))
    rows = columns.join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        name.alias("Table"),
        F.concat(F.lit(" "), F.col("column"), F.lit(" ")).alias("Column"),
        F.when(price > 450000, F.col("order") + 1).otherwise(F.col("order")).cast("string").alias("Order"),
        F.when(kind == "INTEGER", "SERIAL")
        .when((kind == "NUMERIC") & (F.col("scale") > 0), F.format_string("NUMERIC(%s,%s)", F.col("precision").cast("string"), F.col("scale").cast("string")))
        .when(kind == "CHARACTER", "TEXT")
        .otherwise(kind)
        .alias("Type"),
        F.when(price < 50000, "").when(price < 100000, "yes").when(price < 250000, "FALSE").when(price < 260000, "false ").otherwise(" True").alias("Nullable?"),
        F.when(price < 60000, "").when(price > 480000, "TRUE").otherwise("FALSE").alias("Primary Key?"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "")
        .otherwise(F.coalesce(F.concat(F.lit("meta.cust__"), F.col("o_custkey"), F.lit(".o_"), target), F.lit("")))
        .alias("Foreign Key"),
        F.concat(F.lit('Says "'), F.col("o_orderpriority"), F.lit('",\nstatus '), F.col("o_orderstatus")).alias("Description"),
        F.when(price > 400000, "").otherwise(F.concat_ws("|", F.col("o_orderkey"), F.col("o_custkey"))).alias("Sample Values"),
    )
    blank = [F.lit("").alias(c) for c in CATALOG_HEADER[3:]]
    heads = columns.select(name.alias("Table")).distinct().select("Table", F.lit("NULL").alias("Column"), F.lit("0").alias("Order"), *blank)
    return rows.unionByName(heads)


def documentation(spark: SparkSession, sf_dir: str, columns: DataFrame) -> DataFrame:
    """Documented columns; those of medium priority are documented again in a later file."""
    rows = typed_catalog(catalog_tokens(spark, sf_dir, columns))
    again = F.col("type") == "CHARACTER VARYING"
    files = rows.withColumn("file_rank", F.explode(F.when(again, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return documented_columns(without_generated_owners(files.withColumn("type", F.when(F.col("file_rank") == 2, "TEXT").otherwise(F.col("type")))))


def _two_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """The schema as it was before December, a documentation that begins in February, and the order of its rows."""
    columns, _ = written(raw_columns(spark, sf_dir), "columns")
    actual = actual_metadata(spark, sf_dir, columns.where(_month() < 12)).where(~F.col("schema").isin(*SYSTEM_SCHEMAS, GENERATED_SCHEMA))
    actual = actual.withColumn("table", F.concat_ws(".", *TABLE))
    return actual, documentation(spark, sf_dir, columns.where(_month() > 1)), ["file_rank", "order"]


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_issues(*_two_sides(spark, sf_dir))


def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole comparison in one row."""
    return catalog_report(*_two_sides(spark, sf_dir))


def metadata_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata = actual_metadata(spark, sf_dir).where(~F.col("schema").isin(*SYSTEM_SCHEMAS))
    named = metadata.withColumn("table", F.concat_ws(".", *TABLE))
    return named.select("table", "column", "order", "type", "nullable", "primary_key", "foreign_key")


def metadata_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a table whose line numbers are its key columns, and refers to its customer's first order."""
    # The numbers of an order side by side: the rows of a constraint stay together in what is shuffled, where they compress well.
    numbers = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.struct("l_linenumber")).alias("numbers"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    kinds = F.explode(
        F.array(
            *[
                F.struct(F.lit(p).alias("prefix"), F.lit(k).alias("kind"))
                for p, k in (("pk_", "PRIMARY KEY"), ("uq_", "UNIQUE"), ("fk_", "FOREIGN KEY"))
            ]
        )
    )

    def names(key: str) -> list[Column]:
        return [
            F.lit("sales").alias("schema"),
            F.concat(F.lit("order_"), F.col(key)).alias("table"),
            F.concat(F.col("k.prefix"), F.col(key)).alias("name"),
        ]

    constraints = orders.select("o_orderkey", kinds.alias("k")).select(*names("o_orderkey"), "k.kind")
    key_columns = numbers.select("l_orderkey", "numbers", kinds.alias("k")).select("l_orderkey", "k", F.inline("numbers")).select(
        *names("l_orderkey"), F.concat(F.lit("c"), F.col("l_linenumber")).alias("column"), F.col("l_linenumber").alias("position")
    )
    first = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    references = orders.join(first, "o_custkey").select(
        F.lit("sales").alias("schema"),
        F.concat(F.lit("fk_"), F.col("o_orderkey")).alias("name"),
        F.lit("sales").alias("ref_schema"),
        F.concat(F.lit("pk_"), F.col("first")).alias("ref_name"),
    )

    def rows(kind: str, df: DataFrame) -> DataFrame:
        optional = [c if c in df.columns else F.lit(None).alias(c) for c in ("position", "ref_table", "ref_column")]
        return df.select(F.lit(kind).alias("kind"), "table", "column", *optional)

    return (
        rows("PRIMARY KEY", primary_key_columns(constraints, key_columns))
        .unionByName(rows("UNIQUE", single_unique_columns(constraints, key_columns)))
        .unionByName(rows("FOREIGN KEY", foreign_key_columns(constraints, key_columns, references)))
    )


def lateral_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The foreign keys of ``metadata_keys`` from the system catalog's form: column numbers in arrays, names elsewhere."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    first = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("ref_relation"))
    numbers = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("numbers"))
    own = orders.join(first, "o_custkey").select(F.col("o_orderkey").alias("relation"), "ref_relation").join(numbers.withColumnRenamed("l_orderkey", "relation"), "relation")
    both = own.join(numbers.select(F.col("l_orderkey").alias("ref_relation"), F.col("numbers").alias("others")), "ref_relation")
    shared = F.array_intersect("numbers", "others")
    constraints = both.select(F.concat(F.lit("fk_"), F.col("relation")).alias("name"), F.lit("f").alias("kind"), "relation", "ref_relation", shared.alias("numbers"), shared.alias("ref_numbers"))
    relations = orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order_"), F.col("o_orderkey")).alias("name"), F.lit(1).alias("namespace"))
    namespaces = spark.createDataFrame([(1, "sales")], "id int, name string")
    attributes = lines.select(F.col("l_orderkey").alias("relation"), F.col("l_linenumber").alias("number"), F.concat(F.lit("c"), F.col("l_linenumber")).alias("name"))
    return catalogued_foreign_keys(constraints, relations, namespaces, attributes).drop("schema", "name", "ref_schema")


def catalog_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog files with three headers: the whole one, one in another order, one that lacks columns."""
    tokens, path = catalog_tokens(spark, sf_dir), scratch_path(spark, "headers")
    kind = F.length("Table") % 3
    for i, header in enumerate((CATALOG_HEADER, CATALOG_HEADER[::-1], CATALOG_HEADER[:-2])):
        write_csv(tokens.where(kind == i).select(*[f"`{c}`" for c in header]), f"{path}/part{i}")
    return typed_catalog(read_catalog(spark, [f"{path}/part{i}" for i in range(3)]))


def catalog_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as columns of a table for each nation: catalog files per table, loaded in place of an older version."""
    path, target = scratch_path(spark, "catalogs"), scratch_path(spark, "catalog")
    customers = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("meta.nation__"), F.col("c_nationkey")).alias("table"),
        F.col("c_name").alias("column"),
        F.col("c_custkey").cast("long").alias("order"),
        F.col("c_mktsegment").alias("type"),
        (F.col("c_acctbal") > 5000).alias("nullable"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") > 9000).alias("primary_key"),
        F.when(F.col("c_acctbal") < 0, F.concat(F.lit("meta.nation__"), F.col("c_nationkey"), F.lit(".ID"))).alias("foreign_key"),
        F.concat(F.lit('of "'), F.col("c_mktsegment"), F.lit('",\nthat is all')).alias("description"),
        F.lit(None).cast("string").alias("sample_values"),
    )
    replace_rows(customers.withColumn("file", F.lit("old")), target)
    write_catalogs(customers, path)
    replace_catalog(spark, [path, f"{path}/absent"], target, file_name=None)
    remove_old_versions(spark, target)
    return read_rows(spark, target).drop("file")


def footer_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of all given files as their footers tell, with the rows and NULL values of plain ones."""
    files = list_tree(spark, [sf_dir]).where(F.col("name").endswith(".parquet"))
    name = F.regexp_extract("file", r"/([a-z]+)\.parquet(/[^/]*)?$", 1)
    found = parquet_columns(files).groupBy(name.alias("table"), "column", "order")
    return found.agg(F.min("type").alias("type"), F.count_distinct("type").alias("types"), F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls")).where(F.col("table") != "")


def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens to CSV files and back through the header-bound reader."""
    path = scratch_path(spark, "catalog")
    write_csv(catalog_tokens(spark, sf_dir), path, ["Table", "Order"])
    return typed_catalog(read_catalog(spark, path))


def catalog_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_rows(typed_catalog(catalog_tokens(spark, sf_dir)))


def catalog_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differences(spark, sf_dir).select("type", "table", "column", "db_value", "catalog_value")


def catalog_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of all differences."""
    return differences(spark, sf_dir).select("type", "table", "column", "message")


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table_presence(
        user_tables(raw_columns(spark, sf_dir).where(_month() < 12)),
        user_tables(raw_columns(spark, sf_dir).where(_month() > 1)),
    )
    return both.agg(
        F.count_if("in_left").alias("db_tables"),
        F.count_if("in_right").alias("catalog_tables"),
        F.count_if(F.col("in_left") & F.col("in_right")).alias("tables_checked"),
    )


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with a column since 1998 against tables with one before."""
    columns = raw_columns(spark, sf_dir)
    recent = F.year("o_orderdate") >= 1998
    return snapshot_diff(user_tables(columns.where(recent)), user_tables(columns.where(~recent)), ["meta", TEST_SCHEMA])


def identifier_exprs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def column(name: str, c: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.lit(c).alias("source"), F.col(c).alias("name"))

    names = column("part", "p_name").unionByName(column("nation", "n_name")).unionByName(column("customer", "c_name"))
    names = names.unionByName(column("part", "p_brand")).unionByName(column("pages", "url")).unionByName(column("events", "event_type"))
    name, qualified = F.col("name"), F.concat(F.lit("meta."), F.replace(F.col("name"), F.lit(" "), F.lit("__")))
    return names.select(
        "source",
        "name",
        quote_identifier(name).alias("quoted"),
        quote_qualified(qualified).alias("qualified"),
        diagram_name(name).alias("diagram"),
        table_path(qualified).alias("path"),
    )


def ddl_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns, _ = written(raw_columns(spark, sf_dir).where(~F.col("schema").isin(*SYSTEM_SCHEMAS)), "columns")
    unique = columns.where(F.col("o_totalprice") > 490000).select(*TABLE, "column")
    foreign, _ = written(foreign_keys(columns, table(spark, sf_dir, "lineitem")), "foreign-keys")
    # A foreign key counts once per table and reference; its name is the first of its constraints.
    lines = ddl_lines(columns, primary_keys(columns), unique, foreign)
    return lines.select(*TABLE, "section", "constraint", "position", "text")


def er_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = last_per_key(typed_catalog(catalog_tokens(spark, sf_dir)), ["table", "column"], ["order"])
    schemas = ["meta", TEST_SCHEMA]
    definitions, _ = written(table_definitions(catalog, schemas), "definitions")
    return diagram_lines(definitions, schemas)


_RAW = f"""raw AS (
  SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'meta' WHEN o_orderstatus = 'O' THEN '{TEST_SCHEMA}'
      WHEN year(o_orderdate) < 1998 THEN '{GENERATED_SCHEMA}' ELSE 'pg_catalog' END AS schema_name,
    'cust__' || o_custkey AS table_name,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'Order ID ' ELSE 'o_' END || o_orderkey AS column_name,
    o_orderkey + 1 AS pos, month(o_orderdate) AS mon,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'INTEGER' WHEN '2-HIGH' THEN 'NUMERIC'
      WHEN '3-MEDIUM' THEN 'CHARACTER VARYING' WHEN '4-NOT SPECIFIED' THEN 'TIMESTAMP WITHOUT TIME ZONE'
      ELSE 'CHARACTER' END AS kind,
    CASE WHEN month(o_orderdate) > 1 THEN day(o_orderdate) END AS len,
    month(o_orderdate) + 8 AS prec, year(o_orderdate) - 1995 AS scale,
    o_totalprice > 250000 AS nullable
  FROM orders)"""

_FK = """fk_rows AS (
  SELECT raw.*, 'fk_' || l_linenumber AS constraint_name,
    'cust__' || CASE WHEN l_returnflag = 'R' THEN o_custkey ELSE l_suppkey END AS ref_table,
    'o_' || CASE WHEN l_returnflag = 'R' THEN o_orderkey ELSE l_partkey END AS ref_column
  FROM lineitem JOIN raw ON l_orderkey = o_orderkey)"""

_ACTUAL = f"""{_RAW}, db_raw AS (SELECT * FROM raw),
{_FK.replace("JOIN raw", "JOIN db_raw AS raw")},
ends AS (SELECT schema_name, table_name, min(pos) AS lo, max(pos) AS hi FROM db_raw GROUP BY ALL),
fk AS (SELECT o_orderkey, arg_max('meta.' || ref_table || '.' || ref_column,
    (constraint_name, 'meta.' || ref_table || '.' || ref_column)) AS foreign_key FROM fk_rows GROUP BY o_orderkey),
actual AS (
  SELECT schema_name || '.' || table_name AS tab, schema_name, column_name AS col, pos,
    CASE WHEN kind = 'NUMERIC' AND scale <> 0 THEN 'NUMERIC(' || prec || ',' || scale || ')' ELSE kind END AS typ,
    nullable, pos IN (lo, hi) AS pk, foreign_key
  FROM db_raw JOIN ends USING (schema_name, table_name) LEFT JOIN fk USING (o_orderkey))"""

_TOKENS = """doc_raw AS (SELECT * FROM raw),
docs AS (
  SELECT schema_name || '.' || table_name AS tab, column_name AS col,
    pos + CASE WHEN o_totalprice > 450000 THEN 1 ELSE 0 END AS pos,
    CASE WHEN kind = 'INTEGER' THEN 'SERIAL' WHEN kind = 'NUMERIC' AND scale > 0 THEN 'NUMERIC(' || prec || ',' || scale || ')'
      WHEN kind = 'CHARACTER' THEN 'TEXT' ELSE kind END AS typ,
    CASE WHEN o_totalprice < 100000 THEN NULL ELSE o_totalprice >= 260000 END AS nullable,
    CASE WHEN o_totalprice < 60000 THEN NULL ELSE o_totalprice > 480000 END AS pk,
    CASE WHEN o_orderpriority <> '2-HIGH' THEN 'meta.cust__' || o_custkey || '.o_' ||
      CASE WHEN part IS NOT NULL THEN CASE WHEN o_totalprice > 480000 THEN o_orderkey ELSE part END END END AS foreign_key,
    'Says "' || o_orderpriority || '",' || chr(10) || 'status ' || o_orderstatus AS description,
    CASE WHEN o_totalprice <= 400000 THEN o_orderkey || '|' || o_custkey END AS samples
  FROM doc_raw LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS part FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
heads AS (SELECT DISTINCT schema_name || '.' || table_name AS tab FROM doc_raw)"""

# Two sides that differ: the schema before December, the documentation since February.
_ISSUES = f"""{_ACTUAL.replace("FROM raw),", "FROM raw WHERE mon < 12),", 1)}, {_TOKENS.replace("FROM raw),", "FROM raw WHERE mon > 1),", 1)},
a AS (SELECT * FROM actual WHERE schema_name IN ('meta', '{TEST_SCHEMA}')),
d AS (SELECT * REPLACE (CASE WHEN typ = 'CHARACTER VARYING' THEN 'TEXT' ELSE typ END AS typ) FROM docs
  WHERE tab NOT LIKE '{GENERATED_SCHEMA}.%'),
j AS (SELECT a.tab, a.col, a.pos AS apos, d.pos AS dpos, a.typ AS atyp, d.typ AS dtyp, a.nullable AS an, d.nullable AS dn,
    a.pk AS ap, d.pk AS dp, a.foreign_key AS af, d.foreign_key AS df FROM a JOIN d USING (tab, col)),
common AS (SELECT tab FROM a INTERSECT SELECT tab FROM d),
found AS (
  SELECT 'missing_table' AS type, tab, NULL AS col, NULL AS x, NULL AS y FROM (SELECT tab FROM a EXCEPT SELECT tab FROM d)
  UNION ALL SELECT 'extra_table', tab, NULL, NULL, NULL FROM (SELECT tab FROM d EXCEPT SELECT tab FROM a)
  UNION ALL SELECT 'missing_column', tab, col, NULL, NULL FROM (SELECT tab, col FROM a EXCEPT SELECT tab, col FROM d) SEMI JOIN common USING (tab)
  UNION ALL SELECT 'extra_column', tab, col, NULL, NULL FROM (SELECT tab, col FROM d EXCEPT SELECT tab, col FROM a) SEMI JOIN common USING (tab)
  UNION ALL SELECT 'order_mismatch', tab, col, CAST(apos AS VARCHAR), CAST(dpos AS VARCHAR) FROM j WHERE apos <> dpos
  UNION ALL SELECT 'type_mismatch', tab, col, atyp, dtyp FROM j WHERE atyp <> dtyp AND NOT (atyp = 'INTEGER' AND dtyp = 'SERIAL')
  UNION ALL SELECT 'nullability_mismatch', tab, col, CASE WHEN an THEN 'True' ELSE 'False' END, CASE WHEN dn THEN 'True' ELSE 'False' END FROM j WHERE an <> dn
  UNION ALL SELECT 'primary_key_mismatch', tab, col, CASE WHEN ap THEN 'True' ELSE 'False' END, CASE WHEN dp THEN 'True' ELSE 'False' END FROM j WHERE ap <> dp
  UNION ALL SELECT 'foreign_key_mismatch', tab, col, af, df FROM j WHERE af <> df
  UNION ALL SELECT 'foreign_key_missing_in_catalog', tab, col, af, NULL FROM j WHERE af IS NOT NULL AND df IS NULL)"""

_CATALOG_SQL = f"""WITH {_RAW}, {_TOKENS}, typed AS (
  SELECT tab AS "table", col AS "column", pos AS "order", typ AS type, nullable, pk AS primary_key, foreign_key,
    description, samples AS sample_values FROM docs
  UNION ALL SELECT tab, NULL, 0, '', NULL, NULL, NULL, NULL, NULL FROM heads)"""


def _quoted(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, '^[0-9]') OR regexp_matches({x}, '\\p{{Lu}}') OR "
        f"NOT regexp_full_match(replace({x}, '_', ''), '[\\p{{L}}\\p{{N}}]+') THEN '\"' || {x} || '\"' ELSE {x} END"
    )


_DDL_SQL = f"""WITH {_RAW.replace("raw AS (", "every AS (", 1)}, raw AS (SELECT * FROM every WHERE schema_name <> 'pg_catalog'), {_FK},
fk AS (
  SELECT schema_name, table_name, text, min((constraint_name, 1)) AS spot FROM (
    SELECT *, '    FOREIGN KEY (' || {_quoted("column_name")} || ') REFERENCES meta.' || ref_table || ' (' || ref_column || ')' AS text
    FROM fk_rows) GROUP BY ALL),
fk_last AS (SELECT schema_name, table_name, max(spot) AS last_fk FROM fk GROUP BY ALL),
ends AS (SELECT schema_name, table_name, min(pos) AS lo, max(pos) AS hi, arg_min(column_name, pos) AS first_name,
    arg_max(column_name, pos) AS last_name FROM raw GROUP BY ALL),
tabs AS (SELECT *, '    PRIMARY KEY (' || {_quoted("first_name")} || CASE WHEN lo <> hi THEN ', ' || {_quoted("last_name")} ELSE '' END || ')' AS pk
  FROM ends LEFT JOIN fk_last USING (schema_name, table_name)),
lines AS (
  SELECT schema_name, table_name, section, '' AS cons, CAST(position AS BIGINT) AS position, text FROM tabs, LATERAL (VALUES
    (0, 0, '-- Schema Creation'), (0, 1, 'CREATE SCHEMA IF NOT EXISTS ' || {_quoted("schema_name")} || ';'), (0, 2, ''),
    (0, 3, '-- Table Creation'), (0, 4, 'CREATE TABLE ' || {_quoted("schema_name")} || '.' || table_name || ' ('), (0, 5, ''),
    (0, 6, '    -- Columns'), (2, 0, ''), (2, 1, '    -- Primary Key'),
    (2, 2, pk || CASE WHEN last_fk IS NULL THEN '' ELSE ',' END), (5, 0, ''), (5, 1, ');')) AS v(section, position, text)
  UNION ALL
  SELECT schema_name, table_name, 3, '', position, text FROM tabs, LATERAL (VALUES (0, ''), (1, '    -- Foreign Keys')) AS v(position, text)
    WHERE last_fk IS NOT NULL
  UNION ALL
  SELECT schema_name, table_name, 1, '', pos, '    ' || {_quoted("column_name")} || ' ' ||
    CASE kind WHEN 'INTEGER' THEN 'SERIAL' WHEN 'CHARACTER' THEN 'TEXT'
      WHEN 'CHARACTER VARYING' THEN CASE WHEN len IS NULL THEN 'TEXT' ELSE 'VARCHAR(' || len || ')' END
      WHEN 'NUMERIC' THEN CASE WHEN scale = 0 THEN 'NUMERIC(' || prec || ')' ELSE 'NUMERIC(' || prec || ',' || scale || ')' END
      ELSE kind END ||
    CASE WHEN nullable THEN '' ELSE ' NOT NULL' END || CASE WHEN o_totalprice > 490000 THEN ' UNIQUE' ELSE '' END ||
    CASE WHEN kind = 'CHARACTER' THEN ' DEFAULT ''none''' ELSE '' END || ',' FROM raw
  UNION ALL
  SELECT schema_name, table_name, 4, spot[1], 1, text || CASE WHEN spot = last_fk THEN '' ELSE ',' END
  FROM fk JOIN fk_last USING (schema_name, table_name))
SELECT schema_name AS "schema", table_name AS "table", section, cons AS "constraint", position, text FROM lines"""

_ER_SQL = f"""WITH {_RAW}, {_TOKENS},
defs AS (
  SELECT split_part(tab, '.', 1) AS sch, split_part(tab, '.', 2) AS name, replace(tab, '.', '_') AS entity,
    CASE WHEN tab LIKE 'meta.%' THEN 1 ELSE 2 END AS rnk, * FROM docs WHERE tab NOT LIKE '{GENERATED_SCHEMA}.%' AND tab NOT LIKE 'pg_catalog.%'),
ents AS (SELECT DISTINCT rnk, name, entity FROM defs),
rel AS (SELECT rnk, name, entity, col, pos, 'meta_' || split_part(foreign_key, '.', 2) AS ref_entity,
    split_part(foreign_key, '.', 3) AS ref_col FROM defs WHERE foreign_key IS NOT NULL),
lines AS (
  SELECT * FROM (VALUES (0, 0, '', -1, 0, 'erDiagram'), (0, 0, '', -1, 1, ''), (2, 0, '', -1, 0, '    %% Relationships'), (2, 0, '', -1, 1, ''),
    (1, 1, '', -1, 0, '    %% Meta Schema'), (1, 1, '', -1, 1, ''), (1, 2, '', -1, 0, '    %% Test00000000000000000000 Schema'),
    (1, 2, '', -1, 1, '')) AS v(section, schema_rank, name, part, position, text)
  UNION ALL SELECT 1, rnk, name, part, 0, CASE part WHEN 0 THEN '    ' || entity || ' {{' WHEN 2 THEN '    }}' ELSE '' END
    FROM ents, (VALUES (0), (2), (3)) AS p(part)
  UNION ALL SELECT 1, rnk, name, 1, pos, '        ' || CASE WHEN typ LIKE 'NUMERIC%' THEN 'DECIMAL' WHEN typ LIKE 'TIMESTAMP%' THEN 'TIMESTAMP'
    ELSE typ END || ' ' || replace(col, ' ', '_') FROM defs
  UNION ALL SELECT 2, rnk, name, 0, pos, '    ' || entity || CASE WHEN EXISTS (SELECT 1 FROM defs k WHERE k.pk AND k.entity = rel.ref_entity
      AND k.col = rel.ref_col) THEN ' ||--o{{ ' ELSE ' }}o--|| ' END || ref_entity || ' : "' || col || '"'
    FROM rel WHERE ref_entity IN (SELECT entity FROM ents))
SELECT section, schema_rank, name, part, CAST(position AS BIGINT) AS position, text FROM lines""".replace("{{", "{").replace("}}", "}")

# Arrow's names of the types in the files, as DuckDB calls them.
_ARROW = "CASE data_type WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT[]' THEN 'list<element: float>' WHEN 'TIMESTAMP' THEN 'timestamp[us]' WHEN 'DATE' THEN 'date32[day]' ELSE data_type END"
_FOOTER_SQL = "\nUNION ALL ".join(
    f"""SELECT '{name}' AS "table", '{column}' AS "column", {order} AS "order", {_ARROW.replace("data_type", f"(SELECT any_value(typeof({column})) FROM {name})")} AS type,
      1::BIGINT AS types, count(*)::BIGINT AS rows, {"NULL::BIGINT" if column == "embedding" else f"(count(*) - count({column}))::BIGINT"} AS nulls FROM {name}"""
    for name, columns in COLUMNS.items()
    for order, column in enumerate(columns.split(), start=1)
)

QUERIES = {
    "metadata_columns": metadata_columns,
    "metadata_keys": metadata_keys,
    "lateral_keys": lateral_keys,
    "catalog_headers": catalog_headers,
    "catalog_replace": catalog_replace,
    "footer_columns": footer_columns,
    "catalog_scan": catalog_scan,
    "catalog_export": catalog_export,
    "catalog_reconcile": catalog_reconcile,
    "catalog_messages": catalog_messages,
    "catalog_summary": catalog_summary,
    "catalog_tables": catalog_tables,
    "snapshot_diff": snapshot,
    "identifier_exprs": identifier_exprs,
    "ddl_text": ddl_text,
    "er_edges": er_edges,
}

ORACLE = {
    "metadata_columns": f"""WITH {_ACTUAL} SELECT tab AS "table", col AS "column", pos AS "order", typ AS type, nullable,
        pk AS primary_key, foreign_key FROM actual WHERE schema_name <> 'pg_catalog'""",
    "metadata_keys": """WITH l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem),
        f AS (SELECT o_orderkey AS o, min(o_orderkey) OVER (PARTITION BY o_custkey) AS r FROM orders)
        SELECT 'PRIMARY KEY' AS kind, 'order_' || o AS "table", 'c' || n AS "column", n AS position,
          NULL::VARCHAR AS ref_table, NULL::VARCHAR AS ref_column FROM l
        UNION ALL SELECT 'UNIQUE', 'order_' || o, 'c' || min(n), NULL, NULL, NULL FROM l GROUP BY o HAVING count(*) = 1
        UNION ALL SELECT 'FOREIGN KEY', 'order_' || l.o, 'c' || l.n, l.n, 'order_' || f.r, 'c' || p.n
          FROM l JOIN f ON l.o = f.o JOIN l AS p ON p.o = f.r AND p.n = l.n""",
    "lateral_keys": """WITH l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem),
        f AS (SELECT o_orderkey AS o, min(o_orderkey) OVER (PARTITION BY o_custkey) AS r FROM orders)
        SELECT 'order_' || l.o AS "table", 'c' || l.n AS "column", (row_number() OVER (PARTITION BY l.o ORDER BY l.n))::INTEGER AS position,
          'order_' || f.r AS ref_table, 'c' || p.n AS ref_column FROM l JOIN f ON l.o = f.o JOIN l AS p ON p.o = f.r AND p.n = l.n""",
    "catalog_headers": f"""{_CATALOG_SQL} SELECT * EXCLUDE (lacks) REPLACE (CASE WHEN lacks THEN NULL ELSE description END AS description,
        CASE WHEN lacks THEN NULL ELSE sample_values END AS sample_values) FROM (SELECT *, length("table") % 3 = 2 AS lacks FROM typed)""",
    "catalog_replace": """SELECT 'meta.nation__' || c_nationkey AS "table", c_name AS "column", c_custkey AS "order", c_mktsegment AS type, c_acctbal > 5000 AS nullable,
        CASE WHEN c_acctbal > 0 THEN c_acctbal > 9000 END AS primary_key, CASE WHEN c_acctbal < 0 THEN 'meta.nation__' || c_nationkey || '.ID' END AS foreign_key,
        'of "' || c_mktsegment || '",' || chr(10) || 'that is all' AS description, NULL::VARCHAR AS sample_values FROM customer""",
    "footer_columns": _FOOTER_SQL,
    "catalog_scan": f"{_CATALOG_SQL} SELECT * FROM typed",
    "catalog_export": f"""{_CATALOG_SQL} SELECT "table" AS "Table", coalesce("column", 'NULL') AS "Column", CAST("order" AS VARCHAR) AS "Order",
        type AS "Type", CASE nullable WHEN true THEN 'TRUE' WHEN false THEN 'FALSE' ELSE '' END AS "Nullable?",
        CASE primary_key WHEN true THEN 'TRUE' WHEN false THEN 'FALSE' ELSE '' END AS "Primary Key?",
        coalesce(foreign_key, '') AS "Foreign Key", coalesce(description, '') AS "Description",
        coalesce(sample_values, '') AS "Sample Values" FROM typed""",
    "catalog_reconcile": f'WITH {_ISSUES} SELECT type, tab AS "table", col AS "column", x AS db_value, y AS catalog_value FROM found',
    "catalog_messages": f"""WITH {_ISSUES} SELECT type, tab AS "table", col AS "column", CASE type
        WHEN 'missing_table' THEN 'The catalog says nothing about table ' || tab
        WHEN 'extra_table' THEN 'The catalog describes table ' || tab || ', which is not in the database'
        WHEN 'missing_column' THEN 'The catalog says nothing about column ' || tab || '.' || col
        WHEN 'extra_column' THEN 'The catalog describes column ' || tab || '.' || col || ', which is not in the database'
        WHEN 'foreign_key_missing_in_catalog' THEN 'Column ' || tab || '.' || col || ' refers to ' || x || ', the catalog names no target'
        ELSE replace(replace(type, '_mismatch', ''), '_', ' ') || ' of ' || tab || '.' || col || ' is ' || x || ' in the database and ' || y || ' in the catalog'
        END AS message FROM found""",
    "catalog_summary": f"""WITH {_ISSUES}, n AS (SELECT (SELECT count(*) FROM found) AS total_issues, (SELECT count(*) FROM common) AS tables_checked, (SELECT count(*) FROM j) AS columns_checked)
        SELECT 'validation_errors' AS status, false AS valid, 'catalog: ' || total_issues || ' issues in ' || tables_checked || ' tables, ' || columns_checked || ' columns' AS message, * FROM n""",
    "catalog_tables": f"""WITH {_RAW}, a AS (SELECT DISTINCT schema_name, table_name FROM raw WHERE mon < 12 AND schema_name <> 'pg_catalog'),
        d AS (SELECT DISTINCT schema_name, table_name FROM raw WHERE mon > 1 AND schema_name <> 'pg_catalog')
        SELECT (SELECT count(*) FROM a) AS db_tables, (SELECT count(*) FROM d) AS catalog_tables,
          (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM d)) AS tables_checked""",
    "snapshot_diff": f"""WITH {_RAW}, t AS (SELECT schema_name, table_name, bool_or(year(o_orderdate) >= 1998) AS in_db,
          bool_or(year(o_orderdate) < 1998) AS in_local FROM raw WHERE schema_name IN ('meta', '{TEST_SCHEMA}') GROUP BY ALL)
        SELECT schema_name || '.' || table_name AS "table", CASE WHEN NOT in_db THEN 'delete' WHEN NOT in_local THEN 'create'
          ELSE 'update' END AS action, schema_name || '/' || replace(table_name, '__', '/') || '/create.sql' AS path FROM t""",
    "identifier_exprs": f"""WITH n AS (SELECT 'p_name' AS source, p_name AS name FROM part UNION ALL SELECT 'n_name', n_name FROM nation
          UNION ALL SELECT 'c_name', c_name FROM customer UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'url', url FROM pages
          UNION ALL SELECT 'event_type', event_type FROM events),
        x AS (SELECT *, replace(name, ' ', '__') AS t FROM n)
        SELECT source, name, {_quoted("name")} AS quoted, 'meta.' || {_quoted("t")} AS qualified,
          regexp_replace(replace(name, ' ', '_'), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS diagram,
          'meta/' || replace(t, '__', '/') || '/create.sql' AS path FROM x""",
    "ddl_text": _DDL_SQL,
    "er_edges": _ER_SQL,
}
