"""CSV with exact rules for NULL and empty text.

With ``multi_line`` a file is one task, as quoted fields may span lines: write many files of bounded
size (see the CSV sink), or turn it off where no field contains a line break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyfold.session import written
from tallyfold.sources.storage import csv_headers, plain_path

# Text that cannot be a field, so that no field is read as NULL by its spelling.
NO_TOKEN = "\x01"


def _reader(spark: SparkSession, multi_line: bool):
    return spark.read.options(header=True, multiLine=multi_line, escape='"', nullValue=NO_TOKEN, encoding="UTF-8")


def read_by_header(
    spark: SparkSession, paths: str | list[str], columns: list[str], default: str = "", multi_line: bool = True, file: str | None = None
) -> DataFrame:
    """All values as text, bound by the header of the file they are in; a column that it lacks holds ``default``.

    Headers may differ in any way from file to file. Of several fields of one name the last counts. An empty field, or one that a short row
    lacks, is the empty string. With ``file`` the path of the row's file is given in a column of that name.

    The headers make an index of one row per file, from the first records alone; the rows are bound by position and meet the index by their
    file. The index is small against the rows; Spark broadcasts it as long as its size allows that.
    """
    hidden = "_tallyfold_file"
    every = _reader(spark, multi_line).schema("first string").csv(paths)
    files = spark.createDataFrame([(f,) for f in every.inputFiles()], "file string")
    headers, _ = written(csv_headers(files), "headers")
    width = headers.agg(F.max("position")).first()[0]
    if width is None:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in [*columns, *([file] if file else [])]))
    index = headers.groupBy(plain_path(F.col("file")).alias(hidden)).agg(*[F.max(F.when(F.col("name") == c, F.col("position"))).alias(f"_at{i}") for i, c in enumerate(columns)])
    fields = [f"_c{i}" for i in range(width + 1)]
    rows = _reader(spark, multi_line).options(emptyValue="", enforceSchema=True).schema(", ".join(f"{f} string" for f in fields)).csv(paths)
    rows = rows.select(F.array(*fields).alias("_fields"), plain_path(F.col("_metadata.file_path")).alias(hidden)).join(index, hidden)

    def bound(i: int) -> Column:
        at = F.col(f"_at{i}")
        return F.when(at.isNull(), default).otherwise(F.coalesce(F.get("_fields", at), F.lit("")))

    named = [F.url_decode(hidden).alias(file)] if file else []
    return rows.select(*[bound(i).alias(c) for i, c in enumerate(columns)], *named)


def load_strict(spark: SparkSession, paths: str | list[str], schema: str | StructType, multi_line: bool = True) -> DataFrame:
    """Columns bound by position below one header line; any malformed row fails the whole load.

    An unquoted empty field is NULL, a quoted one the empty string. Column pruning is off, as a pruned
    parser would accept rows of the wrong width.
    """
    return (
        _reader(spark, multi_line)
        .options(mode="FAILFAST", enforceSchema=True, emptyValue="", columnPruning=False)
        .schema(schema)
        .csv(paths)
    )
