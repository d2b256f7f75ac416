"""Texts that are kept as one line per row, and the number of each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.session import written


def write_lines(lines: DataFrame, path: str, order_by: list[str], folder_by: list[str] | None = None) -> None:
    """Write the ``text`` column in the given order, optionally one folder per value of ``folder_by``.

    The part files of a folder, taken by name, hold the lines in order.
    """
    ordered = lines.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    writer = ordered.select(*(folder_by or []), "text").write
    (writer.partitionBy(*folder_by) if folder_by else writer).text(path)


def _numbered(rows: DataFrame, stretch: list[str], within: str) -> DataFrame:
    """``rows`` with ``line``: stretches in order, and in a stretch the rows by ``within``, which rises by one from row to row.

    Stretches are as many as tasks or files, so their counts can be added up in one window; the rows themselves need none.
    """
    sizes = rows.groupBy(*stretch).agg(F.count(F.lit(1)).alias("rows"), F.min(within).alias("first"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy(*stretch).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*stretch, "first", before.alias("before"))
    return rows.join(offsets, stretch).withColumn("line", F.col("before") + F.col(within) - F.col("first") + 1).drop("before", "first")


def numbered_lines(lines: DataFrame, order_by: list[str]) -> DataFrame:
    """``lines`` with ``line`` (long, from 1): the place of each row in the given order over all rows.

    Rows are dealt out by ranges and sorted within them, and that is written, so that places hold if a task is run again. Rows that are equal in
    ``order_by`` may take each other's places.
    """
    ordered = lines.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed, _ = written(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "lines")
    return _numbered(placed, ["_part"], "_at").drop("_part", "_at")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line, text)`` of the text files at ``path``, taken by name: what :func:`write_lines` wrote, with the number of each line.

    Large files are read in blocks; lines are numbered over the blocks of all files.
    """
    read = spark.read.text(path).select(
        F.col("value").alias("text"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")
    )
    # Places are kept as they were read: a block is read in one go, so they rise by one within it.
    return _numbered(written(read, "read-lines")[0], ["_file", "_block"], "_at").select("line", "text")
