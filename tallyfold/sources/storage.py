"""What Spark's own readers do not tell of files: listings with hidden names, first records, footers, unreadable texts.

Files are opened in tasks by their address, so the work is dealt out by prefixes or by groups of files. Addresses are paths or URIs of
any file system that Arrow knows.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files that one task opens for their heads or footers.
GROUP = 64


def opened(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address and the path in it."""
    scheme = urlparse(address).scheme
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(urlparse(address).path) if scheme else address
    return pafs.FileSystem.from_uri(address)


def plain_path(address: Column) -> Column:
    """An address without the scheme of local files, which Spark spells in several ways."""
    return F.regexp_replace(address, "^file:/+", "/")


def exists(address: str) -> bool:
    system, path = opened(address)
    return system.get_file_info(path).type != pafs.FileType.NotFound


class _Prefix(InputPartition):
    def __init__(self, address: str, deep: bool):
        self.address, self.deep = address, deep


class _TreeReader(DataSourceReader):
    def __init__(self, roots: list[str]):
        self.roots = roots

    def partitions(self) -> list[_Prefix]:
        """The files of each root, and each folder in it with all below. A root that does not exist has none."""
        found = []
        for root in self.roots:
            system, path = opened(root)
            if system.get_file_info(path).type != pafs.FileType.Directory:
                continue
            found.append(_Prefix(root, False))
            inside = system.get_file_info(pafs.FileSelector(path, recursive=False))
            found += [_Prefix(root.rstrip("/") + "/" + one.base_name, True) for one in inside if one.type == pafs.FileType.Directory]
        return found or [_Prefix("", False)]  # a source has at least one partition

    def read(self, partition: _Prefix) -> Iterator[tuple]:
        if not partition.address:
            return
        system, path = opened(partition.address)
        root = partition.address.rstrip("/")
        for one in system.get_file_info(pafs.FileSelector(path, recursive=partition.deep)):
            if one.type == pafs.FileType.File:
                below = one.path[len(path.rstrip("/")) + 1 :]
                yield f"{root}/{below}", below.rsplit("/", 1)[-1], one.size, one.mtime


class FileTree(DataSource):
    """Every file below some roots, whatever its name: ``(path, name, size, modified)``, a partition for each folder of a root."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "path string, name string, size long, modified timestamp"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(json.loads(self.options["roots"]))


def list_tree(spark: SparkSession, roots: list[str], name: str | None = None, without: str | None = None) -> DataFrame:
    """``(path, name, size, modified)`` of the files below ``roots``, optionally of one name and without those that hold a text in their path.

    Names that begin with ``.`` or ``_`` are listed too; roots that do not exist are skipped.
    """
    spark.dataSource.register(FileTree)
    files = spark.read.format("file_tree").option("roots", json.dumps(list(roots))).load()
    if name is not None:
        files = files.where(F.col("name") == name)
    return files if without is None else files.where(~F.contains("path", F.lit(without)))


def _grouped(files: DataFrame, column: str) -> DataFrame:
    """The addresses, spread so that a task opens some ``GROUP`` files."""
    names = files.select(column)
    return names.repartition(max(1, -(-names.count() // GROUP)))


def _first_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for address in batch.column(0).to_pylist():
            system, path = opened(address)
            with system.open_input_stream(path) as stream, io.TextIOWrapper(stream, encoding="utf-8", newline="") as text:
                for position, name in enumerate(next(csv.reader(text), [])):
                    rows.append({"file": address, "position": position, "name": name})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("position", pa.int32()), ("name", pa.string())]))


def csv_headers(files: DataFrame, column: str = "file") -> DataFrame:
    """``(file, position, name)``: the header of each file, from its first record alone. A name may be quoted and hold line breaks."""
    return _grouped(files, column).mapInArrow(_first_records, "file string, position int, name string")


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    schema = pa.schema([("file", pa.string()), ("column", pa.string()), ("order", pa.int32()), ("type", pa.string()), ("nullable", pa.bool_()), ("rows", pa.int64()), ("nulls", pa.int64())])
    for batch in batches:
        rows = []
        for address in batch.column(0).to_pylist():
            system, path = opened(address)
            with system.open_input_file(path) as source:
                footer = pq.read_metadata(source)
            nulls: dict[str, int | None] = {}
            for group in range(footer.num_row_groups):
                for i in range(footer.num_columns):
                    chunk = footer.row_group(group).column(i)
                    known = chunk.statistics.null_count if chunk.statistics is not None and chunk.statistics.has_null_count else None
                    sofar = nulls.get(chunk.path_in_schema, 0)
                    nulls[chunk.path_in_schema] = None if known is None or sofar is None else sofar + known
            for order, field in enumerate(footer.schema.to_arrow_schema(), start=1):
                # Only a plain column has its own statistics; those of nested ones are about their parts.
                count = nulls.get(field.name, None if footer.num_row_groups or pa.types.is_nested(field.type) else 0)
                rows.append({"file": address, "column": field.name, "order": order, "type": str(field.type), "nullable": field.nullable, "rows": footer.num_rows, "nulls": count})
        yield pa.RecordBatch.from_pylist(rows, schema)


def parquet_columns(files: DataFrame, column: str = "path") -> DataFrame:
    """``(file, column, order, type, nullable, rows, nulls)`` of each Parquet file, from its footer alone, so drift between files is seen.

    ``nulls`` is NULL where the footer does not say: for nested columns and files without statistics.
    """
    return _grouped(files, column).mapInArrow(_footers, "file string, column string, order int, type string, nullable boolean, rows long, nulls long")
