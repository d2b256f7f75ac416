"""File inventories, from a directory tree or from a table of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.components import file_name_of
from tallyfold.sources.storage import list_tree

# Bookkeeping files that are no content, and name patterns that are no components.
SYSTEM_FILES = (".objects", ".buckets", ".DS_Store")
NOT_COMPONENTS = r"\.test\.(tsx?|ts)\z|\.spec\.(tsx?|ts)\z|types\.ts\z|\.d\.ts\z"
NOT_COMPONENT_FOLDERS = ("utils", "providers")


def list_files(spark: SparkSession, roots: list[str], name: str | None = None) -> DataFrame:
    """``(path, size)`` of all files below the roots that exist, optionally of one file name. Only the listing is read, never the bytes."""
    return list_tree(spark, roots, name).select("path", "size")


def named(files: DataFrame, name: str, without: str | None = None) -> DataFrame:
    """Files of one name, minus those whose path contains ``without``."""
    kept = files.where(file_name_of(F.col("path")) == name)
    return kept if without is None else kept.where(~F.col("path").contains(without))


def is_component(path: Column) -> Column:
    """A ``.tsx`` file, or a ``.ts`` file outside helper folders; no tests and no type definitions."""
    folders = F.split(path, "/")
    helper = F.arrays_overlap(folders, F.array(*[F.lit(f) for f in NOT_COMPONENT_FOLDERS]))
    source = path.endswith(".tsx") | (path.endswith(".ts") & ~helper)
    return source & ~path.rlike(NOT_COMPONENTS)


def is_system_file(path: Column) -> Column:
    return file_name_of(path).isin(*SYSTEM_FILES)
