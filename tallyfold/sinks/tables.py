"""Tables that are replaced as a whole: each version in a folder of its own, and commits that name the current one.

A version counts from the moment its commit file stands, which is written last. So a load that fails half-way, or a driver that is lost, leaves the
old rows in place, and a reader sees one version or the other. Rows are written once.
"""

from __future__ import annotations

import json
import uuid

from pyarrow.fs import FileSelector, FileType
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyfold.sources.catalogs import read_catalog, typed_catalog
from tallyfold.sources.storage import list_tree, opened

_COMMIT = "version long, folder string, rows long, layout string"


def _commits(spark: SparkSession, path: str) -> list:
    """The commits of a table, the newest first. There is one small row for each version that was not removed."""
    try:
        found = spark.read.schema(_COMMIT).json(f"{path}/commits").collect()
    except AnalysisException:  # no commit yet
        return []
    return sorted(found, key=lambda c: (c["version"], c["folder"]), reverse=True)


def replace_rows(df: DataFrame, path: str) -> int:
    """Replace the table at ``path`` by ``df`` and return its row count. The rows may be those of the table itself."""
    spark = df.sparkSession
    known = _commits(spark, path)
    folder = f"rows-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    count = spark.read.schema(df.schema).parquet(f"{path}/{folder}").count()
    commit = (known[0]["version"] + 1 if known else 1, folder, count, df.schema.json())
    spark.createDataFrame([commit], _COMMIT).coalesce(1).write.mode("append").json(f"{path}/commits")
    return count


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest version."""
    known = _commits(spark, path)
    if not known:
        raise FileNotFoundError(f"{path} holds no committed version")
    layout = StructType.fromJson(json.loads(known[0]["layout"]))
    return spark.read.schema(layout).parquet(f"{path}/{known[0]['folder']}")


def remove_old_versions(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete the rows of all but the newest ``keep`` versions, and of loads that were never committed; return how many folders went.

    Commits stay, so version numbers go on. To be called while no reader uses an old version and no load is under way.
    """
    kept = {c["folder"] for c in _commits(spark, path)[:keep]}
    system, root = opened(path)
    old = [f for f in system.get_file_info(FileSelector(root)) if f.type == FileType.Directory and f.base_name.startswith("rows-") and f.base_name not in kept]
    for folder in old:
        system.delete_dir(folder.path)
    return len(old)


def replace_catalog(spark: SparkSession, roots: list[str], path: str, file_name: str | None = "catalog.csv") -> int | None:
    """Replace the catalog table by the rows of all catalog files below ``roots``; returns their number.

    Files are those of one name, or all CSV files that are not hidden. Without any file the table is left alone and the result is None. Files with a header only empty the table. Headers may differ
    from file to file; ``file`` names the file of a row.
    """
    files = list_tree(spark, roots, file_name)
    if file_name is None:
        files = files.where(F.col("name").endswith(".csv") & ~F.col("name").startswith("."))
    paths = [r["path"] for r in files.select("path").collect()]
    if not paths:
        return None
    raw = read_catalog(spark, paths, file="file")
    return replace_rows(typed_catalog(raw, "file"), path)
