"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyfold")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        # Hash joins where the partitions of one side are small enough to be held, instead of sorting both.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyfold-"))
    return spark.sparkContext.getCheckpointDir()


def bounded_batches(spark: SparkSession, most: str = "4m") -> None:
    """Rows reach Python in batches of about so many bytes; a size that the user has set stays.

    Spark's own limit is 10,000 rows: of long texts, a batch takes much memory, once in the JVM and twice in the worker that reads the next.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, most)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; no two calls share one."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Write ``df`` to the shared folder and return it as a fresh scan, with its row count.

    Cuts the lineage, survives the loss of executors, and gives the optimizer true sizes for its
    choice between broadcast and shuffle. The rows are counted from the footers of the files, as counts
    observed while writing may take in tasks that were run again.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    fresh = df.sparkSession.read.schema(df.schema).parquet(path)
    return fresh, fresh.count()
