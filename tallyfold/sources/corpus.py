"""Whole texts as rows, from files or from a table that already holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.components import file_name_of, folder_of
from tallyfold.functions.text import unix_newlines
from tallyfold.sources.storage import exists, list_tree, plain_path

#: Bytes of a file that is read as one text.
LARGEST = 1 << 28


def corpus_from_table(df: DataFrame, path: Column, content: Column) -> DataFrame:
    """CORPUS rows; line breaks become ``\\n``."""
    return df.select(path.alias("path"), unix_newlines(content).alias("content")).select(
        "path", folder_of(F.col("path")).alias("dir"), file_name_of(F.col("path")).alias("name"), "content"
    )


def read_corpus(spark: SparkSession, roots: list[str], root: str = "", largest: int = LARGEST) -> tuple[DataFrame, DataFrame]:
    """The texts below ``roots``, and the files that gave none: CORPUS rows with paths relative to ``root``, and ``(path, reason)``.

    A file is a text if it can be read, holds valid UTF-8 and no more than ``largest`` bytes. Every file that is listed is in one of the two
    results. Roots that do not exist hold nothing. Files whose names are hidden from Spark's readers are not read, and reported as such.
    """
    listed = list_tree(spark, roots).select(plain_path(F.col("path")).alias("path"), "size", "name")
    hidden = F.col("name").startswith(".") | F.col("name").startswith("_")
    present = [r for r in roots if exists(r)]
    options = {"recursiveFileLookup": True, "ignoreMissingFiles": True, "ignoreCorruptFiles": True}
    if present:
        read = spark.read.format("binaryFile").options(**options).load(present).where(F.col("length") <= largest)
        read = read.select(plain_path(F.col("path")).alias("path"), F.col("content").cast("string").alias("content"))
    else:
        read = spark.createDataFrame([], "path string, content string")
    # Spark reads no split of an empty file.
    empty = listed.where((F.col("size") == 0) & ~hidden).select("path", F.lit("").alias("content"))
    read = read.where("content <> ''").unionByName(empty).withColumn("valid", F.is_valid_utf8("content"))
    seen = read.select(F.col("path").alias("seen"), "valid")
    state = listed.join(seen, F.col("path") == F.col("seen"), "left")
    reason = (
        F.when(F.col("valid"), None)
        .when(~F.col("valid"), "not valid UTF-8")
        .when(F.col("size") > largest, "too large")
        .when(hidden, "hidden")
        .otherwise("not readable")
    )
    failed = state.select("path", reason.alias("reason")).where("reason is not null")
    top = plain_path(F.lit(root.rstrip("/") + "/")) if root else F.lit("")
    relative = F.when(F.startswith("path", top), F.substr("path", F.length(top) + 1)).otherwise(F.col("path"))
    texts = read.where("valid").select(relative.alias("path"), "content")
    return corpus_from_table(texts, F.col("path"), F.col("content")), failed.select(relative.alias("path"), "reason")
