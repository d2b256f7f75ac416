"""JSON bundles ``language -> key -> value`` in long form.

JSON is read as VARIANT: a wrong type in one value then neither voids the file nor changes into text.
Non-finite numbers, which Python's parser accepts, count as malformed here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, VOID, ..."""
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)


def members_of(value: Column) -> Column:
    """Members of a JSON object; NULL for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def parse_bundles(files: DataFrame) -> DataFrame:
    """``(file, content)`` to ``(file, kind, members)``; ``kind`` is NULL where the JSON is malformed.

    A repeated key counts once, with its last value.
    """
    files.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # Exploding a single value keeps the optimizer from parsing once per use.
    value = F.explode(F.array(F.try_parse_json("content")))
    return files.select("file", value.alias("value")).select(
        "file", kind_of(F.col("value")).alias("kind"), members_of(F.col("value")).alias("members")
    )


def bundle_languages(parsed: DataFrame) -> DataFrame:
    """``(file, lang, kind, members)`` for every language a file names."""
    return parsed.select("file", F.explode("members").alias("lang", "value")).select(
        "file", "lang", kind_of(F.col("value")).alias("kind"), members_of(F.col("value")).alias("members")
    )


def bundle_entries(languages: DataFrame) -> DataFrame:
    """BUNDLE rows ``(file, lang, key, value, value_type)``; non-string values keep their JSON text."""
    return languages.select("file", "lang", F.explode("members").alias("key", "v")).select(
        "file",
        "lang",
        "key",
        F.coalesce(F.when(kind_of(F.col("v")) == "STRING", F.try_variant_get("v", "$", "string")), F.to_json("v")).alias(
            "value"
        ),
        kind_of(F.col("v")).alias("value_type"),
    )
