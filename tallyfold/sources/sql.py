"""Parameterised SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def run_sql(spark: SparkSession, query: str | None, params: tuple | list | dict | None = None, **tables) -> DataFrame:
    """Run ``query`` with values bound to ``?`` (sequence) or ``:name`` (dict) markers.

    ``tables`` are DataFrames named in the text as ``{name}``; without any the text is taken as it is.
    """
    if not query:
        raise ValueError("SQL query cannot be empty")
    args = list(params) if isinstance(params, tuple) else params
    return spark.sql(query, args=args, **tables)
