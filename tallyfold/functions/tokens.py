"""Typed values from the text tokens of catalog files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfold.functions.text import strip


def bool_token(token: Column) -> Column:
    """TRUE and FALSE in any case; everything else is NULL. A cast would also accept ``t`` or ``yes``."""
    word = F.upper(strip(token))
    return F.when(word == "TRUE", F.lit(True)).when(word == "FALSE", F.lit(False))


def bool_text(value: Column) -> Column:
    """The inverse of :func:`bool_token`; NULL becomes the empty string."""
    return F.when(value, "TRUE").when(~value, "FALSE").otherwise("")


def null_token(token: Column) -> Column:
    """The word NULL in any case, and blank text, mean NULL; other text is stripped."""
    word = strip(token)
    return F.when((word != "") & (F.upper(word) != "NULL"), word)


def empty_to_null(token: Column) -> Column:
    return F.nullif(token, F.lit(""))


def is_table_row(order_token: Column) -> Column:
    """The row describes the table and not a column of it."""
    return F.coalesce(strip(order_token), F.lit("")).isin("", "0", "NULL")


def order_number(order_token: Column) -> Column:
    """Position of the column; text that is no number stops the query under ANSI mode."""
    return strip(order_token).cast("long")
