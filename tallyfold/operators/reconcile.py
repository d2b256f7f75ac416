"""Comparing two keyed relations: the core that catalog, snapshot and mirror checks share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.schemas import ISSUE


def issue(type_: str, **fields: Column) -> Column:
    """One ISSUE struct; fields that are not given are NULL."""
    fields = {"type": F.lit(type_), **fields}
    return F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in ISSUE.items()])


def issues(df: DataFrame, type_: str, **fields: Column) -> DataFrame:
    """Every row of ``df`` as an ISSUE row."""
    return df.select(F.inline(F.array(issue(type_, **fields))))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by name. Halving keeps the analysis of long unions short: each part is gone over a few times."""
    if len(parts) == 1:
        return parts[0]
    middle = len(parts) // 2
    return union_all(parts[:middle]).unionByName(union_all(parts[middle:]))


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key. Aggregates before the shuffle, so hot keys stay small."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
        .select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])
    )


def matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer match of two relations that are unique by ``keys``: ``(*keys, l, r)``.

    ``l`` and ``r`` hold the other columns; a side without the key is NULL.
    """

    def packed(df: DataFrame, side: str) -> DataFrame:
        return df.select(*keys, F.struct(F.lit(True).alias("present"), *[c for c in df.columns if c not in keys]).alias(side))

    return packed(left, "l").join(packed(right, "r"), keys, "full_outer")


Rule = tuple[Callable[[Column, Column], Column], Callable[[Column, Column], Column]]


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """ISSUE rows for every rule a matched pair breaks.

    A rule is ``(broken, as_issue)``: two functions of the structs ``l`` and ``r``, one giving a
    condition and one the ISSUE struct. Pairs lacking a side take part, so rules must say what they
    need; a condition that is NULL is not broken.
    """
    return broken_rules(matched(left, right, keys), rules)


def broken_rules(pairs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The same for pairs ``(*keys, l, r)`` that are matched already."""
    l, r = F.col("l"), F.col("r")
    found = F.array(*[F.when(broken(l, r), as_issue(l, r)) for broken, as_issue in rules])
    return pairs.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("i.*")


def tagged(left: DataFrame, right: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``(*keys, l, r)`` as :func:`matched`, by one aggregate over the union of both sides instead of a join.

    ``left`` is unique by ``keys``; of several rows of ``right`` that with the greatest ``order`` counts. ``l`` and ``r`` hold the columns of
    ``left``. Rows are combined before they are shuffled, so a key that many rows share is no hot key.
    """
    fields = [c for c in left.columns if c not in keys]
    packed = F.struct(F.lit(True).alias("present"), *fields)
    rank = F.struct(*order)
    one = left.select(*keys, packed.alias("l"))
    many = right.select(*keys, packed.alias("r"), rank.alias("rank"))
    both = one.unionByName(many, allowMissingColumns=True)
    return both.groupBy(*keys).agg(F.any_value("l", True).alias("l"), F.max_by("r", "rank").alias("r"))


def presence(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, in_left, in_right)``, one row per key, by one aggregation over both sides."""
    sides = left.select(*keys, F.lit(True).alias("l")).unionByName(right.select(*keys, F.lit(False).alias("l")))
    return sides.groupBy(*keys).agg(F.bool_or("l").alias("in_left"), F.bool_or(~F.col("l")).alias("in_right"))
