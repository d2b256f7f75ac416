"""Mirroring object inventories ``(bucket, key, size)``: difference, application, manifests."""

from __future__ import annotations

import mimetypes
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.summary import observed
from tallyfold.sources.files import is_system_file


def chosen_buckets(inventory: DataFrame, buckets: Iterable[str] | None) -> DataFrame:
    """Rows of the requested buckets; all for None. Requested buckets that do not exist match nothing."""
    return inventory if buckets is None else inventory.where(F.col("bucket").isin(*buckets))


def mirror_diff(
    remote: DataFrame, local: DataFrame, buckets: Iterable[str] | None = None, existing: DataFrame | None = None
) -> DataFrame:
    """``(bucket, key, action, remote_size, local_size)`` with action download, delete or keep.

    An object is downloaded when it is missing or its size differs, and deleted when only the local
    side has it. Local system files are never deleted. Buckets that do not exist remotely (by default
    those without objects) are not visited.
    """
    return _compared(remote, local, buckets, existing).where(F.col("action") != "system")


def _compared(remote: DataFrame, local: DataFrame, buckets: Iterable[str] | None, existing: DataFrame | None) -> DataFrame:
    source = chosen_buckets(remote, buckets).select("bucket", "key", F.coalesce("size", F.lit(0)).alias("remote_size"), F.lit(True).alias("is_remote"))
    visited = (remote if existing is None else existing).select("bucket").distinct()
    copies = chosen_buckets(local, buckets).select("bucket", "key", F.col("size").alias("local_size"))
    copies = copies.join(visited, "bucket", "left_semi")
    action = (
        F.when(F.col("is_remote") & F.col("remote_size").eqNullSafe(F.col("local_size")), "keep")
        .when(F.col("is_remote"), "download")
        .when(is_system_file(F.col("key")), "system")
        .otherwise("delete")
    )
    return source.join(copies, ["bucket", "key"], "full_outer").select(
        "bucket", "key", action.alias("action"), "remote_size", "local_size"
    )


def mirror_counts(diff: DataFrame) -> DataFrame:
    """``(bucket, downloaded, deleted)``."""
    return diff.groupBy("bucket").agg(
        F.count_if(F.col("action") == "download").alias("downloaded"),
        F.count_if(F.col("action") == "delete").alias("deleted"),
    )


def mirror_totals(diff: DataFrame, visited: DataFrame) -> DataFrame:
    """``(bucket, downloaded, deleted)`` for each visited bucket, with or without objects, and for all of them (bucket NULL), by one aggregate."""
    steps = diff.select("bucket", F.when(F.col("action") == "download", 1).otherwise(0).alias("down"), F.when(F.col("action") == "delete", 1).otherwise(0).alias("gone"))
    every = steps.unionByName(visited.select("bucket", F.lit(0).alias("down"), F.lit(0).alias("gone")))
    return every.rollup("bucket").agg(F.sum("down").alias("downloaded"), F.sum("gone").alias("deleted"))


def mirror_run(
    remote: DataFrame, local: DataFrame, buckets: Iterable[str] | None = None, existing: DataFrame | None = None
) -> DataFrame:
    """One row ``(status, message, buckets, downloaded, deleted, kept)`` of a whole run, counted while its steps are written."""
    names = list(buckets) if buckets is not None else None
    visited = chosen_buckets(remote if existing is None else existing, names).select("bucket").distinct().count()
    counters = {step: F.count_if(F.col("action") == action) for step, action in (("downloaded", "download"), ("deleted", "delete"), ("kept", "keep"))}
    _, seen = observed(mirror_diff(remote, local, names, existing), "mirror", **counters)
    said = f"{visited} buckets mirrored: {seen['downloaded']} objects fetched, {seen['deleted']} removed"
    row = ("success", said, visited, seen["downloaded"], seen["deleted"], seen["kept"])
    return remote.sparkSession.createDataFrame([row], "status string, message string, buckets long, downloaded long, deleted long, kept long")


def mirror_apply(
    remote: DataFrame, local: DataFrame, buckets: Iterable[str] | None = None, existing: DataFrame | None = None
) -> DataFrame:
    """The local inventory after the mirror run: kept and copied objects, and what is out of its reach."""
    after = _compared(remote, local, buckets, existing).where(F.col("action") != "delete")
    mirrored = after.select("bucket", "key", F.coalesce("remote_size", "local_size").alias("size"))
    visited = chosen_buckets(remote if existing is None else existing, buckets).select("bucket").distinct()
    outside = local.join(visited, "bucket", "left_anti").select("bucket", "key", "size")
    return mirrored.unionByName(outside)


def manifest(inventory: DataFrame) -> DataFrame:
    """``(bucket, dir, child)``: the direct children of every folder, each once; ``""`` is the top.

    One row per child, so that a folder of any size spreads over tasks. Sort by all three to write it.
    """
    parts = F.split("key", "/")
    levels = inventory.select("bucket", parts.alias("parts"), F.posexplode(parts).alias("depth", "child"))
    above = F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/")
    return levels.select("bucket", above.alias("dir"), "child").distinct()


def bucket_list(buckets: DataFrame, existing: DataFrame) -> DataFrame:
    """Names seen now together with those listed before."""
    return buckets.select("bucket").union(existing.select("bucket")).distinct()


def _extension(name: Column) -> Column:
    """Last extension with its dot; leading dots of a name start no extension."""
    return F.regexp_extract(name, r"[^./][^/]*?(\.[^./]*)\z", 1)


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in sorted(table.items()) for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def content_type(path: Column) -> Column:
    """Content type by extension, NULL when unknown.

    The table is the one of Python's standard library, without the machine's own additions.
    """
    known = mimetypes.MimeTypes(filenames=())
    types = known.types_map[True]
    # Short forms such as .tgz stand for two extensions, of which the inner one decides.
    inner = {short: _inner(long) for short, long in known.suffix_map.items()}
    last = _extension(path)
    packed = last.isin(*known.encodings_map)
    stem = F.when(packed, F.substr(path, F.lit(1), F.length(path) - F.length(last)))
    ending = F.coalesce(_lookup(inner, F.lower(last)), F.when(packed, _extension(stem)), last)
    return _lookup(types, F.lower(ending))


def _inner(extensions: str) -> str:
    """``.tar`` of ``.tar.gz``."""
    return extensions[: extensions.rindex(".")] if extensions.count(".") > 1 else extensions
