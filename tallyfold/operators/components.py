"""Components against bundles: keys used and defined, paths, orphans, seed names.

Inputs: ``corpus`` holds CORPUS rows; ``bundles`` are ``(dir, valid, n_keys)``, one row per
bundle folder, where ``valid`` is false for malformed JSON; ``keys`` are ``(dir, key)``, the source-language
keys of the bundles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import components as text
from tallyfold.functions.text import strip
from tallyfold.operators.reconcile import issues
from tallyfold.sources.files import is_component

# Fixed value: the bundle that belongs to no component.
GLOBAL_BUNDLE_DIR = "providers/TranslationProvider"


def scanned_components(corpus: DataFrame, attributes: tuple[str, ...] = text.TEXT_ATTRIBUTES) -> DataFrame:
    """``(path, dir, uses, keys, calls, aliases, found)``: every extraction in one pass over the texts.

    The checks read this several times; write it once (:func:`tallyfold.session.written`), as it is far
    smaller than the texts.
    """
    content = F.col("content")
    return corpus.where(is_component(F.col("path"))).select(
        "path",
        "dir",
        text.uses_translations(content).alias("uses"),
        text.used_keys(content).alias("keys"),
        F.transform(text.bundle_calls(content), text.forward_slashes).alias("calls"),
        text.aliases(content).alias("aliases"),
        text.hardcoded_text(content, attributes, with_context=False).alias("found"),
    )


def _using(scanned: DataFrame) -> DataFrame:
    return scanned.where("uses")


def _calls(scanned: DataFrame) -> DataFrame:
    return _using(scanned).select("path", "dir", F.explode("calls").alias("call"))


def resolved_bundles(scanned: DataFrame, bundles: DataFrame) -> DataFrame:
    """``(path, keys, bundle)`` per component that uses translations.

    ``bundle`` is the folder whose keys count: its own, or else that of the first call; NULL when
    neither can be read.
    """
    readable = bundles.where("valid").select("dir")
    own = readable.withColumn("own", F.col("dir"))
    shared = readable.select(F.col("dir").alias("first_call"), F.col("dir").alias("shared"))
    return (
        _using(scanned)
        .withColumn("first_call", F.get("calls", F.lit(0)))
        .join(own, "dir", "left")
        .join(shared, "first_call", "left")
        .select("path", "keys", F.coalesce("own", "shared").alias("bundle"))
    )


def path_mismatches(scanned: DataFrame, bundles: DataFrame) -> DataFrame:
    """Calls that name neither the component's own folder nor an existing bundle."""
    wrong = _calls(scanned).where(F.col("call") != F.col("dir"))
    wrong = wrong.join(bundles.select(F.col("dir").alias("call")), "call", "left_anti")
    return issues(
        wrong,
        "translation_path_mismatch",
        file=F.col("path"),
        text=F.col("call"),
        message=F.format_string("The bundle of %s is opened from %s, and there is no such bundle", "call", "dir"),
    )


def repeated_calls(scanned: DataFrame) -> DataFrame:
    """Bundles that one component opens more than once. The calls of a component sit in its row."""
    used = _using(scanned).select("path", "calls", F.explode(F.array_distinct("calls")).alias("call"))
    counted = used.select(
        "path", "call", F.size(F.filter("calls", lambda c: c == F.col("call"))).cast("long").alias("n")
    )
    return issues(
        counted.where(F.col("n") > 1),
        "duplicate_use_translation",
        file=F.col("path"),
        text=F.col("call"),
        count=F.col("n"),
        message=F.format_string("'%s' is opened %s times in the same component", F.col("call"), F.col("n").cast("string")),
    )


def alias_issues(scanned: DataFrame) -> DataFrame:
    return issues(
        _using(scanned).select("path", F.explode("aliases").alias("alias")),
        "aliased_translation_function",
        file=F.col("path"),
        text=F.col("alias"),
        message=F.format_string("The lookup function goes by the name %s here", "alias"),
    )


def missing_bundles(scanned: DataFrame, bundles: DataFrame) -> DataFrame:
    """Components that use translations while neither their folder nor any folder they name has a bundle."""
    wanted = _using(scanned).select("path", "dir", F.explode(F.array_union(F.array("dir"), F.col("calls"))).alias("at"))
    found = wanted.join(bundles.select(F.col("dir").alias("at")), "at", "left_semi").select("path").distinct()
    return issues(
        _using(scanned).join(found, "path", "left_anti"),
        "component_missing_translations",
        file=F.col("path"),
        message=F.format_string("Texts are looked up, yet %s has no bundle and no other one is opened", "dir"),
    )


def hardcoded_issues(scanned: DataFrame) -> DataFrame:
    """Text written into components that use translations, one issue per find."""
    found = _using(scanned).select("path", F.explode("found").alias("f")).select("path", "f.*")
    return issues(
        found,
        "component_hardcoded_text",
        file=F.col("path"),
        text=F.col("text"),
        line=F.col("line"),
        message=F.format_string("Line %s shows a fixed text: %s", F.col("line").cast("string"), F.col("text")),
    )


def untranslated_components(scanned: DataFrame) -> DataFrame:
    """Components with visible text that use no translations, with the number of finds."""
    n = F.size("found").cast("long")
    return issues(
        scanned.where(~F.col("uses") & (n > 0)),
        "component_needs_translations",
        file=F.col("path"),
        count=n,
        message=F.format_string("No text is looked up, %s are fixed", n.cast("string")),
    )


def missing_keys(scanned: DataFrame, bundles: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys a component uses that its bundle does not define."""
    used = resolved_bundles(scanned, bundles).where(F.col("bundle").isNotNull())
    used = used.select("path", F.col("bundle").alias("dir"), F.explode("keys").alias("key"))
    return issues(
        used.join(keys, ["dir", "key"], "left_anti"),
        "component_missing_key",
        file=F.col("path"),
        key=F.col("key"),
        message=F.format_string("The bundle has no text for %s", "key"),
    )


def keys_used_below(corpus: DataFrame) -> DataFrame:
    """``(dir, key)``: keys used by any ``.tsx`` file in a folder or below it, tests included.

    Every file is listed under each of its folders, so that containment becomes equality.
    """
    used = corpus.where(F.col("path").endswith(".tsx")).select(
        F.explode(text.ancestors(F.col("dir"))).alias("dir"), text.used_keys(F.col("content")).alias("keys")
    )
    return used.select("dir", F.explode("keys").alias("key")).distinct()


def unused_keys(scanned: DataFrame, bundles: DataFrame, keys: DataFrame, used_below: DataFrame) -> DataFrame:
    """``(dir, key, components)``: defined keys and how many components of the folder they are unused by.

    A component uses a key if it does so itself, or if a ``.tsx`` file at or below the folder does. Only for readable
    bundles whose folder holds a component that uses translations. Each such component is answerable for every key of its
    folder it does not use; as that may be all pairs of the two, they are counted here and spelled out by
    :func:`unused_key_issues`.
    """
    owners = _owners(scanned, bundles)
    by_dir = owners.groupBy("dir").agg(F.count(F.lit(1)).alias("owners"))
    users = owners.select("dir", F.explode(F.array_distinct("keys")).alias("key")).groupBy("dir", "key").agg(F.count(F.lit(1)).alias("users"))
    free = keys.join(used_below, ["dir", "key"], "left_anti").join(by_dir, "dir").join(users, ["dir", "key"], "left")
    left = F.col("owners") - F.coalesce("users", F.lit(0))
    return free.select("dir", "key", left.alias("components")).where("components > 0")


def _owners(scanned: DataFrame, bundles: DataFrame) -> DataFrame:
    """Components that use translations and have a readable bundle in their own folder."""
    return _using(scanned).join(bundles.where("valid").select("dir"), "dir", "left_semi").select("path", "dir", "keys")


def unused_key_issues(scanned: DataFrame, bundles: DataFrame, keys: DataFrame, used_below: DataFrame) -> DataFrame:
    """One issue per component and unused key of its folder, minus the keys the component uses itself.

    For trees in which a folder holds few components; otherwise read :func:`unused_keys`.
    """
    owners = _owners(scanned, bundles)
    free = unused_keys(scanned, bundles, keys, used_below).select("dir", "key")
    pairs = owners.join(free, "dir").where(~F.array_contains("keys", F.col("key")))
    return issues(
        pairs,
        "component_unused_key",
        file=F.col("path"),
        key=F.col("key"),
        message=F.format_string("Nothing at or below the folder looks up %s", "key"),
    )


def component_issues(scanned: DataFrame, bundles: DataFrame) -> DataFrame:
    """The checks of single components apart from keys, as ISSUE rows."""
    return (
        path_mismatches(scanned, bundles)
        .unionByName(repeated_calls(scanned))
        .unionByName(alias_issues(scanned))
        .unionByName(missing_bundles(scanned, bundles))
        .unionByName(hardcoded_issues(scanned))
        .unionByName(untranslated_components(scanned))
    )


def _name_priority(path: Column, folder: Column) -> Column:
    """Which file of a folder stands for its bundle; NULL for files that cannot."""
    name, own = text.file_name_of(path), F.substring_index(folder, "/", -1)
    ordinary = ~F.lower(name).contains("test") & ~F.lower(name).contains("spec")
    return (
        F.when(name == F.concat(own, F.lit(".tsx")), 1)
        .when(name == F.concat(own, F.lit(".ts")), 2)
        .when(name == "index.tsx", 3)
        .when(name == "index.ts", 4)
        .when(name.endswith(".tsx") & ordinary, 5)
        .when(name.endswith(".ts") & ordinary, 6)
    )


def orphan_bundles(
    scanned: DataFrame, bundles: DataFrame, files: DataFrame, global_dir: str = GLOBAL_BUNDLE_DIR
) -> DataFrame:
    """``(dir, n_keys, component)``: bundles with source keys that no component opens.

    ``files`` are ``(path, dir)`` of all files; ``component`` is the one that stands for the folder.
    """
    in_use = _using(scanned).select(F.explode(F.array_union(F.array("dir"), F.col("calls"))).alias("dir")).distinct()
    orphans = bundles.where(F.col("valid") & (F.col("n_keys") > 0) & ~F.col("dir").endswith(global_dir))
    orphans = orphans.join(in_use, "dir", "left_anti").select("dir", "n_keys")
    priority = _name_priority(F.col("path"), F.col("dir"))
    stands = (
        files.select("dir", "path", priority.alias("priority"))
        .where(F.col("priority").isNotNull())
        .groupBy("dir")
        .agg(F.min_by("path", F.struct("priority", "path")).alias("component"))
    )
    return orphans.join(stands, "dir", "left").select("dir", "n_keys", "component")


def seed_name_issues(seeds: dict[str, DataFrame | None], actual: DataFrame | None, name_column: str = "name") -> DataFrame:
    """The global bundle against the names in seed tables.

    ``seeds`` maps a table to its rows, None where its file is absent; ``actual`` are the keys (key) of
    the global bundle, None where it is absent or malformed.
    """
    present = {name: df for name, df in seeds.items() if df is not None}
    spark = next(df for df in [actual, *present.values()] if df is not None).sparkSession
    result = issues(
        spark.createDataFrame([(n,) for n, df in seeds.items() if df is None], "seed string"),
        "global_translations_seed_not_found",
        file=F.col("seed"),
        message=F.format_string("There is no table %s to take names from", "seed"),
    )
    if actual is None:
        lost = issues(spark.range(1), "global_translations_missing", message=F.lit("There is no global bundle"))
        return result.unionByName(lost)
    names = spark.createDataFrame([], "key string")
    for df in present.values():
        names = names.unionByName(df.select(strip(F.col(name_column)).alias("key")))
    expected = names.where(F.col("key") != "").distinct()
    actual = actual.select("key").distinct()
    lacking = issues(
        expected.join(actual, "key", "left_anti"),
        "global_translations_missing_key",
        key=F.col("key"),
        message=F.format_string("The global bundle has no text for the name %s", "key"),
    )
    extra = issues(
        actual.join(expected, "key", "left_anti"),
        "global_translations_extra_key",
        key=F.col("key"),
        message=F.format_string("No table has the name %s of the global bundle", "key"),
    )
    return result.unionByName(lacking).unionByName(extra)
