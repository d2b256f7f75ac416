"""Localised bundles in long form ``(file, lang, key, value)``: checks, gaps, merge, removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.reconcile import issue
from tallyfold.schemas import ISSUE
from tallyfold.sources.bundles import kind_of, members_of

# The languages a bundle holds, in their order; the first is the source language.
LANGUAGES = (
    "en", "es", "fr", "de", "it", "pt", "ru", "ja", "zh", "ko", "ar", "hi",
    "nl", "sv", "no", "da", "fi", "pl", "tr", "el", "ga", "he", "eo", "vi",
)
# Languages that the translation memory knows by another code.
MEMORY_CODES = {"zh": "zh-CN", "he": "iw", "no": "no"}


def _listed(languages: Sequence[str]) -> Column:
    return F.array(*[F.lit(lang) for lang in languages])


def key_parity(entries: DataFrame, present: DataFrame, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """``(file, language, key, type, reference)`` where the keys of a language differ from the reference.

    The reference of a file is the first of ``languages`` that it holds in ``present`` (file, lang);
    type is missing_key or extra_key. Per file and per key only the set of languages is kept, which is
    no longer than the list, so both groupings shrink before they are shuffled.
    """
    order = _listed(languages)
    known = F.col("lang").isin(*languages)
    per_key = entries.where(known).groupBy("file", "key").agg(F.collect_set("lang").alias("has"))
    per_file = present.where(known).groupBy("file").agg(F.collect_set("lang").alias("langs"))
    per_file = per_file.withColumn("langs", F.filter(order, lambda lang: F.array_contains("langs", lang)))
    joined = per_key.join(per_file, "file").withColumn("reference", F.get("langs", F.lit(0)))
    in_reference = F.array_contains("has", F.col("reference"))
    differing = F.when(in_reference, F.array_except("langs", "has")).otherwise(F.col("has"))
    return joined.select(
        "file",
        F.explode(differing).alias("language"),
        "key",
        F.when(in_reference, "missing_key").otherwise("extra_key").alias("type"),
        "reference",
    )


def bundle_issues(parsed: DataFrame, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """All issues of bundle files as ISSUE rows, from the rows of ``parse_bundles``.

    A file is one row, so every check, the comparison of keys included, is made within the row: one pass,
    no shuffle. Only the listed languages are checked; a file with an empty object is fine. Keys are
    compared with those of the first listed language that is an object.
    """
    file, members = F.col("file"), F.col("members")
    langs = F.transform(
        _listed(languages),
        lambda lang: F.struct(
            lang.alias("lang"),
            F.coalesce(kind_of(F.try_element_at(members, lang)), F.lit("VOID")).alias("kind"),
            members_of(F.try_element_at(members, lang)).alias("members"),
        ),
    )
    read = parsed.select("file", "kind", members.alias("members"), langs.alias("langs"))
    read = read.withColumn("valid", F.filter("langs", lambda x: x["kind"] == "OBJECT"))
    read = read.withColumn("reference", F.get("valid", F.lit(0)))
    valid, reference = F.col("valid"), F.col("reference")
    none = F.array().cast(f"array<struct<{', '.join(f'`{n}`: {t}' for n, t in ISSUE.items())}>>")

    def of_file(condition: Column, type_: str, message: Column) -> Column:
        return F.when(condition, F.array(issue(type_, file=file, message=message))).otherwise(none)

    def of_language(condition, type_: str, text: str) -> Column:
        return F.transform(
            F.filter("langs", condition),
            lambda x: issue(type_, file=file, language=x["lang"], message=F.format_string(text, x["lang"])),
        )

    def of_keys(keys, type_: str, text: str) -> Column:
        def one(lang: Column, key: Column) -> Column:
            message = F.format_string(text, lang, key, reference["lang"])
            return issue(type_, file=file, language=lang, key=key, message=message)

        return F.flatten(F.transform(valid, lambda x: F.transform(keys(x["members"]), lambda key: one(x["lang"], key))))

    def bad_values(entries: Column) -> Column:
        text = F.map_filter(entries, lambda key, v: (kind_of(v) != "STRING") | (F.try_variant_get(v, "$", "string") == ""))
        return F.map_keys(text)

    known = F.map_keys(reference["members"])
    found = [
        of_file(F.col("kind").isNull(), "json_parse_error", F.format_string("%s cannot be read as JSON", file)),
        of_file(F.col("kind") != "OBJECT", "invalid_format", F.lit("The top level must be an object")),
        F.when(F.size("members") > 0, of_language(lambda x: x["kind"] == "VOID", "missing_language", "No entries for language '%s'")).otherwise(none),
        of_language(lambda x: ~x["kind"].isin("OBJECT", "VOID"), "invalid_format", "The entry for language '%s' must be an object"),
        of_keys(lambda m: F.filter(F.map_keys(m), lambda key: key == ""), "invalid_key", "An empty key stands in '%s'"),
        of_keys(bad_values, "invalid_value", "'%s' has no text for key '%s'"),
        of_keys(lambda m: F.array_except(known, F.map_keys(m)), "missing_key", "'%s' lacks key '%s', which '%s' defines"),
        of_keys(lambda m: F.array_except(F.map_keys(m), known), "extra_key", "'%s' defines key '%s', which '%s' lacks"),
    ]
    return read.select(F.inline(F.concat(*found)))


def gap_plan(
    entries: DataFrame,
    source: str = LANGUAGES[0],
    targets: Sequence[str] = LANGUAGES[1:],
    force: bool = False,
) -> DataFrame:
    """``(file, lang, key, action, source_value)``: keys to add to or to remove from target languages.

    Compared with the source language of the file; a language that is absent or empty lacks every key,
    and with ``force`` all keys count as lacking. Files without source keys are left alone. As in
    :func:`key_parity` only bounded language sets are grouped.
    """
    goal = _listed(targets)
    per_key = (
        entries.where(F.col("lang").isin(source, *targets))
        .groupBy("file", "key")
        .agg(
            F.collect_set("lang").alias("has"),
            F.max(F.when(F.col("lang") == source, F.col("value"))).alias("source_value"),
        )
    )
    files = entries.where(F.col("lang") == source).select("file").distinct()
    planned = per_key.join(files, "file", "left_semi")
    in_source = F.array_contains("has", F.lit(source))
    add = goal if force else F.array_except(goal, F.col("has"))
    return planned.select(
        "file",
        F.explode(F.when(in_source, add).otherwise(F.array_intersect(goal, F.col("has")))).alias("lang"),
        "key",
        F.when(in_source, "add").otherwise("remove").alias("action"),
        "source_value",
    )


def incomplete_files(plan: DataFrame) -> DataFrame:
    """``(file, languages, added, removed)`` of files with anything to do."""
    return plan.groupBy("file").agg(
        F.count_distinct("lang").alias("languages"),
        F.count_if(F.col("action") == "add").alias("added"),
        F.count_if(F.col("action") == "remove").alias("removed"),
    )


def generation_summary(entries: DataFrame, file: str | None = None, every: bool = False, force: bool = False, **plan) -> DataFrame:
    """One row ``(status, message, folders_processed, files_generated)`` of a run over one file or over all.

    ``files_generated`` counts languages with a gap over all files. Exactly one of ``file`` and ``every``
    must be given; otherwise the status is error. ``plan`` goes to :func:`gap_plan`.
    """
    if bool(file) == every:
        text = "Name a file or ask for all, not both" if every else "Name a file or ask for all"
        row = [("error", text, 0, 0)]
        return entries.sparkSession.createDataFrame(row, "status string, message string, folders_processed long, files_generated long")
    chosen = entries if every else entries.where(F.col("file") == file)
    files = incomplete_files(gap_plan(chosen, force=force, **plan))
    folders = F.count(F.lit(1)) if every else F.lit(1).cast("long")
    totals = files.agg(folders.alias("folders_processed"), F.coalesce(F.sum("languages"), F.lit(0)).alias("files_generated"))
    n, m = F.col("files_generated").cast("string"), F.col("folders_processed").cast("string")
    message = F.format_string("%s languages had gaps in a run over %s files", n, m)
    return totals.select(F.lit("success").alias("status"), message.alias("message"), "folders_processed", "files_generated")


def memory_code(lang: Column, codes: dict[str, str] = MEMORY_CODES) -> Column:
    """The code of a language in the translation memory."""
    pairs = [F.lit(x) for item in codes.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), lang), lang) if pairs else lang


def gap_fill(entries: DataFrame, plan: DataFrame, memory: DataFrame, codes: dict[str, str] = MEMORY_CODES) -> DataFrame:
    """Bundles after the plan: ``(file, lang, key, value, origin)``.

    Values to add come from ``memory`` (lang, source_text, target_text); of several for one text the greatest is taken.
    Origin is kept, filled, or pending where the memory has no translation yet (value NULL). Keys to
    remove are gone; languages outside the plan stay as they are.
    """
    place = ["file", "lang", "key"]
    kept = entries.select(*place, "value").join(plan.select(*place), place, "left_anti")
    wanted = plan.where(F.col("action") == "add").withColumn("code", memory_code(F.col("lang"), codes))
    known = memory.groupBy(F.col("lang").alias("code"), F.col("source_text").alias("source_value")).agg(F.max("target_text").alias("target_text"))
    added = wanted.join(known, ["code", "source_value"], "left").select(
        *place,
        F.col("target_text").alias("value"),
        F.when(F.col("target_text").isNull(), "pending").otherwise("filled").alias("origin"),
    )
    return kept.withColumn("origin", F.lit("kept")).unionByName(added)


def without_keys(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bundles without the given keys, in every language."""
    return entries.where(~F.col("key").isin(*keys))


def removal_counts(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(file, removed, remaining)`` of files that lose a key; the others need no writing."""
    gone = F.col("key").isin(*keys)
    return (
        entries.groupBy("file")
        .agg(F.count_if(gone).alias("removed"), F.count_if(~gone).alias("remaining"))
        .where(F.col("removed") > 0)
    )


def _json_string(text: Column) -> Column:
    """Text as a JSON string, other scripts kept as they are."""
    array = F.to_json(F.array(text))
    return F.substr(array, F.lit(2), F.length(array) - 2)


def bundle_lines(entries: DataFrame) -> DataFrame:
    """The JSON text of each bundle, one line per row: ``(file, lang, part, key, text)``.

    Languages and keys are sorted and indented by two blanks each. Entries without a value (pending ones) are left out. Sorting by ``file, lang, part, key``
    puts the lines in order (parts -1 and 0 open, 1 holds entries, 2 and 3 close). The last entry of a group drops
    its comma, so only the greatest key of each group is looked up, and no bundle is ever gathered in
    one row.
    """
    entries = entries.where("value IS NOT NULL")
    last_key = entries.groupBy("file", "lang").agg(F.max("key").alias("last_key"))
    last_lang = last_key.groupBy("file").agg(F.max("lang").alias("last_lang"))
    comma = lambda last: F.when(last, "").otherwise(",")
    line = F.concat(
        F.lit("    "),
        _json_string(F.col("key")),
        F.lit(": "),
        _json_string(F.col("value")),
        comma(F.col("key") == F.col("last_key")),
    )
    body = entries.join(last_key, ["file", "lang"]).select("file", "lang", F.lit(1).alias("part"), "key", line.alias("text"))
    frames = last_key.join(last_lang, "file")
    opening = frames.select("file", "lang", F.lit(0).alias("part"), F.concat(F.lit("  "), _json_string(F.col("lang")), F.lit(": {")).alias("text"))
    closing = frames.select(
        "file", "lang", F.lit(2).alias("part"), F.concat(F.lit("  }"), comma(F.col("lang") == F.col("last_lang"))).alias("text")
    )
    # The greatest code point keeps the end of the file behind all languages.
    first = last_lang.select("file", F.lit("").alias("lang"), F.lit(-1).alias("part"), F.lit("{").alias("text"))
    final = last_lang.select("file", F.lit("\U0010ffff").alias("lang"), F.lit(3).alias("part"), F.lit("}").alias("text"))
    edges = opening.unionByName(closing).unionByName(first).unionByName(final)
    return body.unionByName(edges.withColumn("key", F.lit("")))
