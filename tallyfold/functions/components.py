"""What can be read off the text of a user-interface component."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfold.functions.text import SPACE, WORD, captures, is_upper, matches_with_lines, starts_upper, strip

# Call patterns and the attributes that carry visible text.
KEY_CALL = rf"(?<!{WORD})t(?:[A-Z]{WORD}*)?\(['\"]([^'\"]+)['\"]\)"
BUNDLE_CALL = rf"(?<!{WORD})useTranslation\(['\"]([^'\"]+)['\"]\)"
ALIAS = rf"\{{{SPACE}*t{SPACE}*:{SPACE}*(t[A-Z]{WORD}*){SPACE}*\}}"
TEXT_ATTRIBUTES = ("placeholder", "title", "label", "aria-label")

_ELEMENT = r">([^<]++)</"
_LINK = r"<(button|a)[^>]*>([^<]++)</(button|a)>"


def used_keys(content: Column) -> Column:
    """Distinct keys the component asks for."""
    return F.array_distinct(captures(content, KEY_CALL))


def bundle_calls(content: Column) -> Column:
    """Bundle paths the component opens, in order, repeats kept."""
    return captures(content, BUNDLE_CALL)


def aliases(content: Column) -> Column:
    """Other names given to the lookup function, repeats kept."""
    return captures(content, ALIAS)


def uses_translations(content: Column) -> Column:
    return content.contains("useTranslation") | content.rlike(KEY_CALL)


def _findings(content: Column, pattern: str, kind, text, keep, with_context: bool) -> Column:
    def finding(m: Column) -> Column:
        context = [strip(m["context"]).alias("context")] if with_context else []
        return F.struct(
            kind(m["match"]).alias("kind"), strip(text(m["match"])).alias("text"), m["line"].alias("line"), *context
        )

    found = F.transform(matches_with_lines(content, pattern, with_context), finding)
    return F.filter(found, lambda f: keep(f["text"]))


def _plain(text: Column) -> Column:
    """No placeholder braces, and no constant in capitals."""
    return ~text.contains("{") & ~text.contains("}") & ~(is_upper(text) & (F.length(text) > 5))


def _sentence(text: Column) -> Column:
    return starts_upper(text) & (F.length(text) >= 3) & _plain(text)


def _attribute_value(text: Column) -> Column:
    return _plain(text) & ~text.startswith("$") & ~text.startswith("@") & ~text.contains("()")


def hardcoded_text(
    content: Column, attributes: tuple[str, ...] = TEXT_ATTRIBUTES, with_context: bool = True
) -> Column:
    """Visible text that is written into the component, as ``array<struct<kind, text, line[, context]>>``.

    Element text, text attributes and link or button text are looked for one after the other; text
    found twice is reported twice.
    """
    attribute = rf"({'|'.join(attributes)})=[\"']([^\"']{{3,}}+)[\"']"
    return F.concat(
        _findings(
            content,
            _ELEMENT,
            lambda m: F.lit("jsx_text_node"),
            lambda m: F.regexp_extract(m, _ELEMENT, 1),
            _sentence,
            with_context,
        ),
        _findings(
            content,
            attribute,
            lambda m: F.concat(F.lit("attribute_"), F.regexp_extract(m, attribute, 1)),
            lambda m: F.regexp_extract(m, attribute, 2),
            _attribute_value,
            with_context,
        ),
        _findings(
            content,
            _LINK,
            lambda m: F.concat(F.regexp_extract(m, _LINK, 1), F.lit("_text")),
            lambda m: F.regexp_extract(m, _LINK, 2),
            _sentence,
            with_context,
        ),
    )


def folder_of(path: Column) -> Column:
    """Folder part of a relative path; ``.`` for a file at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit("."))


def file_name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def ancestors(folder: Column) -> Column:
    """The folder and every folder above it, up to the top folder ``.``."""
    parts = F.split(folder, "/")
    above = F.transform(parts, lambda part, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))
    return F.array_union(F.array(F.lit(".")), above)
